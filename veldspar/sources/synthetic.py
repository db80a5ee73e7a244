"""A generated session with known answers, as tables, for tests and trials.

20 s at rest-frame rates: poses at 60 Hz, depth and stills at 5 Hz, motion at
100 Hz, fixes and headings at 1 Hz, planes with additions, updates and removals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T0, SECONDS = 12345.0, 20
ID = "20260101-000000-abcdef"


def build(spark: SparkSession, *, portrait: bool = False, upside_down: bool = False, hunting: bool = False, interruption: bool = False) -> dict[str, DataFrame]:
    """Tables by stream name, each with session_id and ordinal."""

    def rows(n: int, hz: float) -> DataFrame:
        return spark.range(n).select(F.lit(ID).alias("session_id"), F.col("id").alias("ordinal"), (T0 + F.col("id") / hz).alias("t"))

    down = 0.0 if portrait else 0.9 if upside_down else -0.9
    pose = rows(60 * SECONDS, 60).withColumn("frame", F.col("ordinal"))
    still = F.floor(F.col("frame") / 12)
    pose = pose.select(
        "*",
        (F.col("ordinal") * 0.01).alias("tx"), F.lit(1.15).alias("ty"), F.lit(0.0).alias("tz"),
        F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"), F.lit(1.0).alias("qw"),
        (F.lit(1500.0) - 30 * F.least(still, F.lit(7)) if hunting else F.lit(1500.0)).cast("double").alias("fx"), F.lit(1500.0).alias("fy"),
        F.lit(960.0).alias("cx"), F.lit(720.0).alias("cy"),
        F.when(F.col("ordinal") <= 40, "limited:initializing").otherwise("normal").alias("tracking"),
        F.lit(0.9 if portrait else 0.0).alias("gravX"), F.lit(down).alias("gravY"), F.lit(-0.42261826174).alias("gravZ"),
    )
    at_5hz = rows(5 * SECONDS, 5).withColumn("frame", F.col("ordinal") * 12)
    depth = at_5hz.select("*", (F.col("ordinal") * 98304).alias("offset"), F.lit(98304).cast("bigint").alias("length"), F.lit(256).alias("width"), F.lit(192).alias("height"), F.lit(None).cast("double").alias("cond"))
    frames = at_5hz.select("*", F.format_string("frames/%06d.jpg", "ordinal").alias("file"), F.lit(1920).alias("width"), F.lit(1440).alias("height"), F.lit(250_000).cast("bigint").alias("bytes"))
    plane = [(0.5, "floor", "added", "floor", 0.0), (0.6, "wall1", "added", "wall", 1.0), (0.7, "wall2", "added", "wall", 1.0), (0.8, "table", "added", "table", 0.7), (0.9, "ghost", "added", "none", 0.2), (1.5, "floor", "updated", "floor", 0.0), (2.0, "ghost", "removed", "none", 0.2)]
    planes = spark.createDataFrame([(ID, i, T0 + t, n, e, c, y) for i, (t, n, e, c, y) in enumerate(plane)], "session_id string, ordinal bigint, t double, id string, event string, classification string, ty double")
    event = [(0.0, "app.recording", ""), (0.1, "ar.started", ""), (0.7, "ar.normal", ""), (5.0, "battery", "0.9"), (12.0, "thermal.fair", ""), (20.0, "app.stopped", "")]
    if interruption:
        event += [(10.0, "ar.interrupted", ""), (10.5, "ar.resumed", "")]
    events = spark.createDataFrame([(ID, i, T0 + t, k, d) for i, (t, k, d) in enumerate(sorted(event))], "session_id string, ordinal bigint, t double, kind string, detail string")
    location = rows(SECONDS, 1).select("*", F.lit(35.0).alias("hAcc"), F.lit(-1.0).alias("speed"), F.lit(-1.0).alias("course"))
    heading = rows(SECONDS, 1).select("*", F.lit(-1.0).alias("trueHeading"))
    motion = rows(100 * SECONDS, 100).select("*", F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(0.0).alias("az"), *[F.lit(v).alias(q) for q, v in zip(("qx", "qy", "qz", "qw"), (0.0, 0.0, 0.0, 1.0), strict=True)])
    return {"pose": pose, "depth": depth, "frames": frames, "planes": planes, "events": events, "location": location, "heading": heading, "motion": motion}
