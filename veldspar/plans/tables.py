"""Views of the driver's tables in the shape of session streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"unix_date(cast({ts} as date)) * 86400000000L + (hour({ts}) * 3600 + minute({ts}) * 60) * 1000000L + cast(extract(second from {ts}) * 1000000 as bigint)")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id (session), t (microseconds), event_id (file order), kind, cents, k."""
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        micros("ts").alias("t"),
        F.col("event_type").alias("kind"),
        F.floor(F.col("value") * 100 + 0.5).alias("cents"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


#: The same view in SQL.
EVENTS = "ev AS (SELECT user_id, event_id, epoch_us(ts)::BIGINT AS t, event_type AS kind, floor(value * 100 + 0.5)::BIGINT AS cents, (props ->> '$.k')::BIGINT AS k FROM events)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label (session), vec_id (order), estimate x y z, reference rx ry rz, further a b c."""
    e = F.col("embedding")
    names = ("x", "y", "z", "rx", "ry", "rz", "a", "b", "c")
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", *[e[i].cast("double").alias(n) for i, n in enumerate(names)])


POINTS = "pt AS (SELECT label, vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {n}" for i, n in enumerate(("x", "y", "z", "rx", "ry", "rz", "a", "b", "c"))) + " FROM embeddings)"


def quantised(x: Column | str, scale: float = 1e6) -> Column:
    """Whole millionths, the same in any engine."""
    c = F.col(x) if isinstance(x, str) else x
    return F.floor(c * scale + 0.5).cast("bigint")


def q(x: str, scale: str = "1e6") -> str:
    return f"floor(({x}) * {scale} + 0.5)::BIGINT"


DAY = 86_400_000_000
