"""Writers: episodes, summaries, packed sessions, results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import WIDTH, numbered, running, safe_join

TUM_HEADER = "# timestamp tx ty tz qx qy qz qw"


def tum_lines(poses: DataFrame, by: Sequence[str], order: Sequence[str], *, width: float = WIDTH) -> DataFrame:
    """Lines of pose files (6 decimals of time, 8 of the rest), numbered from 0, with the image name of each."""
    cols = ("t", "tx", "ty", "tz", "qx", "qy", "qz", "qw")
    line = F.format_string("%.6f " + " ".join(["%.8f"] * 7), *[F.col(c) for c in cols])
    rows = numbered(poses, by, order, "line", width=width)
    return rows.select(*by, "line", line.alias("text"), F.format_string("%06d.jpg", "line").alias("image"))


def write_episodes(lines: DataFrame, path: str, by: str) -> None:
    """A text file of poses for each episode: header, then the lines in order."""
    header = lines.select(by).distinct().select(by, F.lit(-1).cast("bigint").alias("line"), F.lit(TUM_HEADER).alias("text"))
    rows = header.unionByName(lines.select(by, "line", "text"))
    rows.repartition(by).sortWithinPartitions(by, "line").select("text", by).write.partitionBy(by).mode("overwrite").text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """Tab-separated: episode, frames, roll_std (.3f), mean_roll (.3f), y_spread_std (.4f)."""
    rows = summary.select("episode", F.col("frames").cast("string"), F.format_string("%.3f", "roll_std"), F.format_string("%.3f", "mean_roll"), F.format_string("%.4f", "y_spread_std"))
    rows.orderBy("episode").coalesce(1).write.mode("overwrite").option("sep", "\t").csv(path)


def packed_index(index: DataFrame, by: Sequence[str], order: Sequence[str], *, length: str = "length", limit: int | None = None, width: float = WIDTH) -> DataFrame:
    """An index whose offsets are those of the kept rasters laid end to end."""
    rows = index
    if limit is not None:
        rows = numbered(rows, by, order, "__i", width=width).where(F.col("__i") < limit).drop("__i")
    return running(rows, by, order, {"new_offset": F.col(length)}, inclusive=False, width=width)


def packed_poses(poses: DataFrame, kept: DataFrame, by: Sequence[str], *, frame: str = "frame") -> DataFrame:
    """Poses up to the last kept frame of each session; without any, up to frame 0."""
    most = kept.groupBy(*by).agg(F.max(F.coalesce(frame, F.lit(0))).alias("__most"))
    return safe_join(poses, most, by, "left").where(F.col(frame) <= F.coalesce("__most", F.lit(0))).drop("__most")


def write_trajectory(rows: DataFrame, path: str, by: str = "session_id") -> None:
    """Trajectories as Parquet, a folder for each session, rows in the order of frames."""
    rows.repartition(by).sortWithinPartitions(by, "frame").write.partitionBy(by).mode("overwrite").parquet(path)


def write_fused(fused: DataFrame, scores: DataFrame, path: str, by: str = "session_id") -> None:
    """A fused trajectory as Parquet, and the report of its scores as lines of JSON."""
    write_trajectory(fused, f"{path}/trajectory", by)
    scores.write.mode("overwrite").json(f"{path}/report")


def results(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sorted by arm and the given order of sessions, others last."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("session"))
    return rows.orderBy("arm", F.when(place > 0, place).otherwise(99), "session")


def top_rows(df: DataFrame, by: Sequence[str], order, n: int) -> DataFrame:
    """First ``n`` rows of each session in an order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= n).drop("__k")
