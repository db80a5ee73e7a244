"""Triage and summary statistics of sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import BLOCK, DEALT, OWN, WIDTH, blocks, cut, previous, safe_join
from .ranks import exact_percentiles


def count_reconcile(actual: DataFrame, declared: DataFrame, by: Sequence[str], *, stream: str = "stream") -> DataFrame:
    """Declared against counted rows where a stream has both, and whether they agree."""
    found = actual.groupBy(*by, stream).agg(F.count("*").alias("actual"))
    return safe_join(found, declared.select(*by, stream, "declared"), [*by, stream]).withColumn("agrees", F.col("actual") == F.col("declared"))


def dominant(df: DataFrame, by: Sequence[str], *, bucket: str, order: Sequence[str]) -> DataFrame:
    """Most frequent bucket (of equals the one met first), its count, and whether others occur."""
    counts = df.where(F.col(bucket).isNotNull()).groupBy(*by, bucket).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("__first"))
    best = F.max_by(F.struct(bucket, "n"), F.struct("n", _descending("__first", counts)))
    out = counts.groupBy(*by).agg(best.alias("__b"), (F.count("*") > 1).alias("mixed"))
    return out.select(*by, "__b.*", "mixed")


def _descending(column: str, df: DataFrame) -> Column:
    """An expression that falls as the (numeric) parts of a struct rise."""
    return F.struct(*[(-F.col(f"{column}.{f.name}")).alias(f.name) for f in df.schema[column].dataType])


def circular_mean(degrees: Column) -> Column:
    r = F.radians(degrees)
    return F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r))))


def spread(df: DataFrame, by: Sequence[str], value: str, *, warn: float | None = None, clamped: str | None = None) -> DataFrame:
    """mean, least, most and spread of a measure per session; ``warn`` marks a wide spread, ``clamped`` (a boolean column) counts its rows."""
    aggs = [F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), (F.max(value) - F.min(value)).alias("spread")]
    out = df.groupBy(*by).agg(*aggs, *([] if clamped is None else [F.count_if(F.col(clamped)).alias("clamped")]))
    return out if warn is None else out.withColumn("warns", F.col("spread") > warn)


def percentiles(df: DataFrame, by: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, and the number of values; no group is gathered (``ranks``)."""
    return exact_percentiles(df, by, value, at)


def mad_variation(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """1.4826 times the median distance from the median."""
    rows = cut(df.select(*by, value))
    mid = exact_percentiles(rows, by, value, {"median": 0.5}).drop("n")
    away = safe_join(rows, mid, by).withColumn("__away", F.abs(F.col(value) - F.col("median")))
    out = exact_percentiles(away, by, "__away", {"__mid": 0.5})
    return safe_join(mid, out, by).select(*by, "median", (1.4826 * F.col("__mid")).alias("variation"))


def bands(df: DataFrame, by: Sequence[str], *, cond: str, error: str, edges: Sequence[float] = (0.01, 0.05)) -> DataFrame:
    """Count, median and 90th percentile of errors by bands of conditioning."""
    band = F.when(F.col(cond) < edges[0], 0).when(F.col(cond) < edges[1], 1).otherwise(2)
    rows = cut(df.where(F.col(cond).isNotNull()).select(*by, band.alias("band"), error))
    counts = rows.groupBy(*by, "band").agg(F.count("*").alias("n"))
    return safe_join(counts, exact_percentiles(rows, [*by, "band"], error, {"median": 0.5, "p90": 0.9}).drop("n"), [*by, "band"])


def cut_ratios(df: DataFrame, by: Sequence[str], *, score: str, error: str, cuts: Sequence[float] = (0.98, 0.95, 0.92)) -> DataFrame:
    """Median error under each cut over that at or above it."""
    side = lambda c: F.struct(F.lit(float(c)).alias("cut"), (F.col(score) < c).alias("__low"))
    rows = df.withColumn("__c", F.explode(F.array(*[side(c) for c in cuts]))).select(*by, "__c.*", error)
    mids = exact_percentiles(rows, [*by, "cut", "__low"], error, {"__mid": 0.5})
    under, over = F.max(F.when(F.col("__low"), F.col("__mid"))), F.max(F.when(~F.col("__low"), F.col("__mid")))
    return mids.groupBy(*by, "cut").agg(under.alias("under"), over.alias("over"), F.try_divide(under, over).alias("ratio"))


def path(df: DataFrame, by: Sequence[str], order: Sequence[str], axes: Sequence[str] = ("tx", "ty", "tz"), *, width: float = WIDTH) -> DataFrame:
    """Length of a track, distance of its ends, and its time span."""
    t = order[0]
    rows = previous(df, by, order, {f"__p{a}": a for a in axes}, width=width)
    step = F.sqrt(sum((F.pow(F.col(a) - F.col(f"__p{a}"), 2) for a in axes[1:]), F.pow(F.col(axes[0]) - F.col(f"__p{axes[0]}"), 2)))
    place = F.struct(*order)
    ends = [(F.max_by(a, place) - F.min_by(a, place)) for a in axes]
    gap = F.sqrt(sum((e * e for e in ends[1:]), ends[0] * ends[0]))
    return rows.groupBy(*by).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("length"), gap.alias("gap"), (F.max(t) - F.min(t)).alias("span"), F.count("*").alias("rows"))


def loop_gap(df: DataFrame, by: Sequence[str], order: Sequence[str], *, x: str, z: str) -> DataFrame:
    """Distance of first and last position on the floor."""
    place = F.struct(*order)
    d = [F.max_by(a, place) - F.min_by(a, place) for a in (x, z)]
    return df.groupBy(*by).agg(F.hypot(*d).alias("gap"))


def rate(df: DataFrame, by: Sequence[str], *, t: str = "t") -> DataFrame:
    """(rows - 1) / span; null for no span."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.try_divide(F.count("*") - 1, F.max(t) - F.min(t)).alias("hz"))


def largest_gap(df: DataFrame, by: Sequence[str], *, t: str = "t", order: Sequence[str] = (), width: float = WIDTH) -> DataFrame:
    """Rows, their rate, the largest time between two in a row, and ``warns`` where it is over 4 rows' time (from 3 rows on)."""
    rows = previous(df.where(F.col(t).isNotNull()), by, [t, *order], {"__was": t}, width=width)
    out = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.try_divide(F.count("*") - 1, F.max(t) - F.min(t)).alias("hz"), F.max(F.col(t) - F.col("__was")).alias("gap"))
    return out.withColumn("warns", F.coalesce((F.col("rows") > 2) & (F.col("hz") > 0) & (F.col("gap") * F.col("hz") > 4), F.lit(False)))


def sampled_fraction(index: DataFrame, by: Sequence[str], order: Sequence[str], *, hits: str, total: str, probes: int = 8) -> DataFrame:
    """Fraction over every (n // probes)-th row, the first ``probes`` of them."""
    from .ordered import numbered

    rows = numbered(index, by, order, "__i")
    n = rows.groupBy(*by).agg(F.greatest(F.lit(1), F.floor(F.count("*") / probes)).cast("bigint").alias("__step"))
    rows = safe_join(rows, n, by).where((F.col("__i") % F.col("__step") == 0) & (F.col("__i") < F.col("__step") * probes))
    return rows.groupBy(*by).agg(F.try_divide(F.sum(hits), F.sum(total)).alias("fraction"), F.count("*").alias("probes"))


def verdict(usable: Column, depth_hz: Column, travelled: Column, complete: Column, agrees: Column, thermal: Column) -> Column:
    """The first fault of a session, or ok."""
    return (
        F.when(usable < 0.5, "too dark")
        .when(depth_hz < 12, "depth too slow")
        .when(travelled < 3, "barely moved")
        .when(~complete & ~agrees, "truncated")
        .when(thermal, "thermal pause")
        .otherwise("ok")
    )


def odometry_verdict(median_error: Column, median_motion: Column, speed: Column, inliers: Column) -> Column:
    """Diverging where errors pass the motion itself, unless the session stood still."""
    return F.when(speed < 0.15, "standing").when(median_error > median_motion, "diverging").when(inliers < 0.3, "few inliers").otherwise("ok")


def histogram_percentile(df: DataFrame, by: Sequence[str], value: str, *, fraction: float, bins: int = 256, size: float = 0.05) -> DataFrame:
    """Percentile from a clamped histogram: centre of the bin where the count reaches max(1, round(n * fraction))."""
    rows = df.where(F.col(value).isNotNull()).withColumn("bin", F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col(value) / size))).cast("int"))
    counts = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    counts = counts.withColumn("seen", F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    reached = F.col("seen") >= F.greatest(F.lit(1), F.floor(F.col("all") * fraction + 0.5))
    return counts.where(reached).groupBy(*by).agg(((F.min("bin") + 0.5) * size).alias("value"), F.first("all").alias("n"))


def rolling_below(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, *, floor: float = 0.007, rows: int = 150, width: float = WIDTH) -> DataFrame:
    """Fraction of the last ``rows`` non-null samples under ``floor``."""
    w = Window.partitionBy(*by, BLOCK).orderBy(*order).rowsBetween(1 - rows, 0)
    dealt = blocks(df.where(F.col(value).isNotNull()), by, order, before=rows - 1, width=width)
    return dealt.withColumn("below", F.avg(F.when(F.col(value) < floor, 1.0).otherwise(0.0)).over(w)).where(OWN).drop(*DEALT)


def upload_progress(files: DataFrame, by: Sequence[str], *, done: str = "done", in_flight: str = "in_flight", sent: str = "sent", size: str = "size") -> DataFrame:
    """Per session that is not finished: total, completed, in flight, pending, bytes sent and to send."""
    out = files.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count(F.when(F.col(done), 1)).alias("completed"),
        F.count(F.when(F.col(in_flight) & ~F.col(done), 1)).alias("moving"),
        F.sum(F.when(F.col(done), F.col(size)).otherwise(F.least(F.col(sent), F.col(size)))).alias("bytes_sent"),
        F.sum(size).alias("bytes"),
    )
    out = out.where("completed < total").withColumn("pending", F.greatest(F.lit(0), F.col("total") - F.col("completed") - F.col("moving")))
    return out


def straightness(chains: DataFrame, by: Sequence[str], *, chain: str = "chain", x: str = "x", y: str = "y", least: int = 30, bins: int = 24) -> DataFrame:
    """How far edge chains bow: chains, median and 90th percentile of the root mean square offset.

    A chain's direction is that of its greatest spread (one not 4 times that across is left out); offsets
    are averaged in ``bins`` along it, half of which must hold points.
    """
    key = [*by, chain]
    axes = chains.groupBy(*key).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("a"), F.var_pop(y).alias("b"), F.covar_pop(x, y).alias("c")).where(F.col("n") >= least)
    mid, off = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, 2) + F.col("c") * F.col("c"))
    axes = axes.where(F.sqrt(mid + off) >= 4 * F.sqrt(F.greatest(mid - off, F.lit(0.0)))).withColumn("g", 0.5 * F.atan2(2 * F.col("c"), F.col("a") - F.col("b")))
    rows = safe_join(chains, axes, key)
    dx, dy = F.col(x) - F.col("mx"), F.col(y) - F.col("my")
    rows = rows.select(*key, (dx * F.cos("g") + dy * F.sin("g")).alias("along"), (dy * F.cos("g") - dx * F.sin("g")).alias("across"))
    ends = rows.groupBy(*key).agg(F.min("along").alias("lo"), (F.max("along") + 1e-9).alias("hi"))
    rows = safe_join(rows, ends, key).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("along") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    means = rows.groupBy(*key, "bin").agg(F.avg("across").alias("m"))
    bows = means.groupBy(*key).agg(F.sqrt(F.avg(F.col("m") * F.col("m"))).alias("bow"), F.count("*").alias("occupied")).where(F.col("occupied") >= bins // 2)
    return exact_percentiles(bows, by, "bow", {"median": 0.5, "p90": 0.9}).withColumnRenamed("n", "chains")


def expected_files(manifest: DataFrame) -> DataFrame:
    """Number of files a complete session holds, from its manifest; null where it is unusable.

    Eight streams, one for the index of stills or the video, the rasters that
    are enabled, and a file for each still.
    """
    stills = F.col("config.captureMode") == "stills"
    n = F.lit(9) + F.col("config.recordDepth").cast("int") + (F.col("config.recordDepth") & F.col("config.recordConfidence")).cast("int")
    n = n + F.when(stills, F.coalesce(F.try_element_at("counts", F.lit("frames")), F.lit(0))).otherwise(0)
    return manifest.withColumn("expected", F.when(F.col("config").isNotNull() & F.col("counts").isNotNull(), n))


def gate_segments(df: DataFrame, by: Sequence[str], least: int = 10) -> DataFrame:
    """Rows of segments that hold ``least`` rows."""
    enough = df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    return safe_join(df, enough.select(*by), by, "left_semi")
