"""Operators along time: as-of joins, intervals, gaps, segments, gates, resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .ordered import BLOCK, DEALT, OWN, PLACE, WIDTH, blocks, carried, cut, keys_of, numbered, previous, running, runs, safe_join, scan
from .ranks import exact_percentiles


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], *, t: str = "t", right_order: Sequence[str] = (), values: Sequence[str], prefix: str = "near_", tie: str = "earlier", tolerance: float | None = None, width: float = WIDTH) -> DataFrame:
    """Bidirectional as-of join: each left row with the right row nearest in time.

    Equal distances go to the earlier (``tie="earlier"``) or later row; among
    right rows at the left time the first is taken, among earlier ones of one
    time the last. Beyond ``tolerance`` the values are null. Adds ``prefix`` +
    each of ``values`` and ``prefix`` + ``dt`` (left time less right time).

    Both sides are merged in time order and neighbours carried along, in slots.
    Left rows without a time have null values; right rows without one are left out; a null
    session key is a session. Names of the left side that begin with two underscores are kept.
    """
    order = list(right_order)
    hidden = {c: f"kept{c}" for c in left.columns if c.startswith("__")}
    left = left.withColumnsRenamed(hidden)
    sides = left.select("*", F.lit(0).alias("__side"), F.lit(None).cast(_row_type(right, t, values)).alias("__row"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"__o_{c}") for c in order])
    row = F.struct(F.col(t).alias("t"), *[F.col(c).alias(f"v_{c}") for c in values])
    keys = [*by, t]
    others = right.where(F.col(t).isNotNull()).select(*[F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(1).alias("__side"), row.alias("__row"), *[F.col(c).alias(f"__o_{c}") for c in order])
    both = sides.unionByName(others)
    both = carried(both, by, [t, "__side", *[f"__o_{c}" for c in order]], F.col("__row"), forward="__prev", backward="__next", width=width)
    both = both.where("__side = 0")
    back, ahead = F.col(t) - F.col("__prev.t"), F.col("__next.t") - F.col(t)
    earlier = back <= ahead if tie == "earlier" else back < ahead
    chosen = F.when(F.col("__prev").isNull(), F.col("__next")).when(F.col("__next").isNull() | earlier, F.col("__prev")).otherwise(F.col("__next"))
    if tolerance is not None:
        chosen = F.when(F.abs(F.col(t) - chosen["t"]) <= tolerance, chosen)
    both = both.withColumn("__row", F.when(F.col(t).isNotNull(), chosen))
    out = both.withColumns({f"{prefix}{c}": F.col(f"__row.v_{c}") for c in values} | {f"{prefix}dt": F.col(t) - F.col("__row.t")})
    return out.drop("__side", "__row", "__prev", "__next", *[f"__o_{c}" for c in order]).withColumnsRenamed({v: k for k, v in hidden.items()})


def _row_type(right: DataFrame, t: str, values: Sequence[str]) -> str:
    return f"struct<t: {right.schema[t].dataType.simpleString()}, " + ", ".join(f"`v_{c}`: {right.schema[c].dataType.simpleString()}" for c in values) + ">"


def interval_average(intervals: DataFrame, samples: DataFrame, by: Sequence[str], *, start: str, end: str, t: str = "t", value: str, name: str, width: float) -> DataFrame:
    """Average and number (``name``, ``name``_n) of the samples with start <= t <= end, for each interval; see ``interval_averages``."""
    return interval_averages(intervals, samples, by, start=start, end=end, t=t, values={name: F.col(value)}, width=width)


def interval_averages(intervals: DataFrame, samples: DataFrame, by: Sequence[str], *, start: str, end: str, t: str = "t", values: dict[str, Column], width: float) -> DataFrame:
    """For each name in ``values`` the average and number (name, name_n) of the samples with start <= t <= end.

    Null values don't count. An interval without a border or that ends before it starts has none; repeated ones have the same.
    Samples on a border count on both sides.

    No range join: borders and samples are merged in time order, running sums and counts are taken
    in slots of ``width``, and an interval is the difference of those at its borders, however many
    slots it covers. Values are summed about their session's mean, so that sums stay small.
    """
    key = [*by, start, end]
    wanted = intervals.select(*key).distinct().where(F.col(start) <= F.col(end))
    own = {n: f"__v{i}" for i, n in enumerate(values)}
    dots = samples.where(F.col(t).isNotNull()).select(*by, F.col(t).alias("__t"), *[v.cast("double").alias(own[n]) for n, v in values.items()])
    means = dots.groupBy(*by).agg(*[F.avg(c).alias(f"__m{c}") for c in own.values()])
    dots = safe_join(dots, means, by).withColumns({c: F.col(c) - F.col(f"__m{c}") for c in own.values()} | {"__side": F.lit(1)}).drop(*[f"__m{c}" for c in own.values()])
    ends = F.array(F.struct(F.col(start).alias("t"), F.lit(0).alias("side")), F.struct(F.col(end).alias("t"), F.lit(2).alias("side")))
    borders = wanted.withColumn("__b", F.explode(ends)).select(*key, F.col("__b.t").alias("__t"), F.col("__b.side").alias("__side"))
    both = dots.unionByName(borders, allowMissingColumns=True)
    sums = {f"__s{c}": F.col(c) for c in own.values()} | {f"__n{c}": F.when(F.col(c).isNotNull(), 1) for c in own.values()}
    both = running(both, by, ["__t", "__side"], sums, width=width).where("__side <> 1")
    out = both.groupBy(*key).agg(*[F.sum(F.when(F.col("__side") == 2, F.col(c)).otherwise(-F.col(c))).alias(c) for c in sums])
    out = safe_join(out, means, by, "left")
    n = {c: F.col(f"__n{c}") for c in own.values()}
    mean = {name: F.when(n[c] > 0, F.col(f"__m{c}") + F.col(f"__s{c}") / n[c]) for name, c in own.items()}
    out = out.select(*key, *[x for name, c in own.items() for x in (mean[name].alias(name), n[c].cast("bigint").alias(f"{name}_n"))])
    return safe_join(intervals, out, key, "left").withColumns({f"{name}_n": F.coalesce(f"{name}_n", F.lit(0)) for name in values})


def gaps(df: DataFrame, by: Sequence[str], *, t: str = "t", order: Sequence[str] = (), threshold: float = 5.0, width: float = WIDTH) -> DataFrame:
    """(start, end) of consecutive rows more than ``threshold`` apart."""
    rows = previous(df, by, [t, *order], {"gap_start": t}, width=width)
    return rows.where(F.col(t) - F.col("gap_start") > threshold).select(*by, "gap_start", F.col(t).alias("gap_end"))


def segments(rows: DataFrame, breaks: DataFrame, by: Sequence[str], *, t: str = "t", order: Sequence[str] = (), name: str = "segment", width: float = WIDTH) -> DataFrame:
    """Numbers segments from 0; a row at or after a break begins a new one, empty ones don't count."""
    marks = breaks.select(*by, F.col(t), F.lit(0).alias("__side"))
    both = rows.withColumn("__side", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    both = running(both, by, [t, "__side", *order], {"__breaks": F.when(F.col("__side") == 0, 1).otherwise(0)}, width=width).where("__side = 1")
    # Ranks of the counts that have rows: a small table by session and count.
    kinds = both.select(*by, "__breaks").distinct().withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy("__breaks")) - 1).cast("bigint"))
    return safe_join(both, kinds, [*by, "__breaks"]).drop("__side", "__breaks")


def focus_settle(samples: DataFrame, by: Sequence[str], *, t: str = "t", fx: str = "fx", origin: DataFrame, quiet: float = 10.0, run: int = 5, least: int = 6, width: float = WIDTH) -> DataFrame:
    """When a signal settles: the first of ``run`` rates in a row under ``quiet``.

    Per session: settled (t less ``origin.t0``; 0.0 if quiet from the first rate
    on; null if it never settles) and whether it could be told: fewer than
    ``least`` samples or a step of no time give no row.
    """
    finite = lambda c: F.abs(F.col(c).cast("double")) < float("inf")
    rows = samples.where(finite(t) & finite(fx))
    rows = numbered(previous(rows, by, [t], {"__t0": t, "__f0": fx}, width=width), by, [t], "__i", width=width)
    dt = F.col(t) - F.col("__t0")
    rows = rows.withColumn("__rate", F.when(dt > 0, F.abs(F.col(fx) - F.col("__f0")) / F.when(dt > 0, dt)))
    rates = rows.where("__i > 0")
    quiet_run = Window.partitionBy(*by, BLOCK).orderBy("__i").rowsBetween(0, run - 1)
    rates = blocks(rates, by, [t], after=run - 1, width=width)
    rates = rates.withColumn("__most", F.max("__rate").over(quiet_run)).withColumn("__n", F.count("__rate").over(quiet_run)).where(OWN).drop(*DEALT)
    hit = F.when((F.col("__n") == run) & (F.col("__most") < quiet), F.col("__i"))
    found = rates.groupBy(*by).agg(F.min(hit).alias("__at"), F.min_by(t, F.when(hit.isNotNull(), F.col("__i"))).alias("__t"), F.min(dt).alias("__dt"), (F.count("*") + 1).alias("samples"))
    found = found.where((F.col("samples") >= least) & (F.col("__dt") > 0))
    found = safe_join(found, origin.select(*by, "t0"), by)
    return found.select(*by, "samples", F.when(F.col("__at") == 1, F.lit(0.0)).otherwise(F.col("__t") - F.col("t0")).alias("settled"))


def rate_gate(df: DataFrame, by: Sequence[str], *, t: str = "t", order: Sequence[str] = (), hz: float, name: str = "fires", width: float = WIDTH) -> DataFrame:
    """Marks the rows that a gate of ``hz`` lets through.

    The first row fires; later ones if t >= due. Due moves on by the interval,
    or to t + interval if the row came an interval late or more. The fold depends
    on order, so it streams through rows; a session is cut where it pauses for two intervals, since a gate
    has forgotten its past by then. Rows without a time fire nothing; a null session key is a session.
    """
    return _fold(df, by, [t, *order], t, {name: hz}, width)


def coupled_gates(df: DataFrame, by: Sequence[str], *, t: str = "t", order: Sequence[str] = (), image_hz: float, depth_hz: float, throttled: str | None = None, width: float = WIDTH) -> DataFrame:
    """Adds image (its gate) and depth (either gate); both gates see every row but ``throttled`` ones, which give neither."""
    rest = df.limit(0) if throttled is None else df.where(F.col(throttled))
    seen = df if throttled is None else df.where(~F.coalesce(F.col(throttled), F.lit(False)))
    out = _fold(seen, by, [t, *order], t, {"image": image_hz, "__depth": depth_hz}, width)
    out = out.withColumn("depth", F.col("image") | F.col("__depth")).drop("__depth")
    return out if throttled is None else out.unionByName(rest.withColumns({"image": F.lit(False), "depth": F.lit(False)}))


def _fold(df: DataFrame, by: Sequence[str], order: Sequence[str], t: str, rates: dict[str, float], width: float) -> DataFrame:
    steps = {n: 1.0 / max(0.01, hz) for n, hz in rates.items()}
    timed = F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double"))
    rows, apart = runs(df.where(timed), by, order, 2 * max(steps.values()), width=width)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, due = None, {}
        for batch in batches:
            fired = {n: [] for n in steps}
            times = batch.column(batch.schema.names.index(t)).to_pylist()
            for key, x in zip(keys_of(batch, apart), map(float, times), strict=True):
                if key != now:
                    now, due = key, {}
                for n, step in steps.items():
                    d = due.get(n)
                    fires = d is None or x >= d
                    if fires:
                        due[n] = x + step if d is None or x - d >= step else d + step
                    fired[n].append(fires)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(f, pa.bool_()) for f in fired.values()]], names=[*batch.schema.names[:-1], *fired])

    schema = StructType([*df.schema.fields, *[StructField(n, BooleanType()) for n in steps]])
    return rows.mapInArrow(task, schema).unionByName(df.where(~timed).withColumns({n: F.lit(False) for n in steps}))


def row_windows(df: DataFrame, by: Sequence[str], *, order: Sequence[str], size: int, step: int, pinned: bool = True, width: float = WIDTH) -> DataFrame:
    """Overlapping windows of ``size`` rows every ``step``; the last is pinned to the end.

    One row for each row and window it is in: adds window_start (row number).
    Windows that a row is in follow from its number, so nothing is joined but
    the session's number of rows.
    """
    rows = numbered(df, by, order, "__i", width=width)
    counts = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    rows = safe_join(rows, counts, by)
    last = F.greatest(F.col("__n") - size, F.lit(0))
    low = F.greatest(F.lit(0), F.ceil((F.col("__i") - size + 1) / F.lit(step)) * step)
    high = F.least(F.floor(F.col("__i") / step) * step, F.floor(last / step) * step)
    starts = F.when(low <= high, F.sequence(low, high, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    if pinned:
        tail = (last % step != 0) & (F.col("__i") >= last)
        starts = F.concat(starts, F.when(tail, F.array(last)).otherwise(F.array().cast("array<bigint>")))
    return rows.withColumn("window_start", F.explode(starts)).drop("__i", "__n")


def resample(df: DataFrame, by: Sequence[str], *, t: str = "t", order: Sequence[str] = (), value: str, step: float, width: float = WIDTH) -> DataFrame:
    """Linear interpolation on a uniform grid from the first time in steps, clamped at the ends."""
    ends = df.groupBy(*by).agg(F.min(t).alias("__a"), F.max(t).alias("__b"))
    grid = ends.select(*by, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__b") - F.col("__a")) / step).cast("bigint"))).alias("k"), "__a")
    grid = grid.select(*by, "k", (F.col("__a") + F.col("k") * step).alias(t))
    points = df.select(*by, F.col(t), F.lit(None).cast("bigint").alias("k"), F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("v")).alias("__p"), F.lit(0).alias("__side"))
    spots = grid.withColumn("__p", F.lit(None).cast(points.schema["__p"].dataType)).withColumn("__side", F.lit(1)).select(points.columns)
    both = carried(points.unionByName(spots), by, [t, "__side"], F.col("__p"), forward="__l", backward="__r", width=width).where("__side = 1")
    span = F.col("__r.t") - F.col("__l.t")
    v = F.when(F.col("__r").isNull() | (span <= 0), F.col("__l.v")).when(F.col("__l").isNull(), F.col("__r.v"))
    v = v.otherwise(F.col("__l.v") + (F.col("__r.v") - F.col("__l.v")) * (F.col(t) - F.col("__l.t")) / F.when(span > 0, span))
    return both.select(*by, "k", t, v.alias(value))


def low_pass(df: DataFrame, by: Sequence[str], *, t: str = "t", order: Sequence[str] = (), value: str, cutoff_hz: float = 2.0, name: str = "smooth", width: float = WIDTH, block: int = 256) -> DataFrame:
    """Zero-phase one-pole filter: one pass forward, one backward, with the session's median time step.

    Each pass is a scan over maps y -> a y + b, whose composition is associative; the first row's
    map forgets what came before it. Rows without a finite time or value take no part and have
    none; rows of one time go in ``order``; a null session key is a session.
    """
    finite = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    rows, rest = df.where(finite(t) & finite(value)), df.where(~(finite(t) & finite(value)))
    steps = previous(rows, by, [t, *order], {"__t0": t}, width=width)
    steps = cut(numbered(steps, by, [t, *order], PLACE, width=width).withColumn("__dt", F.col(t) - F.col("__t0")))
    dt = exact_percentiles(steps, by, "__dt", {"__mid": 0.5})
    weight = F.when(F.col("__mid") > 0, F.col("__mid") / (F.col("__mid") + 1 / (2 * math.pi * cutoff_hz))).otherwise(1.0)
    # As many steps as the last place is.
    rows = safe_join(steps, dt.select(*by, F.col("n").alias("__last"), weight.alias("__w")), by).withColumn("__back", F.col("__last") - F.col(PLACE))

    def filtered(rows: DataFrame, place: str, x: Column, out: str) -> DataFrame:
        first, w = F.col(place) == 0, F.col("__w")
        step = F.struct(F.when(first, 0.0).otherwise(1 - w).alias("a"), F.when(first, x).otherwise(w * x).alias("b"))
        then = lambda f, g: F.struct((g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"))
        start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
        return scan(rows, by, place, step, start, then, "__y", block=block).withColumn(out, F.col("__y.b"))

    rows = filtered(rows, PLACE, F.col(value).cast("double"), "__f").drop("__y")
    rows = filtered(rows, "__back", F.col("__f"), name)
    return rows.select(*df.columns, name).unionByName(rest.withColumn(name, F.lit(None).cast("double")))
