"""Scans along time that need no task to hold a whole session.

Ordered operators (previous row, running totals, carried values) are built in
two levels. Rows are dealt to slots of ``width`` along the order's first column;
windows run inside (session, slot), and what a slot inherits from those before it
comes from a window over slot summaries, one row each. A session that holds a
third of all rows is spread over as many tasks as it has slots.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOT = "__slot"
#: Default width of a slot, in units of the order's first column (seconds, mostly).
WIDTH = 3600.0


def safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` that takes nulls as equal; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    match = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"__r_{c}"]) for c in on])
    return left.join(renamed, match, how).drop(*[f"__r_{c}" for c in on])


def slotted(df: DataFrame, t: str, width: float) -> DataFrame:
    return df.withColumn(SLOT, F.floor(F.col(t) / F.lit(width)))


def _within(by: Sequence[str], order: Sequence[str | Column]) -> Window:
    return Window.partitionBy(*by, SLOT).orderBy(*order)


def _across(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy(SLOT)


def previous(df: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, str], *, width: float = WIDTH) -> DataFrame:
    """Adds, for each name in ``values``, its column's value in the session's row before."""
    row = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    df = slotted(df, order[0], width)
    last = df.groupBy(*by, SLOT).agg(F.max_by(row, F.struct(*order)).alias("__end"))
    last = last.withColumn("__end", F.lag("__end").over(_across(by)))
    out = df.withColumn("__lag", F.lag(row).over(_within(by, order)))
    out = safe_join(out, last, [*by, SLOT]).withColumn("__lag", F.coalesce("__lag", "__end"))
    return out.withColumns({n: F.col(f"__lag.{n}") for n in values}).drop("__lag", "__end", SLOT)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, Column | str], *, inclusive: bool = True, width: float = WIDTH) -> DataFrame:
    """Adds running totals along the session; exclusive ones leave the row itself out."""
    df = slotted(df, order[0], width).withColumns({f"__x_{n}": F.coalesce(F.expr(c) if isinstance(c, str) else c, F.lit(0)) for n, c in sums.items()})
    totals = df.groupBy(*by, SLOT).agg(*[F.sum(f"__x_{n}").alias(f"__s_{n}") for n in sums])
    before = _across(by).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"__s_{n}": F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)) for n in sums})
    inside = _within(by, order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"__i_{n}": F.sum(f"__x_{n}").over(inside) for n in sums})
    out = safe_join(out, totals, [*by, SLOT])
    out = out.withColumns({n: F.col(f"__s_{n}") + F.col(f"__i_{n}") - (F.lit(0) if inclusive else F.col(f"__x_{n}")) for n in sums})
    return out.drop(SLOT, *[f"__{k}_{n}" for k in "xsi" for n in sums])


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "row_index", *, width: float = WIDTH) -> DataFrame:
    """Adds the row's place in its session, from 0."""
    return running(df, by, order, {name: F.lit(1)}, inclusive=False, width=width).withColumn(name, F.col(name).cast("bigint"))


#: Columns of ``blocks``: the block, the row's place, and what tells the block's own rows.
BLOCK, PLACE = "__block", "__place"
DEALT, OWN = (BLOCK, PLACE), f"floor({PLACE} / 4096) = {BLOCK}"


def blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], *, before: int = 0, after: int = 0, width: float = WIDTH) -> DataFrame:
    """Rows dealt to blocks of 4096 of their session, with the ``before`` and ``after`` rows next to each block.

    A window over (session, block) then sees what a row needs; ``where(OWN)`` leaves each row once.
    """
    rows = numbered(df, by, order, PLACE, width=width)
    span = F.sequence(F.greatest(F.lit(0), F.floor((F.col(PLACE) - after) / 4096)), F.floor((F.col(PLACE) + before) / 4096))
    return rows.withColumn(BLOCK, F.explode(span))


def carried(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, *, forward: str | None = None, backward: str | None = None, width: float = WIDTH) -> DataFrame:
    """Adds the nearest non-null ``value`` before (``forward``) and after (``backward``) each row, the row itself not counted."""
    df = slotted(df, order[0], width).withColumn("__v", value)
    place = F.struct(*order)
    ends = df.where("__v is not null").groupBy(*by, SLOT).agg(F.max_by("__v", place).alias("__last"), F.min_by("__v", place).alias("__first"))
    slots = df.select(*by, SLOT).distinct()
    ends = safe_join(slots, ends, [*by, SLOT], "left")
    ends = ends.select(
        *by,
        SLOT,
        F.last("__last", ignorenulls=True).over(_across(by).rowsBetween(Window.unboundedPreceding, -1)).alias("__from_before"),
        F.first("__first", ignorenulls=True).over(_across(by).rowsBetween(1, Window.unboundedFollowing)).alias("__from_after"),
    )
    out = df
    if forward:
        out = out.withColumn(forward, F.last("__v", ignorenulls=True).over(_within(by, order).rowsBetween(Window.unboundedPreceding, -1)))
    if backward:
        out = out.withColumn(backward, F.first("__v", ignorenulls=True).over(_within(by, order).rowsBetween(1, Window.unboundedFollowing)))
    out = safe_join(out, ends, [*by, SLOT])
    if forward:
        out = out.withColumn(forward, F.coalesce(forward, "__from_before"))
    if backward:
        out = out.withColumn(backward, F.coalesce(backward, "__from_after"))
    return out.drop("__v", "__from_before", "__from_after", SLOT)


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], pause: float, *, width: float = WIDTH) -> tuple[DataFrame, list[str]]:
    """Rows in order within runs that no pause of over ``pause`` interrupts, for folds that forget by then.

    Returns the rows, with the run's number as a last column, dealt out by run, and the columns that tell runs apart.
    """
    rows = previous(df, by, order, {"__was": order[0]}, width=width)
    # A little more than the pause, for rounding.
    fresh = F.coalesce(F.col(order[0]) - F.col("__was") > pause * (1 + 1e-6), F.lit(True))
    rows = running(rows, by, order, {"__run": F.when(fresh, 1).otherwise(0)}, width=width).select(*df.columns, "__run")
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, *by, "__run").sortWithinPartitions(*by, "__run", *order), [*by, "__run"]


def keys_of(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple]:
    """Each row's key as Python values; NaN equals NaN."""
    columns = [["nan" if isinstance(v, float) and v != v else v for v in batch.column(batch.schema.names.index(n)).to_pylist()] for n in names]
    return zip(*columns, strict=True)


Combine = Callable[[Column, Column], Column]


def _listed(rows: DataFrame, by: Sequence[str], place: str, block: int, **parts: Column) -> DataFrame:
    """Blocks of ``block`` places: ``group``, the block's number, and ``rows``, its rows' parts in order."""
    item = F.struct(F.col(place).alias("place"), *[c.alias(n) for n, c in parts.items()])
    lists = rows.groupBy(*by, F.floor(F.col(place) / block).alias("group")).agg(F.collect_list(item).alias("rows"))
    return lists.withColumn("rows", F.array_sort("rows", lambda a, b: F.signum(a["place"] - b["place"]).cast("int")))


def _each(kept: str, start: Column, combine: Combine, *, inclusive: bool) -> Column:
    """For each of ``rows`` its part ``kept`` and what ``made`` and the elements up to it make."""

    def step(a: Column, x: Column) -> Column:
        after = combine(a["made"], x["element"])
        one = F.struct(x[kept].alias("row"), (after if inclusive else a["made"]).alias("made"))
        return F.struct(after.alias("made"), F.concat(a["out"], F.array(one)).alias("out"))

    none = F.slice(F.transform("rows", lambda x: F.struct(x[kept].alias("row"), start.alias("made"))), 1, 0)
    return F.aggregate("rows", F.struct(F.col("made"), none.alias("out")), step, lambda a: a["out"])


def _made_before(elements: DataFrame, by: Sequence[str], start: Column, combine: Combine, block: int, levels: int) -> DataFrame:
    """(place, made): what the elements (place, element) of a session before each place make."""
    if levels:
        lists = _listed(elements, by, "place", block, element=F.col("element"))
        lists = _with_before(lists, by, start, combine, block, levels - 1)
    else:
        lists = _listed(elements, by, "place", 1 << 62, element=F.col("element")).withColumn("made", start)
    return lists.select(*by, F.inline(_each("place", start, combine, inclusive=False))).withColumnRenamed("row", "place")


def _with_before(lists: DataFrame, by: Sequence[str], start: Column, combine: Combine, block: int, levels: int) -> DataFrame:
    """``lists`` with ``made``: what the session's elements before the block make."""
    totals = lists.select(*by, F.col("group").alias("place"), F.aggregate("rows", start, lambda a, x: combine(a, x["element"])).alias("element"))
    before = _made_before(totals, by, start, combine, block, levels)
    return safe_join(lists, before.withColumnRenamed("place", "group"), [*by, "group"])


def scan(df: DataFrame, by: Sequence[str], place: str, element: Column, start: Column, combine: Combine, name: str, *, block: int = 256, levels: int = 2) -> DataFrame:
    """Adds ``name``: what ``combine`` makes of the elements of a session's rows up to and with the row.

    ``combine`` is associative and ``start`` neutral to it, and all have one type; ``place`` is the row's
    number in its session (``numbered``). Rows go to blocks of ``block`` by it, a block's
    elements are reduced to one, these are scanned the same way on ``levels`` further levels,
    and rows are finished inside their blocks. Nothing but a last level, of a session's
    rows / block^(levels + 1), is gathered by session.
    """
    others = F.struct(*[F.col(c) for c in df.columns if c not in by])
    lists = cut(_listed(df, by, place, block, element=element, others=others))
    lists = _with_before(lists, by, start, combine, block, levels)
    out = lists.select(*by, F.inline(_each("others", start, combine, inclusive=True)))
    return out.select(*by, "row.*", F.col("made").alias(name))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a session on one machine that names none gets a temporary one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='veldspar-')}")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, kept in the shared folder.

    For what is read several times on the way: plans that join a table with its own summary
    double with each step.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def sortable(value: Column) -> Column:
    """A whole number for each double that orders as doubles do: the bits of its magnitude with its sign."""
    v = F.abs(value)
    # The exponent by logarithm may be off by one beside a power of two.
    e = F.floor(F.log2(v))
    e = F.when(F.pow(F.lit(2.0), e) > v, e - 1).when(F.pow(F.lit(2.0), e + 1) <= v, e + 1).otherwise(e)
    unit = F.lit(1 << 52).cast("bigint")
    normal = (e + 1023) * unit + ((v / F.pow(F.lit(2.0), e) - 1) * unit).cast("bigint")
    small = F.lit(2.0**-1022)
    bits = F.when(v == 0, 0).when(v < small, (v / F.lit(5e-324)).cast("bigint")).when(v == float("inf"), 2047 * unit).otherwise(normal)
    return F.when(F.isnan(value), 2047 * unit + 1).when(value < 0, -bits).otherwise(bits).cast("bigint")
