"""Exact ranks of a group's values without holding the group.

A percentile needs the two values beside its rank. Values are counted by distinct value, and
ordered by whole numbers of 64 bits (``ordered.sortable``). A round counts the ranges of 2^21 (at first 2^22)
that the range holding a rank is divided into, adds the counts up, and keeps the one range
the rank is in; after three rounds that is one value. Counts are combined before each shuffle and
a group with a third of all rows is spread by value, so no task or buffer holds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import cut, safe_join, sortable

#: Bits of the number that are left out in each round.
ROUNDS = (42, 21, 0)


def _range(key: Column, shift: int) -> Column:
    return F.shiftright(key, shift)


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Per group: ``n`` values, and for each name in ``at`` the percentile with linear interpolation.

    Null values don't count; a group without others has n 0 and nulls. NaN is larger than all numbers. A null key is a group.
    """
    by = list(by)
    hidden = {c: f"__g{i}" for i, c in enumerate(by)}
    groups = [hidden[c] for c in by]
    rows = df.select(*[F.col(c).alias(hidden[c]) for c in by], F.col(value).cast("double").alias("__v"))
    counted = cut(rows.groupBy(*groups, "__v").agg(F.count("*").alias("__n")).withColumn("__key", sortable(F.col("__v"))))
    sizes = counted.groupBy(*groups).agg(F.sum(F.when(F.col("__v").isNotNull(), F.col("__n")).otherwise(0)).alias("n"))
    counted = counted.where("__v is not null")

    def ranks(p: float) -> list[Column]:
        place = F.lit(float(p)) * (F.col("n") - 1)
        low = F.floor(place)
        return [F.struct(F.lit(name).alias("name"), r.cast("bigint").alias("r"), part.alias("part")) for name, r, part in ((names[p], low, 1 - (place - low)), (names[p], F.least(low + 1, F.col("n") - 1), place - low))]

    names = {p: str(i) for i, p in enumerate(dict.fromkeys(at.values()))}
    wanted = F.filter(F.array(*[r for p in names for r in ranks(p)]), lambda x: x["part"] > 0)
    held = sizes.where("n > 0").select(*groups, F.lit(None).cast("bigint").alias("__range"), wanted.alias("__q"))
    above = None
    for shift in ROUNDS:
        outer = F.lit(None).cast("bigint") if above is None else _range(F.col("__key"), above)
        met = safe_join(counted.withColumn("__range", outer), held, [*groups, "__range"])
        parts = met.groupBy(*groups, "__range", _range(F.col("__key"), shift).alias("__part")).agg(F.sum("__n").alias("__n"), F.first("__q").alias("__q"), F.max("__v").alias("__v"))
        upto = F.sum("__n").over(Window.partitionBy(*groups, "__range").orderBy("__part"))
        parts = parts.withColumn("__to", upto).withColumn("__from", F.col("__to") - F.col("__n"))
        inside = F.transform(F.filter("__q", lambda x: (x["r"] >= F.col("__from")) & (x["r"] < F.col("__to"))), lambda x: x.withField("r", x["r"] - F.col("__from")))
        parts = parts.withColumn("__q", inside).where(F.size("__q") > 0)
        held = parts.select(*groups, F.col("__part").alias("__range"), "__q", "__v").drop(*(["__v"] if shift else []))
        above = shift
    found = held.select(*groups, "__v", F.explode("__q").alias("__q")).select(*groups, F.col("__q.name").alias("__name"), (F.col("__q.part") * F.col("__v")).alias("__v"))
    found = found.groupBy(*groups).agg(*[F.sum(F.when(F.col("__name") == names[p], F.col("__v"))).alias(f"__p{names[p]}") for p in names])
    out = safe_join(sizes, found, groups, "left") if groups else sizes.crossJoin(F.broadcast(found))
    return out.select(*[F.col(hidden[c]).alias(c) for c in by], "n", *[F.col(f"__p{names[p]}").alias(name) for name, p in at.items()])
