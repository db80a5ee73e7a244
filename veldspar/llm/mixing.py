"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents are
ordered by it, prefix sums of their sizes are taken, and the source is cut at
its exact budget: whole passes (epochs) first, then the part of one pass that
is left, the last document in it in part.

Plan, DataFrame functions alone: the key's first three hex digits deal each
source into 4096 ranges of keys, so a prefix sum is a sum over the ranges before
(small, by source) and one within the range. No task holds a source, however
large; the text is read for its size and does not enter a shuffle. The table of
sources (one row each) is small next to the documents; it is joined on the
source with a salted side only as Spark's adaptive execution splits it.

Defined results: a null text has size 0, a very long one the size it has; a null source is a source of its own,
last in the order; documents of the same id and size are interchangeable; an
empty table gives an empty mix; a source without words has target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD_PATTERN, require, spare


def word_count(text: str | Column) -> Column:
    """Number of runs without ASCII white space, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with each source's ``target``.

    Sources in code point order (null last) take the weights in turn. They
    share ``share`` of all sizes by weight; none passes ``max_epochs`` times
    its size, and what it would have had over goes to the others by weight.
    With sources in the order of size over weight, those that stop form a
    prefix: it ends where the level of the rest no longer reaches the cap.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    rows = rows.withColumn("w_rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))) / F.col("w_rest"))
    rows = rows.withColumn("stops", F.col("cap") <= F.col("level") * F.col("w"))
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)  # levels fall after the first
    return rows.withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(level * F.col("w"))).select("source", "source_size", "target")


def _decided(rows: DataFrame, name: dict[str, str], weights: Sequence[float], share: float, max_epochs: float, seed: str) -> DataFrame:
    """``rows`` with source_size, target, epochs and taken added, under the names that ``name`` gives.

    ``name`` also gives the columns id, source and size.
    """
    c = {k: F.col(v) for k, v in name.items()}
    key = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(c["id"].cast("string"), F.lit("null"))).cast("binary"))
    rows = rows.withColumn(name["key"], key).withColumn(name["range"], F.substring(c["key"], 1, 3))
    # A range of keys holds about one document in 4096 of a source; equal keys (repeated ids) share a range.
    ranges = rows.groupBy(c["source"].alias("source"), c["range"].alias("range")).agg(F.sum(c["size"]).alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    ranges = ranges.withColumn("source_size", F.sum("range_size").over(Window.partitionBy("source")))
    plan = targets(ranges.select("source", "source_size").distinct(), weights=weights, share=share, max_epochs=max_epochs)
    ranges = ranges.alias("r").join(plan.alias("p"), F.expr("coalesce(r.source, '') = coalesce(p.source, '') and r.source <=> p.source"))
    ranges = ranges.select("r.source", "range", "before", "r.source_size", "target")
    within = Window.partitionBy(name["source"], name["range"]).orderBy(name["key"], name["id"], name["size"]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name["inside"], F.coalesce(F.sum(c["size"]).over(within), F.lit(0)))
    d = {k: F.col(f"d.`{v}`") for k, v in name.items()}
    none = F.lit("")
    same = (F.coalesce(d["source"], none) == F.coalesce("r.source", none)) & d["source"].eqNullSafe(F.col("r.source")) & (d["range"] == F.col("r.range"))
    out = rows.alias("d").join(ranges.alias("r"), same)
    budget, whole = F.round("r.target").cast("bigint"), F.col("r.source_size")
    epochs = F.when(whole > 0, F.floor(budget / whole)).otherwise(F.lit(0)).cast("bigint")
    part = F.greatest(F.lit(0), F.least(d["size"], budget - epochs * whole - F.col("r.before") - d["inside"]))
    gone = (name["key"], name["range"], name["inside"])
    return out.select(
        *[F.col(f"d.`{x}`") for x in rows.columns if x not in gone],
        whole.alias(name["source_size"]),
        F.col("r.target").alias(name["target"]),
        epochs.alias(name["epochs"]),
        (epochs * d["size"] + part).cast("bigint").alias(name["taken"]),
    )


_PARTS = ("id", "source", "size", "key", "range", "inside", "source_size", "target", "epochs", "taken")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "0",
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, epochs (whole
    passes of its source), taken (words, repeats counted)."""
    require(docs, id_col, text_col, source_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return _decided(rows, {k: k for k in _PARTS} | {"id": "doc_id"}, weights, share, max_epochs, seed)


def sample(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    count_col: str | None = None,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "0",
) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it.

    Whole passes give copies. The one document of a source in which its budget
    ends gives a row of the words that are left, joined by blanks. Documents not
    taken go; documents without words weigh nothing and stay. All columns stay;
    ``count_col``, if given, gets a shortened text's number of characters.
    """
    require(docs, id_col, text_col, source_col)
    names = docs.columns
    name = {k: spare(docs, f"_mix_{k}") for k in (*_PARTS, "rows")} | {"id": id_col, "source": source_col}
    rows = docs.withColumn(name["size"], word_count(F.col(text_col)))
    out = _decided(rows, name, weights, share, max_epochs, seed)
    size, taken, left = (F.col(name[k]) for k in ("size", "taken", "rows"))
    out = out.where((taken > 0) | (size == 0))
    # 0 for each whole pass, and the number of words of a part.
    whole = F.when(size == 0, F.lit(1)).otherwise(F.floor(taken / size)).cast("int")
    part = F.when(size == 0, F.lit(0)).otherwise(F.pmod(taken, size)).cast("int")
    out = out.withColumn(name["rows"], F.explode(F.concat(F.array_repeat(F.lit(0), whole), F.array_repeat(part, F.when(part > 0, 1).otherwise(0)))))
    first = F.array_join(F.slice(F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.greatest(left, F.lit(1))), " ")
    out = out.withColumn(text_col, F.when(left > 0, first).otherwise(F.col(text_col)))
    if count_col:
        out = out.withColumn(count_col, F.when(left > 0, F.length(text_col).cast("bigint")).otherwise(F.col(count_col)))
    return out.select(*names)
