"""Connected components of an edge table, by contraction, without the driver.

In each round every node points at the node of least hash among itself and its
neighbours, pointers are followed twice, and the ends of the edges are renamed;
edges inside a component vanish. The hash order is new in every round, so chains
of any order shrink by a constant factor, and a star takes a round or two, as
minima are combined before the shuffle. Edges and pointers stay distributed and
are cut by tables in the shared folder, which go when the next round has been made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); component is its least node.

    Loops and repeated edges do no harm; an empty table gives an empty one. The result
    is a ``cut`` table.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found, turn = None, 0
    while not edges.isEmpty():
        place = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        to = both.groupBy("node").agg(F.min(place("other")).alias("best"))
        first = cut(to.select("node", F.least("best", place("node"))["to"].alias("to")))
        to = first
        for _ in range(2):
            to = to.alias("x").join(to.alias("y"), F.expr("x.to = y.node")).select("x.node", F.col("y.to").alias("to"))
        to = cut(to)
        discard(first)
        old, before = edges, found
        if found is None:
            found = to
        else:
            found = cut(found.alias("f").join(to.alias("t"), F.expr("f.to = t.node"), "left").select("f.node", F.expr("coalesce(t.to, f.to)").alias("to")))
        left = edges.alias("e").join(to.alias("x"), F.expr("e.a = x.node")).join(to.alias("y"), F.expr("e.b = y.node"))
        left = left.select(F.greatest("x.to", "y.to").alias("a"), F.least("x.to", "y.to").alias("b")).where("a <> b").distinct()
        edges = cut(left)
        discard(old)
        if before is not None:
            discard(before)
            discard(to)
        turn += 1
    if found is None:
        found = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("to")))
    least = found.groupBy("to").agg(F.min("node").alias("component"))
    out = cut(found.join(least, "to").select("node", "component"))
    discard(edges)
    discard(found)
    return out
