"""Exact nearest vectors by cells.

Centres are fitted on a bounded sample; every vector goes to the cell of its nearest centre. By the triangle
inequality, no vector of a cell is nearer to a query than its distance from the centre less the cell's radius (or
than the cell's least distance from its centre less that of the query). A first round opens the cells that bound a
query's k-th distance; a second one opens the cells that the bound doesn't rule out. Cells are kept as blocks of a
bounded number of vectors, so a cell that holds a third of them is many rows; a block meets a chunk of queries as
one product of matrices. The sample decides how many cells are opened, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import cut

#: Rows that centres are fitted on, centres at most, vectors of a block, and queries of a chunk.
SAMPLE, CELLS, BLOCK, CHUNK = 20_000, 1024, 2048, 256
_FOUND = "query bigint, cell bigint, distance double, id bigint"


def centres(vectors: DataFrame, vector: str, *, cells: int | None = None, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Centres of about as many cells as the root of the number of rows, from at most ``sample`` rows chosen by hash."""
    whole = vectors.where(F.col(vector).isNotNull())
    n = whole.count()
    if not n:
        return np.zeros((0, 0))
    chosen = whole.orderBy(F.xxhash64(F.col(vector).cast("array<double>"))).limit(sample) if n > sample else whole
    rows = np.array([r[0] for r in chosen.select(F.col(vector).cast("array<double>")).collect()], float)
    rows = np.unique(rows, axis=0)
    k = min(len(rows), cells or min(CELLS, max(1, int(n**0.5))))
    out = rows[np.linspace(0, len(rows) - 1, k).astype(int)]
    for _ in range(rounds):
        near = _squares(rows, out).argmin(1)
        sums = np.zeros_like(out)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=k)
        out = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], out)
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, by one product; rounding may leave them a little off."""
    return np.maximum(0.0, (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def _dealt(vectors: DataFrame, id_col: str, vector: str, at: np.ndarray) -> DataFrame:
    """(id, v, cell, r): each vector with its nearest centre and the distance from it; null vectors are left out."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                v = _matrix(part.column(1))
                near = _squares(v, at).argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int64)), pa.array(np.sqrt(((v - at[near]) ** 2).sum(1)))], names=["id", "v", "cell", "r"])

    return rows.mapInArrow(task, "id bigint, v array<double>, cell bigint, r double")


def _share(sizes: dict[int, int], most: int) -> Column:
    """The share of its cell (by hash of its id) that a row is in, so that shares hold about ``most`` rows."""
    parts = F.array(*[F.lit(-(-sizes.get(c, 0) // most) or 1) for c in range(max(sizes, default=0) + 1)])
    return F.pmod(F.xxhash64("id"), F.get(parts, F.col("cell").cast("int")))


def _met(queries: DataFrame, blocks: DataFrame, k: int, itself: bool) -> DataFrame:
    """(query, cell, distance, id): the k nearest of each block that a query (id, v, cell) opens."""
    queries = cut(queries)
    sizes = {r.cell: r.n for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each centre
    chunks = queries.groupBy("cell", _share(sizes, CHUNK).alias("chunk")).agg(F.collect_list(F.struct("id", "v")).alias("asked"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.array([x["id"] for x in row["held"]])
                v, w = (np.array([x["v"] for x in row[name]], float) for name in ("held", "asked"))
                rough = _squares(w, v)
                found = []
                for i, x in enumerate(row["asked"]):
                    own = rough[i] if itself else np.where(ids == x["id"], np.inf, rough[i])
                    few = min(k, len(own))
                    # What rounding can't tell from the k-th is measured again, plainly.
                    slack = 1e-9 * (1 + (w[i] ** 2).sum() + (v**2).sum(1).max())
                    near = np.flatnonzero(own <= np.partition(own, few - 1)[few - 1] + slack)
                    near = near[np.isfinite(own[near])]
                    exact = np.sqrt(((v[near] - w[i]) ** 2).sum(1))
                    for j in np.lexsort((ids[near], exact))[:k]:
                        found.append((x["id"], row["cell"], float(exact[j]), int(ids[near[j]])))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["query", "cell", "distance", "id"])

    met = chunks.join(blocks, "cell").select("cell", "asked", "held")
    return met.mapInArrow(task, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, one rank after the other: no list of all is kept."""
    rest, out = found.select("query", F.struct("distance", "id").alias("n")).distinct(), None
    for rank in range(1, k + 1):
        least = rest.groupBy("query").agg(F.min("n").alias("least"))
        one = least.select("query", F.lit(rank).alias("rank"), "least.distance", "least.id")
        out = one if out is None else out.unionByName(one)
        rest = rest.join(least, "query").where(F.col("n") > F.col("least")).drop("least")
    return out


def nearest(queries: DataFrame, vectors: DataFrame, *, id_col: str, vector: str, k: int = 2, itself: bool = True, cells: int | None = None) -> DataFrame:
    """For each query its ``k`` nearest vectors, exact: query, rank, id, distance, opened (cells that were read for it).

    Equal distances go to the smaller id. Without ``itself`` a vector of the query's id is none. Null vectors ask and
    are nothing; fewer than ``k`` vectors give fewer rows; ids are whole numbers, unique on either side.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    spark = queries.sparkSession
    at = centres(vectors, vector, cells=cells)
    if not len(at):
        return spark.createDataFrame([], "query bigint, rank int, id bigint, distance double, opened bigint")
    dealt = cut(_dealt(vectors, id_col, vector, at))
    stats = {r.cell: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most")).collect()}  # a row for each centre
    used = np.array(sorted(stats))
    held, least, most = (np.array([stats[c][i] for c in used], float) for i in ("n", "least", "most"))
    middle = at[used]
    blocks = dealt.groupBy("cell", _share({c: r.n for c, r in stats.items()}, BLOCK).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("held"))
    blocks = cut(blocks.select("cell", "held"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    need = k + (not itself)

    def opening(later: bool):
        """Cells to open: at first the nearest that hold enough, later those that the bound doesn't rule out."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    v = _matrix(part.column(1))
                    far = np.sqrt(_squares(v, middle))
                    low = np.maximum(0.0, np.maximum(far - most, least - far))
                    order = np.argsort(far, axis=1)
                    enough = np.cumsum(held[order], axis=1) - held[order] < need
                    first = np.zeros(far.shape, bool)
                    np.put_along_axis(first, order, enough, 1)
                    if later:
                        bound = part.column(2).to_numpy(zero_copy_only=False)[:, None]
                        first = ~first & (low <= bound * (1 + 1e-9) + 1e-9)
                    i, c = np.nonzero(first)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)), pa.array(used[c])], names=["id", "v", "cell"])

        return task

    shape = "id bigint, v array<double>, cell bigint"
    first = cut(_met(asked.mapInArrow(opening(False), shape), blocks, k, itself))
    # A query with fewer than k found so far is bounded by nothing.
    bounds = _best(first, k).groupBy("query").agg(F.max("distance").alias("bound"), F.count("*").alias("n"))
    bounded = asked.join(bounds.withColumnRenamed("query", "id"), "id", "left").select("id", "v", F.when(F.col("n") >= k, F.col("bound")).otherwise(float("inf")).alias("bound"))
    later = cut(_met(bounded.mapInArrow(opening(True), shape), blocks, k, itself))
    found = first.unionByName(later)
    opened = found.groupBy("query").agg(F.count_distinct("cell").alias("opened"))
    return _best(found, k).join(opened, "query").select("query", "rank", "id", "distance", "opened")
