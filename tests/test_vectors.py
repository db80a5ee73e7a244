"""The vector index against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.operators import joins, vectors


def brute(queries, points, k, itself):
    out = {}
    for i, v in queries:
        near = sorted((float(np.sqrt(((np.array(w) - v) ** 2).sum())), j) for j, w in points if itself or j != i)[:k]
        out[i] = [(j, d) for d, j in near]
    return out


@pytest.mark.parametrize(("k", "itself", "cells"), [(2, False, None), (1, True, 7), (3, False, 1)])
def test_exact_with_copies_and_a_hot_cell(spark, k, itself, cells):
    rng = np.random.default_rng(k)
    points = [(i, (rng.normal(size=5) + 8 * (i % 4)).tolist()) for i in range(300)]
    points += [(1000 + i, points[3][1]) for i in range(150)]  # one cell holds a third
    rows = spark.createDataFrame([*points, (9999, None)], "id bigint, v array<double>")
    queries = [p for p in points if p[0] % 20 == 0] + [(-1, [100.0] * 5)]
    asked = spark.createDataFrame([*queries, (-2, None)], rows.schema)
    got = {}
    for r in vectors.nearest(asked, rows, id_col="id", vector="v", k=k, itself=itself, cells=cells).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, r.distance))
        assert 1 <= r.opened <= 40
    want = brute([(i, np.array(v)) for i, v in queries], points, k, itself)
    assert got.keys() == want.keys()
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]]
        assert np.allclose([d for _, d in got[i]], [d for _, d in want[i]], atol=1e-12)


def test_most_cells_stay_closed(spark):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, (30 * (i % 25) + rng.normal(size=4)).tolist()) for i in range(1000)], "id bigint, v array<double>")
    out = vectors.nearest(rows.where("id % 20 = 0"), rows, id_col="id", vector="v", k=2, itself=False)
    assert out.agg(F.avg("opened")).first()[0] < 8


def test_few_and_no_vectors(spark):
    rows = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "id bigint, v array<double>")
    assert [(r.query, r.id, r.distance) for r in vectors.nearest(rows, rows, id_col="id", vector="v", k=5, itself=False).orderBy("query").collect()] == [(1, 2, 3.0), (2, 1, 3.0)]
    assert vectors.nearest(rows, rows.limit(0), id_col="id", vector="v").count() == 0


def test_ratio_matches(spark):
    rows = [(None, q, r, d) for q, near in {1: [(7, 1.0), (8, 2.0), (9, 3.0)], 2: [(7, 1.0), (8, 1.2)], 3: [(9, 0.5), (9, 0.5), (8, 1.0)], 4: [(9, 0.1)], 5: [(7, 0.0), (8, 0.0)]}.items() for r, d in near]
    rows += [("b", 1, 7, 1.0), ("b", 1, 8, 9.0), ("b", 2, 8, None)]
    df = spark.createDataFrame(rows, "pair string, q int, r int, d double")
    got = joins.ratio_matches(df, ["pair"], left="q", right="r", distance="d", least=2).collect()
    assert sorted((x.pair, x.q, x.r, x.d) for x in got) == [(None, 1, 7, 1.0), (None, 3, 9, 0.5)]
