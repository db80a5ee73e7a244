"""Operators along time against plain restatements on random and odd data."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from veldspar.operators import changelog, joins, timeops
from veldspar.operators.ordered import carried, numbered, previous, running

SCHEMA = "s string, t double, i bigint"


def rows_of(seed, n, sessions=3, spread=40):
    r = random.Random(seed)
    return [(f"s{r.randrange(sessions)}", float(r.randrange(spread)), i) for i in range(n)]


def nearest_by_bisect(times, t, tie):
    k = bisect.bisect_left(times, t)
    if not times:
        return None
    if k == 0:
        return 0
    if k == len(times):
        return len(times) - 1
    back, ahead = t - times[k - 1], times[k] - t
    return k - 1 if (back <= ahead if tie == "earlier" else back < ahead) else k


@pytest.mark.parametrize("tie", ["earlier", "later"])
@pytest.mark.parametrize("width", [5.0, 1e9])
def test_nearest_equals_bisect(spark, tie, width):
    left, right = rows_of(1, 120), rows_of(2, 90, sessions=2)
    out = timeops.nearest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["s"], right_order=["i"], values=["i"], tie=tie, width=width)
    by = {}
    for s, t, i in right:
        by.setdefault(s, []).append((t, i))
    for v in by.values():
        v.sort()
    got = {r.i: r.near_i for r in out.collect()}
    assert len(got) == len(left)
    for s, t, i in left:
        own = by.get(s, [])
        k = nearest_by_bisect([x for x, _ in own], t, tie)
        assert got[i] == (None if k is None else own[k][1])


def test_nearest_tolerance_and_empty(spark):
    left = spark.createDataFrame([("a", 0.0, 1), ("a", 9.0, 2)], SCHEMA)
    right = spark.createDataFrame([("a", 0.04, 7)], SCHEMA)
    out = timeops.nearest(left, right, ["s"], values=["i"], tolerance=0.05)
    assert {r.i: r.near_i for r in out.collect()} == {1: 7, 2: None}
    none = timeops.nearest(left, right.limit(0), ["s"], values=["i"])
    assert [r.near_i for r in none.collect()] == [None, None]


@pytest.mark.parametrize("width", [3.0, 1e9])
def test_scans_equal_plain_loops(spark, width):
    rows = rows_of(3, 150)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    state = {}
    for s, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        before, total, count = state.get(s, (None, 0, 0))
        want[i] = (before, total + i, count)
        state[s] = (i, total + i, count + 1)
    out = previous(df, ["s"], ["t", "i"], {"p": "i"}, width=width)
    out = running(out, ["s"], ["t", "i"], {"total": F.col("i")}, width=width)
    out = numbered(out, ["s"], ["t", "i"], width=width)
    assert {r.i: (r.p, r.total, r.row_index) for r in out.collect()} == want


def test_carried_skips_nulls_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0, 1, None), (None, 2.0, 2, 5), (None, 100.0, 3, None), (None, 300.0, 4, 8)], SCHEMA + ", v int")
    out = carried(df, ["s"], ["t", "i"], F.col("v"), forward="f", backward="b", width=10.0)
    assert {r.i: (r.f, r.b) for r in out.collect()} == {1: (None, 5), 2: (None, 8), 3: (5, 8), 4: (5, None)}


def test_segments_collapse_empty_ones(spark):
    rows = spark.createDataFrame([("a", float(t), i) for i, t in enumerate([0, 1, 2, 5, 6, 9])], SCHEMA)
    breaks = spark.createDataFrame([("a", 2.0), ("a", 3.0), ("a", 4.0), ("a", 9.0), ("a", 20.0)], "s string, t double")
    got = [r.segment for r in timeops.segments(rows, breaks, ["s"], order=["i"]).orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 2, 3]


def test_rate_gate_steps(spark):
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate([0.0, 0.05, 0.11, 0.19, 0.2, 0.9, 0.95, 1.0])], SCHEMA)
    got = [r.fires for r in timeops.rate_gate(df, ["s"], order=["i"], hz=10.0).orderBy("i").collect()]
    due, want = None, []
    for t in [0.0, 0.05, 0.11, 0.19, 0.2, 0.9, 0.95, 1.0]:
        fires = due is None or t >= due
        want.append(fires)
        if fires:
            due = t + 0.1 if due is None or t - due >= 0.1 else due + 0.1
    assert got == want


def test_row_windows_pinned(spark):
    for n, size, step in ((0, 4, 2), (1, 4, 2), (4, 4, 3), (9, 4, 3), (10, 4, 3), (11, 5, 5)):
        df = spark.createDataFrame([("a", float(i), i) for i in range(n)], SCHEMA)
        got = timeops.row_windows(df, ["s"], order=["t", "i"], size=size, step=step).groupBy("window_start").agg(F.sort_array(F.collect_list("i")).alias("v"))
        starts = list(range(0, max(n - size, 0) + 1, step)) if n else []
        if n and starts[-1] + size < n:
            starts.append(n - size)
        assert {r.window_start: r.v for r in got.collect()} == {a: list(range(a, min(n, a + size))) for a in starts}


def test_focus_settle_cases(spark):
    def settle(values, dt=0.2):
        df = spark.createDataFrame([("a", i * dt, float(v)) for i, v in enumerate(values)], "s string, t double, fx double")
        origin = spark.createDataFrame([("a", 0.0)], "s string, t0 double")
        return [r.settled for r in timeops.focus_settle(df, ["s"], origin=origin).collect()]

    assert settle([1500] * 8) == [0.0]
    assert settle([1500] * 5) == []
    assert settle([1500 - 30 * min(i, 7) for i in range(20)]) == [pytest.approx(8 * 0.2)]
    assert settle([1500 + 30 * (i % 2) for i in range(20)]) == [None]


def test_interval_average_counts_borders_twice(spark):
    ivs = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 2.0), ("a", 5.0, 6.0)], "s string, a double, b double")
    dots = spark.createDataFrame([("a", 0.5, 2.0), ("a", 1.0, 4.0), ("a", 1.5, 6.0)], "s string, t double, v double")
    out = timeops.interval_average(ivs, dots, ["s"], start="a", end="b", value="v", name="m", width=0.7).orderBy("a").collect()
    assert [(r.m, r.m_n) for r in out] == [(3.0, 2), (5.0, 2), (None, 0)]


def test_changelog_compaction_and_throttle(spark):
    log = spark.createDataFrame(
        [("a", 0.0, 0, "p", "added"), ("a", 0.1, 1, "p", "updated"), ("a", 0.5, 2, "p", "updated"), ("a", 1.2, 3, "p", "updated"), ("a", 1.3, 4, "p", "removed"), ("a", 1.4, 5, "p", "updated"), ("a", 0.0, 6, "q", "added"), ("a", 3.0, 7, "q", "removed")],
        SCHEMA + ", id string, event string",
    )
    assert [(r.id, r.i) for r in changelog.compact(log, ["s"], key="id", order=["i"]).collect()] == [("p", 5)]
    kept = changelog.throttle(log, ["s", "id"], order=["i"])
    assert sorted(r.i for r in kept.collect()) == [0, 3, 4, 5, 6, 7]


def test_idle_sessions_and_transitions(spark):
    df = spark.createDataFrame([("a", float(t), i) for i, t in enumerate([0, 6, 12.5, 13])], SCHEMA)
    got = [(r.session, r.start, r.end, r.rows) for r in changelog.idle_sessions(df, ["s"], order=["i"]).orderBy("session").collect()]
    assert got == [(1, 0.0, 6.0, 2), (2, 12.5, 13.0, 2)]
    hot = changelog.transitions(df, ["s"], order=["i"], hot=F.col("t").between(6, 12.5))
    assert sorted((r.i, r.throttled) for r in hot.collect()) == [(1, True), (3, False)]


def test_posed_images_take_the_last_pose(spark):
    frames = spark.createDataFrame([("a", 5, 1.0), ("a", 6, 2.0)], "s string, frame bigint, t double")
    poses = spark.createDataFrame([("a", 5, 0.9, 0), ("a", 5, 1.1, 1)], "s string, frame bigint, t double, ordinal bigint")
    assert [(r.frame, r.pose_t) for r in joins.posed_images(frames, poses, ["s"]).collect()] == [(5, 1.1)]


def test_exact_or_nearest(spark):
    left = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "s string, frame bigint, t double")
    right = spark.createDataFrame([("a", 1, 1.4, 0), ("a", 9, 2.2, 1)], "s string, frame bigint, t double, ordinal bigint")
    out = {r.frame: (r.depth_frame, round(r.depth_dt, 6)) for r in joins.exact_or_nearest(left, right, ["s"], values=["frame"]).collect()}
    assert out == {1: (1, 0.0), 2: (9, -0.2)}


def test_low_pass_keeps_constants(spark):
    df = spark.createDataFrame([("a", i / 50, 3.0) for i in range(30)], "s string, t double, v double")
    assert all(abs(r.smooth - 3.0) < 1e-9 for r in timeops.low_pass(df, ["s"], value="v").collect())
