"""Null keys and times, clashing names, repeated intervals, and windows over blocks."""

import random

import numpy as np

from veldspar.operators import cloud, joins, odometry, quality, timeops


def test_nearest_null_times_and_clashing_names(spark):
    left = spark.createDataFrame([("s", 1.0, 7), ("s", None, 8), (None, 2.0, 9)], "s string, t double, __row int")
    right = spark.createDataFrame([("s", 1.5, 0, 5), (None, 2.5, 0, 6), ("s", None, 1, 7)], "s string, t double, ordinal int, v int")
    out = {r["__row"]: (r.near_v, r.near_dt) for r in timeops.nearest(left, right, ["s"], values=["v"], right_order=["ordinal"]).collect()}
    assert out == {7: (5, -0.5), 8: (None, None), 9: (6, -0.5)}


def test_repeated_intervals_and_null_samples(spark):
    ivs = spark.createDataFrame([("s", 0.0, 2.0)] * 2 + [("s", 5.0, 6.0), (None, 0.0, 9.0), ("s", None, 1.0)], "s string, a double, b double")
    dots = spark.createDataFrame([("s", 0.0, 1.0), ("s", 1.0, 3.0), ("s", 2.0, None), (None, 4.0, 8.0)], "s string, t double, v double")
    out = timeops.interval_average(ivs, dots, ["s"], start="a", end="b", value="v", name="m", width=1.0).collect()
    got = sorted(((r.s, r.a, r.m, r.m_n) for r in out), key=repr)
    assert got == sorted([("s", 0.0, 2.0, 2), ("s", 0.0, 2.0, 2), ("s", 5.0, None, 0), (None, 0.0, 8.0, 1), ("s", None, None, 0)], key=repr)


def test_null_session_keys_are_kept(spark):
    rows = spark.createDataFrame([(None, i) for i in range(12)] + [("a", 1)], "s string, f int")
    assert quality.gate_segments(rows, ["s"]).count() == 12
    assert joins.usable(rows, [rows, rows], ["s", "f"]).count() == 13
    assert joins.uncovered(rows, rows, ["s", "f"]).count() == 0
    assert joins.pending(rows, rows.limit(0), rows.where("f = 1"), ["s", "f"]).count() == 11
    assert {r.s: (r.matched, r.dropped) for r in joins.unmatched(rows, rows.where("f < 3"), ["s"], ["s", "f"]).collect()} == {None: (3, 9), "a": (1, 0)}


def test_rolling_fraction_over_blocks(spark):
    r = random.Random(4)
    values = [r.choice([None, 0.001, 0.01]) for _ in range(9500)]
    df = spark.createDataFrame([("s", float(i), v) for i, v in enumerate(values)], "s string, t double, v double")
    out = {x.t: x.below for x in quality.rolling_below(df, ["s"], ["t"], "v", width=700.0).collect()}
    some = [(float(i), v) for i, v in enumerate(values) if v is not None]
    for k, (t, _) in enumerate(some):
        part = [v < 0.007 for _, v in some[max(0, k - 149) : k + 1]]
        assert abs(out[t] - sum(part) / len(part)) < 1e-12


def test_focus_settles_over_blocks(spark):
    n, quiet = 9000, 8190
    fx = np.cumsum([0.0] + [20.0 if i < quiet else 1.0 for i in range(1, n)])
    df = spark.createDataFrame([("s", float(i), float(f)) for i, f in enumerate(fx)] + [("s", float("inf"), 1.0), ("s", 3.0, float("nan"))], "s string, t double, fx double")
    out = timeops.focus_settle(df, ["s"], origin=spark.createDataFrame([("s", 0.0)], "s string, t0 double"), width=500.0).collect()
    assert [(x.samples, x.settled) for x in out] == [(n, float(quiet))]


def test_capped_votes(spark):
    rows = [("s", k, 0.1, 0.0, 0.0) for k in range(20)] + [("s", 20, 0.4, 0.0, 0.0)]
    out = cloud.voxel_fuse(spark.createDataFrame(rows, "s string, f int, x double, y double, z double"), ["s"], frame="f", size=1.0, max_weight=20).first()
    assert abs(out.px - (20 * 0.1 + 0.4) / 21) < 1e-12 and out.w == 20
    m = odometry.VoxelMap(size=1.0, max_weight=20)
    for _, _, *p in rows:
        m.add(np.array([p]), np.array([[0.0, 0.0, 1.0]]))
    (cell,) = m.cells
    assert abs(cell[0] - out.px) < 1e-12 and cell[6] == 20


def test_odometry_logs(spark):
    from veldspar.sources.session import LOG_PATTERNS, odometry_logs

    text = """s1: 120 depth frames, stride 1
  frame-only conditioning  median 0.012  p10 0.004  degenerate 3/120
  cond < 0.01 3 frames
  cond >= 0.05 100 frames  translation median 0.4 cm p90 0.8 cm  rotation median 0.06°
  rotation  median 0.06°  p90 0.21°
  ICP inliers: median 71%"""
    row, empty = odometry_logs(spark.createDataFrame([(0, text), (1, None)], "i int, value string"), "value").orderBy("i").collect()
    assert row.frames == [None, 120.0] and row.frames_text == ["s1", "120"] and row.cond == [0.012, 0.004, 3.0, 120.0] and row.rpe_rot == [0.06, 0.21] and row.inliers == [71.0] and row.loop is None
    assert [tuple(b) for b in row.bands] == [("cond < 0.01", 3, None, None), ("cond >= 0.05", 100, 0.4, 0.8)]
    assert all(empty[k] is None for k in LOG_PATTERNS) and empty.bands == []


def test_throttled_rows_fire_no_gate(spark):
    rows = [("s", i / 10, 3 <= i < 7) for i in range(12)]
    df = spark.createDataFrame(rows, "s string, t double, hot boolean")
    out = {r.t: (r.image, r.depth) for r in timeops.coupled_gates(df, ["s"], image_hz=2.0, depth_hz=5.0, throttled="hot").collect()}
    cool = {r.t: (r.image, r.depth) for r in timeops.coupled_gates(df.where("not hot"), ["s"], image_hz=2.0, depth_hz=5.0).collect()}
    assert out == cool | {t: (False, False) for _, t, hot in rows if hot}


def test_fusion_scores(spark):
    from veldspar.operators import trajectory

    r = random.Random(3)
    rows = [("s", ["anchor", "between", "outside"][i % 3], *[float(r.random()) for _ in range(3)]) for i in range(90)]
    rows = [(*x, x[2] + 0.1 * (i % 2), x[3], x[4], x[2] + 0.5 * (i % 2), x[3], x[4]) for i, x in enumerate(rows)]
    df = spark.createDataFrame(rows, "s string, position string, rx double, ry double, rz double, fx double, fy double, fz double, ox double, oy double, oz double")
    out = {x["class"]: x for x in trajectory.fusion_scores(df, ["s"], fused_axes=("fx", "fy", "fz"), other_axes=("ox", "oy", "oz"), reference=("rx", "ry", "rz")).collect()}
    assert {k: v.frames for k, v in out.items()} == {"anchor": 30, "between": 30, "non-anchor": 60}
    assert all(v.better and v.not_worse and v.delta < 0 for v in out.values())
