"""Geometry, trajectories and clouds against numpy."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.functions import display, geometry as g, lens
from veldspar.operators import cloud, joins, odometry, quality, trajectory

RNG = np.random.default_rng(0)


def rotation(rng):
    q = rng.normal(size=4)
    x, y, z, w = q / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def pose(rng):
    p = np.eye(4)
    p[:3, :3], p[:3, 3] = rotation(rng), rng.normal(size=3)
    return p


def test_quaternion_round_trip_and_zero(spark):
    qs = RNG.normal(size=(40, 4)).tolist() + [[0.0] * 4, [1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0]]
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(qs)], "i int, x double, y double, z double, w double")
    out = df.withColumn("m", g.quaternion_to_matrix("x", "y", "z", "w")).withColumn("q", g.matrix_to_quaternion("m")).orderBy("i").collect()
    for r, q in zip(out, qs, strict=True):
        m = np.array(r.m).reshape(3, 3)
        assert np.allclose(m @ m.T, np.eye(3)) and np.isclose(np.linalg.det(m), 1)
        if any(q):
            u = np.array(q) / np.linalg.norm(q)
            v = np.array([r.q.x, r.q.y, r.q.z, r.q.w])
            assert min(abs(u - v).max(), abs(u + v).max()) < 1e-9


def test_relative_pose_rigidity_and_angle(spark):
    a, b = pose(RNG), pose(RNG)
    bad = a.copy()
    bad[0, 0] += 1e-3
    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist(), bad.ravel().tolist())], "a array<double>, b array<double>, bad array<double>")
    r = df.select(g.relative_pose("a", "b").alias("r"), g.is_rigid("a").alias("ok"), g.is_rigid("bad").alias("no"), g.rotation_angle("a", 4).alias("angle")).first()
    assert np.allclose(np.array(r.r).reshape(4, 4), np.linalg.inv(a) @ b)
    assert r.ok and not r.no
    assert np.isclose(r.angle, np.arccos((np.trace(a[:3, :3]) - 1) / 2))


def test_minimal_rotation(spark):
    pairs = [((1, 0, 0), (0, 1, 0)), ((0, 0, 1), (0, 0, -1)), ((0.6, 0.8, 0), (0.6, 0.8, 0)), ((1, 0, 0), (-1, 0, 0))]
    for a, b in pairs:
        m = np.array(spark.range(1).select(g.minimal_rotation([F.lit(float(v)) for v in a], [F.lit(float(v)) for v in b]).alias("m")).first().m).reshape(3, 3)
        assert np.allclose(m @ np.array(a), b, atol=1e-9) and np.isclose(np.linalg.det(m), 1)


def test_rigid_interpolation_ends_and_middle(spark):
    one = F.struct(*[F.lit(v).alias(k) for k, v in zip(("x", "y", "z", "w", "tx", "ty", "tz"), (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), strict=True)])
    two = F.struct(*[F.lit(v).alias(k) for k, v in zip(("x", "y", "z", "w", "tx", "ty", "tz"), (0.0, 0.0, 1.0, 0.0, 2.0, 0.0, 0.0), strict=True)])
    for alpha, w, tx in ((-1.0, 1.0, 0.0), (0.5, np.sqrt(0.5), 1.0), (2.0, 0.0, 2.0)):
        r = spark.range(1).select(g.rigid_interpolation(one, two, F.lit(alpha)).alias("p")).first().p
        assert np.isclose(r.w, w, atol=1e-9) and np.isclose(r.tx, tx)


def test_orientation_and_display(spark):
    rows = spark.createDataFrame([(0.0, -1.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (1e-4, 0.0), (None, 1.0)], "x double, y double")
    got = [r[0] for r in rows.select(g.orientation(g.upright_roll("x", "y"))).collect()]
    assert got == ["landscape", "portrait", "portrait (inverted)", "landscape (upside down)", None, None]
    paths = spark.createDataFrame([("a/b",), ("a",), (".x/b",), ("a/.complete",), ("a/%2e",), ("a//b",)], "p string")
    assert [r[0] for r in paths.select(display.safe_upload_path(F.col("p"))).collect()] == [True, False, False, True, False, False]
    d = spark.createDataFrame([(59.9,), (61.0,), (3661.0,)], "s double")
    assert [r[0] for r in d.select(display.duration(F.col("s"))).collect()] == ["0:59", "1:01", "1:01:01"]


def test_lens_table_clamps(spark):
    t = F.array(F.lit(0.0), F.lit(1.0), F.lit(4.0))
    r = spark.createDataFrame([(0.0,), (0.5,), (1.5,), (9.0,)], "r double").select(lens.magnification(F.col("r"), t, F.lit(2.0))).collect()
    assert [x[0] for x in r] == [0.0, 0.5, 2.5, 4.0]


@pytest.mark.parametrize("scaled", [False, True])
def test_alignment_recovers_a_similarity(spark, scaled):
    rot, k = rotation(RNG), 1.7 if scaled else 1.0
    p = RNG.normal(size=(60, 3))
    q = k * p @ rot.T + np.array([1.0, -2.0, 0.5])
    df = spark.createDataFrame([("a", *map(float, [*a, *b])) for a, b in zip(p, q, strict=True)], "s string, x double, y double, z double, u double, v double, w double")
    out = trajectory.trajectory_error(df, ["s"], ("x", "y", "z"), ("u", "v", "w"), scaled=scaled).first()
    assert out.ate_mean < 1e-9 and out.rows == 60


@pytest.mark.parametrize("size", [24, 48, 96])
def test_chain_of_windows(spark, size):
    rng = np.random.default_rng(7)
    t = np.linspace(0, 2 * np.pi, 240, endpoint=False)
    truth = np.stack([3 * np.cos(t), 0.2 * np.sin(3 * t), 2 * np.sin(t)], 1)
    rows = []
    for k, a in enumerate(range(0, 240 - size + 1, size // 2)):
        rot, scale, shift = (np.eye(3), 1.0, np.zeros(3)) if k == 0 else (rotation(rng), rng.uniform(0.5, 2), rng.normal(size=3))
        rows += [("a", k, f, *map(float, scale * rot @ truth[f] + shift)) for f in range(a, a + size)]
    df = spark.createDataFrame(rows, "s string, window int, frame bigint, x double, y double, z double")
    out = trajectory.chain(df, ["s"]).orderBy("frame").collect()
    assert max(np.linalg.norm(np.array([r.x, r.y, r.z]) - truth[r.frame]) for r in out) < 1e-9


def test_chain_refuses_short_overlap(spark):
    df = spark.createDataFrame([("a", 0, 1, 0.0, 0.0, 0.0), ("a", 1, 2, 0.0, 0.0, 0.0)], "s string, window int, frame bigint, x double, y double, z double")
    with pytest.raises(Exception, match="shares 0 frames"):
        trajectory.chain(df, ["s"]).collect()


def test_voxel_neighbours_equal_brute_force(spark):
    p, m = RNG.uniform(0, 1, (60, 3)), RNG.uniform(0, 1, (80, 3))
    cols = "s string, point_id int, x double, y double, z double"
    a = spark.createDataFrame([("a", i, *map(float, v)) for i, v in enumerate(p)], cols)
    b = spark.createDataFrame([("a", *map(float, v)) for v in m], "s string, x double, y double, z double")
    got = {r.point_id: r.d2 for r in joins.voxel_neighbours(a, b, ["s"], size=0.2, max_dist=0.2).collect()}
    d2 = ((p[:, None] - m[None]) ** 2).sum(2).min(1)
    assert got.keys() == {i for i, d in enumerate(d2) if d < 0.04}
    assert all(np.isclose(got[i], d2[i]) for i in got)


def test_voxel_cap_forgets(spark):
    df = spark.createDataFrame([("a", f, 0.01 * f, 0.0, 0.0) for f in range(6)], "s string, frame int, x double, y double, z double")
    out = cloud.voxel_fuse(df, ["s"], frame="frame", size=1.0, max_weight=3).first()
    mean, w = 0.0, 0.0
    for f in range(6):
        k = min(w, 3.0)
        mean, w = (mean * k + 0.01 * f) / (k + 1), min(w + 1, 3.0)
    assert np.isclose(out.px, mean) and out.w == 3.0


def test_conditioning_of_a_wall_is_zero(spark):
    rows = [("a", float(x), float(y), 2.0, 0.0, 0.0, -1.0) for x in range(5) for y in range(5)]
    out = cloud.conditioning(spark.createDataFrame(rows, "s string, x double, y double, z double, nx double, ny double, nz double"), ["s"]).first()
    assert out.cond < 1e-9 and len(out.weak) == 6


def test_box_smooth_keeps_edges_and_gaps():
    z = np.ones((12, 12))
    z[:, 6:] = 2.0
    z[0, 0] = np.nan
    out = cloud.box_smooth(z)
    assert np.isnan(out[0, 0]) and np.allclose(out[:, 0:3][~np.isnan(out[:, 0:3])], 1.0) and np.allclose(out[:, 9:], 2.0)
    assert np.allclose(out[3:9, 5], 1.0)


def room(n=1500, rng=None):
    rng = rng or np.random.default_rng(3)
    parts, normals = [], []
    for axis in range(3):
        p = rng.uniform(-1, 1, (n // 3, 3))
        p[:, axis] = 1.5
        nrm = np.zeros_like(p)
        nrm[:, axis] = -1
        parts.append(p)
        normals.append(nrm)
    return np.concatenate(parts), np.concatenate(normals)


def test_tracker_follows_a_walk():
    points, normals = room()
    tracker = odometry.Tracker()
    for k in range(6):
        truth = odometry.exp(np.array([0, 0.01 * k, 0, 0.02 * k, 0, 0.01 * k]))
        inv = np.linalg.inv(truth)
        out = tracker.step(points @ inv[:3, :3].T + inv[:3, 3], normals @ inv[:3, :3].T)
        assert out["ok"] and np.linalg.norm(out["pose"][:3, 3] - truth[:3, 3]) < 0.02


def test_track_query_form(spark):
    points, normals = room(450)
    rows = [("a", f, f / 30, *map(float, [*(p - [0.01 * f, 0, 0]), *n])) for f in range(3) for p, n in zip(points, normals, strict=True)]
    df = spark.createDataFrame(rows, "session_id string, frame bigint, t double, x double, y double, z double, nx double, ny double, nz double")
    out = odometry.track(df).orderBy("frame").collect()
    assert [r.frame for r in out] == [0, 1, 2] and abs(out[2].est[3] - 0.02) < 0.01


def test_twist_round_trip_and_photometric():
    for _ in range(20):
        xi = RNG.normal(size=6) * 0.5
        assert np.allclose(odometry.log(odometry.exp(xi)), xi, atol=1e-9)
    y, x = np.mgrid[0:60, 0:80].astype(float)
    image = lambda dx: np.sin((x + dx) / 6) + np.cos(y / 7)
    pts = np.stack([RNG.uniform(-0.5, 0.5, 200), RNG.uniform(-0.4, 0.4, 200), np.full(200, 2.0)], 1)
    moved = odometry.exp(np.zeros(6))
    for _ in range(15):
        moved, _ = odometry.photometric_step(image(0), image(1.0), pts, (50.0, 50.0, 40.0, 30.0), moved)
    # At one depth a shift and a turn look alike: the pixels' own shift is what is determined.
    q = pts @ moved[:3, :3].T + moved[:3, 3]
    assert abs(np.mean(50 * q[:, 0] / q[:, 2] - 50 * pts[:, 0] / pts[:, 2]) + 1.0) < 0.1


def test_focal_search(spark):
    rng = np.random.default_rng(5)
    f, w, h = 500.0, 640, 480
    rows = []
    for _ in range(4):
        r = odometry.exp(np.r_[rng.normal(size=3) * 0.15, 0, 0, 0])[:3, :3]
        t = rng.normal(size=3)
        e = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]]) @ r
        for _ in range(40):
            p = np.r_[rng.uniform(-1, 1, 2), rng.uniform(3, 5)]
            q = r @ p + t
            if q[2] > 0.5:
                rows.append((f * p[0] / p[2] + w / 2, f * p[1] / p[2] + h / 2, f * q[0] / q[2] + w / 2, f * q[1] / q[2] + h / 2, e.ravel().tolist()))
    df = spark.createDataFrame([(*map(float, a[:4]), a[4]) for a in rows], "x1 double, y1 double, x2 double, y2 double, e array<double>")
    fx, fy, _ = lens.focal_search(df, width=w, height=h, low=300.0, high=800.0, steps=11, rounds=4)
    assert abs(fx / f - 1) < 0.03 and abs(fy / f - 1) < 0.03


def test_verdict_order(spark):
    cases = [((0.4, 5.0, 1.0, False, False, True), "too dark"), ((0.9, 5.0, 1.0, False, False, True), "depth too slow"), ((0.9, 15.0, 1.0, False, False, True), "barely moved"), ((0.9, 15.0, 9.0, False, False, True), "truncated"), ((0.9, 15.0, 9.0, True, False, True), "thermal pause"), ((0.9, 15.0, 9.0, False, True, False), "ok")]
    for args, want in cases:
        assert spark.range(1).select(quality.verdict(*[F.lit(a) for a in args])).first()[0] == want


def test_box_mean_across_tiles(spark):
    rng = np.random.default_rng(8)
    raster = rng.uniform(1, 1.2, (37, 45))
    raster[rng.random(raster.shape) < 0.1] = np.nan
    raster[20, 20], raster[0, 44] = 3.0, np.inf
    rows = [(None, v, u, None if np.isnan(z) else float(z)) for (v, u), z in np.ndenumerate(raster)]
    df = spark.createDataFrame(rows, "s string, v int, u int, z double")
    want = cloud.box_smooth(np.where(np.isfinite(raster), raster, np.nan))
    for tile in (8, 128):
        out = cloud.box_mean(df, ["s"], tile=tile).collect()
        assert len(out) == raster.size
        for r in out:
            w = want[r.v, r.u]
            assert (r.smooth is None) == np.isnan(w) and (r.smooth is None or abs(r.smooth - w) < 1e-12)
    assert cloud.box_mean(df.limit(0), ["s"]).count() == 0


def test_voxel_neighbours_by_tiles_keep_ties_sessions_and_borders(spark):
    r = random.Random(3)
    spot = lambda: [r.choice((r.gauss(0, 0.01), r.uniform(-3, 3), r.randrange(-12, 12) / 4)) for _ in range(3)]
    a = [(r.choice(("a", None)), i, *spot()) for i in range(500)] + [("a", 500, None, 0.0, 0.0), ("a", 501, float("nan"), 0.0, 0.0), ("a", 0, 0.1, 0.1, 0.1)]
    b = [(r.choice(("a", None)), *spot()) for _ in range(800)] + [("a", 0.0, None, 0.0), ("b", 0.0, 0.0, 0.0)]
    got = joins.voxel_neighbours(spark.createDataFrame(a, "s string, point_id int, x double, y double, z double"), spark.createDataFrame(b, "s string, x double, y double, z double"), ["s"], size=0.5, max_dist=0.6)
    want = {}
    for s, i, *p in a:
        if all(v is not None and v == v for v in p):
            for t, *m in b:
                step = [math.floor(y / 0.5) - math.floor(x / 0.5) for x, y in zip(p, m, strict=True)] if s == t and None not in m else [9]
                d2 = sum(((x - y) * (x - y) for x, y in zip(p[1:], m[1:], strict=True)), (p[0] - m[0]) * (p[0] - m[0])) if max(map(abs, step)) < 2 else 9
                if d2 < 0.6 * 0.6:
                    want[s, i] = min(want.get((s, i), (9,)), (d2, step[0] * 9 + step[1] * 3 + step[2] + 13, *m))
    assert {(x.s, x.point_id): (round(x.d2, 12), *x[3:]) for x in got.collect()} == {k: (round(v[0], 12), *v[1:]) for k, v in want.items()}


def test_voxel_neighbours_of_one_crowded_voxel_follow_points_not_pairs(spark):
    # 30,000 points within one voxel: 9e8 pairs by voxels alone, and 27 rows a point.
    p = spark.range(30_000).select(F.lit(1).alias("s"), F.col("id").alias("point_id"), *[(F.pmod(F.xxhash64("id", F.lit(a)), F.lit(10**6)) / 2.1e6).alias(a) for a in "xyz"])
    fused = p.select("s", *[(F.col(a) + 1e-5).alias(a) for a in "xyz"])
    out = joins.voxel_neighbours(p, fused, ["s"], size=0.5, max_dist=0.5)
    assert "__s" not in out._jdf.queryExecution().toString()  # no stencil of 27 rows
    began = time.perf_counter()
    n, far = out.agg(F.count("*"), F.max("d2")).first()
    assert n == 30_000 and far < 3.1e-10 and time.perf_counter() - began < 30
