"""Pose fusion and inertial motion against numpy restatements."""

import numpy as np
import pytest

from veldspar.operators import imu, trajectory


def turned(rng, size=None):
    axis = rng.normal(size=3)
    axis /= np.linalg.norm(axis)
    return rodrigues(axis, rng.uniform(0, np.pi) if size is None else size)


def rodrigues(axis, angle):
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def posed(r, p):
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, p
    return out


def part_way(c, alpha):
    """By axis and angle, not by quaternions."""
    v = np.array([c[2, 1] - c[1, 2], c[0, 2] - c[2, 0], c[1, 0] - c[0, 1]])
    size = np.linalg.norm(v)
    if size < 1e-12:
        return posed(np.eye(3), alpha * c[:3, 3])
    return posed(rodrigues(v / size, alpha * np.arctan2(size, np.trace(c[:3, :3]) - 1)), alpha * c[:3, 3])


def fuse(times, own, anchors):
    """anchors: place to pose."""
    at, out = sorted(anchors), []
    for k, pose in enumerate(own):
        left, right = max([a for a in at if a <= k], default=at[0]), min([a for a in at if a >= k], default=at[-1])
        base = anchors[left] @ np.linalg.inv(own[left])
        if k in anchors:
            out.append(anchors[k])
        elif left == right or left > k or right < k:
            out.append(base @ pose)
        else:
            off = anchors[right] @ np.linalg.inv(base @ own[right])
            out.append(part_way(off, (times[k] - times[left]) / (times[right] - times[left])) @ base @ pose)
    return out


def test_fused_poses(spark):
    rng = np.random.default_rng(5)
    rows, marks, want = [], [], {}
    for s, at in (("a", [3, 9, 10, 17]), (None, [6])):
        times = np.cumsum(rng.uniform(0.05, 0.3, 24))
        own = [posed(turned(rng), rng.normal(size=3)) for _ in times]
        goals = {k: posed(turned(rng, 0.4) @ own[k][:3, :3], own[k][:3, 3] + 0.3 * rng.normal(size=3)) for k in at}
        rows += [(s, k, float(t), p.ravel().tolist()) for k, (t, p) in enumerate(zip(times, own, strict=True))]
        marks += [(s, k, p.ravel().tolist()) for k, p in goals.items()]
        for k, p in enumerate(fuse(times, own, goals)):
            want[s, k] = p
    df = spark.createDataFrame([*rows, ("a", 99, None, np.eye(4).ravel().tolist()), ("bare", 0, 1.0, np.eye(4).ravel().tolist())], "s string, frame int, t double, pose array<double>")
    anchors = spark.createDataFrame(marks, "s string, frame int, pose array<double>")
    out = {(r.s, r.frame): r for r in trajectory.fused_poses(df, anchors, ["s"], width=0.7).collect()}
    for key, pose in want.items():
        assert np.allclose(np.array(out[key].fused).reshape(4, 4), pose, atol=1e-9)
    assert out["a", 99].fused is None and out["bare", 0].fused is None and out["bare", 0].position is None
    assert [out["a", k].position for k in (0, 3, 5, 9, 23)] == ["outside", "anchor", "between", "anchor", "outside"]
    with pytest.raises(ValueError, match="anchors must be frames"):
        trajectory.fused_poses(df, spark.createDataFrame([("a", 77, marks[0][2])], anchors.schema), ["s"])


def matrix(q):
    x, y, z, w = np.array(q) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


CAMERA = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
DEPTH = np.diag([1.0, -1, -1])


def motion_between(samples, a, b):
    """(rotation, acceleration) of one step, as loops over samples in time order."""
    if a is None or b is None or not b > a:
        return None, None
    ends = []
    for t in (a, b):
        best = min(samples, key=lambda s: (abs(s[0] - t), -s[0]), default=None)
        if best is None or abs(best[0] - t) > 0.05 or any(c is None for c in best[1]) or not any(best[1]):
            return None, None
        ends.append(matrix(best[1]))
    turn = DEPTH.T @ (CAMERA @ (ends[0].T @ ends[1]) @ CAMERA.T) @ DEPTH
    own = [s[2] for s in samples if a <= s[0] <= b]
    if not own or not all(c is not None and np.isfinite(c) for v in own for c in v):
        return turn, None
    return turn, DEPTH.T @ (CAMERA @ np.mean(own, axis=0) * 9.80665)


def test_motion_between_frames(spark):
    rng = np.random.default_rng(6)
    times = [round(float(x), 3) for x in np.cumsum(rng.choice([0.01, 0.02, 0.2], 300))]
    samples = [(t, rng.normal(size=4).tolist(), rng.normal(size=3).tolist()) for t in times]
    for k in range(40, 280, 25):
        samples[k][2][1] = float("nan")
    samples[81] = (samples[81][0], samples[81][1], [None, 1.0, 1.0])
    samples[120] = (samples[120][0], [0.0] * 4, samples[120][2])
    steps = []
    for i in range(0, 290, 3):
        steps.append((i, times[i] + rng.choice([0.0, 0.005, 0.03]), times[i + 3] + rng.choice([0.0, 0.01, 0.07])))
    steps += [(900, None, 1.0), (901, 2.0, 2.0), (902, 3.0, 1.0), (903, float("nan"), 4.0), (904, -50.0, -49.0)]
    steps = [(i, a if a is None else float(a), b if b is None else float(b)) for i, a, b in steps]
    rows = [(None, t, *q, *a) for t, q, a in samples] + [(None, None, *[1.0] * 7), ("other", 1.0, *[1.0] * 7)]
    motion = spark.createDataFrame(rows, "s string, t double, qx double, qy double, qz double, qw double, ax double, ay double, az double")
    df = spark.createDataFrame([(None, *x, float(x[0])) for x in steps], "s string, i int, t0 double, t1 double, t double")
    out = {r.i: r for r in imu.relative_motion(df, motion, ["s"], width=0.9).collect()}
    assert len(out) == len(steps) and all(r.t == r.i for r in out.values())
    seen = [0, 0, 0]
    for i, a, b in steps:
        turn, moved = motion_between(samples, a, b) if a == a else (None, None)
        seen[(turn is not None) + (moved is not None)] += 1
        assert (out[i].rotation is None) == (turn is None) and (out[i].acceleration is None) == (moved is None)
        if turn is not None:
            assert np.allclose(np.array(out[i].rotation).reshape(3, 3), turn, atol=1e-9)
        if moved is not None:
            assert np.allclose(out[i].acceleration, moved, atol=1e-9)
    assert min(seen) >= 3


def test_absolute_rotation(spark):
    from pyspark.sql import functions as F

    q = [0.1, -0.5, 0.3, 0.7]
    got = spark.createDataFrame([tuple(q), (0.0, 0.0, 0.0, 0.0)], "x double, y double, z double, w double").select(imu.absolute_rotation([F.col(c) for c in "xyzw"]).alias("r")).collect()
    assert np.allclose(np.array(got[0].r).reshape(3, 3), matrix(q) @ CAMERA.T @ DEPTH) and got[1].r is None
