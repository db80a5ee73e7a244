"""Depth odometry: registration of point clouds, one session at a time in order.

The tracker is a fold over frames, so a session is one task and sessions run in
parallel. Frames stream through it; the map it keeps is trimmed to a radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Matches = tuple[np.ndarray, np.ndarray, np.ndarray]


def exp(xi: np.ndarray) -> np.ndarray:
    """Pose of a twist (rotation vector, translation)."""
    w, v = xi[:3], xi[3:]
    a = float(np.linalg.norm(w))
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    if a < 1e-9:
        r, left = np.eye(3) + k, np.eye(3) + k / 2
    else:
        r = np.eye(3) + np.sin(a) / a * k + (1 - np.cos(a)) / a**2 * k @ k
        left = np.eye(3) + (1 - np.cos(a)) / a**2 * k + (a - np.sin(a)) / a**3 * k @ k
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, left @ v
    return out


def log(p: np.ndarray) -> np.ndarray:
    """Twist of a pose."""
    r = p[:3, :3]
    a = float(np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1)))
    w = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) * (0.5 if a < 1e-9 else a / (2 * np.sin(a)))
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    left = np.eye(3) + k / 2 if a < 1e-9 else np.eye(3) + (1 - np.cos(a)) / a**2 * k + (a - np.sin(a)) / a**3 * k @ k
    return np.r_[w, np.linalg.solve(left, p[:3, 3])]


def project_rotation(m: np.ndarray) -> np.ndarray:
    """Nearest rotation."""
    u, _, vt = np.linalg.svd(m)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt


def _packed(cells: np.ndarray) -> np.ndarray:
    """One number for each voxel (within a million of the origin on each axis)."""
    c = cells + (1 << 20)
    return (c[:, 0] << 42) | (c[:, 1] << 21) | c[:, 2]


class VoxelMap:
    """Points fused by voxel: running means of one vote of each frame, weights capped.

    ``keys`` are sorted; a row of ``cells`` has the mean point, the mean normal and the weight.
    """

    def __init__(self, size: float = 0.03, max_weight: float = 20.0, radius: float = 6.0):
        self.size, self.max_weight, self.radius = size, max_weight, radius
        self.keys, self.cells = np.zeros(0, np.int64), np.zeros((0, 7))

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of voxels, and which of them are in the map."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, points: np.ndarray, normals: np.ndarray) -> None:
        keys, inverse = np.unique(_packed(np.floor(points / self.size).astype(np.int64)), return_inverse=True)
        n = np.bincount(inverse)
        votes = np.stack([np.bincount(inverse, weights=c) / n for c in np.c_[points, normals].T], 1)
        at, known = self._find(keys)
        old = self.cells[at[known]]
        self.cells[at[known], :6] = (old[:, :6] * old[:, 6:] + votes[known]) / (old[:, 6:] + 1)
        self.cells[at[known], 6] = np.minimum(old[:, 6] + 1, self.max_weight)
        fresh = np.c_[votes[~known], np.ones((~known).sum())]
        order = np.argsort(np.r_[self.keys, keys[~known]], kind="stable")
        self.keys, self.cells = np.r_[self.keys, keys[~known]][order], np.r_[self.cells, fresh][order]

    def trim(self, centre: np.ndarray) -> None:
        near = np.sum((self.cells[:, :3] - centre) ** 2, axis=1) < self.radius**2
        self.keys, self.cells = self.keys[near], self.cells[near]

    def nearest(self, points: np.ndarray, max_dist: float) -> Matches:
        """(places of matched points, their map points, their normals), nearest in 27 voxels."""
        best, found = np.full(len(points), max_dist**2), np.full(len(points), -1)
        base = np.floor(points / self.size).astype(np.int64)
        for step in np.stack(np.meshgrid(*[(-1, 0, 1)] * 3, indexing="ij"), -1).reshape(-1, 3):
            at, known = self._find(_packed(base + step))
            some = np.flatnonzero(known)
            d = np.sum((self.cells[at[some], :3] - points[some]) ** 2, axis=1)
            nearer = d < best[some]
            best[some[nearer]], found[some[nearer]] = d[nearer], at[some[nearer]]
        hit = np.flatnonzero(found >= 0)
        cells = self.cells[found[hit]]
        n = cells[:, 3:6] / np.maximum(np.linalg.norm(cells[:, 3:6], axis=1, keepdims=True), 1e-12)
        return hit, cells[:, :3], n


def icp(points: np.ndarray, association: Callable[[np.ndarray], Matches], prior: np.ndarray, *, iterations: int = 20, max_dist: float = 0.15, rcond: float = 1e-3, least: int = 100, anchor: float = 0.0, fixed_rotation: bool = False) -> tuple[np.ndarray, dict]:
    """Point-to-plane registration of ``points`` from a prior pose.

    ``association`` takes moved points and returns matches. Weak directions
    (eigenvalues under ``rcond`` of the greatest) are not moved along; steps of
    over three match radii are refused.
    """
    pose = prior.copy()
    report = {"inliers": 0.0, "conditioning": 0.0, "residual": float("nan"), "ok": False}
    for _ in range(iterations):
        moved = points @ pose[:3, :3].T + pose[:3, 3]
        hit, target, normal = association(moved)
        report["inliers"] = len(hit) / max(1, len(points))
        if len(hit) < least:
            return prior, report | {"ok": False}
        p = moved[hit]
        r = np.einsum("ij,ij->i", normal, target - p)
        a = np.c_[np.cross(p, normal), normal]
        if fixed_rotation:
            a = a[:, 3:]
        h, g = a.T @ a / len(r), a.T @ r / len(r)
        if anchor:
            h = h + anchor * np.eye(len(h)) * h.diagonal().max()
        w, v = np.linalg.eigh(h)
        keep = w > rcond * w[-1]
        step = v[:, keep] @ ((v[:, keep].T @ g) / w[keep])
        report |= {"conditioning": max(0.0, float(w[0] / w[-1])), "residual": float(np.median(np.abs(r))), "ok": True}
        twist = np.r_[np.zeros(3), step] if fixed_rotation else step
        if np.linalg.norm(twist[3:]) > 3 * max_dist:
            return prior, report | {"ok": False}
        pose = exp(twist) @ pose
        if np.linalg.norm(twist) < 1e-6:
            break
    return pose, report


@dataclass
class Tracker:
    """Frame-to-map tracking with keyframes; state is the pose, the velocity and the map."""

    voxel: float = 0.05
    max_dist: float = 0.15
    key_distance: float = 0.05
    key_degrees: float = 5.0
    key_fill: float = 0.6
    least_cond: float = 1e-3
    floor_gain: float = 0.05
    pose: np.ndarray = field(default_factory=lambda: np.eye(4))
    velocity: np.ndarray = field(default_factory=lambda: np.eye(4))
    key_pose: np.ndarray | None = None
    floor: float | None = None

    def __post_init__(self) -> None:
        self.map = VoxelMap(self.voxel)

    def step(self, points: np.ndarray, normals: np.ndarray, *, rotation: np.ndarray | None = None, floor: float | None = None) -> dict:
        """Registers one frame; ``rotation`` (current from before) replaces the predicted one."""
        if self.key_pose is None:
            self._keep(points, normals)
            self.floor = floor
            return {"pose": self.pose.copy(), "keyframe": True, "inliers": 1.0, "conditioning": float("nan"), "residual": 0.0, "ok": True}
        prior = self.pose @ self.velocity
        if rotation is not None:
            prior[:3, :3] = project_rotation(self.pose[:3, :3] @ rotation)
        pose, report = icp(points, lambda m: self.map.nearest(m, self.max_dist), prior, max_dist=self.max_dist, fixed_rotation=rotation is not None)
        if floor is not None and self.floor is not None:
            pose[1, 3] += self.floor_gain * (floor - self.floor)
        self.velocity = np.linalg.inv(self.pose) @ pose
        self.pose = pose
        due = report["ok"] and self._due(report["inliers"]) and report["conditioning"] > self.least_cond
        if due:
            self._keep(points, normals)
        return report | {"pose": pose.copy(), "keyframe": bool(due)}

    def _due(self, fill: float) -> bool:
        moved = np.linalg.inv(self.key_pose) @ self.pose
        angle = np.degrees(np.arccos(np.clip((np.trace(moved[:3, :3]) - 1) / 2, -1, 1)))
        return bool(np.linalg.norm(moved[:3, 3]) > self.key_distance or angle > self.key_degrees or fill < self.key_fill)

    def _keep(self, points: np.ndarray, normals: np.ndarray) -> None:
        self.key_pose = self.pose.copy()
        self.map.add(points @ self.pose[:3, :3].T + self.pose[:3, 3], normals @ self.pose[:3, :3].T)
        self.map.trim(self.pose[:3, 3])


def track(points: DataFrame, *, session: str = "session_id", frame: str = "frame", t: str = "t", **options) -> DataFrame:
    """Trajectory of each session from its points (x, y, z, nx, ny, nz by frame): pose array, inliers, conditioning, residual, keyframe."""
    count = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = points.select(session, frame, t, "x", "y", "z", "nx", "ny", "nz").repartition(count, session).sortWithinPartitions(session, frame)
    key_type = points.schema[session].dataType.simpleString()

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tracker, now, held = None, None, []

        def close() -> pd.DataFrame:
            nonlocal tracker
            part = pd.concat(held)
            key = part[session].iloc[0]
            if tracker is None or tracker[0] != key:
                tracker = (key, Tracker(**options))
            out = tracker[1].step(part[["x", "y", "z"]].to_numpy(float), part[["nx", "ny", "nz"]].to_numpy(float))
            return pd.DataFrame({session: [key], frame: [part[frame].iloc[0]], t: [part[t].iloc[0]], "est": [out["pose"].ravel().tolist()], "inliers": [out["inliers"]], "conditioning": [out["conditioning"]], "residual": [out["residual"]], "keyframe": [out["keyframe"]]})

        for batch in batches:
            for key, part in batch.groupby([session, frame], sort=False):
                if key != now and held:
                    yield close()
                    held = []
                now = key
                held.append(part)
        if held:
            yield close()

    return rows.mapInPandas(task, f"{session} {key_type}, {frame} bigint, {t} double, est array<double>, inliers double, conditioning double, residual double, keyframe boolean")


def photometric_step(reference: np.ndarray, current: np.ndarray, points: np.ndarray, camera: tuple[float, float, float, float], pose: np.ndarray, *, damping: float = 1e-2, huber: float = 1.345, cut: float = 5.0) -> tuple[np.ndarray, float]:
    """One damped step that aligns the grey values of ``points`` (seen in ``reference``) in ``current``."""
    fx, fy, cx, cy = camera

    def sample(image: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        i, j = np.floor(u).astype(int), np.floor(v).astype(int)
        ok = (i >= 0) & (j >= 0) & (i + 1 < image.shape[1]) & (j + 1 < image.shape[0])
        out = np.full(len(u), np.nan)
        a, b, i, j = u[ok] - i[ok], v[ok] - j[ok], i[ok], j[ok]
        out[ok] = (1 - b) * ((1 - a) * image[j, i] + a * image[j, i + 1]) + b * ((1 - a) * image[j + 1, i] + a * image[j + 1, i + 1])
        return out

    gy, gx = np.gradient(current)
    q = points @ pose[:3, :3].T + pose[:3, 3]
    u0, v0 = fx * points[:, 0] / points[:, 2] + cx, fy * points[:, 1] / points[:, 2] + cy
    u, v = fx * q[:, 0] / q[:, 2] + cx, fy * q[:, 1] / q[:, 2] + cy
    r = sample(current, u, v) - sample(reference, u0, v0)
    du, dv = sample(gx, u, v), sample(gy, u, v)
    ok = np.isfinite(r + du + dv) & (q[:, 2] > 0.1)
    if ok.sum() < 6:
        return pose, float("nan")
    r, q, du, dv = r[ok], q[ok], du[ok], dv[ok]
    sigma = 1.4826 * np.median(np.abs(r)) + 1e-9
    w = np.where(np.abs(r) <= huber * sigma, 1.0, huber * sigma / np.maximum(np.abs(r), 1e-12)) * (np.abs(r) <= cut * sigma)
    d = np.stack([du * fx / q[:, 2], dv * fy / q[:, 2], -(du * fx * q[:, 0] + dv * fy * q[:, 1]) / q[:, 2] ** 2], 1)
    a = np.c_[np.cross(q, d), d]
    h, g = (a * w[:, None]).T @ a, (a * w[:, None]).T @ r
    step = -np.linalg.solve(h + damping * np.diag(h.diagonal()), g)
    return exp(step) @ pose, float(np.mean(w * r * r))
