"""Joins of session streams by frame, time and key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .changelog import latest
from .ordered import WIDTH, safe_join
from .timeops import nearest

#: Voxels of a tile's side. Fused points of a cell, times that a voxel is halved at most, rows and pairs looked at together.
TILE, PER_CELL, HALVED, ROWS, PAIRS = 8, 2, 16, 16_384, 1 << 20


def posed_images(frames: DataFrame, poses: DataFrame, by: Sequence[str], *, frame: str = "frame", pose_order: Sequence[str] = ("ordinal",)) -> DataFrame:
    """Frames with the pose of the same frame number; of several poses the last. Frames without one go."""
    pose = latest(poses, [*by, frame], pose_order)
    clash = {c: f"pose_{c}" for c in pose.columns if c in frames.columns and c not in (*by, frame)}
    return safe_join(frames, pose.withColumnsRenamed(clash), [*by, frame])


def exact_or_nearest(left: DataFrame, right: DataFrame, by: Sequence[str], *, frame: str = "frame", t: str = "t", order: Sequence[str] = ("ordinal",), values: Sequence[str], prefix: str = "depth_", width: float = WIDTH) -> DataFrame:
    """The right row of the same frame (dt 0.0), else the nearest in time, else null.

    Only rows without an exact partner go through the as-of join.
    """
    exact = latest(right, [*by, frame], order).select(*by, frame, *[F.col(c).alias(f"{prefix}{c}") for c in values], F.lit(True).alias("__hit"))
    joined = safe_join(left, exact, [*by, frame], "left")
    dt = F.lit(0.0).cast(left.schema[t].dataType)
    found = joined.where("__hit").drop("__hit").withColumn(f"{prefix}dt", dt)
    missing = joined.where("__hit is null").select(*left.columns)
    near = nearest(missing, right, by, t=t, right_order=order, values=values, prefix=prefix, width=width)
    return found.unionByName(near)


def align(poses: DataFrame, by: Sequence[str], *, depth: DataFrame, depth_values: Sequence[str], nearest_streams: dict[str, tuple[DataFrame, Sequence[str]]], frame: str = "frame", t: str = "t", width: float = WIDTH) -> DataFrame:
    """Per pose: depth of the same frame, and the nearest row of each other stream with its signed dt."""
    exact = latest(depth, [*by, frame], ["ordinal"]).select(*by, frame, *[F.col(c).alias(f"depth_{c}") for c in depth_values])
    out = safe_join(poses, exact, [*by, frame], "left")
    for name, (stream, values) in nearest_streams.items():
        out = nearest(out, stream, by, t=t, right_order=["ordinal"], values=values, prefix=f"{name}_", width=width)
    return out


def usable(images: DataFrame, others: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Rows whose key every other side has."""
    for other in others:
        images = safe_join(images, other.select(*key), key, "left_semi")
    return images


def pending(files: DataFrame, acknowledged: DataFrame, in_flight: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows neither acknowledged nor in flight."""
    return safe_join(safe_join(files, acknowledged.select(*key), key, "left_anti"), in_flight.select(*key), key, "left_anti")


def unmatched(candidates: DataFrame, matched: DataFrame, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Per session: candidates, matched and dropped rows."""
    hit = matched.select(*key).distinct().withColumn("__hit", F.lit(1))
    rows = safe_join(candidates, hit, key, "left")
    return rows.groupBy(*by).agg(F.count("*").alias("candidates"), F.count("__hit").alias("matched"), (F.count("*") - F.count("__hit")).alias("dropped"))


def uncovered(anchors: DataFrame, trajectory: DataFrame, key: Sequence[str]) -> DataFrame:
    """Anchors that the trajectory lacks; an empty result means containment."""
    return safe_join(anchors, trajectory.select(*key), key, "left_anti")


def grid(left: DataFrame, right: DataFrame, *, most: int = 10_000) -> DataFrame:
    """All combinations with a small table (experiment arms, candidate parameters) of ``most`` rows at most."""
    n = right.limit(most + 1).count()
    if n > most:
        raise ValueError(f"the small side has over {most} rows")
    return left.crossJoin(F.broadcast(right))


def shared_frames(windows: DataFrame, by: Sequence[str], *, window: str, frame: str, least: int = 3) -> DataFrame:
    """Neighbouring windows and the number of frames they share; ``enough`` from ``least`` on. A frame that a window repeats is one."""
    a = windows.select(*by, F.col(window).alias("w"), F.col(frame).alias("f")).distinct()
    b = a.withColumn("w", F.col("w") - 1)
    out = safe_join(a, b, [*by, "w", "f"]).groupBy(*by, "w").agg(F.count("*").alias("shared"))
    return out.withColumn("enough", F.col("shared") >= least)


def projective(points: DataFrame, target: DataFrame, by: Sequence[str], *, fx: float, fy: float, cx: float, cy: float, width: int, height: int, max_dist: float, least: int = 100) -> DataFrame:
    """Pixel association: points projected into the target raster, matched within ``max_dist``.

    Sessions with fewer than ``least`` matches give none.
    """
    z = F.col("z")
    p = points.where(z > 0.1).withColumns({"u": F.rint(F.col("x") * fx / z + cx).cast("int"), "v": F.rint(F.col("y") * fy / z + cy).cast("int")})
    p = p.where(f"u between 0 and {width - 1} and v between 0 and {height - 1}")
    q = target.where("ok").select(*by, "u", "v", F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz"), *[c for c in ("nx", "ny", "nz") if c in target.columns])
    met = safe_join(p, q, [*by, "u", "v"]).withColumn("dist", F.sqrt(F.pow(F.col("x") - F.col("qx"), 2) + F.pow(F.col("y") - F.col("qy"), 2) + F.pow(z - F.col("qz"), 2)))
    met = met.where(F.col("dist") < max_dist)
    enough = met.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    return safe_join(met, enough.select(*by), by, "left_semi")


def ratio_matches(pairs: DataFrame, by: Sequence[str], *, left: str, right: str, distance: str, ratio: float = 0.7, least: int = 30, baseline: str | None = None, least_baseline: float = 0.05) -> DataFrame:
    """Best of the two nearest descriptors where it is clearly nearer; pairs of images with ``least`` matches.

    With ``baseline`` (metres between a pair's cameras) pairs nearer than ``least_baseline`` don't count.
    """
    if baseline is not None:
        pairs = pairs.where(F.col(baseline) >= least_baseline)
    # The two nearest, one after the other: no list of all neighbours is kept. Of repeated pairs one counts.
    near = F.struct(F.col(distance).alias("d"), F.col(right).alias("r"))
    rows = pairs.where(F.col(distance).isNotNull()).select(*by, left, near.alias("__n")).distinct()
    first = rows.groupBy(*by, left).agg(F.min("__n").alias("__1"))
    second = safe_join(rows, first, [*by, left]).where(F.col("__n") > F.col("__1")).groupBy(*by, left).agg(F.min("__n").alias("__2"))
    good = safe_join(first, second, [*by, left]).where(F.col("__1.d") < ratio * F.col("__2.d"))
    good = good.select(*by, left, F.col("__1.r").alias(right), F.col("__1.d").alias(distance))
    enough = good.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    return safe_join(good, enough.select(*by), by, "left_semi")


def voxel_neighbours(points: DataFrame, fused: DataFrame, by: Sequence[str], *, size: float, max_dist: float, least: int = 0, key: Sequence[str] = ("point_id",)) -> DataFrame:
    """Nearest fused point of each point in its own and the 26 neighbouring voxels.

    Strictly within ``max_dist``; equal distances go to the first place of the
    stencil (dx outermost). Both sides are dealt to tiles of ``TILE`` voxels a side; a point goes
    to its own tile, a fused point also to those whose border it is within a voxel of. A task searches its
    tile by cells as fine as the fused points are dense, so work follows the number of points, not
    pairs, however many share a voxel. A null session key is a session; points without a coordinate have no neighbour.
    """
    known = lambda df: df.where(" and ".join(f"abs({a}) < double('infinity')" for a in "xyz"))
    # The origin is in the middle of a tile, as clouds mostly lie around it.
    tile = lambda c, d: F.floor((F.floor(F.col(c).cast("double") / size) + (TILE // 2 + d)) / TILE)
    tiles = [f"__t{a}" for a in "xyz"]
    xyz = [F.col(a).cast("double").alias(f"__{a}") for a in "xyz"]
    p = known(points).select(*by, *key, *xyz, *[tile(a, 0).alias(t) for a, t in zip("xyz", tiles, strict=True)])
    m = known(fused).select(*by, *xyz, *[F.array_distinct(F.array(tile(a, -1), tile(a, 1))).alias(t) for a, t in zip("xyz", tiles, strict=True)])
    for t in tiles:
        m = m.withColumn(t, F.explode(t))
    kept = [*by, *key]
    found = T.StructType([*p.select(*kept).schema.fields, T.StructField("d2", T.DoubleType()), T.StructField("slot", T.LongType()), *[T.StructField(f"map_{a}", T.DoubleType()) for a in "xyz"]])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q, f = (np.stack([t.column(f"__{a}").to_numpy() for a in "xyz"], 1) for t in (left, right))
        at, d2, slot, near = nearest_in_voxels(q, f, size, max_dist * max_dist)
        out = left.select(kept).take(pa.array(at))
        for name, column in (("d2", d2), ("slot", slot), *((f"map_{a}", near[:, i]) for i, a in enumerate("xyz"))):
            out = out.append_column(name, pa.array(column))
        return out

    near = p.groupBy(*by, *tiles).cogroup(m.groupBy(*by, *tiles)).applyInArrow(search, found)
    best = near.groupBy(*kept).agg(F.min(F.struct("d2", "slot", "map_x", "map_y", "map_z")).alias("__b"))
    return best.select(*kept, "__b.*")


def nearest_in_voxels(q: np.ndarray, m: np.ndarray, size: float, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q`` that have a row of ``m`` in the 27 voxels around and nearer than the root of ``most``: their places, squared distance, slot and that row.

    Cells are voxels halved until few rows share one. What is found nearer than a cell's side is the nearest;
    other rows ask again in cells of twice the side, up to the voxels themselves.
    """
    none = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros((0, 3))
    if not len(q) or not len(m):
        return none
    m = np.unique(m, axis=0)  # in order, so of equal distances and slots the first is the least
    mine, theirs = np.floor(q / size), np.floor(m / size)
    halved = 0
    while halved < HALVED and len(m) > PER_CELL * len(np.unique(np.floor(m / (size / 2**halved)), axis=0)):
        halved += 1
    steps = np.array([(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)], float)
    d2, slot, at = np.full(len(q), np.inf), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    todo = np.arange(len(q))
    for level in range(halved, -1, -1):
        side = size / 2**level
        cells = np.floor(m / side)
        low = cells.min(0)
        wide = (cells.max(0) - low + 1).astype(np.int64)
        number = lambda c: (c[..., 0] * wide[1] + c[..., 1]) * wide[2] + c[..., 2]  # noqa: B023, E731
        numbers = number((cells - low).astype(np.int64))
        order = np.argsort(numbers, kind="stable")
        numbers = numbers[order]
        for lo in range(0, len(todo), ROWS):
            own = todo[lo : lo + ROWS]
            around = np.floor(q[own] / side)[:, None, :] + steps - low
            inside = ((around >= 0) & (around < wide)).all(2)
            asked = number(np.where(inside[..., None], around, 0).astype(np.int64))
            begin = np.searchsorted(numbers, asked, "left")
            n = np.where(inside, np.searchsorted(numbers, asked, "right") - begin, 0)
            ends = np.cumsum(n.sum(1))
            cut = 0
            while cut < len(own):
                until = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + PAIRS, "right")))
                some, first = n[cut:until].reshape(-1), begin[cut:until].reshape(-1)
                j = order[np.repeat(first - (np.cumsum(some) - some), some) + np.arange(some.sum())]
                i = np.repeat(np.repeat(own[cut:until], 27), some)
                gap = q[i] - m[j]
                far = gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2]
                near = far < most
                i, j, far = i[near], j[near], far[near]
                place = ((theirs[j] - mine[i] + 1) @ np.array([9.0, 3.0, 1.0])).astype(np.int64)
                by = np.lexsort((j, place, far, i))
                by = by[np.r_[True, i[by][1:] != i[by][:-1]][: len(by)]]
                d2[i[by]], slot[i[by]], at[i[by]] = far[by], place[by], j[by]
                cut = until
        todo = todo[d2[todo] >= (0.999 * side) ** 2]
    hit = np.flatnonzero(d2 < np.inf)
    return hit, d2[hit], slot[hit], m[at[hit]]
