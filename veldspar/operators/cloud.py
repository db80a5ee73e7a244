"""Point clouds and rasters: voxels, conditioning, rendering, residuals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import cut, safe_join
from .ranks import exact_percentiles
from .trajectory import keyed


def voxel_keys(size: float, axes: Sequence[str] = ("x", "y", "z")) -> dict[str, Column]:
    return {f"k{i}": F.floor(F.col(a) / size).cast("bigint") for i, a in zip("xyz", axes, strict=True)}


def voxel_first(points: DataFrame, by: Sequence[str], *, size: float, order: Sequence[str], axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """First point of each voxel in input order."""
    rest = [c for c in points.columns if c not in by]
    out = points.withColumns(voxel_keys(size, axes)).groupBy(*by, "kx", "ky", "kz").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__p"))
    return out.select(*by, "kx", "ky", "kz", "__p.*")


def voxel_fuse(points: DataFrame, by: Sequence[str], *, frame: str, size: float, max_weight: float | None = None, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Two-level means: one vote of each frame for each voxel, then their mean.

    With a bound the running mean forgets: what a voxel holds weighs no more than
    ``max_weight`` against the next vote. The fold over its votes, in the order of frames, is taken on their sorted array (one number
    for each frame that saw the voxel).
    """
    votes = points.withColumns(voxel_keys(size, axes)).groupBy(*by, "kx", "ky", "kz", frame).agg(*[F.avg(a).alias(f"p{i}") for i, a in zip("xyz", axes, strict=True)])
    keys = [*by, "kx", "ky", "kz"]
    if max_weight is None:
        return votes.groupBy(*keys).agg(*[F.avg(f"p{i}").alias(f"p{i}") for i in "xyz"], F.count("*").cast("double").alias("w"))
    held = votes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(frame, "px", "py", "pz"))).alias("v"))
    start = "named_struct('px', 0D, 'py', 0D, 'pz', 0D, 'w', 0D)"
    moved = ", ".join(f"'p{i}', (a.p{i} * least(a.w, {max_weight}) + x.p{i}) / (least(a.w, {max_weight}) + 1)" for i in "xyz")
    fold = F.expr(f"aggregate(v, {start}, (a, x) -> named_struct({moved}, 'w', least(a.w + 1, {float(max_weight)}D)))")
    return held.select(*keys, fold.alias("f")).select(*keys, "f.*")


def trim(voxels: DataFrame, centres: DataFrame, by: Sequence[str], *, radius: float) -> DataFrame:
    """Voxels nearer than ``radius`` to each session's centre (cx, cy, cz)."""
    d2 = sum((F.pow(F.col(f"p{a}") - F.col(f"c{a}"), 2) for a in "yz"), F.pow(F.col("px") - F.col("cx"), 2))
    return safe_join(voxels, centres, by).where(d2 < radius * radius).drop("cx", "cy", "cz")


def hessian(points: DataFrame, by: Sequence[str], *, p: Sequence[str] = ("x", "y", "z"), n: Sequence[str] = ("nx", "ny", "nz")) -> DataFrame:
    """Mean of a a^T with a = (p x n, n): its 21 upper entries h00..h55, and rows."""
    (x, y, z), (a, b, c) = [F.col(k) for k in p], [F.col(k) for k in n]
    v = [y * c - z * b, z * a - x * c, x * b - y * a, a, b, c]
    return points.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(v[i] * v[j]).alias(f"h{i}{j}") for i in range(6) for j in range(i, 6)])


def conditioning(points: DataFrame, by: Sequence[str], *, least: int = 0, **columns) -> DataFrame:
    """Least over greatest eigenvalue of the frame's Hessian, and the weakest motion (6 numbers)."""
    sums = hessian(points, by, **columns).where(F.col("n") >= least)
    schema = keyed(sums, by, "cond double, weak array<double>, n bigint")

    def solve(batches):
        for p in batches:
            cond, weak = [], []
            for d in p.to_dict("records"):
                m = np.array([[d[f"h{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)])
                w, v = np.linalg.eigh(m)
                axis = v[:, 0] * np.sign(v[np.argmax(np.abs(v[:, 0])), 0])
                cond.append(max(0.0, float(w[0] / w[5])) if w[5] > 0 else 0.0)
                weak.append(axis.tolist())
            yield pd.DataFrame({**{c: p[c] for c in by}, "cond": cond, "weak": weak, "n": p["n"]})

    return sums.mapInPandas(solve, schema)


def floor_height(points: DataFrame, by: Sequence[str], *, gravity: Sequence[str] = ("gx", "gy", "gz"), degrees: float = 15.0, least: int = 100) -> DataFrame:
    """Median height of points below whose normals point along gravity."""
    dot = lambda a, b: sum((F.col(x) * F.col(y) for x, y in zip(a[1:], b[1:], strict=True)), F.col(a[0]) * F.col(b[0]))
    height = dot(("x", "y", "z"), gravity)
    level = F.abs(dot(("nx", "ny", "nz"), gravity)) >= float(np.cos(np.radians(degrees)))
    rows = points.where(level).withColumn("__h", height).where("__h > 0")
    return exact_percentiles(rows, by, "__h", {"height": 0.5}).select(*by, "height", "n").where(F.col("n") >= least)


def z_buffer(points: DataFrame, by: Sequence[str], *, fx: float, fy: float, cx: float, cy: float, width: int, height: int, footprint: float = 0.0, max_splat: int = 3) -> DataFrame:
    """Rendered depth: the nearest surface of each pixel, averaged over a slab behind it.

    A point covers the pixels of its footprint at its depth; points deeper than
    the nearest by more than max(footprint, 0.02) don't count.
    """
    z = F.col("z")
    u, v = F.rint(F.col("x") * fx / z + cx).cast("int"), F.rint(F.col("y") * fy / z + cy).cast("int")
    rows = points.where(z > 0.1).withColumns({"u": u, "v": v})
    if footprint > 0:
        reach = F.least(F.lit(max_splat), F.floor(footprint * fx / z / 2)).cast("int")
        rows = rows.withColumn("__r", reach).withColumn("u", F.explode(F.sequence(F.col("u") - F.col("__r"), F.col("u") + F.col("__r"))))
        rows = rows.withColumn("v", F.explode(F.sequence(F.col("v") - F.col("__r"), F.col("v") + F.col("__r")))).drop("__r")
    rows = rows.where(f"u between 0 and {width - 1} and v between 0 and {height - 1}")
    near = rows.groupBy(*by, "u", "v").agg(F.min("z").alias("__near"))
    slab = safe_join(rows, near, [*by, "u", "v"]).where(z <= F.col("__near") + max(footprint, 0.02))
    return slab.groupBy(*by, "u", "v").agg(F.avg("z").alias("z"), F.count("*").alias("n"))


def nested_median(df: DataFrame, by: Sequence[str], frame: str, value: str, *, least: int = 100) -> DataFrame:
    """Median over frames of each frame's median absolute value; frames under ``least`` rows don't count."""
    rows = cut(df.select(*by, frame, F.abs(F.col(value)).alias("__a")))
    counts = rows.groupBy(*by, frame).agg(F.count("*").alias("__all")).where(F.col("__all") >= least)
    frames = safe_join(exact_percentiles(rows, [*by, frame], "__a", {"__m": 0.5}), counts, [*by, frame])
    out = exact_percentiles(frames, by, "__m", {"residual": 0.5})
    counts = counts.groupBy(*by).agg(F.count("*").alias("frames"))
    return safe_join(counts, out.drop("n"), by).select(*by, "residual", "frames") if by else out.drop("n").crossJoin(F.broadcast(counts))


def compared_residuals(df: DataFrame, by: Sequence[str], frame: str, *, estimate: str, reference: str, least: int = 100) -> DataFrame:
    """Medians over the frames that both trajectories have ``least`` values in, of their median absolute values there, and those frames."""
    parts = []
    for name, value in (("estimate", estimate), ("reference", reference)):
        rows = df.where(F.col(value).isNotNull()).select(*by, frame, F.abs(F.col(value)).alias("__a"))
        parts.append(exact_percentiles(rows, [*by, frame], "__a", {f"__{name}": 0.5}).where(F.col("n") >= least).drop("n"))
    both = cut(safe_join(*parts, [*by, frame]))
    out = exact_percentiles(both, by, "__estimate", {"estimate": 0.5}).withColumnRenamed("n", "frames")
    return safe_join(out, exact_percentiles(both, by, "__reference", {"reference": 0.5}).drop("n"), by)


def radius_probe(matches: DataFrame, by: Sequence[str], *, dist: str = "dist", radii: Sequence[float] = (0.15, 0.08, 0.04, 0.02)) -> DataFrame:
    """Fraction of points matched within each radius."""
    rows = matches.withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    return rows.groupBy(*by, "radius").agg(F.avg(F.when(F.col(dist) < F.col("radius"), 1.0).otherwise(0.0)).alias("fraction"))


def grid_normals(points: DataFrame, by: Sequence[str], *, u: str = "u", v: str = "v") -> DataFrame:
    """Normals from the neighbours left and right, above and below; null at borders and gaps."""
    rows = points
    across, down = Window.partitionBy(*by, v).orderBy(u), Window.partitionBy(*by, u).orderBy(v)
    place = F.struct("x", "y", "z", F.col(u).alias("__u"), F.col(v).alias("__v"))
    rows = rows.withColumns({"__l": F.lag(place).over(across), "__r": F.lead(place).over(across), "__t": F.lag(place).over(down), "__b": F.lead(place).over(down)})
    whole = (F.col("__r.__u") - F.col("__l.__u") == 2) & (F.col("__b.__v") - F.col("__t.__v") == 2)
    a = [F.col(f"__r.{k}") - F.col(f"__l.{k}") for k in "xyz"]
    b = [F.col(f"__b.{k}") - F.col(f"__t.{k}") for k in "xyz"]
    n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    ok = F.when(whole & (size > 1e-12), size)
    # Towards the camera.
    sign = F.when(n[0] * F.col("x") + n[1] * F.col("y") + n[2] * F.col("z") > 0, -1.0).otherwise(1.0)
    return rows.withColumns({f"n{k}": sign * n[i] / ok for i, k in enumerate("xyz")}).drop("__l", "__r", "__t", "__b")


def box_mean(pixels: DataFrame, by: Sequence[str], *, u: str = "u", v: str = "v", value: str = "z", half: int = 2, edge: float = 0.05, name: str = "smooth", tile: int = 128) -> DataFrame:
    """Adds ``name``: the mean of the finite values within ``half`` pixels either way, or the value itself where the mean is off by over ``edge``.

    Pixels are dealt to tiles with a border of ``half`` of their neighbours', so a raster of any size is many groups; in a
    tile the sums along rows are summed along columns, by two range windows. A gap (null or not finite) counts for nothing
    and stays one; rows are expected for every pixel, as ``sources.session.pixels`` gives them, once for each.
    """
    z = F.col(value).cast("double")
    good = F.when(F.abs(z) < float("inf"), z)
    tiles = [F.explode(F.sequence(F.floor((F.col(c) - half) / tile), F.floor((F.col(c) + half) / tile))) for c in (u, v)]
    rows = pixels.withColumns({"__z": good, "__n": good.isNotNull().cast("int")}).withColumn("__tu", tiles[0]).withColumn("__tv", tiles[1])
    across = Window.partitionBy(*by, "__tu", "__tv", v).orderBy(u).rangeBetween(-half, half)
    down = Window.partitionBy(*by, "__tu", "__tv", u).orderBy(v).rangeBetween(-half, half)
    rows = rows.withColumns({"__sz": F.coalesce(F.sum("__z").over(across), F.lit(0.0)), "__sn": F.sum("__n").over(across)})
    rows = rows.withColumns({"__bz": F.sum("__sz").over(down), "__bn": F.sum("__sn").over(down)})
    rows = rows.where((F.floor(F.col(u) / tile) == F.col("__tu")) & (F.floor(F.col(v) / tile) == F.col("__tv")))
    mean = F.col("__bz") / F.when(F.col("__bn") > 0, F.col("__bn"))
    out = F.when(F.col("__z").isNotNull(), F.when(F.abs(mean - F.col("__z")) <= edge, mean).otherwise(F.col("__z")))
    return rows.withColumn(name, out).select(*pixels.columns, name)


def box_smooth(raster: np.ndarray, half: int = 2, edge: float = 0.05) -> np.ndarray:
    """Box mean over (2 half + 1)^2 finite neighbours by summed areas; kept where it moves a value by over ``edge``."""
    ok = np.isfinite(raster)
    z, n = np.where(ok, raster, 0.0), ok.astype(float)

    def box(a: np.ndarray) -> np.ndarray:
        s = np.pad(np.pad(a, half).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        k = 2 * half + 1
        return s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]

    count = box(n)
    mean = box(z) / np.maximum(count, 1)
    return np.where(ok & (np.abs(mean - raster) <= edge), mean, raster)


def depth_statistics(pixels: DataFrame, by: Sequence[str], value: str = "z") -> DataFrame:
    """Least, most, mean and valid percent of a raster's finite pixels."""
    z = F.col(value).cast("double")
    finite = z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf"))
    good = F.when(finite, z)
    return pixels.groupBy(*by).agg(F.min(good).alias("least"), F.max(good).alias("most"), F.avg(good).alias("mean"), (100 * F.avg(F.when(finite, 1.0).otherwise(0.0))).alias("valid_percent"))
