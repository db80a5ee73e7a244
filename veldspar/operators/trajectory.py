"""Trajectories: alignment, scale, chaining, fusion and their scores.

Alignments are three passes: means, then sums of products about them (combined before the
shuffle), which give a 3 x 3 matrix for each session; a small kernel solves it, and the
residuals are taken against the joined solution. Windows are chained by a scan over their similarities.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as g
from .ordered import WIDTH, carried, cut, previous, safe_join, scan

AXES = "xyz"


def keyed(df: DataFrame, by: Sequence[str], more: str) -> StructType:
    """Schema of a kernel's result: the session's columns and ``more``."""
    return StructType([*[df.schema[c] for c in by], *StructType.fromDDL(more).fields])


def _sums(df: DataFrame, by: Sequence[str], source: Sequence[str], target: Sequence[str]) -> DataFrame:
    """Means (m, u) and, about them, sums (s, t), squares (ss) and products (c); far from the origin raw products would lose their digits."""
    sides = [(f"__{k}{i}", c) for k, names in (("m", source), ("u", target)) for i, c in enumerate(names)]
    means = df.groupBy(*by).agg(*[F.avg(c).alias(k) for k, c in sides])
    df = safe_join(df.select(*by, *dict.fromkeys([*source, *target])), means, by)
    a = [F.col(c) - F.col(f"__m{i}") for i, c in enumerate(source)]
    b = [F.col(c) - F.col(f"__u{j}") for j, c in enumerate(target)]
    aggs = [F.count("*").alias("n"), *[F.max(k).alias(k.strip("_")) for k, _ in sides]]
    for i, x in enumerate(a):
        aggs += [F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"ss{i}")]
        aggs += [F.sum(x * y).alias(f"c{i}{j}") for j, y in enumerate(b)]
    aggs += [F.sum(y).alias(f"t{j}") for j, y in enumerate(b)]
    return df.groupBy(*by).agg(*aggs)


def fits(df: DataFrame, by: Sequence[str], source: Sequence[str], target: Sequence[str], *, scaled: bool) -> DataFrame:
    """Least-squares rotation (9), translation (3) and scale from source to target points, per session.

    ``scaled`` gives the similarity of Umeyama, else the rigid fit of Kabsch.
    """
    sums = _sums(df, by, source, target)
    schema = keyed(sums, by, "r array<double>, shift array<double>, scale double, n bigint")

    def solve(batches):
        for p in batches:
            out = {"r": [], "shift": [], "scale": []}
            for row in p.itertuples(index=False):
                d = row._asdict() if hasattr(row, "_asdict") else dict(zip(p.columns, row, strict=True))
                n = d["n"]
                ms, mt = np.array([d[f"s{i}"] for i in range(3)]) / n, np.array([d[f"t{i}"] for i in range(3)]) / n
                cov = np.array([[d[f"c{i}{j}"] for i in range(3)] for j in range(3)]) / n - np.outer(mt, ms)
                u, s, vt = np.linalg.svd(cov)
                sign = np.diag([1.0, 1.0, 1.0 if np.linalg.det(u) * np.linalg.det(vt) >= 0 else -1.0])
                rot = u @ sign @ vt
                at, to = ms + [d[f"m{i}"] for i in range(3)], mt + [d[f"u{i}"] for i in range(3)]
                var = sum(d[f"ss{i}"] for i in range(3)) / n - ms @ ms
                scale = float(np.trace(np.diag(s) @ sign) / var) if scaled and var > 1e-18 else 1.0
                out["r"].append(rot.ravel().tolist())
                out["shift"].append((to - scale * rot @ at).tolist())
                out["scale"].append(scale)
            yield pd.DataFrame({**{c: p[c] for c in by}, **out, "n": p["n"]})

    return sums.mapInPandas(solve, schema)


def aligned(df: DataFrame, solution: DataFrame, by: Sequence[str], source: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Adds the source points moved by each session's fit."""
    out = safe_join(df, solution.select(*by, "r", "shift", "scale"), by)
    r, t, k = F.col("r"), F.col("shift"), F.col("scale")
    moved = {n: k * (r[3 * i] * F.col(source[0]) + r[3 * i + 1] * F.col(source[1]) + r[3 * i + 2] * F.col(source[2])) + t[i] for i, n in enumerate(names)}
    return out.withColumns(moved).drop("r", "shift", "scale")


def _distance(a: Sequence[str], b: Sequence[str]) -> Column:
    return F.sqrt(sum((F.pow(F.col(x) - F.col(y), 2) for x, y in zip(a[1:], b[1:], strict=True)), F.pow(F.col(a[0]) - F.col(b[0]), 2)))


def trajectory_error(df: DataFrame, by: Sequence[str], source: Sequence[str], target: Sequence[str], *, scaled: bool = False) -> DataFrame:
    """Per session after alignment: mean and root mean square distance, and rows."""
    names = ["__ax", "__ay", "__az"]
    moved = aligned(df, fits(df, by, source, target, scaled=scaled), by, source, names).withColumn("__d", _distance(names, target))
    return moved.groupBy(*by).agg(F.avg("__d").alias("ate_mean"), F.sqrt(F.avg(F.col("__d") * F.col("__d"))).alias("ate_rms"), F.count("*").alias("rows"))


def planar_fit(df: DataFrame, by: Sequence[str], source: Sequence[str], target: Sequence[str]) -> DataFrame:
    """Rigid fit in the plane, in closed form: angle (radians) and shift."""
    (sx, sy), (tx, ty) = source, target
    a = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(sx).alias("mx"), F.avg(sy).alias("my"), F.avg(tx).alias("ux"), F.avg(ty).alias("uy"),
        F.covar_pop(sx, tx).alias("cxx"), F.covar_pop(sy, ty).alias("cyy"), F.covar_pop(sx, ty).alias("cxy"), F.covar_pop(sy, tx).alias("cyx"),
    )
    a = a.withColumn("angle", F.atan2(F.col("cxy") - F.col("cyx"), F.col("cxx") + F.col("cyy")))
    c, s = F.cos("angle"), F.sin("angle")
    return a.select(*by, "n", "angle", (F.col("ux") - c * F.col("mx") + s * F.col("my")).alias("shift_x"), (F.col("uy") - s * F.col("mx") - c * F.col("my")).alias("shift_y"))


def scale_fit(df: DataFrame, by: Sequence[str], measured: str, predicted: str) -> DataFrame:
    """Least-squares scale sum(xy) / sum(yy) and the correlation."""
    x, y = F.col(measured), F.col(predicted)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.sum(x * y), F.sum(y * y)).alias("scale"), F.corr(x, y).alias("r"))


def log_correlation(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    rows = df.where((F.col(a) > 0) & (F.col(b) > 0))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr(F.ln(a), F.ln(b)).alias("r")) if by else rows.agg(F.count("*").alias("n"), F.corr(F.ln(a), F.ln(b)).alias("r"))


def plane_fit(df: DataFrame, by: Sequence[str], points: Sequence[str], gravity: Sequence[float] | None = None) -> DataFrame:
    """Plane of least squares: normal, thickness (rms) and tilt against gravity in degrees."""
    sums = _sums(df, by, points, points)
    schema = keyed(sums, by, "normal array<double>, thickness double, tilt double, n bigint")
    down = np.array(gravity if gravity is not None else (0.0, -1.0, 0.0), float)

    def solve(batches):
        for p in batches:
            rows = []
            for d in p.to_dict("records"):
                m = np.array([d[f"s{i}"] for i in range(3)]) / d["n"]
                cov = np.array([[d[f"c{i}{j}"] for j in range(3)] for i in range(3)]) / d["n"] - np.outer(m, m)
                w, v = np.linalg.eigh(cov)
                normal = v[:, 0] * np.sign(v[np.argmax(np.abs(v[:, 0])), 0])
                rows.append((normal.tolist(), float(np.sqrt(max(0.0, w[0]))), float(np.degrees(np.arccos(min(1.0, abs(normal @ down) / np.linalg.norm(down)))))))
            yield pd.DataFrame({**{c: p[c] for c in by}, "normal": [r[0] for r in rows], "thickness": [r[1] for r in rows], "tilt": [r[2] for r in rows], "n": p["n"]})

    return sums.mapInPandas(solve, schema)


def mean_gravity(df: DataFrame, by: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Unit mean vector; the query fails for a session where it has no length."""
    a = df.groupBy(*by).agg(*[F.avg(c).alias(f"g{k}") for c, k in zip(axes, AXES, strict=True)])
    n = F.sqrt(sum((F.col(f"g{k}") * F.col(f"g{k}") for k in "yz"), F.col("gx") * F.col("gx")))
    n = F.when(n >= 1e-9, n).otherwise(F.raise_error(F.lit("gravity cancels out")).cast("double"))
    return a.select(*by, *[(F.col(f"g{k}") / n).alias(f"g{k}") for k in AXES])


def floor_projection(df: DataFrame, gravity: DataFrame, by: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Positions on two axes perpendicular to gravity: adds floor_a and floor_b."""
    down = [F.col(f"g{k}") for k in AXES]
    seed_z = F.abs(down[0]) > 0.9
    seed = [F.when(seed_z, 0.0).otherwise(1.0), F.lit(0.0), F.when(seed_z, 1.0).otherwise(0.0)]
    dot = seed[0] * down[0] + seed[2] * down[2]
    a = [seed[i] - dot * down[i] for i in range(3)]
    n = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
    a = [x / n for x in a]
    b = [down[1] * a[2] - down[2] * a[1], down[2] * a[0] - down[0] * a[2], down[0] * a[1] - down[1] * a[0]]
    out = safe_join(df, gravity, by)
    on = lambda v: sum((v[i] * F.col(axes[i]) for i in (1, 2)), v[0] * F.col(axes[0]))
    return out.withColumns({"floor_a": on(a), "floor_b": on(b)}).drop("gx", "gy", "gz")


def second_difference(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, *, step: str = "dt", width: float = WIDTH) -> DataFrame:
    """(next - 2 here + before) / dt^2; null at the ends."""
    out = carried(df, by, order, F.struct(F.col(value).alias("v")), forward="__b", backward="__a", width=width)
    return out.withColumn("second", (F.col("__a.v") - 2 * F.col(value) + F.col("__b.v")) / (F.col(step) * F.col(step))).drop("__a", "__b")


def fused(rows: DataFrame, anchors: DataFrame, by: Sequence[str], *, t: str = "t", frame: str = "frame", values: Sequence[str] = ("tx", "ty", "tz"), width: float = WIDTH) -> DataFrame:
    """Moves a trajectory onto sparse anchors: each row takes the correction
    interpolated between the anchors around it, or that of the nearest at the ends.

    ``anchors`` (frame and values) must be frames of the trajectory.
    """
    a = anchors.select(*by, frame, *[F.col(v).alias(f"__a_{v}") for v in values])
    out = safe_join(rows, a, [*by, frame], "left")
    here = F.struct(F.col(t).alias("t"), *[(F.col(f"__a_{v}") - F.col(v)).alias(v) for v in values])
    fix = F.when(F.col(f"__a_{values[0]}").isNotNull(), here)
    out = carried(out.withColumn("__fix", fix), by, [t, frame], F.col("__fix"), forward="__l", backward="__r", width=width)
    left, right = F.coalesce("__fix", "__l", "__r"), F.coalesce("__fix", "__r", "__l")
    out = out.withColumn("__l", left).withColumn("__r", right)
    span = F.col("__r.t") - F.col("__l.t")
    alpha = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(t) - F.col("__l.t")) / F.when(span > 0, span)))).otherwise(0.0)
    moved = {f"fused_{v}": F.col(v) + F.col(f"__l.{v}") + alpha * (F.col(f"__r.{v}") - F.col(f"__l.{v}")) for v in values}
    kind = F.when(F.col("__fix").isNotNull(), "anchor").when((F.col(t) < F.col("__l.t")) | (F.col(t) > F.col("__r.t")), "outside").otherwise("between")
    return out.withColumns(moved | {"position": kind}).drop("__fix", "__l", "__r", *[f"__a_{v}" for v in values])


def _rotation(p: Column) -> Column:
    """Rotation of a pose of 16."""
    return F.array(*[p[4 * i + j] for i in range(3) for j in range(3)])


def _part_way(correction: Column, alpha: Column) -> Column:
    """The pose that is ``alpha`` of the way from none to a correction: slerp of rotations, lerp of shifts."""
    none = F.struct(*[F.lit(float(k == "w")).alias(k) for k in "xyzw"], *[F.lit(0.0).alias(k) for k in ("tx", "ty", "tz")])
    q = g.let(_rotation(correction), g.matrix_to_quaternion)
    whole = g.let(q, lambda q: F.struct(*[q[k].alias(k) for k in "xyzw"], *[correction[4 * i + 3].alias(k) for i, k in enumerate(("tx", "ty", "tz"))]))
    between = g.let(whole, lambda w: g.rigid_interpolation(none, w, alpha))
    return g.let(between, lambda b: g.pose(g.quaternion_to_matrix(b["x"], b["y"], b["z"], b["w"]), b["tx"], b["ty"], b["tz"]))


def fused_poses(rows: DataFrame, anchors: DataFrame, by: Sequence[str], *, t: str = "t", frame: str = "frame", pose: str = "pose", anchor_pose: str = "pose", width: float = WIDTH) -> DataFrame:
    """Moves a trajectory of poses (arrays of 16) onto sparse anchors in another frame: adds ``fused`` and ``position``.

    From each anchor on, the trajectory's own motion is followed; at the next anchor it is off by a correction, which is
    spread over the interval by time, rotation (slerp) and shift. Before the first anchor and after the last the motion
    alone is followed. Anchors keep their pose. ``anchors`` (frame, ``anchor_pose``) must be frames of the
    trajectory, or this fails. Rows without a time have no fused pose; a null session key is a session; a session without anchors has none.
    """
    if not safe_join(anchors, rows.select(*by, frame), [*by, frame], "left_anti").isEmpty():
        raise ValueError("anchors must be frames of the trajectory")
    a = anchors.select(*by, frame, F.col(anchor_pose).alias("__goal"))
    out = safe_join(rows, a, [*by, frame], "left")
    here = F.struct(F.col(t).alias("t"), F.col(pose).alias("own"), F.col("__goal").alias("goal"))
    out = out.withColumn("__fix", F.when(F.col("__goal").isNotNull() & F.col(t).isNotNull(), here))
    out = carried(out, by, [t, frame], F.col("__fix"), forward="__l", backward="__r", width=width)
    # Products name each number of a pose many times: cut here, they name columns, and results have names of their own (let).
    out = cut(out.withColumns({"__l": F.coalesce("__fix", "__l", "__r"), "__r": F.coalesce("__fix", "__r", "__l")}))
    left, right, own = F.col("__l"), F.col("__r"), F.col(pose)
    span = right["t"] - left["t"]
    alpha = (F.col(t) - left["t"]) / F.when(span > 0, span)

    def corrected(base: Column, predicted: Column) -> Column:
        off = g.let(g.multiply(base, right["own"], 4), lambda end: g.let(g.inverse_pose(end), lambda inv: g.multiply(right["goal"], inv, 4)))
        return g.let(off, lambda off: g.let(_part_way(off, alpha), lambda c: g.multiply(c, predicted, 4)))

    base = g.let(g.inverse_pose(left["own"]), lambda inv: g.multiply(left["goal"], inv, 4))
    moved = g.let(base, lambda b: g.let(g.multiply(b, own, 4), lambda p: F.when(span > 0, corrected(b, p)).otherwise(p)))
    fused_ = F.when(F.col("__fix").isNotNull(), F.col("__goal")).when(F.col(t).isNull() | left.isNull(), None).otherwise(moved)
    kind = F.when(F.col("__fix").isNotNull(), "anchor").when(F.col("__l").isNull() | F.col(t).isNull(), None).when(span > 0, "between").otherwise("outside")
    out = out.withColumns({"fused": fused_, "position": kind})
    return out.drop("__goal", "__fix", "__l", "__r")


def fusion_scores(rows: DataFrame, by: Sequence[str], *, fused_axes: Sequence[str], other_axes: Sequence[str], reference: Sequence[str], position: str = "position") -> DataFrame:
    """Alignment errors of a fused trajectory and another one by class of rows: anchor, between, and non-anchor (all but anchors).

    ``not_worse`` allows a slack of 1e-10, ``better`` none.
    """
    classes = F.when(F.col(position) == "anchor", F.array(F.lit("anchor"))).when(F.col(position) == "between", F.array(F.lit("between"), F.lit("non-anchor"))).otherwise(F.array(F.lit("non-anchor")))
    key = [*by, "class"]
    dealt = rows.withColumn("class", F.explode(classes))
    ours = trajectory_error(dealt, key, fused_axes, reference).select(*key, F.col("ate_mean").alias("fused_ate"), F.col("rows").alias("frames"))
    out = safe_join(ours, trajectory_error(dealt, key, other_axes, reference).select(*key, F.col("ate_mean").alias("other_ate")), key)
    gain = F.col("fused_ate") - F.col("other_ate")
    return out.withColumns({"delta": gain, "not_worse": gain <= 1e-10, "better": gain < 0})


def umeyama(source: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Similarity (scale, rotation, translation) from source to target points."""
    ms, mt = source.mean(0), target.mean(0)
    u, s, vt = np.linalg.svd((target - mt).T @ (source - ms) / len(source))
    sign = np.diag([1.0, 1.0, 1.0 if np.linalg.det(u) * np.linalg.det(vt) >= 0 else -1.0])
    rot = u @ sign @ vt
    scale = float(np.trace(np.diag(s) @ sign) / ((source - ms) ** 2).sum(1).mean())
    return scale, rot, mt - scale * rot @ ms


def _same() -> Column:
    """The similarity that changes nothing."""
    return F.struct(F.lit(1.0).alias("scale"), F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)]).alias("r"), F.array(*[F.lit(0.0)] * 3).alias("shift"))


def _moved(m: Column, p: Sequence[Column]) -> list[Column]:
    """A point under a similarity."""
    return [m["scale"] * v + m["shift"][i] for i, v in enumerate(g.apply(m["r"], p))]


def _after(a: Column, b: Column) -> Column:
    """First ``b``, then ``a``."""
    return F.struct((a["scale"] * b["scale"]).alias("scale"), g.multiply(a["r"], b["r"]).alias("r"), F.array(*_moved(a, [b["shift"][i] for i in range(3)])).alias("shift"))


def _enough(of: Column, least: int) -> Column:
    """``of``, or an error where a fit has too few frames."""
    few = F.raise_error(F.concat(F.lit("window "), F.col("__w").cast("string"), F.lit(" shares "), F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.lit(" frames with the windows before it")))
    return F.when(F.coalesce(F.col("n"), F.lit(0)) >= least, of).otherwise(few.cast("struct<scale: double, r: array<double>, shift: array<double>>"))


def window_maps(windows: DataFrame, by: Sequence[str], *, window: str, frame: str, axes: Sequence[str], least: int, block: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of windows with their first window, the similarity of each window to its session's first, and sessions it can't be taken of.

    A window is fitted to the one before over the frames that began there, by sums; the fits of a session
    are composed by a scan, as similarities compose associatively. The last window, which may reach back over
    several, is fitted to the composed ones. Sessions in which another window reaches back further are given apart.
    """
    rows = windows.where(F.col(frame).isNotNull() & F.col(window).isNotNull()).groupBy(*by, F.col(window).alias("__w"), frame).agg(F.min(F.struct(*axes)).alias("__p"))
    numbers = rows.select(*by, "__w").distinct().withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy("__w")) - 1)
    numbers = numbers.withColumn("__last", F.max("__k").over(Window.partitionBy(*by)))
    first = F.min(F.struct("__k", "__p")).over(Window.partitionBy(*by, frame))
    rows = cut(safe_join(rows, numbers, [*by, "__w"]).withColumn("__first", first))
    rows = rows.select("*", *[F.col(f"__p.{a}").cast("double").alias(f"__s{i}") for i, a in enumerate(axes)], *[F.col(f"__first.__p.{a}").cast("double").alias(f"__t{i}") for i, a in enumerate(axes)])
    source, target = [f"__s{i}" for i in range(3)], [f"__t{i}" for i in range(3)]
    shared = rows.where(F.col("__first.__k") < F.col("__k"))
    odd = shared.where((F.col("__k") < F.col("__last")) & (F.col("__first.__k") < F.col("__k") - 1)).select(*by).distinct()
    inner = safe_join(shared.where(F.col("__k") < F.col("__last")), odd, by, "left_anti") if by else shared.where(F.col("__k") < F.col("__last"))
    local = fits(inner, [*by, "__k"], source, target, scaled=True)
    numbers = numbers.select(*by, "__w", "__k", "__last").where((F.col("__k") < F.col("__last")) | (F.col("__k") == 0))
    numbers = safe_join(numbers, odd, by, "left_anti") if by else numbers
    steps = safe_join(numbers, local.withColumn("__m", F.struct("scale", "r", "shift")), [*by, "__k"], "left")
    step = F.when(F.col("__k") == 0, _same()).otherwise(_enough(F.col("__m"), least))
    steps = steps.select(*by, "__k", step.alias("__m"))
    maps = cut(scan(steps, by, "__k", F.col("__m"), _same(), _after, "__map", block=block).select(*by, "__k", "__map"))
    ends = shared.where(F.col("__k") == F.col("__last")).withColumn("__at", F.col("__first.__k"))
    ends = safe_join(ends, maps.withColumnRenamed("__k", "__at"), [*by, "__at"])
    ends = ends.withColumns({f"__t{i}": c for i, c in enumerate(_moved(F.col("__map"), [F.col(f"__t{i}") for i in range(3)]))})
    final = fits(ends, by, source, target, scaled=True).withColumn("__m", F.struct("scale", "r", "shift"))
    lasts = rows.where((F.col("__k") == F.col("__last")) & (F.col("__k") > 0)).select(*by, "__k", "__w").distinct()
    lasts = safe_join(lasts, odd, by, "left_anti") if by else lasts
    lasts = safe_join(lasts, final, by, "left").select(*by, "__k", _enough(F.col("__m"), least).alias("__map"))
    return rows, maps.unionByName(lasts), odd


def chain(windows: DataFrame, by: Sequence[str], *, window: str = "window", frame: str = "frame", axes: Sequence[str] = ("x", "y", "z"), least: int = 3, block: int = 256) -> DataFrame:
    """Chains overlapping windows of one trajectory, each with a frame and scale of its own.

    The first window is the base; each next one is mapped by the similarity over
    the frames it shares with what is chained so far, whose positions win. Fewer
    than ``least`` shared frames fail. Where windows overlap by half at most (but for the last) this is a scan
    (``window_maps``); sessions whose windows overlap by more are folded in order, one session a task.
    Rows without a frame or window are left out, a frame that a window repeats is taken once, a null session key is a session.
    """
    rows, maps, odd = window_maps(windows, by, window=window, frame=frame, axes=axes, least=least, block=block)
    schema = windows.select(*by, frame, *axes).schema
    own = rows.where(F.col("__first.__k") == F.col("__k")).select(*by, frame, "__k", "__s0", "__s1", "__s2")
    out = safe_join(own, maps, [*by, "__k"])
    at = [F.col(f"__s{i}") for i in range(3)]
    out = out.select(*by, frame, *[c.cast(windows.schema[a].dataType).alias(a) for a, c in zip(axes, _moved(F.col("__map"), at), strict=True)])
    if not by:
        return out

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        done: dict[int, np.ndarray] = {}
        for _, part in rows.sort_values(["__k", frame], kind="stable").groupby("__k", sort=True):
            at, xyz = part[frame].tolist(), part[["__s0", "__s1", "__s2"]].to_numpy(float)
            if done:
                both = [i for i, f in enumerate(at) if f in done]
                if len(both) < least:
                    raise ValueError(f"window {part['__w'].iloc[0]} shares {len(both)} frames with the windows before it")
                scale, rot, shift = umeyama(xyz[both], np.array([done[at[i]] for i in both]))
                xyz = scale * xyz @ rot.T + shift
            for f, p in zip(at, xyz, strict=True):
                done.setdefault(f, p)
        out = pd.DataFrame({frame: list(done), **{a: [p[i] for p in done.values()] for i, a in enumerate(axes)}})
        for c in by:
            out[c] = rows[c].iloc[0]
        return out[[*by, frame, *axes]]

    rest = safe_join(rows.select(*by, frame, "__k", "__w", "__s0", "__s1", "__s2"), odd, by, "left_semi")
    return out.unionByName(rest.groupBy(*by).applyInPandas(kernel, schema))


def relative_errors(df: DataFrame, by: Sequence[str], order: Sequence[str], *, estimate: str = "est", reference: str = "ref", width: float = WIDTH) -> DataFrame:
    """Per consecutive pair: difference of the steps in length and in rotation (degrees). Poses are arrays of 16."""
    rows = previous(df, by, order, {"__e": estimate, "__f": reference}, width=width).where("__e is not null")

    def errors(steps: Column) -> Column:
        e, f = steps["e"], steps["f"]
        moved = F.sqrt(sum((F.pow(e[k] - f[k], 2) for k in (7, 11)), F.pow(e[3] - f[3], 2)))
        turn = sum((e[4 * i + j] * f[4 * i + j] for i in range(3) for j in range(3) if (i, j) != (0, 0)), e[0] * f[0])
        return F.struct(moved.alias("step"), F.degrees(F.acos(g.clamp((turn - 1) / 2))).alias("turn"))

    steps = F.struct(g.relative_pose(estimate, "__e").alias("e"), g.relative_pose(reference, "__f").alias("f"))
    rows = rows.withColumn("__x", g.let(steps, errors))
    return rows.withColumns({"step_error": F.col("__x.step"), "turn_error": F.col("__x.turn")}).drop("__e", "__f", "__x")
