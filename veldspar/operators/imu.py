"""Motion between frames from an inertial stream.

Attitudes are taken at both ends of a step by nearest-in-time joins, accelerations averaged in
between from prefix sums; neither joins by range nor gathers a session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .ordered import WIDTH
from .timeops import interval_averages, nearest

#: Device axes to camera axes, camera axes to depth axes (by rows), and metres a second squared of one g.
CAMERA_FROM_DEVICE = (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)
CAMERA_FROM_DEPTH = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0)
STANDARD_GRAVITY = 9.80665
QUATERNION, ACCELERATION = ("qx", "qy", "qz", "qw"), ("ax", "ay", "az")


def _matrix(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def depth_from_device() -> Column:
    """Rotation from device to depth axes."""
    return g.multiply(g.transpose(_matrix(CAMERA_FROM_DEPTH)), _matrix(CAMERA_FROM_DEVICE))


def absolute_rotation(quaternion: Sequence[Column]) -> Column:
    """World-from-depth rotation of a world-from-device quaternion; null without length."""
    size = sum((c * c for c in quaternion[1:]), quaternion[0] * quaternion[0])
    turned = g.let(g.quaternion_to_matrix(*quaternion), lambda r: g.multiply(r, g.transpose(depth_from_device())))
    return F.when(size > 0, turned)


def relative_motion(steps: DataFrame, motion: DataFrame, by: Sequence[str], *, start: str = "t0", end: str = "t1", t: str = "t", order: Sequence[str] = (), tolerance: float = 0.05, width: float = WIDTH) -> DataFrame:
    """Adds ``rotation`` (9, previous camera from current camera, in depth axes) and ``acceleration`` (3, metres a second squared).

    Both are null where an end has no time, the end is not after the start, or no sample is within
    ``tolerance`` of an end (of two as near, the later counts) or its quaternion is null or 0. The acceleration is
    the mean of the samples from start to end, both included; null without samples, or where one isn't finite.
    Samples without a finite time are left out; a null session key is a session.
    """
    names = steps.columns
    finite = lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))
    at = "at"
    while at in names:
        at += "_"
    samples = motion.where(finite(F.col(t))).withColumnRenamed(t, at)
    able = finite(F.col(start)) & finite(F.col(end)) & (F.col(end) > F.col(start))
    out = steps.withColumns({"__start": F.when(able, F.col(start)), "__end": F.when(able, F.col(end))})
    for place in ("start", "end"):
        out = nearest(out.withColumn(at, F.col(f"__{place}")), samples, by, t=at, right_order=order, values=QUATERNION, prefix=f"__{place}_", tie="later", tolerance=tolerance, width=width)
        out = out.select(*names, *[c for c in out.columns if c.startswith("__") and not c.endswith("_dt")])
    whole = [F.when(finite(F.col(c)), F.col(c)) for c in ACCELERATION]
    values = {f"__{c}": v for c, v in zip(ACCELERATION, whole, strict=True)} | {"__all": F.lit(1.0)}
    out = interval_averages(out, samples, by, start="__start", end="__end", t=at, values=values, width=width)
    first, last = ([F.col(f"__{p}_{c}") for c in QUATERNION] for p in ("start", "end"))
    turn = g.let(g.multiply(g.transpose(F.col("__m0")), F.col("__m1")), lambda r: g.let(depth_from_device(), lambda d: g.multiply(g.multiply(d, r), g.transpose(d))))
    out = out.withColumns({"__m0": g.quaternion_to_matrix(*first), "__m1": g.quaternion_to_matrix(*last)})
    has = F.lit(True)
    for q in (first, last):
        has = has & F.coalesce(sum((c * c for c in q[1:]), q[0] * q[0]) > 0, F.lit(False))
    full = has & (F.col("__all_n") > 0)
    for c in ACCELERATION:
        full = full & (F.col(f"__{c}_n") == F.col("__all_n"))
    moved = F.array(*[x * STANDARD_GRAVITY for x in g.apply(depth_from_device(), [F.col(f"__{c}") for c in ACCELERATION])])
    return out.select(*names, F.when(has, turn).alias("rotation"), F.when(full, moved).alias("acceleration"))
