"""Column expressions of rotations, poses, cameras and fields of view.

A rotation is an array of 9 doubles (rows), a pose one of 16 or a rotation and a
translation; quaternions are (x, y, z, w). All are built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is evaluated once however often it is used."""
    return F.transform(F.array(value), then)[0]


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def to_unix(t: C, anchor: C) -> Column:
    """Wall time of a monotonic time."""
    return _c(t) + _c(anchor)


def from_unix(wall: C, anchor: C) -> Column:
    return _c(wall) - _c(anchor)


def upright_roll(grav_x: C, grav_y: C) -> Column:
    """Roll in degrees; null where gravity hardly lies in the image plane."""
    x, y = _c(grav_x), _c(grav_y)
    return F.when(F.hypot(x, y) >= 1e-3, F.degrees(F.atan2(x, -y)))


def orientation(roll: C) -> Column:
    r = _c(roll)
    return (
        F.when(r.isNull(), None)
        .when((r >= -45) & (r < 45), "landscape")
        .when((r >= 45) & (r < 135), "portrait")
        .when((r >= -135) & (r < -45), "portrait (inverted)")
        .otherwise("landscape (upside down)")
    )


def pitch_down(grav_z: C) -> Column:
    return F.degrees(F.asin(clamp(-_c(grav_z))))


def field_of_view(width: C, height: C, fx: C, fy: C) -> Column:
    """struct<h, v, d> in degrees."""
    w, h, x, y = (_c(v) for v in (width, height, fx, fy))
    angle = lambda half: 2 * F.degrees(F.atan(half))
    return F.struct(angle(w / (2 * x)).alias("h"), angle(h / (2 * y)).alias("v"), angle(F.hypot(w, h) / (2 * x)).alias("d"))


def quaternion_to_matrix(x: C, y: C, z: C, w: C) -> Column:
    """Rotation of a quaternion of any length; the identity if it has none."""
    parts = [_c(v).cast("double") for v in (x, y, z, w)]

    def matrix(q: Column) -> Column:
        x, y, z, w = (q[i] for i in range(4))
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
            2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
        )

    def unit(q: Column) -> Column:
        n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
        return let(F.when(n >= 1e-12, n), lambda n: F.transform(q, lambda v: v / n))

    m = let(F.array(*parts), lambda q: let(unit(q), matrix))
    return F.coalesce(F.when(F.get(m, F.lit(0)).isNotNull(), m), F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)]))


def matrix_to_quaternion(m: C) -> Column:
    """struct<x, y, z, w> of length 1 of a rotation: the branch of its greatest diagonal part."""
    unit = lambda q: let(F.sqrt(sum((q[k] * q[k] for k in "yzw"), q["x"] * q["x"])), lambda n: F.struct(*[(q[k] / n).alias(k) for k in "xyzw"]))
    return let(_greatest_branch(_c(m)), unit)


def _greatest_branch(m: Column) -> Column:
    a = [m[i] for i in range(9)]
    trace = a[0] + a[4] + a[8]

    def quaternion(s: Column, x: Column, y: Column, z: Column, w: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w"))

    safe = lambda v: F.sqrt(F.greatest(v, F.lit(1e-300))) * 2
    s0, s1, s2, s3 = safe(trace + 1), safe(1 + a[0] - a[4] - a[8]), safe(1 + a[4] - a[0] - a[8]), safe(1 + a[8] - a[0] - a[4])
    return (
        F.when(trace > 0, quaternion(s0, (a[7] - a[5]) / s0, (a[2] - a[6]) / s0, (a[3] - a[1]) / s0, s0 / 4))
        .when((a[0] > a[4]) & (a[0] > a[8]), quaternion(s1, s1 / 4, (a[1] + a[3]) / s1, (a[2] + a[6]) / s1, (a[7] - a[5]) / s1))
        .when(a[4] > a[8], quaternion(s2, (a[1] + a[3]) / s2, s2 / 4, (a[5] + a[7]) / s2, (a[2] - a[6]) / s2))
        .otherwise(quaternion(s3, (a[2] + a[6]) / s3, (a[5] + a[7]) / s3, s3 / 4, (a[3] - a[1]) / s3))
    )


def multiply(a: C, b: C, n: int = 3) -> Column:
    """Product of two n x n matrices (arrays by rows)."""
    a, b = _c(a), _c(b)
    return F.array(*[sum((a[i * n + k] * b[k * n + j] for k in range(1, n)), a[i * n] * b[j]) for i in range(n) for j in range(n)])


def transpose(a: C, n: int = 3) -> Column:
    a = _c(a)
    return F.array(*[a[j * n + i] for i in range(n) for j in range(n)])


def apply(a: C, v: Sequence[Column]) -> list[Column]:
    """A 3 x 3 matrix times a vector."""
    a = _c(a)
    return [a[3 * i] * v[0] + a[3 * i + 1] * v[1] + a[3 * i + 2] * v[2] for i in range(3)]


def pose(rotation: C, tx: C, ty: C, tz: C) -> Column:
    """4 x 4 pose."""
    r, t = _c(rotation), [_c(x) for x in (tx, ty, tz)]
    rows = [[r[3 * i], r[3 * i + 1], r[3 * i + 2], t[i]] for i in range(3)]
    return F.array(*[x for row in rows for x in row], *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])


def inverse_pose(p: C) -> Column:
    p = _c(p)
    t = [p[3], p[7], p[11]]
    cells = []
    for i in range(3):
        row = [p[i], p[4 + i], p[8 + i]]
        cells += [*row, -(row[0] * t[0] + row[1] * t[1] + row[2] * t[2])]
    return F.array(*cells, *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])


def relative_pose(current: C, before: C) -> Column:
    """Transform from the camera before to the current one: inverse(current) times before."""
    return let(inverse_pose(current), lambda inv: multiply(inv, before, 4))


def rotation_angle(m: C, n: int = 3) -> Column:
    """Angle of a rotation (or of a pose's, with n = 4), in radians."""
    m = _c(m)
    return F.acos(clamp((m[0] + m[n + 1] + m[2 * n + 2] - 1) / 2))


def is_rigid(p: C, tolerance: float = 1e-5) -> Column:
    """A pose whose last row, determinant and orthonormality hold within ``tolerance``."""
    p = _c(p)
    r = [[p[4 * i + j] for j in range(3)] for i in range(3)]
    near = lambda x, y: F.abs(x - y) <= tolerance
    ok = F.size(p) == 16
    for j, want in enumerate((0.0, 0.0, 0.0, 1.0)):
        ok = ok & near(p[12 + j], F.lit(want))
    for i in range(3):
        for j in range(i, 3):
            ok = ok & near(sum((r[k][i] * r[k][j] for k in (1, 2)), r[0][i] * r[0][j]), F.lit(float(i == j)))
    det = (
        r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1])
        - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0])
        + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])
    )
    return F.coalesce(ok & near(det, F.lit(1.0)), F.lit(False))


def camera_gravity(rotation: C) -> Column:
    """Gravity in the camera's frame: the negated second row of a y-up pose's rotation."""
    r = _c(rotation)
    return F.struct((-r[3]).alias("x"), (-r[4]).alias("y"), (-r[5]).alias("z"))


def depth_gravity(x: C, y: C, z: C) -> Column:
    """Unit gravity of a camera with y up and the view along -z, in depth coordinates (y down, view along z); null without length."""
    x, y, z = (_c(v) for v in (x, y, z))
    n = F.sqrt(x * x + y * y + z * z)
    n = F.when(n > 1e-9, n)
    return F.struct((x / n).alias("x"), (-y / n).alias("y"), (-z / n).alias("z"))


def axis_angle(x: C, y: C, z: C, angle: C) -> Column:
    """Rotation about a unit axis."""
    x, y, z, a = (_c(v) for v in (x, y, z, angle))
    c, s = F.cos(a), F.sin(a)
    k = 1 - c
    return F.array(
        c + x * x * k, x * y * k - z * s, x * z * k + y * s,
        y * x * k + z * s, c + y * y * k, y * z * k - x * s,
        z * x * k - y * s, z * y * k + x * s, c + z * z * k,
    )


def minimal_rotation(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Least rotation that takes unit vector a to b; half a turn about any normal if they are opposite."""
    v = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    s = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    c = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    ok = F.when(s > 1e-9, s)
    turn = axis_angle(v[0] / ok, v[1] / ok, v[2] / ok, F.atan2(s, c))
    # A normal of a: crossed with the axis it is least along.
    along_x = F.abs(a[0]) < 0.9
    n = [F.when(along_x, F.lit(0.0)).otherwise(-a[2]), F.when(along_x, a[2]).otherwise(F.lit(0.0)), F.when(along_x, -a[1]).otherwise(a[0])]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    half = axis_angle(n[0] / size, n[1] / size, n[2] / size, F.lit(3.141592653589793))
    same = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    return F.when(s > 1e-9, turn).when(c > 0, same).otherwise(half)


def back_project(u: C, v: C, z: C, fx: C, fy: C, cx: C, cy: C) -> Column:
    """Camera point of a pixel with depth."""
    u, v, z, fx, fy, cx, cy = (_c(a) for a in (u, v, z, fx, fy, cx, cy))
    return F.struct(((u - cx) * z / fx).alias("x"), ((v - cy) * z / fy).alias("y"), z.alias("z"))


def project(x: C, y: C, z: C, fx: C, fy: C, cx: C, cy: C) -> Column:
    """Pixel of a camera point and the derivatives by the point: struct<u, v, ux, uz, vy, vz>."""
    x, y, z, fx, fy, cx, cy = (_c(a) for a in (x, y, z, fx, fy, cx, cy))
    return F.struct(
        (fx * x / z + cx).alias("u"), (fy * y / z + cy).alias("v"), (fx / z).alias("ux"), (-fx * x / (z * z)).alias("uz"), (fy / z).alias("vy"), (-fy * y / (z * z)).alias("vz")
    )


def scaled_intrinsics(fx: C, fy: C, cx: C, cy: C, width: C, height: C, to_width: C, to_height: C) -> Column:
    """Intrinsics of another buffer size, by the sizes of the buffers (never by the principal point)."""
    sx, sy = _c(to_width) / _c(width), _c(to_height) / _c(height)
    return F.struct((_c(fx) * sx).alias("fx"), (_c(fy) * sy).alias("fy"), (_c(cx) * sx).alias("cx"), (_c(cy) * sy).alias("cy"))


def crop_for_hfov(width: C, fx: C, hfov: C) -> Column:
    """Width of the centred crop with a horizontal field of view, from 64 up to the whole."""
    want = F.bround(2 * _c(fx) * F.tan(F.radians(_c(hfov)) / 2))
    return F.greatest(F.lit(64), F.least(_c(width), want)).cast("int")


def crop_geometry(width: C, height: C, out_width: int, out_height: int) -> Column:
    """Largest centred crop with the output's aspect: struct<x, y, w, h, scale>."""
    w, h = _c(width).cast("double"), _c(height).cast("double")
    wide = w * out_height > h * out_width
    cw = F.when(wide, F.bround(h * out_width / out_height)).otherwise(w)
    ch = F.when(wide, h).otherwise(F.bround(w * out_height / out_width))
    return F.struct(F.floor((w - cw) / 2).cast("int").alias("x"), F.floor((h - ch) / 2).cast("int").alias("y"), cw.cast("int").alias("w"), ch.cast("int").alias("h"), (out_width / cw).alias("scale"))


def export_crop(fit: str, width: C, height: C, out_width: int, out_height: int, *, fx: C | None = None, fy: C | None = None, hfov: float | None = None) -> Column:
    """Crop that a frame is exported with: struct<left, top, w, h, clamped>.

    With ``hfov`` the one of that horizontal field of view and square pixels, clamped to the
    widest that fits; else by ``fit``: ``crop`` to the output's aspect, or the ``whole`` frame.
    """
    w, h = _c(width).cast("double"), _c(height).cast("double")
    clamped = F.lit(False)
    if hfov is not None:
        x, y = _c(fx).cast("double"), _c(fy).cast("double")
        cw = F.bround(2.0 * x * F.tan(F.radians(F.lit(float(hfov))) / 2.0))
        ch = F.bround(cw * (y / x) * (out_height / out_width))
        clamped = (cw > w) | (ch > h)
        scale = F.least(w / cw, h / ch)
        cw, ch = F.when(clamped, F.floor(cw * scale)).otherwise(cw), F.when(clamped, F.floor(ch * scale)).otherwise(ch)
    elif fit == "crop":
        aspect = out_width / out_height
        wide = w / h > aspect
        cw, ch = F.when(wide, F.bround(h * aspect)).otherwise(w), F.when(wide, h).otherwise(F.bround(w / aspect))
    elif fit == "whole":
        cw, ch = w, h
    else:
        raise ValueError(f"unknown fit {fit}")
    parts = {"left": F.floor((w - cw) / 2), "top": F.floor((h - ch) / 2), "w": cw, "h": ch}
    return F.struct(*[v.cast("int").alias(k) for k, v in parts.items()], clamped.alias("clamped"))


def world_basis(forward: Sequence[Column], up: Sequence[Column]) -> Column:
    """Rotation from a y-up world to one with z up and x along the heading on the floor.

    A heading of no length falls back to the camera's up; without either the query fails.
    """
    long = lambda v: F.hypot(v[0], v[2])
    n = F.when(long(forward) >= 1e-3, long(forward)).otherwise(long(up))
    x = F.when(long(forward) >= 1e-3, forward[0]).otherwise(up[0]) / F.when(n >= 1e-9, n)
    z = F.when(long(forward) >= 1e-3, forward[2]).otherwise(up[2]) / F.when(n >= 1e-9, n)
    zero, one = F.lit(0.0), F.lit(1.0)
    # Columns: heading, left, up.
    basis = F.array(x, z, zero, zero, zero, one, z, -x, zero)
    return F.when(n >= 1e-9, basis).otherwise(F.raise_error(F.lit("no heading to base the world on")).cast("array<double>"))


def rigid_interpolation(a: C, b: C, alpha: C) -> Column:
    """Pose between two struct<x, y, z, w, tx, ty, tz>: slerp (lerp where close) and lerp."""
    ends = F.struct(_c(a).alias("a"), _c(b).alias("b"), clamp(_c(alpha), 0.0, 1.0).alias("t"))

    def shares(e: Column) -> Column:
        """How much of either end's quaternion, from the angle between them."""
        dot = sum((e["a"][k] * e["b"][k] for k in "yzw"), e["a"]["x"] * e["b"]["x"])

        def of(dot: Column) -> Column:
            theta = F.acos(F.least(F.lit(1.0), F.abs(dot)))
            s = F.when(F.abs(dot) < 1 - 1e-8, F.sin(theta))
            wa, wb = F.coalesce(F.sin((1 - e["t"]) * theta) / s, 1 - e["t"]), F.coalesce(F.sin(e["t"] * theta) / s, e["t"])
            return F.struct(wa.alias("a"), (wb * F.when(dot < 0, -1.0).otherwise(1.0)).alias("b"))

        return let(dot, of)

    def between(e: Column) -> Column:
        mixed = let(shares(e), lambda w: F.struct(*[(w["a"] * e["a"][k] + w["b"] * e["b"][k]).alias(k) for k in "xyzw"]))
        unit = let(mixed, lambda q: let(F.sqrt(sum((q[k] * q[k] for k in "yzw"), q["x"] * q["x"])), lambda n: F.struct(*[(q[k] / n).alias(k) for k in "xyzw"])))
        shift = [(e["a"][k] + (e["b"][k] - e["a"][k]) * e["t"]).alias(k) for k in ("tx", "ty", "tz")]
        return let(unit, lambda q: F.struct(*[q[k].alias(k) for k in "xyzw"], *shift))

    return let(ends, between)


def fundamental(essential: C, fx: C, fy: C, cx: C, cy: C) -> Column:
    """K^-T E K^-1 for a camera without skew."""
    e, fx, fy, cx, cy = (_c(v) for v in (essential, fx, fy, cx, cy))
    left = [e[0] / fx, e[1] / fx, e[2] / fx, e[3] / fy, e[4] / fy, e[5] / fy]
    left += [e[6 + j] - cx * left[j] - cy * left[3 + j] for j in range(3)]
    out = []
    for i in range(3):
        a, b = left[3 * i] / fx, left[3 * i + 1] / fy
        out += [a, b, left[3 * i + 2] - cx * a - cy * b]
    return F.array(*out)


def sampson(f: C, x1: C, y1: C, x2: C, y2: C) -> Column:
    """First-order distance of a correspondence to the epipolar constraint, in pixels."""
    f, x1, y1, x2, y2 = (_c(v) for v in (f, x1, y1, x2, y2))
    l2 = [f[3 * i] * x1 + f[3 * i + 1] * y1 + f[3 * i + 2] for i in range(3)]
    l1 = [f[i] * x2 + f[3 + i] * y2 + f[6 + i] for i in range(2)]
    error = x2 * l2[0] + y2 * l2[1] + l2[2]
    return F.abs(error) / F.sqrt(F.greatest(l2[0] * l2[0] + l2[1] * l2[1] + l1[0] * l1[0] + l1[1] * l1[1], F.lit(1e-300)))


def skew(x: C, y: C, z: C) -> Column:
    x, y, z = _c(x), _c(y), _c(z)
    o = F.lit(0.0)
    return F.array(o, -z, y, z, o, -x, -y, x, o)
