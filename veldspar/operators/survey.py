"""Summaries of sessions: survey rows, episodes, pairing, confidence, windows, listings.

All are aggregations by session that combine before the shuffle. Nulls don't count in a
measure; a session without any value has a null one; a null session key is a session of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .ranks import exact_percentiles
from .ordered import WIDTH, numbered, safe_join
from .quality import circular_mean, path, sampled_fraction, verdict
from .selection import floors, tracking_normal

#: The camera that sessions are matched to (fixed values): degrees and metres.
TARGET_HFOV, TARGET_VFOV, TARGET_HEIGHT, HEIGHT_SLACK = 96.3, 64.6, 1.15, 0.15


def camera_height(poses: DataFrame, planes: DataFrame, by: Sequence[str], *, y: str = "ty") -> DataFrame:
    """Mean camera height over the mean floor plane (null without one), its difference to the target, and whether that is small."""
    floor = floors(planes).groupBy(*by).agg(F.avg(y).alias("__floor"))
    out = safe_join(poses.groupBy(*by).agg(F.avg(y).alias("__mean")), floor, by, "left")
    out = out.withColumn("height", F.col("__mean") - F.col("__floor")).withColumn("off", F.col("height") - TARGET_HEIGHT)
    return out.withColumn("on_target", F.abs("off") < HEIGHT_SLACK).drop("__mean", "__floor")


def rig_delta(h: Column, v: Column) -> Column:
    """struct<d_hfov, d_vfov>: degrees over the target camera's."""
    return F.struct((h - TARGET_HFOV).alias("d_hfov"), (v - TARGET_VFOV).alias("d_vfov"))


def image_bytes(frames: DataFrame, by: Sequence[str], size: str = "bytes") -> DataFrame:
    return frames.groupBy(*by).agg(F.count("*").alias("images"), F.sum(size).alias("bytes"))


def plane_classes(planes: DataFrame, by: Sequence[str], *, classification: str = "classification") -> DataFrame:
    return planes.groupBy(*by, classification).agg(F.count("*").alias("n"))


def survey(
    poses: DataFrame,
    index: DataFrame,
    events: DataFrame,
    sessions: DataFrame,
    by: Sequence[str],
    *,
    t: str = "t",
    order: Sequence[str] = ("ordinal",),
    axes: Sequence[str] = ("tx", "ty", "tz"),
    width: float = WIDTH,
) -> DataFrame:
    """One triage row for each session that has poses, with its verdict.

    ``poses``: t, order, axes, tracking. ``index`` (depth): t, order, hits and total of the confidence, null where
    it wasn't recorded. ``events``: kind. ``sessions``: complete, counts_agree, settled, bytes.
    """
    place = F.struct(*order)
    whole = poses.groupBy(*by).agg((F.max_by(t, place) - F.min_by(t, place)).alias("duration"), F.count(F.when(~F.coalesce(F.col("tracking") == "normal", F.lit(False)), 1)).alias("unconverged"))
    walked = path(tracking_normal(poses), by, [*order], axes, width=width).select(*by, F.col("length").alias("travelled"))
    span = F.max_by(t, place) - F.min_by(t, place)
    depth = index.groupBy(*by).agg(F.count("*").alias("depth_frames"), F.when(span > 0, (F.count("*") - 1) / F.when(span > 0, span)).otherwise(0.0).alias("depth_hz"))
    bright = _probed(index, by, order, width=width)
    log = events.groupBy(*by).agg(F.count(F.when(F.startswith("kind", F.lit("thermal")), 1)).alias("thermal"), F.count(F.when(F.col("kind") == "ar.interruptionEnded", 1)).alias("breaks"))
    out = whole
    for part in (walked, depth, bright, log, sessions.select(*by, "complete", "counts_agree", "settled", "bytes")):
        out = safe_join(out, part, by, "left")
    out = out.na.fill(0, ["travelled", "depth_frames", "depth_hz", "thermal", "breaks", "bytes"]).na.fill(False, ["complete", "counts_agree"])
    out = out.withColumn("speed", F.when(F.col("duration") > 0, F.col("travelled") / F.when(F.col("duration") > 0, F.col("duration"))).otherwise(0.0))
    return out.withColumn("verdict", verdict(F.col("usable"), F.col("depth_hz"), F.col("travelled"), F.col("complete"), F.col("counts_agree"), F.col("thermal") > 0))


def _probed(index: DataFrame, by: Sequence[str], order: Sequence[str], *, probes: int = 8, width: float = WIDTH) -> DataFrame:
    """Share of confident pixels over every (n // probes)-th frame that has them, the first ``probes`` of those; null without any."""
    rows = numbered(index, by, order, "__i", width=width)
    step = rows.groupBy(*by).agg(F.greatest(F.lit(1), F.floor(F.count("*") / probes)).cast("bigint").alias("__step"))
    rows = safe_join(rows, step, by).where((F.col("__i") % F.col("__step") == 0) & F.col("total").isNotNull())
    # The first of them: at most 2 * probes + 1 are left of a session.
    first = F.slice(F.sort_array(F.collect_list(F.struct("__i", "hits", "total"))), 1, probes)
    rows = rows.groupBy(*by).agg(first.alias("__p"))
    add = lambda field: F.aggregate(F.transform("__p", lambda p: p[field].cast("double")), F.lit(0.0), lambda a, x: a + x)
    return rows.select(*by, (add("hits") / F.greatest(add("total"), F.lit(1.0))).alias("usable"))


def episode_summary(rows: DataFrame, by: Sequence[str], *, t: str = "t", roll: str = "roll", z: str = "z") -> DataFrame:
    """frames, roll_std and vertical_std (of the population), mean_roll (circular, without sign), duration, and what is too much."""
    out = rows.groupBy(*by).agg(F.count("*").alias("frames"), F.stddev_pop(roll).alias("roll_std"), F.abs(circular_mean(F.col(roll))).alias("mean_roll"), F.stddev_pop(z).alias("vertical_std"), (F.max(t) - F.min(t)).alias("duration"))
    flags = [F.when(F.col(c) > most, c) for c, most in (("roll_std", 4.0), ("mean_roll", 4.0), ("vertical_std", 0.1))]
    return out.withColumn("flags", F.concat_ws(" ", *flags))


def episode_poses(poses: DataFrame, by: Sequence[str], order: Sequence[str], *, t: str = "t", rotate_180: Column | None = None) -> DataFrame:
    """Poses in the frame of the session's first one: t from 0, heading x, left y, up z, and the exported roll.

    ``poses`` has a rotation ``r`` (9) of a y-up world and tx, ty, tz. Adds ft, x, y, z, rotation (9) and roll in degrees.
    """
    # Camera axes to heading, left, up; half a turn about the view for images shot upside down.
    axes = F.array(*[F.lit(float(v)) for v in (0, -1, 0, 0, 0, 1, -1, 0, 0)])
    flip = F.array(*[F.lit(float(v)) for v in (-1, 0, 0, 0, -1, 0, 0, 0, 1)])
    first = poses.groupBy(*by).agg(F.min_by(F.struct(F.col(t).alias("t"), F.col("r").alias("r"), "tx", "ty", "tz"), F.struct(*order)).alias("__f"))
    f = F.col("__f.r")
    first = first.withColumn("__n", g.world_basis([-f[2], -f[5], -f[8]], [f[1], f[4], f[7]]))
    out = safe_join(poses, first, by)
    r = F.col("r") if rotate_180 is None else F.when(rotate_180, g.multiply("r", flip)).otherwise(F.col("r"))
    out = out.withColumn("__m", g.let(r, lambda m: g.multiply(m, axes)))
    out = out.withColumn("rotation", g.let(g.transpose("__n"), lambda n: g.multiply(n, "__m")))
    d = [F.col(c) - F.col(f"__f.{c}") for c in ("tx", "ty", "tz")]
    x, y, z = g.apply(g.transpose("__n"), d)
    out = out.withColumns({"ft": F.col(t) - F.col("__f.t"), "x": x, "y": y, "z": z, "roll": F.degrees(F.atan2(F.col("rotation")[7], F.col("rotation")[8]))})
    return out.drop("__f", "__n", "__m")


def _long(values: Sequence[str]) -> Column:
    """A row for each of some columns: its name and value, as ``__x``."""
    return F.explode(F.array(*[F.struct(F.lit(v).alias("__of"), F.col(v).cast("double").alias("__value")) for v in values])).alias("__x")


def split_medians(rows: DataFrame, by: Sequence[str], flag: str, values: Sequence[str]) -> DataFrame:
    """Medians of flagged rows and of the others, where a session has both, and how far the others lie above."""
    counts = rows.groupBy(*by).agg(F.count(F.when(F.col(flag), 1)).alias("flagged"), F.count(F.when(~F.col(flag), 1)).alias("others"))
    key = [*by, "__flag", "__of"]
    long = rows.select(*by, F.col(flag).alias("__flag"), _long(values)).select(*by, "__flag", "__x.*").where(F.col("__flag").isNotNull())
    mids = exact_percentiles(long, key, "__value", {"__mid": 0.5})
    sides = {f"{v}_{side}": F.max(F.when((F.col("__of") == v) & (F.col("__flag") == hit), F.col("__mid"))) for v in values for side, hit in (("flagged", True), ("others", False))}
    out = safe_join(counts.where("flagged > 0 and others > 0"), mids.groupBy(*by).agg(*[c.alias(n) for n, c in sides.items()]), by)
    return out.withColumns({f"{v}_deficit": F.col(f"{v}_others") - F.col(f"{v}_flagged") for v in values})


def depth_usable(pixels: DataFrame, by: Sequence[str], *, place: str = "place", confidence: str = "confidence", every: int = 16) -> DataFrame:
    """Share of every ``every``-th pixel whose confidence is 1 or more."""
    seen = pixels.where(F.col(place) % every == 0)
    return seen.groupBy(*by).agg(F.avg(F.when(F.col(confidence) >= 1, 1.0).otherwise(0.0)).alias("usable"), F.count("*").alias("seen"))


def pairing(rows: DataFrame, by: Sequence[str], *, tracking: str = "tracking", dt: str = "depth_dt") -> DataFrame:
    """Rows, with converged tracking, with an exact, a nearest and no partner, and the worst offset in ms."""
    d = F.col(dt)
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count(F.when(F.col(tracking) == "normal", 1)).alias("usable"),
        F.count(F.when(d == 0, 1)).alias("exact"),
        F.count(F.when(d != 0, 1)).alias("nearest"),
        F.count(F.when(d.isNull(), 1)).alias("missing"),
        F.max(F.when(d != 0, F.abs(d) * 1000)).alias("worst_ms"),
    )


def middle_confidence(index: DataFrame, by: Sequence[str], order: Sequence[str], *, counts: Sequence[str] = ("low", "medium", "high"), warn: float = 0.8, width: float = WIDTH) -> DataFrame:
    """Shares of the confidence classes in the middle frame (row n // 2), and whether almost all of it is low."""
    rows = numbered(index, by, order, "__i", width=width)
    rows = safe_join(rows, rows.groupBy(*by).agg(F.floor(F.count("*") / 2).alias("__half")), by).where("__i = __half")
    total = F.greatest(sum((F.col(c) for c in counts[1:]), F.col(counts[0])), F.lit(1))
    return rows.select(*by, *[(F.col(c) / total).alias(c) for c in counts]).withColumn("warns", F.col(counts[0]) > warn)


def any_device(index: DataFrame, by: Sequence[str], cond: str = "cond") -> DataFrame:
    """Whether any row was measured on the device."""
    return index.groupBy(*by).agg(F.max(F.col(cond).isNotNull()).alias("device"))


def rates(before: DataFrame, after: DataFrame, by: Sequence[str], *, t: str = "t", least: float = 12.0) -> DataFrame:
    """Rate of what arrived and of what was scored, and whether the latter is under ``least``."""

    def rate(rows: DataFrame, name: str) -> DataFrame:
        span = F.max(t) - F.min(t)
        return rows.groupBy(*by).agg(F.when(span > 0, (F.count("*") - 1) / F.when(span > 0, span)).otherwise(0.0).alias(name))

    out = safe_join(rate(before, "arrived_hz"), rate(after, "scored_hz"), by, "left").na.fill(0.0, ["scored_hz"])
    return out.withColumn("warns", F.col("scored_hz") < least)


def endpoint_errors(rows: DataFrame, by: Sequence[str], order: Sequence[str], *, reference: str = "ref", others: Sequence[str], scales: DataFrame | None = None) -> DataFrame:
    """First-to-last motion of a window in several trajectories of poses (16): lengths, errors, angles and scales.

    Per name in ``others``: name_m, name_err_m, name_rot_deg, name_scale (null under a micrometre of reference), and with
    ``scales`` (scale) name_fixed_err_m.
    """
    place = F.struct(*order)
    names = (reference, *others)
    ends = rows.groupBy(*by).agg(*[f(c, place).alias(f"__{k}_{c}") for c in names for k, f in (("a", F.min_by), ("b", F.max_by))])
    ends = ends.withColumns({f"__{c}": g.relative_pose(f"__a_{c}", f"__b_{c}") for c in names})
    if scales is not None:
        ends = safe_join(ends, scales.select(*by, F.col("scale").alias("__k")), by, "left")
    at = lambda c, k=None: [F.col(f"__{c}")[i] * (1 if k is None else k) for i in (3, 7, 11)]
    size = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    off = lambda v, w: size([x - y for x, y in zip(v, w, strict=True)])
    ref = at(reference)
    out = {f"{reference}_m": size(ref)}
    for c in others:
        m, n = F.col(f"__{reference}"), F.col(f"__{c}")
        trace = sum((m[4 * i + j] * n[4 * i + j] for i in range(3) for j in range(3) if i or j), m[0] * n[0])
        out |= {f"{c}_m": size(at(c)), f"{c}_err_m": off(at(c), ref), f"{c}_rot_deg": F.degrees(F.acos(g.clamp((trace - 1) / 2))), f"{c}_scale": F.when(size(ref) > 1e-6, size(at(c)) / F.when(size(ref) > 1e-6, size(ref)))}
        if scales is not None:
            out[f"{c}_fixed_err_m"] = off(at(c, F.col("__k")), ref)
    return ends.select(*by, *[v.alias(k) for k, v in out.items()])


def window_scores(windows: DataFrame, by: Sequence[str], *, ours: str, theirs: str, scale: str) -> DataFrame:
    """Median errors of two trajectories over a session's windows, the median scale, and how often ours is nearer."""
    counts = windows.groupBy(*by).agg(F.count(F.when(F.col(ours) < F.col(theirs), 1)).alias("wins"), F.count("*").alias("windows"))
    names = dict(zip(dict.fromkeys((ours, theirs, scale)), ("ours", "theirs", "scale"), strict=True))
    mids = exact_percentiles(windows.select(*by, _long(list(names))).select(*by, "__x.*"), [*by, "__of"], "__value", {"__mid": 0.5})
    mids = mids.groupBy(*by).agg(*[F.max(F.when(F.col("__of") == c, F.col("__mid"))).alias(n) for c, n in names.items()])
    return safe_join(mids, counts, by)


def session_list(manifests: DataFrame, files: DataFrame, uploaded: DataFrame, *, session: str = "session") -> DataFrame:
    """A row for each session: duration (null while open), bytes, complete, uploaded, and its streams that aren't empty as text."""
    sizes = files.groupBy(session).agg(F.sum("size").alias("bytes"), F.max(F.col("name") == ".complete").alias("complete"))
    out = safe_join(manifests, sizes, [session], "left")
    out = safe_join(out, uploaded.select(session, F.lit(True).alias("uploaded")), [session], "left")
    shown = [F.when(F.try_element_at("counts", F.lit(key)) > 0, F.format_string(f"{label} %d", F.try_element_at("counts", F.lit(key)))) for label, key in (("gps", "location"), ("imu", "motion"), ("pose", "pose"), ("depth", "depth"))]
    summary = F.concat_ws(" · ", *shown)
    out = out.select(session, (F.col("endedAt") - F.col("startedAt")).alias("duration"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("complete", F.lit(False)).alias("complete"), F.coalesce("uploaded", F.lit(False)).alias("uploaded"), F.when(summary != "", summary).otherwise(F.col(session)).alias("summary"))
    return out


def video_format(formats: DataFrame, by: Sequence[str], *, video_fps: float | None = None, tallest: bool = True) -> DataFrame:
    """The format of the largest area (of equals the first by width), among those of 4:3 if any with ``tallest``.

    With ``video_fps`` only formats of that rate count, unless there is none. ``formats``: width, height, fps.
    """
    ok = F.lit(True) if video_fps is None else F.col("fps") >= video_fps
    four_three = (F.col("height") > 0) & (F.abs(F.col("width") / F.when(F.col("height") > 0, F.col("height")) - 4.0 / 3.0) < 0.02) if tallest else F.lit(True)
    rows = formats.withColumns({"__ok": F.coalesce(ok, F.lit(False)), "__tall": F.coalesce(four_three, F.lit(False))})
    # A format of the wanted rate comes before any other; among either, 4:3 does.
    rank = F.struct("__ok", "__tall", (F.col("width") * F.col("height")).alias("area"), (-F.col("width")).alias("w"), "fps")
    return rows.groupBy(*by).agg(F.max_by(F.struct("width", "height", "fps"), rank).alias("__f")).select(*by, "__f.*")


__all__ = [
    "any_device", "camera_height", "depth_usable", "endpoint_errors", "episode_poses", "episode_summary", "image_bytes", "middle_confidence", "pairing",
    "plane_classes", "rates", "rig_delta", "sampled_fraction", "session_list", "split_medians", "survey", "video_format", "window_scores",
]
