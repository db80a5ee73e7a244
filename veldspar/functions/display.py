"""Column expressions of labels, estimates and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def byte_size(n: Column) -> Column:
    """Bytes with a unit of 1000s and one digit; a 5 behind it rounds up, as the decimal number reads."""
    out = F.format_string("%d B", n.cast("bigint"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1000**power, F.format_string(f"%.1f {unit}", n / float(1000**power))).otherwise(out)
    return out


def session_title(session_id: Column) -> Column:
    """Time of an id ``yyyyMMdd-HHmmss-xxxxxx`` as text; the id itself if it has none."""
    t = F.try_to_timestamp(F.substring(session_id, 1, 15), F.lit("yyyyMMdd-HHmmss"))
    return F.coalesce(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), session_id)


def speed_kph(metres_per_second: Column) -> Column:
    return F.when(metres_per_second < 0, F.lit("-")).otherwise(F.format_string("%.1f km/h", metres_per_second * 3.6))


def storage_rate(stills_hz: Column, still_bytes: Column, depth_hz: Column, depth_bytes: Column, confidence_bytes: Column, motion_hz: Column, motion_row_bytes: Column, video_bits: Column) -> Column:
    """Bytes a second of a recording's configuration."""
    return stills_hz * still_bytes + depth_hz * (depth_bytes + confidence_bytes) + motion_hz * motion_row_bytes + video_bits / 8


def upload_percent(sent: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.floor(sent * 100.0 / F.when(total > 0, total) + 0.5))).otherwise(0).cast("int")


def content_type(path: Column) -> Column:
    kind = F.lower(F.element_at(F.split(path, r"\."), -1))
    out = F.lit("application/octet-stream")
    for ends, name in ((("json",), "application/json"), (("jsonl",), "application/x-ndjson"), (("jpg", "jpeg"), "image/jpeg"), (("mov",), "video/quicktime"), (("mp4",), "video/mp4"), (("txt",), "text/plain")):
        out = F.when(kind.isin(*ends), name).otherwise(out)
    return out


def conditioning_label(cond: Column) -> Column:
    return F.when(cond.isNull(), None).when(cond >= 0.02, "strong").when(cond >= 0.007, "ok").otherwise("weak")


def conditioning_verdict(median: Column) -> Column:
    return F.when(median.isNull(), None).when(median < 0.005, "refuse").when(median < 0.007, "watch").otherwise("ok")


def nullif_negative(x: Column) -> Column:
    """Readings whose negative values mean none."""
    return F.when(x >= 0, x)


def migrated_depth_hz(depth_hz: Column, default: float = 30.0) -> Column:
    return F.when(depth_hz < 10, default).otherwise(depth_hz)


def migrated_confidence(recorded: Column) -> Column:
    """Confidence was off by an old default only, so it is on wherever it was stored."""
    return F.when(recorded.isNotNull(), True)


def drift_rate(mean_error: Column, duration: Column) -> Column:
    """Error a second, of a millionth of a second at least."""
    return mean_error / F.greatest(duration, F.lit(1e-6))


def safe_upload_path(path: Column) -> Column:
    """At least two parts, none hidden (but .complete), without escapes or separators."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: (p == "") | (F.startswith(p, F.lit(".")) & (p != ".complete")) | F.contains(p, F.lit("%")) | F.contains(p, F.lit("\\")) | F.contains(p, F.lit("\0")))
    return (F.size(parts) >= 2) & ~bad


def live_verdict(flat_fraction: Column, usable: Column, cond: Column) -> Column:
    """What a recording screen says: flat before dark before the label."""
    return F.when(flat_fraction > 0.5, "flat").when(usable < 0.2, "dark").otherwise(conditioning_label(cond))


def first_warning(**conditions: Column) -> Column:
    """Name of the first condition that holds, in the order given."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(conditions.items()):
        out = F.when(holds, name).otherwise(out)
    return out
