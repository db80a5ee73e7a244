"""Queries of selections, summaries of sessions and pose algebra, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import display, geometry, lens
from ..operators import changelog, cloud, imu, joins, quality, selection, survey, timeops, trajectory, vectors
from ..operators.ordered import numbered, shared_folder
from ..sources import blobs
from .tables import DAY, EVENTS, POINTS, events, points, q, quantised, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
W = float(30 * DAY)


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _q(df, *columns, scale: float = 1e6):
    return df.withColumns({c: quantised(c, scale) for c in columns})


def _case(column, **names):
    out = F.lit(names.pop("otherwise"))
    for value, name in names.items():
        out = F.when(column == value, name).otherwise(out)
    return out


# --- selections ------------------------------------------------------------------

_TRACKED = "CASE kind WHEN 'view' THEN 'limited' ELSE 'normal' END"


def _tracked(spark, sf):
    return events(spark, sf).withColumn("tracking", _case(F.col("kind"), view="limited", otherwise="normal"))


@query(f"WITH {EVENTS} SELECT event_id, user_id FROM ev WHERE {_TRACKED} = 'normal'")
def tracking_normal(spark, sf):
    return selection.tracking_normal(_tracked(spark, sf)).select("event_id", "user_id")


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, min_by(t, event_id) + CASE WHEN user_id % 5 > 0 THEN user_id % 3 * {DAY} END AS since FROM ev GROUP BY user_id)
    SELECT event_id, user_id FROM ev JOIN s USING (user_id) WHERE since IS NULL OR t >= since""")
def after_settled(spark, sf):
    ev = events(spark, sf)
    settled = ev.groupBy("user_id").agg(F.min_by("t", "event_id").alias("start")).withColumn("settled", F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 3 * DAY))
    return selection.after_settled(ev, settled, ["user_id"]).select("event_id", "user_id")


_SHOT = "CASE kind WHEN 'view' THEN 'landscape' WHEN 'click' THEN 'portrait' WHEN 'error' THEN 'landscape (upside down)' WHEN 'signup' THEN 'portrait (inverted)' ELSE 'landscape' END"


@query(f"""WITH {EVENTS}, c AS (SELECT user_id, {_SHOT} AS dominant, count(*) AS n, min(event_id) AS f FROM ev GROUP BY ALL),
    d AS (SELECT user_id, dominant, count(*) OVER (PARTITION BY user_id) > 1 AS mixed FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1)
    SELECT event_id, dominant = 'landscape (upside down)' AS rotate, mixed FROM ev JOIN d USING (user_id) WHERE dominant NOT LIKE 'portrait%'""")
def by_orientation(spark, sf):
    ev = events(spark, sf)
    shot = _case(F.col("kind"), view="landscape", click="portrait", error="landscape (upside down)", signup="portrait (inverted)", otherwise="landscape")
    top = quality.dominant(ev.withColumn("dominant", shot), ["user_id"], bucket="dominant", order=["event_id"])
    return selection.by_orientation(ev, top, ["user_id"]).select("event_id", "rotate", "mixed")


@query(f"""WITH {EVENTS}, m AS (SELECT event_id, CASE WHEN k % 3 < 1 THEN 'nan'::DOUBLE ELSE cents / 1000.0::DOUBLE END AS z FROM ev)
    SELECT event_id, z > 0.1 AND z < 5.0 AND NOT isnan(z) AS valid, CASE WHEN isnan(z) THEN NULL ELSE {q('z')} END AS z FROM m""")
def depth_mask(spark, sf):
    z = selection.confident(F.col("cents") / 1000.0, F.col("k") % 3)
    rows = events(spark, sf).withColumn("z", z)
    return rows.select("event_id", selection.depth_valid(F.col("z")).alias("valid"), F.when(~F.isnan("z"), quantised("z")).alias("z"))


_KIND = "CASE kind WHEN 'view' THEN 'ar' WHEN 'click' THEN 'thermal' WHEN 'error' THEN 'app' ELSE kind END || CASE WHEN k % 4 = 0 THEN '.started' ELSE '.other' END"


@query(f"WITH {EVENTS}, n AS (SELECT event_id, {_KIND} AS kind FROM ev) SELECT event_id, kind FROM n WHERE string_split(kind, '.')[1] IN ('thermal', 'ar', 'app') AND kind <> 'ar.started'")
def notable_events(spark, sf):
    name = F.concat(F.coalesce(_case(F.col("kind"), view="ar", click="thermal", error="app", otherwise=None), "kind"), F.when(F.col("k") % 4 == 0, ".started").otherwise(".other"))
    return selection.notable(events(spark, sf).select("event_id", name.alias("kind")))


@query(f"WITH {EVENTS}, n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM ev) SELECT event_id, user_id FROM n WHERE i % 3 = 0 AND i < 30")
def strided_rows(spark, sf):
    return selection.strided(events(spark, sf), ["user_id"], ["t", "event_id"], stride=3, limit=10, width=W).select("event_id", "user_id")


@query(f"WITH {EVENTS} SELECT event_id, user_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5('0:' || event_id), event_id) <= 20")
def capped_rows(spark, sf):
    return selection.capped(events(spark, sf), ["user_id"], ["event_id"], most=20).select("event_id", "user_id")


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, cents / 1000.0::DOUBLE AS m, k / 10.0::DOUBLE AS p, k % 10 / 10.0::DOUBLE AS c FROM ev),
    s AS (SELECT user_id, sum(p * m) AS pm, sum(p * p) AS pp, count(*) AS n FROM g WHERE m > 0.05 AND c > 0.5 AND p > 0.05 GROUP BY user_id)
    SELECT user_id, coalesce(n, 0) AS pixels, {q('CASE WHEN n > 25 THEN pm / greatest(pp, 1e-9) ELSE 1.0 END')} AS scale FROM (SELECT DISTINCT user_id FROM ev) LEFT JOIN s USING (user_id)""")
def lidar_scale(spark, sf):
    rows = events(spark, sf).select("user_id", (F.col("cents") / 1000.0).alias("measured"), (F.col("k") / 10.0).alias("predicted"), (F.col("k") % 10 / 10.0).alias("confidence"))
    return _q(selection.lidar_scale(rows, ["user_id"], least=25, otherwise=1.0), "scale")


@query(f"WITH {POINTS}, {EVENTS} SELECT label AS session, vec_id AS t, 'planes' AS log FROM pt UNION ALL SELECT user_id, event_id, 'events' FROM ev")
def merged_log(spark, sf):
    planes = points(spark, sf).select(F.col("label").cast("bigint").alias("session"), F.col("vec_id").alias("t"), F.lit("planes").alias("log"))
    return selection.merged_log([planes, events(spark, sf).select(F.col("user_id").alias("session"), F.col("event_id").alias("t"), F.lit("events").alias("log"))], ["session"])


# --- summaries of sessions ---------------------------------------------------------


@query(f"""WITH {POINTS}, f AS (SELECT label, avg(y) AS f FROM pt WHERE vec_id % 3 = 0 AND label % 4 > 0 GROUP BY label), p AS (SELECT label, avg(ry) + 1.2 AS m FROM pt GROUP BY label)
    SELECT label, {q('m - f')} AS height, {q('m - f - 1.15')} AS off, abs(m - f - 1.15) < 0.15 AS on_target FROM p LEFT JOIN f USING (label)""")
def camera_height(spark, sf):
    p = points(spark, sf)
    planes = p.select("label", F.col("y").alias("ty"), F.when((F.col("vec_id") % 3 == 0) & (F.col("label") % 4 > 0), "floor").otherwise("wall").alias("classification"))
    return _q(survey.camera_height(p.select("label", (F.col("ry") + 1.2).alias("ty")), planes, ["label"]), "height", "off")


@query(f"SELECT p_partkey, {q('2 * degrees(atan(1920 / (2 * p_retailprice))) - 96.3')} AS d_hfov, {q('2 * degrees(atan(1440 / (2 * p_retailprice))) - 64.6')} AS d_vfov FROM part")
def rig_delta(spark, sf):
    f = F.col("p_retailprice")
    fov = geometry.field_of_view(F.lit(1920.0), F.lit(1440.0), f, f)
    return table(spark, sf, "part").select("p_partkey", survey.rig_delta(fov["h"], fov["v"]).alias("d")).select("p_partkey", quantised("d.d_hfov").alias("d_hfov"), quantised("d.d_vfov").alias("d_vfov"))


@query(f"WITH {EVENTS} SELECT user_id, count(*) AS images, sum(cents)::BIGINT AS bytes FROM ev GROUP BY user_id")
def image_bytes(spark, sf):
    return survey.image_bytes(events(spark, sf), ["user_id"], "cents")


@query(f"WITH {EVENTS} SELECT user_id, kind AS classification, count(*) AS n FROM ev GROUP BY ALL")
def plane_classes(spark, sf):
    return survey.plane_classes(events(spark, sf).withColumnRenamed("kind", "classification"), ["user_id"])


@query(f"""WITH {EVENTS}, p AS (SELECT user_id, event_id, t / {DAY}.0::DOUBLE AS t, cents / 100.0::DOUBLE AS x, k / 10.0::DOUBLE AS y, {_TRACKED} = 'normal' AS ok FROM ev),
    w AS (SELECT user_id, sum(sqrt(pow(x - px, 2) + pow(y - py, 2))) AS travelled FROM (SELECT *, lag(x) OVER v AS px, lag(y) OVER v AS py FROM p WHERE ok WINDOW v AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id),
    d AS (SELECT user_id, event_id, t, CASE WHEN user_id % 4 > 0 AND k % 7 > 0 THEN k END AS hits, CASE WHEN user_id % 4 > 0 AND k % 7 > 0 THEN 100 END AS total, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY user_id) // 8) AS s FROM (SELECT ev.* EXCLUDE (t), t / {DAY}.0::DOUBLE AS t FROM ev) WHERE user_id % 6 > 0),
    b AS (SELECT user_id, sum(hits) / greatest(sum(total), 1) AS usable FROM (SELECT * FROM d WHERE i % s = 0 AND total IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i) <= 8) GROUP BY user_id),
    h AS (SELECT user_id, count(*) AS depth_frames, CASE WHEN max(t) > min(t) THEN 500 * (count(*) - 1) / (max(t) - min(t)) ELSE 0 END AS depth_hz FROM d GROUP BY user_id),
    a AS (SELECT user_id, (max_by(p.t, event_id) - min_by(p.t, event_id)) AS duration, count(*) FILTER (NOT ok) AS unconverged, count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'signup') AS breaks FROM p JOIN (SELECT event_id, kind FROM ev) USING (event_id) GROUP BY user_id),
    r AS (SELECT user_id, duration, unconverged, breaks, coalesce(travelled, 0) AS travelled, coalesce(depth_frames, 0) AS depth_frames, coalesce(depth_hz, 0) AS depth_hz, usable, CASE WHEN user_id % 3 = 0 THEN errors ELSE 0 END AS thermal, user_id % 2 = 0 AS complete, user_id % 5 > 0 AS agrees FROM a LEFT JOIN w USING (user_id) LEFT JOIN h USING (user_id) LEFT JOIN b USING (user_id))
    SELECT user_id, {q('duration', '1e3')} AS duration, unconverged, breaks, {q('travelled', '1e3')} AS travelled, depth_frames, {q('depth_hz', '1e3')} AS depth_hz, {q('usable')} AS usable, thermal, {q('CASE WHEN duration > 0 THEN travelled / duration ELSE 0 END', '1e3')} AS speed,
        CASE WHEN usable < 0.5 THEN 'too dark' WHEN depth_hz < 12 THEN 'depth too slow' WHEN travelled < 3 THEN 'barely moved' WHEN NOT complete AND NOT agrees THEN 'truncated' WHEN thermal > 0 THEN 'thermal pause' ELSE 'ok' END AS verdict FROM r""")
def survey_row(spark, sf):
    ev = events(spark, sf).withColumn("t", F.col("t") / float(DAY))
    poses = _tracked(spark, sf).select("user_id", (F.col("t") / float(DAY)).alias("t"), "tracking", F.col("event_id").alias("ordinal"), (F.col("cents") / 100.0).alias("tx"), (F.col("k") / 10.0).alias("ty"), F.lit(0.0).alias("tz"))
    seen = (F.col("user_id") % 4 > 0) & (F.col("k") % 7 > 0)
    # Times in 500ths of a day, so that rates lie around the thresholds.
    index = ev.where("user_id % 6 > 0").select("user_id", (F.col("t") / 500).alias("t"), F.col("event_id").alias("ordinal"), F.when(seen, F.col("k")).alias("hits"), F.when(seen, F.lit(100)).alias("total"))
    kind = F.when(F.col("kind") == "signup", "ar.interruptionEnded").when((F.col("kind") == "error") & (F.col("user_id") % 3 == 0), "thermal.serious").otherwise("app.note")
    said = ev.select("user_id").distinct().withColumns({"complete": F.col("user_id") % 2 == 0, "counts_agree": F.col("user_id") % 5 > 0, "settled": F.lit(0.0), "bytes": F.lit(1).cast("bigint")})
    out = survey.survey(poses, index, ev.select("user_id", kind.alias("kind")), said, ["user_id"], width=1e9)
    out = out.select("user_id", "duration", "unconverged", "breaks", "travelled", "depth_frames", "depth_hz", "usable", "thermal", "speed", "verdict")
    return _q(_q(out, "duration", "travelled", "depth_hz", "speed", scale=1e3), "usable")


@query(f"""WITH {POINTS}, e AS (SELECT label, vec_id / 10.0::DOUBLE AS t, x * (label + 1) * 2 AS roll, y / 4 AS z FROM pt),
    a AS (SELECT label, count(*) AS frames, stddev_pop(roll) AS r, abs(degrees(atan2(avg(sin(radians(roll))), avg(cos(radians(roll)))))) AS m, stddev_pop(z) AS v, max(t) - min(t) AS d FROM e GROUP BY label)
    SELECT label, frames, {q('r')} AS roll_std, {q('m')} AS mean_roll, {q('v')} AS vertical_std, {q('d')} AS duration, concat_ws(' ', CASE WHEN r > 4 THEN 'roll_std' END, CASE WHEN m > 4 THEN 'mean_roll' END, CASE WHEN v > 0.1 THEN 'vertical_std' END) AS flags FROM a""")
def episode_summary(spark, sf):
    rows = points(spark, sf).select("label", (F.col("vec_id") / 10.0).alias("t"), (F.col("x") * (F.col("label") + 1) * 2).alias("roll"), (F.col("y") / 4).alias("z"))
    return _q(survey.episode_summary(rows, ["label"]), "roll_std", "mean_roll", "vertical_std", "duration")


#: Rotations from quaternions x, y, z, w and positions tx, ty, tz of points.
_POSES = """ps AS (SELECT label, vec_id, x / l AS x, y / l AS y, z / l AS z, rx / l AS w, ry AS tx, rz AS ty, a AS tz FROM (SELECT *, sqrt(x * x + y * y + z * z + rx * rx) AS l FROM pt)),
    mx AS (SELECT label, vec_id, tx, ty, tz, 1 - 2 * (y * y + z * z) AS m0, 2 * (x * y - w * z) AS m1, 2 * (x * z + w * y) AS m2, 2 * (x * y + w * z) AS m3, 1 - 2 * (x * x + z * z) AS m4, 2 * (y * z - w * x) AS m5, 2 * (x * z - w * y) AS m6, 2 * (y * z + w * x) AS m7, 1 - 2 * (x * x + y * y) AS m8 FROM ps)"""


def _poses(spark, sf):
    return points(spark, sf).select("label", "vec_id", geometry.quaternion_to_matrix("x", "y", "z", "rx").alias("r"), F.col("ry").alias("tx"), F.col("rz").alias("ty"), F.col("a").alias("tz"))


@query(f"""WITH {POINTS}, {_POSES}, f AS (SELECT label, tx AS x0, ty AS y0, tz AS z0, -m2 / sqrt(m2 * m2 + m8 * m8) AS hx, -m8 / sqrt(m2 * m2 + m8 * m8) AS hz, vec_id AS t0 FROM mx QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)
    SELECT vec_id, vec_id - t0 AS ft, {q('hx * (tx - x0) + hz * (tz - z0)')} AS x, {q('hz * (tx - x0) - hx * (tz - z0)')} AS y, {q('ty - y0')} AS z, {q('degrees(atan2(-m3, m4))', '1e3')} AS roll FROM mx JOIN f USING (label)""")
def episode_poses(spark, sf):
    out = survey.episode_poses(_poses(spark, sf).withColumn("t", F.col("vec_id")), ["label"], ["vec_id"])
    return _q(_q(out, "x", "y", "z"), "roll", scale=1e3).select("vec_id", "ft", "x", "y", "z", "roll")


@query(f"""WITH {EVENTS}, a AS (SELECT user_id, count(*) FILTER (kind = 'view') AS flagged, count(*) FILTER (kind <> 'view') AS others, median(cents) FILTER (kind = 'view') AS f, median(cents) FILTER (kind <> 'view') AS o FROM ev GROUP BY user_id)
    SELECT user_id, flagged, others, {q('f')} AS cents_flagged, {q('o')} AS cents_others, {q('o - f')} AS cents_deficit FROM a WHERE flagged > 0 AND others > 0""")
def keyframe_medians(spark, sf):
    rows = events(spark, sf).withColumn("keyframe", F.col("kind") == "view")
    return _q(survey.split_medians(rows, ["user_id"], "keyframe", ["cents"]), "cents_flagged", "cents_others", "cents_deficit")


@query(f"WITH {EVENTS} SELECT kind, {q('avg(CASE WHEN k % 3 >= 1 THEN 1.0 ELSE 0.0 END)')} AS usable, count(*) AS seen FROM ev WHERE event_id % 16 = 0 GROUP BY kind")
def depth_usable(spark, sf):
    rows = events(spark, sf).select("kind", F.col("event_id").alias("place"), (F.col("k") % 3).alias("confidence"))
    return _q(survey.depth_usable(rows, ["kind"]), "usable")


_DT = "CASE WHEN k % 5 = 0 THEN 0 WHEN k % 5 < 4 THEN (cents - 5000) / 100000.0::DOUBLE END"


@query(f"""WITH {EVENTS}, r AS (SELECT user_id, {_TRACKED} AS tracking, {_DT} AS dt FROM ev)
    SELECT user_id, count(*) AS "rows", count(*) FILTER (tracking = 'normal') AS usable, count(*) FILTER (dt = 0) AS exact, count(*) FILTER (dt <> 0) AS nearest, count(*) FILTER (dt IS NULL) AS missing, {q('max(abs(dt) * 1000) FILTER (dt <> 0)')} AS worst_ms FROM r GROUP BY user_id""")
def pairing_report(spark, sf):
    dt = F.when(F.col("k") % 5 == 0, 0.0).when(F.col("k") % 5 < 4, (F.col("cents") - 5000) / 100000.0)
    return _q(survey.pairing(_tracked(spark, sf).withColumn("depth_dt", dt), ["user_id"]), "worst_ms")


@query(f"""WITH {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) // 2 AS h FROM ev)
    SELECT user_id, {q('cents / (cents + k + 10)')} AS low, {q('k / (cents + k + 10)')} AS medium, {q('10 / (cents + k + 10)')} AS high, cents / (cents + k + 10) > 0.8 AS warns FROM n WHERE i = h""")
def middle_confidence(spark, sf):
    index = events(spark, sf).select("user_id", "t", "event_id", F.col("cents").alias("low"), F.col("k").alias("medium"), F.lit(10).alias("high"))
    return _q(survey.middle_confidence(index, ["user_id"], ["t", "event_id"], width=W), "low", "medium", "high")


@query(f"WITH {EVENTS} SELECT user_id, max(k > 97) AS device FROM ev GROUP BY user_id")
def any_device(spark, sf):
    return survey.any_device(events(spark, sf).withColumn("cond", F.when(F.col("k") > 97, F.col("k"))), ["user_id"])


@query(f"""WITH {EVENTS}, a AS (SELECT user_id, (count(*) - 1) / ((max(t) - min(t)) / {DAY}.0::DOUBLE) AS a FROM ev GROUP BY user_id), b AS (SELECT user_id, (count(*) - 1) / nullif((max(t) - min(t)) / {DAY}.0::DOUBLE, 0) AS b FROM ev WHERE {_TRACKED} = 'normal' GROUP BY user_id)
    SELECT user_id, {q('a', '1e3')} AS arrived_hz, {q('coalesce(b, 0)', '1e3')} AS scored_hz, coalesce(b, 0) < 2 AS warns FROM a LEFT JOIN b USING (user_id)""")
def scored_rate(spark, sf):
    rows = _tracked(spark, sf).withColumn("t", F.col("t") / float(DAY))
    return _q(survey.rates(rows, selection.tracking_normal(rows), ["user_id"], least=2.0), "arrived_hz", "scored_hz", scale=1e3)


_STEP = ", ".join(f"a.m{i} * (b.tx - a.tx) + a.m{i + 3} * (b.ty - a.ty) + a.m{i + 6} * (b.tz - a.tz) AS d{i}" for i in range(3))


@query(f"""WITH {POINTS}, {_POSES}, e AS (SELECT label, vec_id // 20 AS w, min(vec_id) AS f, max(vec_id) AS l FROM pt GROUP BY ALL),
    s AS (SELECT e.label, w, {_STEP}, sqrt(pow(b.tx - a.tx, 2) + pow(b.ty - a.ty, 2) + pow(b.tz - a.tz, 2)) AS m FROM e JOIN mx a ON a.label = e.label AND a.vec_id = f JOIN mx b ON b.label = e.label AND b.vec_id = l)
    SELECT label, w, {q('m')} AS ref_m, {q('2 * m')} AS est_m, {q('m')} AS est_err_m, 0 AS est_rot_deg, CASE WHEN m > 1e-6 THEN 2000000 END AS est_scale, {q('abs(2 * 0.75 - 1) * m')} AS est_fixed_err_m FROM s""")
def window_endpoints(spark, sf):
    pose = lambda k: geometry.pose("r", F.col("tx") * k, F.col("ty") * k, F.col("tz") * k)
    rows = _poses(spark, sf).select("label", F.floor(F.col("vec_id") / 20).alias("w"), "vec_id", pose(1).alias("ref"), pose(2).alias("est"))
    scales = rows.select("label", "w").distinct().withColumn("scale", F.lit(0.75))
    out = survey.endpoint_errors(rows, ["label", "w"], ["vec_id"], others=["est"], scales=scales)
    return _q(_q(out, "ref_m", "est_m", "est_err_m", "est_scale", "est_fixed_err_m"), "est_rot_deg", scale=1e3)


@query(f"WITH {POINTS} SELECT label, {q('median(abs(x))')} AS ours, {q('median(abs(y))')} AS theirs, {q('median(z)')} AS scale, count(*) FILTER (abs(x) < abs(y)) AS wins, count(*) AS windows FROM pt GROUP BY label")
def window_scores(spark, sf):
    rows = points(spark, sf).select("label", F.abs("x").alias("x"), F.abs("y").alias("y"), "z")
    return _q(survey.window_scores(rows, ["label"], ours="x", theirs="y", scale="z"), "ours", "theirs", "scale")


@query("""WITH m AS (SELECT o_orderkey AS session, epoch(o_orderdate::TIMESTAMP) AS s, CASE WHEN o_orderkey % 4 > 0 THEN epoch(o_orderdate::TIMESTAMP) + o_custkey END AS e, o_custkey % 3 AS location, o_orderkey % 2 AS pose FROM orders),
    f AS (SELECT l_orderkey AS session, sum(floor(l_extendedprice))::BIGINT AS bytes, bool_or(l_linenumber = 3) AS complete FROM lineitem GROUP BY ALL)
    SELECT session::VARCHAR AS session, floor((e - s) + 0.5)::BIGINT AS duration, coalesce(bytes, 0)::BIGINT AS bytes, coalesce(complete, false) AS complete, session % 5 = 0 AS uploaded,
        CASE WHEN location = 0 AND pose = 0 THEN session::VARCHAR ELSE concat_ws(' · ', CASE WHEN location > 0 THEN 'gps ' || location END, CASE WHEN pose > 0 THEN 'pose ' || pose END) END AS summary FROM m LEFT JOIN f USING (session)""")
def session_list(spark, sf):
    orders = table(spark, sf, "orders").withColumn("session", F.col("o_orderkey").cast("string"))
    start = F.unix_date(F.col("o_orderdate").cast("date")) * 86400.0
    counts = F.create_map(F.lit("location"), (F.col("o_custkey") % 3).cast("bigint"), F.lit("pose"), (F.col("o_orderkey") % 2).cast("bigint"))
    said = orders.select("session", start.alias("startedAt"), F.when(F.col("o_orderkey") % 4 > 0, start + F.col("o_custkey")).alias("endedAt"), counts.alias("counts"))
    files = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("session"), F.floor("l_extendedprice").alias("size"), F.when(F.col("l_linenumber") == 3, ".complete").otherwise("pose.jsonl").alias("name"))
    out = survey.session_list(said, files, orders.where("o_orderkey % 5 = 0"))
    return selection.newest_first(out.withColumn("duration", quantised("duration", 1.0)))


@query("""WITH f AS (SELECT p_size AS device, CASE WHEN p_partkey % 3 = 0 THEN 4 * (p_partkey % 500 + 1) ELSE 16 * (p_partkey % 300 + 1) END AS width, CASE WHEN p_partkey % 3 = 0 THEN 3 * (p_partkey % 500 + 1) ELSE 9 * (p_partkey % 300 + 1) END AS height, 30 * (p_partkey % 2 + 1) AS fps FROM part),
    o AS (SELECT *, fps >= 60 AS ok, abs(width / height - 4.0 / 3.0) < 0.02 AS tall FROM f)
    SELECT device, width, height, fps FROM o QUALIFY row_number() OVER (PARTITION BY device ORDER BY ok DESC, tall DESC, width * height DESC, width, fps DESC) = 1""")
def video_format(spark, sf):
    k = F.col("p_partkey")
    third = k % 3 == 0
    rows = table(spark, sf, "part").select(F.col("p_size").alias("device"), F.when(third, 4 * (k % 500 + 1)).otherwise(16 * (k % 300 + 1)).alias("width"), F.when(third, 3 * (k % 500 + 1)).otherwise(9 * (k % 300 + 1)).alias("height"), (30 * (k % 2 + 1)).alias("fps"))
    return survey.video_format(rows, ["device"], video_fps=60.0)


# --- labels, joins and clouds --------------------------------------------------------


@query(f"""WITH {EVENTS} SELECT event_id, CASE WHEN cents >= 3600 THEN format('{{:d}}:{{:02d}}:{{:02d}}', (cents // 3600)::INT, (cents % 3600 // 60)::INT, (cents % 60)::INT) ELSE format('{{:d}}:{{:02d}}', (cents // 60)::INT, (cents % 60)::INT) END AS shown,
    CASE WHEN k > 50 THEN 'flat' WHEN k < 10 THEN 'dark' WHEN c >= 0.02 THEN 'strong' WHEN c >= 0.007 THEN 'ok' ELSE 'weak' END AS live FROM (SELECT *, k / 2000.0::DOUBLE AS c FROM ev)""")
def duration_labels(spark, sf):
    live = display.live_verdict(F.col("k") / 100.0, F.col("k") / 50.0, F.col("k") / 2000.0)
    return events(spark, sf).select("event_id", display.duration(F.col("cents")).alias("shown"), live.alias("live"))


@query(f"""WITH {POINTS}, v AS (SELECT label, floor(x / 2.0)::BIGINT AS kx, floor(y / 2.0)::BIGINT AS ky, floor(z / 2.0)::BIGINT AS kz, vec_id AS frame, x AS px FROM pt),
    o AS (SELECT *, row_number() OVER (PARTITION BY label, kx, ky, kz ORDER BY frame) AS i, count(*) OVER (PARTITION BY label, kx, ky, kz) AS n FROM v)
    SELECT label, kx, ky, kz, {q('sum(px * CASE WHEN n <= 4 THEN 1.0 / n WHEN i <= 4 THEN 0.25 * pow(0.8::DOUBLE, n - 4) ELSE 0.2 * pow(0.8::DOUBLE, n - i) END)')} AS px, {q('least(any_value(n), 4)')} AS w FROM o GROUP BY ALL""")
def voxel_capped_votes(spark, sf):
    """A low cap, so that voxels of many votes forget: the fold in closed form."""
    p = points(spark, sf).withColumn("frame", F.col("vec_id"))
    return _q(cloud.voxel_fuse(p, ["label"], frame="frame", size=2.0, max_weight=4).select("label", "kx", "ky", "kz", "px", "w"), "px", "w")


@query(f"""WITH {POINTS}, v AS (SELECT label, floor(x / 0.5)::BIGINT AS kx, floor(y / 0.5)::BIGINT AS ky, floor(z / 0.5)::BIGINT AS kz, avg(x) AS px, avg(y) AS py, avg(z) AS pz FROM pt GROUP BY ALL)
    SELECT label, kx, ky, kz, {q('px')} AS px FROM v WHERE pow(px - label / 10.0::DOUBLE, 2) + pow(py, 2) + pow(pz, 2) < 1.0""")
def voxel_trim(spark, sf):
    p = points(spark, sf)
    fused = cloud.voxel_fuse(p.withColumn("frame", F.lit(1)), ["label"], frame="frame", size=0.5)
    centres = p.select("label").distinct().withColumns({"cx": F.col("label") / 10.0, "cy": F.lit(0.0), "cz": F.lit(0.0)})
    return _q(cloud.trim(fused, centres, ["label"], radius=1.0).select("label", "kx", "ky", "kz", "px"), "px")


@query(f"""WITH {EVENTS}, i AS (SELECT event_id, user_id, t // {DAY} * {DAY} AS a, t // {DAY} * {DAY} + {DAY} AS b FROM ev), s AS (SELECT user_id, t, CASE WHEN k % 4 > 0 THEN cents END AS c FROM ev)
    SELECT event_id, i.user_id, {q('avg(c)')} AS mean, count(c) AS mean_n FROM i LEFT JOIN s ON s.user_id = i.user_id AND s.t BETWEEN a AND b GROUP BY ALL""")
def interval_repeats(spark, sf):
    """Intervals that repeat (all of a day's events ask for their day) and samples that are null."""
    ev = events(spark, sf)
    day = F.floor(F.col("t") / DAY) * DAY
    ivs = ev.select("event_id", "user_id", day.alias("a"), (day + DAY).alias("b"))
    samples = ev.select("user_id", "t", F.when(F.col("k") % 4 > 0, F.col("cents")).alias("c"))
    out = timeops.interval_average(ivs, samples, ["user_id"], start="a", end="b", value="c", name="mean", width=float(DAY))
    return _q(out.select("event_id", "user_id", "mean", "mean_n"), "mean")


@query(f"""WITH {POINTS}, p AS (SELECT vec_id, label, x, y, z + 3 AS z, round_even(x * 4 / (z + 3) + 8, 0)::INT AS u, round_even(y * 4 / (z + 3) + 8, 0)::INT AS v FROM pt WHERE z + 3 > 0.1),
    o AS (SELECT label, vec_id % 16 AS u, vec_id // 16 % 16 AS v, rx AS qx, ry AS qy, rz + 3 AS qz FROM pt WHERE vec_id % 5 > 0),
    j AS (SELECT p.label, vec_id, p.u, p.v, qx, sqrt(pow(x - qx, 2) + pow(y - qy, 2) + pow(z - qz, 2)) AS d FROM p JOIN o ON o.label = p.label AND o.u = p.u AND o.v = p.v WHERE p.u BETWEEN 0 AND 15 AND p.v BETWEEN 0 AND 15)
    SELECT label, vec_id, u, v, {q('qx')} AS qx, {q('d')} AS dist FROM j WHERE d < 4 AND label IN (SELECT label FROM j WHERE d < 4 GROUP BY label HAVING count(*) >= 3)""")
def projective_match(spark, sf):
    p = points(spark, sf)
    target = p.select("label", (F.col("vec_id") % 16).cast("int").alias("u"), (F.floor(F.col("vec_id") / 16) % 16).cast("int").alias("v"), F.col("rx").alias("x"), F.col("ry").alias("y"), (F.col("rz") + 3).alias("z"), (F.col("vec_id") % 5 > 0).alias("ok"))
    out = joins.projective(p.select("label", "vec_id", "x", "y", (F.col("z") + 3).alias("z")), target, ["label"], fx=4.0, fy=4.0, cx=8.0, cy=8.0, width=16, height=16, max_dist=4.0, least=3)
    return _q(out.select("label", "vec_id", "u", "v", "qx", "dist"), "qx", "dist")


@query(f"WITH {POINTS} SELECT vec_id, {q('x * 640.0 / 1920')} AS fx, {q('y * 480.0 / 1440')} AS fy, {q('z * 640.0 / 1920')} AS cx, {q('rx * 480.0 / 1440')} AS cy FROM pt")
def scaled_intrinsics(spark, sf):
    k = geometry.scaled_intrinsics("x", "y", "z", "rx", F.lit(1920.0), F.lit(1440.0), F.lit(640.0), F.lit(480.0))
    return _q(points(spark, sf).select("vec_id", k.alias("k")).select("vec_id", "k.*"), "fx", "fy", "cx", "cy")


@query(f"""WITH {POINTS}, g AS (SELECT vec_id, x / sqrt(x * x + y * y + z * z) AS gx, y / sqrt(x * x + y * y + z * z) AS gy, z / sqrt(x * x + y * y + z * z) AS gz FROM pt)
    SELECT vec_id, {q('gx')} AS x, {q('-gy')} AS y, {q('-gz')} AS z FROM g""")
def depth_gravity(spark, sf):
    return _q(points(spark, sf).select("vec_id", geometry.depth_gravity("x", "y", "z").alias("g")).select("vec_id", "g.*"), "x", "y", "z")


@query(f"""WITH {POINTS}, i AS (SELECT vec_id, (label * 2 + 0.5 - 10) / 8.0::DOUBLE * 5 AS px, (vec_id % 20 + 0.5 - 10) / 8.0::DOUBLE * 5 AS py FROM pt), r AS (SELECT *, sqrt(px * px + py * py) AS r FROM i),
    m AS (SELECT *, 1 + CASE WHEN least(r / 10.0, 1) * 2 < 1 THEN least(r / 10.0, 1) * 2 * 0.05 ELSE 0.05 + (least(r / 10.0, 1) * 2 - 1) * 0.1 END AS m FROM r)
    SELECT vec_id, {q('9 + px * m')} AS x, {q('11 + py * m')} AS y, {q('r')} AS r FROM m""")
def lens_map(spark, sf):
    lut = F.array(*[F.lit(v) for v in (0.0, 0.05, 0.15)])
    at = lens.source_pixel(F.col("label") * 2, F.col("vec_id") % 20, out_f=F.lit(8.0), out_cx=F.lit(10.0), out_cy=F.lit(10.0), f=F.lit(5.0), cx=F.lit(9.0), cy=F.lit(11.0), table=lut, r_max=F.lit(10.0))
    return _q(points(spark, sf).select("vec_id", at.alias("p")).select("vec_id", "p.*"), "x", "y", "r")


@query(f"""WITH {POINTS}, {_POSES}, p AS (SELECT n.label, n.vec_id, {", ".join(f"n.m{i} AS n{i}, b.m{i} AS b{i}" for i in range(9))}, n.tx AS nx, n.ty AS ny, n.tz AS nz, b.tx AS bx, b.ty AS by_, b.tz AS bz FROM mx n JOIN mx b ON b.label = n.label AND b.vec_id = (SELECT max(c.vec_id) FROM mx c WHERE c.label = n.label AND c.vec_id < n.vec_id)),
    s AS (SELECT vec_id, {", ".join(f"n{i} * (bx - nx) + n{i + 3} * (by_ - ny) + n{i + 6} * (bz - nz) AS s{i}" for i in range(3))}, {" + ".join(f"n{i} * b{i}" for i in range(9))} AS tr FROM p)
    SELECT vec_id, {q('sqrt(s0 * s0 + s1 * s1 + s2 * s2)', '1e3')} AS step_error, {q('degrees(acos(greatest(-1, least(1, (tr - 1) / 2))))', '1e2')} AS turn_error FROM s""")
def step_errors(spark, sf):
    """Errors of a trajectory against one that stands still."""
    still = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    rows = _poses(spark, sf).select("label", "vec_id", geometry.pose("r", "tx", "ty", "tz").alias("est"), still.alias("ref"))
    out = trajectory.relative_errors(rows, ["label"], ["vec_id"], width=1e5)
    return _q(_q(out.select("vec_id", "step_error", "turn_error"), "step_error", scale=1e3), "turn_error", scale=1e2)


# --- crops, lenses, edges, recordings ------------------------------------------------


@query("""WITH a AS (SELECT p_partkey, p_retailprice::DOUBLE AS f, 1920.0::DOUBLE AS w, 1440.0::DOUBLE AS h FROM part),
    c AS (SELECT *, round_even(2 * f * tan(radians(75.0::DOUBLE) / 2), 0) AS cw FROM a), d AS (SELECT *, round_even(cw * 1.25::DOUBLE * 480 / 848, 0) AS ch FROM c),
    e AS (SELECT *, cw > w OR ch > h AS clamped, least(w / cw, h / ch) AS s FROM d), g AS (SELECT p_partkey, w, h, clamped, CASE WHEN clamped THEN floor(cw * s) ELSE cw END AS cw, CASE WHEN clamped THEN floor(ch * s) ELSE ch END AS ch FROM e)
    SELECT p_partkey, floor((w - cw) / 2)::INT AS "left", floor((h - ch) / 2)::INT AS top, cw::INT AS w, ch::INT AS h, clamped, 1920 AS crop_w, round_even(1920 / (848.0::DOUBLE / 480), 0)::INT AS crop_h, 1440 AS whole_h FROM g""")
def export_crop(spark, sf):
    f = F.col("p_retailprice")
    size = (F.lit(1920), F.lit(1440), 848, 480)
    fov = geometry.export_crop("crop", *size, fx=f, fy=f * 1.25, hfov=75.0)
    fit, whole = geometry.export_crop("crop", *size), geometry.export_crop("whole", *size)
    return table(spark, sf, "part").select("p_partkey", fov.alias("c"), fit.alias("f"), whole.alias("x")).select("p_partkey", "c.*", F.col("f.w").alias("crop_w"), F.col("f.h").alias("crop_h"), F.col("x.h").alias("whole_h"))


def _magnified(r: str) -> str:
    return f"(1 + CASE WHEN least(({r}) / 10.0, 1) * 2 < 1 THEN least(({r}) / 10.0, 1) * 2 * 0.05 ELSE 0.05 + (least(({r}) / 10.0, 1) * 2 - 1) * 0.1 END)"


@query(f"""WITH {POINTS}, a AS (SELECT label, x, y, {_magnified('sqrt(x * x + y * y)')} AS m FROM pt), b AS (SELECT *, {_magnified('sqrt(x * x + y * y) * m')} AS n FROM a)
    SELECT label, {q('max(sqrt(x * x + y * y) * abs(m - 1))')} AS displacement, {q('max(sqrt(x * x + y * y) * abs(m * n - 1))')} AS round_trip FROM b GROUP BY label""")
def lens_correction(spark, sf):
    lut = F.array(*[F.lit(v) for v in (0.0, 0.05, 0.15)])
    out = lens.correction(points(spark, sf), ["label"], cx=F.lit(0.0), cy=F.lit(0.0), inverse=lut, forward=lut, r_max=F.lit(10.0))
    return _q(out, "displacement", "round_trip")


@query(f"""WITH {POINTS} SELECT vec_id, CASE WHEN abs(f - 1.0) < 0.06 THEN 'square pixels' WHEN abs(f - 4.0::DOUBLE / 3) < 0.10 THEN 'squeezed from 4:3' ELSE 'no common resize' END AS verdict, least(abs(x), abs(y)) / greatest(abs(z), 1e-9) < 2 AS weak FROM (SELECT *, 1 + abs(x) / 5 AS f FROM pt)""")
def focal_verdict(spark, sf):
    return points(spark, sf).select("vec_id", lens.aspect_verdict(1 + F.abs("x") / 5, F.lit(1.0)).alias("verdict"), lens.weakly_constrained(F.abs("z"), F.abs("x"), F.abs("y")).alias("weak"))


@query(f"""WITH {POINTS}, c AS (SELECT label AS image, vec_id % 3 AS chain, vec_id * 0.5::DOUBLE + x * 0.1 AS x, vec_id * 0.2::DOUBLE * (1 + vec_id % 3) + y AS y FROM pt),
    a AS (SELECT image, chain, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM c GROUP BY ALL HAVING count(*) >= 10),
    g AS (SELECT *, 0.5 * atan2(2 * c, a - b) AS g FROM a WHERE sqrt((a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c)) >= 4 * sqrt(greatest((a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c), 0))),
    r AS (SELECT c.image, c.chain, (x - mx) * cos(g) + (y - my) * sin(g) AS u, (y - my) * cos(g) - (x - mx) * sin(g) AS v FROM c JOIN g ON c.image = g.image AND c.chain = g.chain),
    m AS (SELECT image, chain, bin, avg(v) AS m FROM (SELECT *, least(7, floor((u - min(u) OVER w) / (max(u) OVER w + 1e-9 - min(u) OVER w) * 8)) AS bin FROM r WINDOW w AS (PARTITION BY image, chain)) GROUP BY ALL),
    b AS (SELECT image, chain, sqrt(avg(m * m)) AS bow FROM m GROUP BY ALL HAVING count(*) >= 4)
    SELECT image, count(*) AS chains, {q('median(bow)')} AS median, {q('quantile_cont(bow, 0.9)')} AS p90 FROM b GROUP BY image""")
def edge_straightness(spark, sf):
    k = F.col("vec_id")
    rows = points(spark, sf).select(F.col("label").alias("image"), (k % 3).alias("chain"), (k * 0.5 + F.col("x") * 0.1).alias("x"), (k * 0.2 * (1 + k % 3) + F.col("y")).alias("y"))
    return _q(quality.straightness(rows, ["image"], least=10, bins=8), "median", "p90")


@query(f"""WITH {EVENTS}, r AS (SELECT user_id, event_id, t / 1e6::DOUBLE AS e, cents FROM ev), s AS (SELECT user_id, min(e) AS e0 FROM r WHERE cents < 200 GROUP BY user_id)
    SELECT event_id, coalesce(e = e0, false) AS stop, NOT coalesce(e = e0, false) AND floor(e)::BIGINT % 60 = 0 AS heartbeat FROM r LEFT JOIN s USING (user_id) WHERE e0 IS NULL OR e <= e0""")
def recording_ticks(spark, sf):
    rows = events(spark, sf).select("user_id", "event_id", (F.col("t") / 1e6).alias("elapsed"), F.col("cents").alias("free"))
    return changelog.ticks(rows, ["user_id"], least=200).select("event_id", "stop", "heartbeat")


@query("""WITH s AS (SELECT l_orderkey AS session, count(*) AS "rows" FROM lineitem GROUP BY ALL), e AS (SELECT o_orderkey AS session, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 7 END AS expected FROM orders)
    SELECT session, "rows", expected, CASE WHEN expected IS NULL THEN 'unknown' WHEN "rows" >= expected THEN 'complete' ELSE 'INCOMPLETE' END AS verdict FROM s LEFT JOIN e USING (session)""")
def idle_verdicts(spark, sf):
    closed = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("session")).agg(F.count("*").alias("rows"))
    said = table(spark, sf, "orders").select(F.col("o_orderkey").alias("session"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey") % 7).alias("expected"))
    return changelog.idle_verdict(closed, said, ["session"])


@query(f"""WITH {EVENTS} SELECT event_id, CASE WHEN k < 5 THEN '-' ELSE format('{{:.1f}} km/h', (k - 5) * 3.6::DOUBLE) END AS speed,
    CASE kind WHEN 'view' THEN 'application/json' WHEN 'click' THEN 'image/jpeg' WHEN 'error' THEN 'text/plain' ELSE 'application/octet-stream' END AS type, CASE WHEN k < 10 THEN 30.0 ELSE k END::BIGINT AS hz, (k * 1000 + cents * (100 + 50) + 8 * 125)::BIGINT AS rate FROM ev""")
def display_formats(spark, sf):
    k, cents = F.col("k"), F.col("cents")
    path = F.concat(F.lit("a/b."), _case(F.col("kind"), view="json", click="JPG", error="txt", otherwise="bin"))
    rate = display.storage_rate(k, F.lit(1000), cents, F.lit(100), F.lit(50), F.lit(8), F.lit(100), F.lit(1600))
    return events(spark, sf).select("event_id", display.speed_kph((k - 5).cast("double")).alias("speed"), display.content_type(path).alias("type"), display.migrated_depth_hz(k.cast("double")).cast("bigint").alias("hz"), rate.cast("bigint").alias("rate"))


# --- poses and motion ----------------------------------------------------------------


def _mul(a: str, b: str) -> str:
    """Product of two 4 x 4 matrices (lists by rows)."""
    return f"list_transform(range(16), lambda e: {' + '.join(f'{a}[e // 4 * 4 + {k + 1}] * {b}[e % 4 + {4 * k + 1}]' for k in range(4))})"


def _inv(a: str) -> str:
    rows = [[f"{a}[{i + 1}]", f"{a}[{i + 5}]", f"{a}[{i + 9}]"] for i in range(3)]
    return "[" + ", ".join(x for r in rows for x in (*r, f"-({r[0]} * {a}[4] + {r[1]} * {a}[8] + {r[2]} * {a}[12])")) + ", 0, 0, 0, 1]"


def _pose(i: int) -> str:
    """The pose whose quaternion begins at ``embedding[i]``, from a list e of its seven numbers."""
    turn = ["1 - 2 * (y * y + z * z)", "2 * (x * y - w * z)", "2 * (x * z + w * y)", "2 * (x * y + w * z)", "1 - 2 * (x * x + z * z)", "2 * (y * z - w * x)", "2 * (x * z - w * y)", "2 * (y * z + w * x)", "1 - 2 * (x * x + y * y)"]
    cells = ", ".join([*turn[:3], "p0", *turn[3:6], "p1", *turn[6:], "p2"])
    return f"""SELECT label, vec_id, [{cells}, 0, 0, 0, 1] AS m FROM (SELECT label, vec_id, x / l AS x, y / l AS y, z / l AS z, w / l AS w, p0, p1, p2 FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS l FROM (
        SELECT label, vec_id, {", ".join(f"embedding[{i + k}]::DOUBLE AS {n}" for k, n in enumerate(("x", "y", "z", "w", "p0", "p1", "p2")))} FROM embeddings)))"""


_PART = ", ".join(f"{'c' if i == j else '0'} + u{min(i, j)} * u{max(i, j)} * (1 - c)" + ("" if i == j else f" {'-' if (j - i) % 3 == 1 else '+'} s * u{3 - i - j}") if j < 3 else f"alpha * off[{4 * i + 4}]" for i in range(3) for j in range(4))


@query(f"""WITH own AS ({_pose(1)}), goal AS ({_pose(9)}),
    k AS (SELECT own.label, own.vec_id, own.m, max(CASE WHEN own.vec_id % 7 = 0 THEN own.vec_id END) OVER (PARTITION BY own.label ORDER BY own.vec_id) AS lo,
        min(CASE WHEN own.vec_id % 7 = 0 THEN own.vec_id END) OVER (PARTITION BY own.label ORDER BY own.vec_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM own),
    j AS (SELECT k.*, {_mul('ga.m', 'ia.i')} AS base, gb.m AS gb, ob.m AS ob FROM k JOIN goal ga ON ga.vec_id = coalesce(lo, hi) JOIN (SELECT vec_id, {_inv('m')} AS i FROM own) ia ON ia.vec_id = coalesce(lo, hi) JOIN goal gb ON gb.vec_id = coalesce(hi, lo) JOIN own ob ON ob.vec_id = coalesce(hi, lo)),
    e AS (SELECT *, {_mul('base', 'm')} AS predicted, {_mul('base', 'ob')} AS reached FROM j),
    o AS (SELECT *, {_mul('gb', 'ri')} AS off, (vec_id - lo)::DOUBLE / (hi - lo) AS alpha FROM (SELECT *, {_inv('reached')} AS ri FROM e) WHERE lo < hi),
    v AS (SELECT *, off[10] - off[7] AS v0, off[3] - off[9] AS v1, off[5] - off[2] AS v2, off[1] + off[6] + off[11] - 1 AS d FROM o),
    u AS (SELECT *, v0 / n AS u0, v1 / n AS u1, v2 / n AS u2, cos(alpha * atan2(n, d)) AS c, sin(alpha * atan2(n, d)) AS s FROM (SELECT *, sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS n FROM v)),
    f AS (SELECT label, vec_id, {_mul('part', 'predicted')} AS f, 'between' AS p FROM (SELECT *, [{_PART}, 0, 0, 0, 1] AS part FROM u)
        UNION ALL SELECT label, vec_id, CASE WHEN lo = hi THEN gb ELSE predicted END, CASE WHEN lo = hi THEN 'anchor' ELSE 'outside' END FROM e WHERE lo IS NULL OR hi IS NULL OR lo = hi)
    SELECT label, vec_id, p AS "position", {q('f[4]', '1e3')} AS x, {q('f[8]', '1e3')} AS y, {q('f[12]', '1e3')} AS z, {q('f[1]', '1e3')} AS r00, {q('f[6]', '1e3')} AS r11, {q('f[11]', '1e3')} AS r22 FROM f""")
def pose_fusion(spark, sf):
    e = F.col("embedding")
    pose = lambda i: geometry.pose(geometry.quaternion_to_matrix(*[e[i + k].cast("double") for k in range(4)]), *[e[i + 4 + k].cast("double") for k in range(3)])
    rows = table(spark, sf, "embeddings").select("label", "vec_id", F.col("vec_id").cast("double").alias("t"), pose(0).alias("pose"), pose(8).alias("goal"))
    anchors = rows.where("vec_id % 7 = 0").select("label", "vec_id", F.col("goal").alias("pose"))
    out = trajectory.fused_poses(rows, anchors, ["label"], frame="vec_id", width=1e5).where("fused is not null")
    f = F.col("fused")
    return _q(out.select("label", "vec_id", "position", f[3].alias("x"), f[7].alias("y"), f[11].alias("z"), f[0].alias("r00"), f[5].alias("r11"), f[10].alias("r22")), "x", "y", "z", "r00", "r11", "r22", scale=1e3)


def _end(name: str) -> str:
    """The pose nearest in time to each step's end ``name``, the later of two as near, within 6."""
    return f"{name} AS (SELECT s.label, s.vec_id, o.m FROM steps s JOIN own o USING (label) WHERE abs(o.vec_id - s.{name}) <= 6 QUALIFY row_number() OVER (PARTITION BY s.label, s.vec_id ORDER BY abs(o.vec_id - s.{name}), o.vec_id DESC) = 1)"


#: Depth axes from device axes: x is -y, y is -x, z is -z.
_DEVICE = "[0, -1, 0, 0, -1, 0, 0, 0, 0, 0, -1, 0, 0, 0, 0, 1]"


@query(f"""WITH {POINTS}, own AS ({_pose(1)}), steps AS (SELECT label, vec_id, vec_id + 0.5::DOUBLE AS t0, vec_id + 9.0::DOUBLE AS t1 FROM pt WHERE vec_id % 3 = 0), {_end('t0')}, {_end('t1')},
    turn AS (SELECT label, vec_id, {_mul('dr', _DEVICE)} AS r FROM (SELECT label, vec_id, {_mul(_DEVICE, 'rel')} AS dr FROM (SELECT label, vec_id, {_mul('i', 'm1')} AS rel FROM (SELECT t0.label, t0.vec_id, {_inv('t0.m')} AS i, t1.m AS m1 FROM t0 JOIN t1 USING (label, vec_id))))),
    mean AS (SELECT s.label, s.vec_id, avg(p.rx) AS ax, avg(p.ry) AS ay, avg(p.rz) AS az FROM steps s JOIN pt p ON p.label = s.label AND p.vec_id BETWEEN s.t0 AND s.t1 GROUP BY ALL)
    SELECT s.label, s.vec_id, {q('r[1]', '1e3')} AS r00, {q('r[2]', '1e3')} AS r01, {q('r[7]', '1e3')} AS r12, {q('r[11]', '1e3')} AS r22, CASE WHEN r IS NOT NULL THEN {q('-ay * 9.80665::DOUBLE', '1e3')} END AS ax, CASE WHEN r IS NOT NULL THEN {q('-ax * 9.80665::DOUBLE', '1e3')} END AS ay,
        CASE WHEN r IS NOT NULL THEN {q('-az * 9.80665::DOUBLE', '1e3')} END AS az FROM steps s LEFT JOIN turn USING (label, vec_id) LEFT JOIN mean USING (label, vec_id)""")
def imu_motion(spark, sf):
    e = F.col("embedding")
    names = (*imu.QUATERNION, "p0", *imu.ACCELERATION)
    samples = table(spark, sf, "embeddings").select("label", F.col("vec_id").cast("double").alias("t"), *[e[i].cast("double").alias(n) for n, i in zip(names, (0, 1, 2, 3, 4, 3, 4, 5), strict=True)])
    steps = table(spark, sf, "embeddings").where("vec_id % 3 = 0").select("label", "vec_id", (F.col("vec_id") + 0.5).alias("t0"), (F.col("vec_id") + 9.0).alias("t1"))
    out = imu.relative_motion(steps, samples, ["label"], tolerance=6.0, width=1e5)
    r, a = F.col("rotation"), F.col("acceleration")
    return _q(out.select("label", "vec_id", r[0].alias("r00"), r[1].alias("r01"), r[5].alias("r12"), r[8].alias("r22"), a[0].alias("ax"), a[1].alias("ay"), a[2].alias("az")), "r00", "r01", "r12", "r22", "ax", "ay", "az", scale=1e3)


@query(f"""WITH {POINTS}, a AS (SELECT label, vec_id, x AS ox, y AS oy, z AS oz, x + 0.25 * (rx - x) AS fx, y + 0.25 * (ry - y) AS fy, z + 0.25 * (rz - z) AS fz, rx, ry, rz, CASE WHEN vec_id % 5 = 0 THEN 'anchor' WHEN vec_id % 5 < 4 THEN 'between' ELSE 'outside' END AS p FROM pt),
    c AS (SELECT label, unnest(CASE p WHEN 'anchor' THEN ['anchor'] WHEN 'between' THEN ['between', 'non-anchor'] ELSE ['non-anchor'] END) AS class, * EXCLUDE (label, p) FROM a)
    SELECT label, class, count(*) AS frames FROM c GROUP BY ALL""")
def fusion_classes(spark, sf):
    p = points(spark, sf)
    moved = {f"f{a}": F.col(a) + 0.25 * (F.col(f"r{a}") - F.col(a)) for a in "xyz"}
    kind = F.when(F.col("vec_id") % 5 == 0, "anchor").when(F.col("vec_id") % 5 < 4, "between").otherwise("outside")
    out = trajectory.fusion_scores(p.withColumns(moved | {"position": kind}), ["label"], fused_axes=("fx", "fy", "fz"), other_axes=("x", "y", "z"), reference=("rx", "ry", "rz"))
    return out.select("label", "class", "frames")


@query("""WITH p AS (SELECT label, vec_id, unnest(range(12)) AS p FROM embeddings)
    SELECT 's' || label AS session_id, vec_id AS frame, sum((vec_id * 7 + p * 3) % 512)::BIGINT AS quarters, max((vec_id * 7 + p * 3) % 512)::BIGINT AS most, sum((vec_id + p) % 3)::BIGINT AS confidence, count(*) AS pixels FROM p GROUP BY ALL""")
def packed_rasters(spark, sf):
    """Rasters made from a table, packed into blobs, and read from them by byte range."""
    rows = table(spark, sf, "embeddings").select(F.concat(F.lit("s"), F.col("label")).alias("session_id"), F.col("vec_id").cast("bigint").alias("ordinal"))
    pixels = F.sequence(F.lit(0), F.lit(11))
    line = F.to_json(F.struct(F.col("ordinal").cast("double").alias("t"), F.col("ordinal").alias("frame"), F.lit(4).alias("width"), F.lit(3).alias("height")))
    rows = rows.select("*", line.alias("line"), F.transform(pixels, lambda p: ((F.col("ordinal") * 7 + p * 3) % 512 / 4.0).cast("float")).alias("values"), F.transform(pixels, lambda p: (F.col("ordinal") + p) % 3).alias("confidence"))
    out = f"{shared_folder(spark)}/packed-{uuid.uuid4().hex}"
    blobs.pack(blobs.encoded(rows), out, width=1e5)
    total = lambda: F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    depth = blobs.rasters(spark, out).select("session_id", "frame", (4 * total()).cast("bigint").alias("quarters"), (4 * F.array_max("values")).cast("bigint").alias("most"), F.size("values").cast("bigint").alias("pixels"))
    return depth.join(blobs.rasters(spark, out, "confidence").select("session_id", "frame", total().cast("bigint").alias("confidence")), ["session_id", "frame"])


# --- vectors -------------------------------------------------------------------------

_NEAREST = """near AS (SELECT a.vec_id AS query, a.label, b.vec_id AS id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"""


@query(f"WITH {_NEAREST} SELECT query, rank::INT AS rank, id, {q('d')} AS distance FROM near WHERE rank <= 2")
def nearest_vectors(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = vectors.nearest(rows.where("vec_id % 20 = 0"), rows, id_col="vec_id", vector="embedding", k=2, itself=False)
    return _q(out.drop("opened"), "distance")


@query(f"""WITH {_NEAREST}, g AS (SELECT query, label, min_by(id, rank) AS id, min(d) AS d FROM near WHERE rank <= 2 GROUP BY query, label HAVING min(d) < 0.98::DOUBLE * max(d)),
    e AS (SELECT label % 4 AS pair FROM g GROUP BY ALL HAVING count(*) >= 2) SELECT label % 4 AS pair, query, id, {q('d')} AS distance FROM g WHERE label % 4 IN (SELECT pair FROM e)""")
def ratio_matches(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    near = vectors.nearest(rows.where("vec_id % 20 = 0"), rows, id_col="vec_id", vector="embedding", k=2, itself=False)
    pairs = near.join(rows.select(F.col("vec_id").alias("query"), (F.col("label") % 4).alias("pair")), "query")
    return _q(joins.ratio_matches(pairs, ["pair"], left="query", right="id", distance="distance", ratio=0.98, least=2), "distance")


# --- rasters -------------------------------------------------------------------------

_PIXELS = """px AS (SELECT label, v, u, CASE WHEN (vec_id + u) % 11 > 0 THEN embedding[u + 1]::DOUBLE END AS z FROM (SELECT *, unnest(range(len(embedding))) AS u FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS v FROM embeddings)))"""


def _pixels(spark, sf):
    """A raster for each label: its vectors as rows, with a gap in eleven pixels."""
    rows = numbered(table(spark, sf, "embeddings"), ["label"], ["vec_id"], "v", width=1e5)
    rows = rows.select("label", "vec_id", "v", F.posexplode("embedding").alias("u", "e"))
    return rows.select("label", "v", F.col("u").cast("bigint").alias("u"), F.when((F.col("vec_id") + F.col("u")) % 11 > 0, F.col("e").cast("double")).alias("z"))


@query(f"""WITH {_PIXELS}, a AS (SELECT *, coalesce(sum(z) OVER w, 0) AS sz, count(z) OVER w AS sn FROM px WINDOW w AS (PARTITION BY label, v ORDER BY u RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    b AS (SELECT *, sum(sz) OVER w AS bz, sum(sn) OVER w AS bn FROM a WINDOW w AS (PARTITION BY label, u ORDER BY v RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    SELECT label, v, u, CASE WHEN z IS NOT NULL THEN {q('CASE WHEN abs(bz / bn - z) <= 0.5::DOUBLE THEN bz / bn ELSE z END')} END AS smooth FROM b""")
def box_mean(spark, sf):
    return _q(cloud.box_mean(_pixels(spark, sf), ["label"], edge=0.5, tile=16).select("label", "v", "u", "smooth"), "smooth")


@query(f"""WITH {_PIXELS}, c AS (SELECT label, v, u, u * d / 10 AS x, v * d / 10 AS y, d AS z FROM (SELECT *, abs(z) + 1 AS d FROM px WHERE z IS NOT NULL)),
    n AS (SELECT c.*, r.x - l.x AS a0, r.y - l.y AS a1, r.z - l.z AS a2, b.x - t.x AS b0, b.y - t.y AS b1, b.z - t.z AS b2 FROM c
        LEFT JOIN c l ON l.label = c.label AND l.v = c.v AND l.u = c.u - 1 LEFT JOIN c r ON r.label = c.label AND r.v = c.v AND r.u = c.u + 1
        LEFT JOIN c t ON t.label = c.label AND t.u = c.u AND t.v = c.v - 1 LEFT JOIN c b ON b.label = c.label AND b.u = c.u AND b.v = c.v + 1),
    p AS (SELECT *, a1 * b2 - a2 * b1 AS n0, a2 * b0 - a0 * b2 AS n1, a0 * b1 - a1 * b0 AS n2 FROM n),
    s AS (SELECT *, CASE WHEN n0 * x + n1 * y + n2 * z > 0 THEN -1 ELSE 1 END / CASE WHEN n0 * n0 + n1 * n1 + n2 * n2 > 1e-24 THEN sqrt(n0 * n0 + n1 * n1 + n2 * n2) END AS k FROM p)
    SELECT label, v, u, {q('n0 * k')} AS nx, {q('n1 * k')} AS ny, {q('n2 * k')} AS nz FROM s""")
def grid_normals(spark, sf):
    d = F.abs("z") + 1
    rows = _pixels(spark, sf).where("z is not null").select("label", "v", "u", (F.col("u") * d / 10).alias("x"), (F.col("v") * d / 10).alias("y"), d.alias("z"))
    return _q(cloud.grid_normals(rows, ["label"]).select("label", "v", "u", "nx", "ny", "nz"), "nx", "ny", "nz")
