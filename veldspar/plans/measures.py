"""Queries of summaries, geometry, trajectories and clouds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display, geometry, lens
from ..operators import cloud, joins, quality, trajectory
from ..operators.ordered import previous
from ..sources.session import log_extract
from .tables import DAY, EVENTS, POINTS, events, points, q, quantised, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
W = float(30 * DAY)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _q(df, *columns, scale: float = 1e6):
    return df.withColumns({c: quantised(c, scale) for c in columns})


# --- summaries -----------------------------------------------------------------


@query("""SELECT o_orderkey AS session, 'lineitem' AS stream, count(*) AS actual, any_value(o_custkey % 7 + 1)::BIGINT AS declared, count(*) = any_value(o_custkey % 7 + 1) AS agrees
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def count_reconcile(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session"), F.lit("lineitem").alias("stream"))
    said = table(spark, sf, "orders").select(F.col("o_orderkey").alias("session"), F.lit("lineitem").alias("stream"), (F.col("o_custkey") % 7 + 1).alias("declared"))
    return quality.count_reconcile(items, said, ["session"])


@query(f"""WITH {EVENTS}, c AS (SELECT user_id, kind, count(*) AS n, min(event_id) AS f FROM ev GROUP BY user_id, kind)
    SELECT user_id, kind, n, (SELECT count(*) FROM c d WHERE d.user_id = c.user_id) > 1 AS mixed FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def dominant_bucket(spark, sf):
    return quality.dominant(events(spark, sf), ["user_id"], bucket="kind", order=["event_id"])


@query(f"WITH {EVENTS} SELECT user_id, {q('degrees(atan2(avg(sin(radians(cents / 100.0))), avg(cos(radians(cents / 100.0)))))', '1e3')} AS mean FROM ev GROUP BY user_id")
def circular_mean(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(quantised(quality.circular_mean(F.col("cents") / 100.0), 1e3).alias("mean"))


@query(f"""WITH {EVENTS}, r AS (SELECT user_id, event_id, degrees(atan2(sin(cents), -cos(cents))) AS roll FROM ev)
    SELECT user_id, CASE WHEN roll >= -45 AND roll < 45 THEN 'landscape' WHEN roll >= 45 AND roll < 135 THEN 'portrait' WHEN roll >= -135 AND roll < -45 THEN 'portrait (inverted)' ELSE 'landscape (upside down)' END AS shot, count(*) AS n FROM r GROUP BY ALL""")
def roll_orientation(spark, sf):
    roll = geometry.upright_roll(F.sin("cents"), F.cos("cents"))
    return events(spark, sf).select("user_id", geometry.orientation(roll).alias("shot")).groupBy("user_id", "shot").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT user_id, {q('avg(p)')} AS mean, {q('min(p)')} AS least, {q('max(p)')} AS most, {q('max(p) - min(p)')} AS spread, max(p) - min(p) > 0.5 AS warns FROM (SELECT user_id, degrees(asin(greatest(-1, least(1, -(cents % 200 - 100) / 90.0::DOUBLE)))) AS p FROM ev) GROUP BY user_id")
def camera_aim(spark, sf):
    rows = events(spark, sf).select("user_id", geometry.pitch_down((F.col("cents") % 200 - 100) / F.lit(90.0)).alias("p"))
    return _q(quality.spread(rows, ["user_id"], "p", warn=0.5), "mean", "least", "most", "spread")


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, t, event_id, kind, sqrt(pow((cents - lag(cents) OVER w) / 100.0::DOUBLE, 2)) AS d FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    a AS (SELECT user_id, count(*) AS n, (max(t) - min(t)) / {DAY}.0::DOUBLE AS days, sum(d) FILTER (kind <> 'error') AS travelled, avg(CASE WHEN kind IN ('view', 'click') THEN 1.0 ELSE 0.0 END) AS usable, count(*) FILTER (kind = 'error') AS breaks FROM s GROUP BY user_id)
    SELECT user_id, n, {q('travelled', '1e3')} AS travelled, {q('(n - 1) / days', '1e3')} AS hz, {q('usable')} AS usable, breaks,
        CASE WHEN usable < 0.3 THEN 'too dark' WHEN (n - 1) / days < 2 THEN 'depth too slow' WHEN travelled < 300 THEN 'barely moved' WHEN breaks > 15 AND n % 2 = 0 THEN 'truncated' WHEN breaks > 18 THEN 'thermal pause' ELSE 'ok' END AS verdict FROM a WHERE days > 0""")
def session_survey(spark, sf):
    rows = previous(events(spark, sf), ["user_id"], ["t", "event_id"], {"__c": "cents"}, width=W).withColumn("d", F.abs(F.col("cents") - F.col("__c")) / 100.0)
    a = rows.groupBy("user_id").agg(
        F.count("*").alias("n"), ((F.max("t") - F.min("t")) / float(DAY)).alias("days"), F.sum(F.when(F.col("kind") != "error", F.col("d"))).alias("travelled"),
        F.avg(F.when(F.col("kind").isin("view", "click"), 1.0).otherwise(0.0)).alias("usable"), F.count(F.when(F.col("kind") == "error", 1)).alias("breaks"),
    ).where("days > 0").withColumn("hz", (F.col("n") - 1) / F.col("days"))
    v = quality.verdict(F.col("usable") + 0.2, F.col("hz") + 10, F.col("travelled") / 100, F.lit(False), ~((F.col("breaks") > 15) & (F.col("n") % 2 == 0)), F.col("breaks") > 18)
    return _q(_q(a.withColumn("verdict", v), "travelled", "hz", scale=1e3), "usable").drop("days")


@query(f"WITH {EVENTS} SELECT kind, count(cents) AS n, {q('quantile_cont(cents, 0.5)')} AS p50, {q('quantile_cont(cents, 0.9)')} AS p90 FROM ev GROUP BY kind")
def percentiles(spark, sf):
    return _q(quality.percentiles(events(spark, sf), ["kind"], "cents", {"p50": 0.5, "p90": 0.9}), "p50", "p90")


@query(f"WITH {EVENTS}, m AS (SELECT user_id, median(cents) AS m FROM ev GROUP BY user_id) SELECT user_id, {q('any_value(m)')} AS median, {q('1.4826::DOUBLE * median(abs(cents - m))', '1e3')} AS variation FROM ev JOIN m USING (user_id) GROUP BY user_id")
def mad_variation(spark, sf):
    out = quality.mad_variation(events(spark, sf), ["user_id"], "cents")
    return out.select("user_id", quantised("median").alias("median"), quantised("variation", 1e3).alias("variation"))


@query(f"WITH {EVENTS} SELECT user_id, CASE WHEN k < 10 THEN 0 WHEN k < 50 THEN 1 ELSE 2 END AS band, count(*) AS n, {q('median(cents)')} AS median, {q('quantile_cont(cents, 0.9)')} AS p90 FROM ev WHERE k IS NOT NULL GROUP BY ALL")
def band_stats(spark, sf):
    return _q(quality.bands(events(spark, sf), ["user_id"], cond="k", error="cents", edges=(10, 50)), "median", "p90")


@query(f"""WITH {EVENTS}, c AS (SELECT kind, cents, k / 100.0::DOUBLE AS s, unnest([0.98::DOUBLE, 0.95::DOUBLE, 0.92::DOUBLE]) AS cut FROM ev), a AS (SELECT kind, cut, median(cents) FILTER (s < cut) AS u, median(cents) FILTER (s >= cut) AS o FROM c GROUP BY kind, cut)
    SELECT kind, {q('cut')} AS cut, {q('u')} AS under, {q('o')} AS over, CASE WHEN o <> 0 THEN {q('u / o')} END AS ratio FROM a""")
def cut_ratio(spark, sf):
    rows = events(spark, sf).withColumn("s", F.col("k") / 100.0)
    return _q(quality.cut_ratios(rows, ["kind"], score="s", error="cents"), "cut", "under", "over", "ratio")


@query(f"""WITH {EVENTS}, b AS (SELECT user_id, least(255, greatest(0, floor(cents / 200.0::DOUBLE)))::INT AS bin, count(*) AS n FROM ev GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY user_id) AS tot FROM b)
    SELECT user_id, {q('(min(bin) + 0.5) * 200.0')} AS value, any_value(tot)::BIGINT AS n FROM c WHERE seen >= greatest(1, floor(tot * 0.9::DOUBLE + 0.5)) GROUP BY user_id""")
def hist_percentile(spark, sf):
    out = quality.histogram_percentile(events(spark, sf), ["user_id"], "cents", fraction=0.9, size=200.0)
    return out.select("user_id", quantised("value").alias("value"), "n")


@query(f"""WITH {EVENTS}, n AS (SELECT user_id, cents, k, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY user_id) // 8) AS s FROM ev)
    SELECT user_id, {q('sum(k) / sum(cents)')} AS fraction, count(*) AS probes FROM n WHERE i % s = 0 AND i < s * 8 GROUP BY user_id""")
def sampled_fraction(spark, sf):
    return _q(quality.sampled_fraction(events(spark, sf), ["user_id"], ["t", "event_id"], hits="k", total="cents"), "fraction")


@query(f"WITH {EVENTS} SELECT user_id, count(*) AS \"rows\", {q(f'(count(*) - 1) / ((max(t) - min(t)) / {DAY}.0::DOUBLE)', '1e3')} AS hz FROM ev GROUP BY user_id HAVING max(t) > min(t)")
def arrival_rate(spark, sf):
    rows = events(spark, sf).withColumn("t", F.col("t") / float(DAY))
    return _q(quality.rate(rows, ["user_id"]).where("hz is not null"), "hz", scale=1e3)


@query("""WITH f AS (SELECT o_custkey AS session, o_orderstatus = 'F' AS done, o_orderstatus = 'P' AS moving, floor(o_totalprice)::BIGINT AS size FROM orders),
    a AS (SELECT session, count(*) AS total, count(*) FILTER (done) AS completed, count(*) FILTER (moving AND NOT done) AS moving, sum(CASE WHEN done THEN size ELSE least(100000, size) END)::BIGINT AS bytes_sent, sum(size)::BIGINT AS bytes FROM f GROUP BY session)
    SELECT *, greatest(0, total - completed - moving)::BIGINT AS pending FROM a WHERE completed < total""")
def upload_progress(spark, sf):
    f = table(spark, sf, "orders").select(F.col("o_custkey").alias("session"), (F.col("o_orderstatus") == "F").alias("done"), (F.col("o_orderstatus") == "P").alias("in_flight"), F.lit(100000).cast("bigint").alias("sent"), F.floor("o_totalprice").alias("size"))
    return quality.upload_progress(f, ["session"])


@query(f"""WITH {EVENTS}, s AS (SELECT kind, user_id, count(*) AS n, median(abs(cents - 5000)) AS m FROM ev GROUP BY ALL HAVING count(*) >= 5) SELECT kind, {q('median(m)')} AS residual, count(*) AS frames FROM s GROUP BY kind""")
def nested_median(spark, sf):
    rows = events(spark, sf).withColumn("r", F.col("cents") - 5000)
    return _q(cloud.nested_median(rows, ["kind"], "user_id", "r", least=5), "residual")


@query(f"WITH {EVENTS} SELECT user_id, {q('r')} AS radius, {q('avg(CASE WHEN cents / 100000.0::DOUBLE < r THEN 1.0 ELSE 0.0 END)')} AS fraction FROM ev, (SELECT unnest([0.15::DOUBLE, 0.08::DOUBLE, 0.04::DOUBLE, 0.02::DOUBLE]) AS r) GROUP BY user_id, r")
def radius_probe(spark, sf):
    return _q(cloud.radius_probe(events(spark, sf).withColumn("dist", F.col("cents") / 100000.0), ["user_id"]), "radius", "fraction")


@query(f"""WITH {EVENTS} SELECT kind, min(k) AS least, max(k) AS most, {q('avg(k)')} AS mean, {q('100 * avg(CASE WHEN k IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS valid_percent FROM (SELECT kind, CASE WHEN k < 90 THEN k::DOUBLE END AS k FROM ev) GROUP BY kind""")
def depth_statistics(spark, sf):
    z = F.when(F.col("k") < 90, F.col("k").cast("double")).otherwise(F.lit(float("nan")))
    return _q(cloud.depth_statistics(events(spark, sf).withColumn("z", z), ["kind"]), "mean", "valid_percent")


@query("""SELECT user_id, CASE WHEN min(cents) < 50 THEN 'standing' WHEN median(cents) > 5200 THEN 'diverging' WHEN avg(k) < 45 THEN 'few inliers' ELSE 'ok' END AS verdict FROM ev GROUP BY user_id""".join([f"WITH {EVENTS} ", ""]))
def odometry_verdict(spark, sf):
    a = events(spark, sf).groupBy("user_id").agg(F.median("cents").alias("m"), F.min("cents").alias("lo"), F.avg("k").alias("k"))
    return a.select("user_id", quality.odometry_verdict(F.col("m"), F.lit(5200), F.col("lo") * 0.15 / 50, F.col("k") * 0.3 / 45).alias("verdict"))


# --- text, labels ----------------------------------------------------------------


@query(r"SELECT page_id, nullif(regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(coalesce(html, ''), 'lang=\"(\w+)\"', 1), '') AS lang, nullif(regexp_extract(coalesce(html, ''), 'track\((\d+)\)', 1), '') AS track FROM pages")
def regex_extract(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    return log_extract(pages, "html", {"title": r"<title>([^<]*)</title>", "lang": r'lang="(\w+)"', "track": r"track\((\d+)\)"}).drop("html")


@query("SELECT page_id, CASE WHEN len(p) < 2 THEN false ELSE len(list_filter(p, lambda x: x = '' OR (x LIKE '.%' AND x <> '.complete') OR contains(x, '%') OR contains(x, chr(92)))) = 0 END AS safe FROM (SELECT page_id, string_split(replace(url, '://', '/'), '/') AS p FROM pages WHERE url IS NOT NULL)")
def safe_paths(spark, sf):
    pages = table(spark, sf, "pages").where("url is not null")
    return pages.select("page_id", display.safe_upload_path(F.replace("url", F.lit("://"), F.lit("/"))).alias("safe"))


@query(f"""WITH {EVENTS} SELECT event_id, CASE WHEN c >= 0.02 THEN 'strong' WHEN c >= 0.007 THEN 'ok' ELSE 'weak' END AS label, CASE WHEN c < 0.005 THEN 'refuse' WHEN c < 0.007 THEN 'watch' ELSE 'ok' END AS verdict,
    least(100, floor(k * 100.0 / 80 + 0.5))::INT AS percent, CASE WHEN cents >= 3600 THEN format('{{:d}}:{{:02d}}:{{:02d}}', (cents // 3600)::INT, (cents % 3600 // 60)::INT, (cents % 60)::INT) ELSE format('{{:d}}:{{:02d}}', (cents // 60)::INT, (cents % 60)::INT) END AS shown,
    CASE WHEN cents - 100 >= 0 THEN cents - 100 END AS speed FROM (SELECT *, k / 4000.0::DOUBLE AS c FROM ev)""")
def display_labels(spark, sf):
    c = F.col("k") / 4000.0
    return events(spark, sf).select("event_id", display.conditioning_label(c).alias("label"), display.conditioning_verdict(c).alias("verdict"), display.upload_percent(F.col("k"), F.lit(80)).alias("percent"), display.duration(F.col("cents")).alias("shown"), display.nullif_negative(F.col("cents") - 100).alias("speed"))


@query(f"WITH {EVENTS} SELECT user_id, CASE WHEN e > 20 THEN 'errors' WHEN n > 80 THEN 'busy' WHEN v < 5 THEN 'idle' END AS warning FROM (SELECT user_id, count(*) FILTER (kind = 'error') AS e, count(*) AS n, count(*) FILTER (kind = 'view') AS v FROM ev GROUP BY user_id)")
def first_warning(spark, sf):
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    a = events(spark, sf).groupBy("user_id").agg(count("error").alias("e"), F.count("*").alias("n"), count("view").alias("v"))
    return a.select("user_id", display.first_warning(errors=F.col("e") > 20, busy=F.col("n") > 80, idle=F.col("v") < 5).alias("warning"))


# --- geometry --------------------------------------------------------------------


@query("""SELECT p_partkey, floor(2 * degrees(atan(w / (2 * f))) * 1e6 + 0.5)::BIGINT AS h, floor(2 * degrees(atan(1440.0::DOUBLE / (2 * f))) * 1e6 + 0.5)::BIGINT AS v,
    greatest(64, least(1920, round_even(2 * f * tan(radians(60.0::DOUBLE) / 2), 0)))::INT AS crop FROM (SELECT p_partkey, 1920.0::DOUBLE AS w, p_retailprice AS f FROM part)""")
def crop_geometry(spark, sf):
    f = F.col("p_retailprice")
    fov = geometry.field_of_view(F.lit(1920.0), F.lit(1440.0), f, f)
    return table(spark, sf, "part").select("p_partkey", quantised(fov["h"]).alias("h"), quantised(fov["v"]).alias("v"), geometry.crop_for_hfov(F.lit(1920), f, F.lit(60.0)).alias("crop"))


_QUAT = "SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS w FROM embeddings"


@query(f"""WITH a AS ({_QUAT}), n AS (SELECT vec_id, x / l AS x, y / l AS y, z / l AS z, w / l AS w FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS l FROM a))
    SELECT vec_id, {q('1 - 2 * (y * y + z * z)')} AS m00, {q('2 * (x * y - w * z)')} AS m01, {q('2 * (y * z - w * x)')} AS m12, {q('abs(w)')} AS w, {q('CASE WHEN w < 0 THEN -x ELSE x END')} AS x, {q('acos(greatest(-1, least(1, (4 * w * w - 2) / 2)))')} AS angle FROM n""")
def pose_roundtrip(spark, sf):
    e = F.col("embedding")
    m = geometry.quaternion_to_matrix(*[e[i].cast("double") for i in range(4)])
    rows = table(spark, sf, "embeddings").select("vec_id", m.alias("m")).withColumn("q", geometry.matrix_to_quaternion("m"))
    sign = F.when(F.col("q.w") < 0, -1.0).otherwise(1.0)
    return rows.select("vec_id", quantised(F.col("m")[0]).alias("m00"), quantised(F.col("m")[1]).alias("m01"), quantised(F.col("m")[5]).alias("m12"), quantised(sign * F.col("q.w")).alias("w"), quantised(sign * F.col("q.x")).alias("x"), quantised(geometry.rotation_angle("m")).alias("angle"))


@query(f"""WITH {POINTS} SELECT vec_id, {q('(x * 100 - 50) * d / 210', '1e3')} AS px, {q('(y * 100 - 60) * d / 220', '1e3')} AS py, {q('210 * rx / d + 50', '1e3')} AS u FROM (SELECT *, abs(z) + 1 AS d FROM pt)""")
def projection(spark, sf):
    d = F.abs("z") + 1
    p = geometry.back_project(F.col("x") * 100, F.col("y") * 100, d, F.lit(210.0), F.lit(220.0), F.lit(50.0), F.lit(60.0))
    u = geometry.project(F.col("rx"), F.col("ry"), d, F.lit(210.0), F.lit(220.0), F.lit(50.0), F.lit(60.0))
    return points(spark, sf).select("vec_id", quantised(p["x"], 1e3).alias("px"), quantised(p["y"], 1e3).alias("py"), quantised(u["u"], 1e3).alias("u"))


_LUT = "[0.0::DOUBLE, 0.01::DOUBLE, 0.03::DOUBLE, 0.06::DOUBLE, 0.1::DOUBLE]"


@query(f"""WITH {POINTS}, s AS (SELECT vec_id, greatest(0, least(sqrt(x * x + y * y) / 3.0, 1.0)) * 4 AS s FROM pt), i AS (SELECT *, least(floor(s), 3)::INT AS i FROM s)
    SELECT vec_id, {q(f'{_LUT}[i + 1] + ({_LUT}[i + 2] - {_LUT}[i + 1]) * (s - i)')} AS m FROM i""")
def lut_interp(spark, sf):
    lut = F.array(*[F.lit(v) for v in (0.0, 0.01, 0.03, 0.06, 0.1)])
    return points(spark, sf).select("vec_id", quantised(lens.magnification(F.hypot("x", "y"), lut, F.lit(3.0))).alias("m"))


_FOCALS = "SELECT f.f FROM (SELECT unnest([300.0::DOUBLE, 400.0::DOUBLE, 500.0::DOUBLE, 600.0::DOUBLE]) AS f) f"


@query(f"""WITH {POINTS}, c AS (SELECT pt.*, f FROM pt, ({_FOCALS})),
    n AS (SELECT label, f, (x * 100) / f AS u1, (y * 100) / f AS v1, (rx * 100) / f AS u2, (ry * 100) / f AS v2 FROM c),
    d AS (SELECT label, f, abs(v2 * u1 * 0 + v1 * 1.0 - v2) / sqrt(1.0 / (f * f) + 1.0 / (f * f)) AS d FROM n),
    m AS (SELECT label, f, median(d) AS m FROM d GROUP BY label, f)
    SELECT label, {q('f')} AS f, {q('m', '1e3')} AS score FROM m""")
def sampson_argmin(spark, sf):
    essential = F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 1.0, 0.0)])
    grid = spark.createDataFrame([(300.0,), (400.0,), (500.0,), (600.0,)], "f double")
    rows = joins.grid(points(spark, sf), grid).withColumn("fm", geometry.fundamental(essential, "f", "f", F.lit(0.0), F.lit(0.0)))
    d = geometry.sampson("fm", F.col("x") * 100, F.col("y") * 100, F.col("rx") * 100, F.col("ry") * 100)
    out = rows.groupBy("label", "f").agg(F.median(d).alias("m"))
    return out.select("label", quantised("f").alias("f"), quantised("m", 1e3).alias("score"))


# --- trajectories ----------------------------------------------------------------


@query(f"""WITH {POINTS}, s AS (SELECT label, vec_id, x, y, z, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS d FROM pt WINDOW w AS (PARTITION BY label ORDER BY vec_id))
    SELECT label, {q('coalesce(sum(d), 0)')} AS length, {q('sqrt(pow(max_by(x, vec_id) - min_by(x, vec_id), 2) + pow(max_by(y, vec_id) - min_by(y, vec_id), 2) + pow(max_by(z, vec_id) - min_by(z, vec_id), 2))')} AS gap, max(vec_id) - min(vec_id) AS span, count(*) AS "rows" FROM s GROUP BY label""")
def path_length(spark, sf):
    return _q(quality.path(points(spark, sf), ["label"], ["vec_id"], ("x", "y", "z"), width=1e5), "length", "gap")


@query(f"WITH {POINTS} SELECT label, {q('sqrt(pow(max_by(x, vec_id) - min_by(x, vec_id), 2) + pow(max_by(z, vec_id) - min_by(z, vec_id), 2))')} AS gap FROM pt GROUP BY label")
def loop_gap(spark, sf):
    return _q(quality.loop_gap(points(spark, sf), ["label"], ["vec_id"], x="x", z="z"), "gap")


@query(f"""WITH {POINTS}, a AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(rx) AS ux, avg(ry) AS uy, atan2(covar_pop(x, ry) - covar_pop(y, rx), covar_pop(x, rx) + covar_pop(y, ry)) AS g FROM pt GROUP BY label)
    SELECT label, n, {q('g')} AS angle, {q('ux - cos(g) * mx + sin(g) * my')} AS shift_x, {q('uy - sin(g) * mx - cos(g) * my')} AS shift_y FROM a""")
def rigid_fit_2d(spark, sf):
    return _q(trajectory.planar_fit(points(spark, sf), ["label"], ("x", "y"), ("rx", "ry")), "angle", "shift_x", "shift_y")


def _fit_sql(scaled: bool) -> str:
    """Fits of (x, y, z) to (rx, ry, rz) by label, as table ``fit`` (label, means, rotation r0.. by rows, scale k).

    The rotation's quaternion belongs to the largest root of a quartic, found by Newton's steps from above; it is a
    column of cofactors.
    """
    s = {(i, j): f"s{i}{j}" for i in range(3) for j in range(3)}
    n = [["xx", "a", "b", "c"], ["a", "xy", "d", "e"], ["b", "d", "xz", "f"], ["c", "e", "f", "xw"]]
    entries = {"a": "s12 - s21", "b": "s20 - s02", "c": "s01 - s10", "d": "s01 + s10", "e": "s20 + s02", "f": "s12 + s21", "xx": "s00 + s11 + s22", "xy": "s00 - s11 - s22", "xz": "s11 - s00 - s22", "xw": "s22 - s00 - s11"}

    def det3(m):
        return f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"

    def cofactor(m, i, j):
        return ("" if (i + j) % 2 == 0 else "-") + det3([[m[r][c] for c in range(4) if c != j] for r in range(4) if r != i])

    det4 = " + ".join(f"{n[0][j]} * {cofactor(n, 0, j)}" for j in range(4))
    k = [[f"({n[i][j]} - l)" if i == j else n[i][j] for j in range(4)] for i in range(4)]
    columns = [f"[{', '.join(cofactor(k, i, j) for j in range(4))}]" for i in range(4)]
    return f"""mean AS (SELECT label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(rx) AS ux, avg(ry) AS uy, avg(rz) AS uz FROM pt GROUP BY label),
        about AS (SELECT label, x - mx AS p0, y - my AS p1, z - mz AS p2, rx - ux AS q0, ry - uy AS q1, rz - uz AS q2 FROM pt JOIN mean USING (label)),
        sums AS (SELECT label, {", ".join(f"sum(p{i} * q{j}) AS {v}" for (i, j), v in s.items())}, sum(p0 * p0 + p1 * p1 + p2 * p2) AS pp, sum(q0 * q0 + q1 * q1 + q2 * q2) AS qq FROM about GROUP BY label),
        quart AS (SELECT *, -2 * ({" + ".join(f"{v} * {v}" for v in s.values())}) AS c2, -8 * {det3([[s[i, j] for j in range(3)] for i in range(3)])} AS c1, {det4} AS c0
            FROM (SELECT *, {", ".join(f"{e} AS {v}" for v, e in entries.items())} FROM sums)),
        newton(label, step, l) AS (SELECT label, 0, (pp + qq) / 2 FROM quart
            UNION ALL SELECT n.label, step + 1, l - (((l * l + c2) * l + c1) * l + c0) / ((4 * l * l + 2 * c2) * l + c1) FROM newton n JOIN quart USING (label) WHERE step < 80),
        adjoint AS (SELECT q.label, l, pp, [{", ".join(columns)}] AS m FROM quart q JOIN newton n ON n.label = q.label AND step = 80),
        longest AS (SELECT label, l, pp, list_reduce(m, lambda a, b: CASE WHEN list_dot_product(a, a) >= list_dot_product(b, b) THEN a ELSE b END) AS v FROM adjoint),
        unit AS (SELECT label, l, pp, v[1] / g AS w, v[2] / g AS i, v[3] / g AS j, v[4] / g AS h FROM (SELECT *, sqrt(list_dot_product(v, v)) AS g FROM longest)),
        fit AS (SELECT mean.*, {"l / pp" if scaled else "1.0::DOUBLE"} AS k, 1 - 2 * (j * j + h * h) AS r0, 2 * (i * j - w * h) AS r1, 2 * (i * h + w * j) AS r2, 2 * (i * j + w * h) AS r3, 1 - 2 * (i * i + h * h) AS r4, 2 * (j * h - w * i) AS r5,
            2 * (i * h - w * j) AS r6, 2 * (j * h + w * i) AS r7, 1 - 2 * (i * i + j * j) AS r8 FROM unit JOIN mean USING (label))"""


def _ate_sql(scaled: bool) -> str:
    off = [f"pow(k * (r{3 * i} * (x - mx) + r{3 * i + 1} * (y - my) + r{3 * i + 2} * (z - mz)) + u{a} - r{a}, 2)" for i, a in enumerate("xyz")]
    return f"""WITH RECURSIVE {POINTS}, {_fit_sql(scaled)}, d AS (SELECT label, sqrt({" + ".join(off)}) AS d FROM pt JOIN fit USING (label))
        SELECT label, {q('avg(d)')} AS ate_mean, {q('sqrt(avg(d * d))')} AS ate_rms, count(*) AS "rows" FROM d GROUP BY label"""


@query(_ate_sql(False))
def ate_kabsch(spark, sf):
    return _q(trajectory.trajectory_error(points(spark, sf), ["label"], ("x", "y", "z"), ("rx", "ry", "rz")), "ate_mean", "ate_rms")


@query(_ate_sql(True))
def ate_umeyama(spark, sf):
    return _q(trajectory.trajectory_error(points(spark, sf), ["label"], ("x", "y", "z"), ("rx", "ry", "rz"), scaled=True), "ate_mean", "ate_rms")


@query(f"""WITH {POINTS}, c AS (SELECT label, count(*) AS n, var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, covar_pop(x, y) AS d, covar_pop(y, z) AS e, covar_pop(x, z) AS f FROM pt GROUP BY label),
    m AS (SELECT *, (a + b + c) / 3 AS m, sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM c),
    r AS (SELECT *, greatest(-1, least(1, (((a - m) * ((b - m) * (c - m) - e * e) - d * (d * (c - m) - e * f) + f * (d * e - (b - m) * f)) / (p * p * p)) / 2)) AS r FROM m),
    l AS (SELECT *, m + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3) AS l FROM r),
    v AS (SELECT *, d * e - f * (b - l) AS n0, f * d - (a - l) * e AS n1, (a - l) * (b - l) - d * d AS n2 FROM l)
    SELECT label, n, {q('sqrt(greatest(0, l))')} AS thickness, {q('degrees(acos(least(1, abs(n1) / sqrt(n0 * n0 + n1 * n1 + n2 * n2))))')} AS tilt FROM v""")
def plane_thickness(spark, sf):
    return _q(trajectory.plane_fit(points(spark, sf), ["label"], ("x", "y", "z")).drop("normal"), "thickness", "tilt")


@query(f"WITH {POINTS} SELECT label, count(*) AS n, {q('sum(x * rx) / sum(rx * rx)')} AS scale, {q('corr(x, rx)')} AS r FROM pt GROUP BY label")
def lsq_scale_corr(spark, sf):
    return _q(trajectory.scale_fit(points(spark, sf), ["label"], "x", "rx"), "scale", "r")


@query(f"WITH {POINTS} SELECT label, count(*) AS n, {q('corr(ln(x), ln(y))')} AS r FROM pt WHERE x > 0 AND y > 0 GROUP BY label")
def loglog_corr(spark, sf):
    return _q(trajectory.log_correlation(points(spark, sf), ["label"], "x", "y"), "r")


@query(f"""WITH {POINTS}, m AS (SELECT label, avg(x) AS a, avg(y) AS b, avg(z) AS c FROM pt GROUP BY label) SELECT label, {q('a / sqrt(a * a + b * b + c * c)')} AS gx, {q('b / sqrt(a * a + b * b + c * c)')} AS gy, {q('c / sqrt(a * a + b * b + c * c)')} AS gz FROM m""")
def mean_gravity(spark, sf):
    return _q(trajectory.mean_gravity(points(spark, sf), ["label"], ("x", "y", "z")), "gx", "gy", "gz")


@query(f"""WITH {POINTS}, m AS (SELECT label, avg(a) AS ga, avg(b) AS gb, avg(c) AS gc FROM pt GROUP BY label),
    g AS (SELECT label, ga / l AS g0, gb / l AS g1, gc / l AS g2 FROM (SELECT *, sqrt(ga * ga + gb * gb + gc * gc) AS l FROM m)),
    s AS (SELECT *, CASE WHEN abs(g0) > 0.9 THEN 0.0 ELSE 1.0 END AS s0, CASE WHEN abs(g0) > 0.9 THEN 1.0 ELSE 0.0 END AS s2 FROM g),
    p AS (SELECT *, s0 - (s0 * g0 + s2 * g2) * g0 AS p0, -(s0 * g0 + s2 * g2) * g1 AS p1, s2 - (s0 * g0 + s2 * g2) * g2 AS p2 FROM s),
    u AS (SELECT *, p0 / sqrt(p0 * p0 + p1 * p1 + p2 * p2) AS a0, p1 / sqrt(p0 * p0 + p1 * p1 + p2 * p2) AS a1, p2 / sqrt(p0 * p0 + p1 * p1 + p2 * p2) AS a2 FROM p)
    SELECT vec_id, {q('a0 * x + a1 * y + a2 * z')} AS floor_a, {q('(g1 * a2 - g2 * a1) * x + (g2 * a0 - g0 * a2) * y + (g0 * a1 - g1 * a0) * z')} AS floor_b FROM pt JOIN u USING (label)""")
def floor_projection(spark, sf):
    p = points(spark, sf)
    out = trajectory.floor_projection(p, trajectory.mean_gravity(p, ["label"], ("a", "b", "c")), ["label"], ("x", "y", "z"))
    return _q(out.select("vec_id", "floor_a", "floor_b"), "floor_a", "floor_b")


@query(f"WITH {POINTS} SELECT vec_id, {q('(lead(x) OVER w - 2 * x + lag(x) OVER w) / 0.25')} AS second FROM pt WINDOW w AS (PARTITION BY label ORDER BY vec_id)")
def second_difference(spark, sf):
    out = trajectory.second_difference(points(spark, sf).withColumn("dt", F.lit(0.5)), ["label"], ["vec_id"], "x", width=1e5)
    return _q(out.select("vec_id", "second"), "second")


@query(f"""WITH {POINTS}, k AS (SELECT label, vec_id, CASE WHEN vec_id % 7 = 0 THEN rx - x END AS d, x FROM pt),
    w AS (SELECT *, CASE WHEN d IS NOT NULL THEN vec_id END AS h, max(CASE WHEN d IS NOT NULL THEN vec_id END) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
        min(CASE WHEN d IS NOT NULL THEN vec_id END) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM k),
    j AS (SELECT w.*, a.d AS ld, b.d AS rd FROM w LEFT JOIN k a ON a.vec_id = coalesce(w.l, w.r) AND a.label = w.label LEFT JOIN k b ON b.vec_id = coalesce(w.r, w.l) AND b.label = w.label)
    SELECT vec_id, CASE WHEN h IS NOT NULL THEN 'anchor' WHEN l IS NULL OR r IS NULL THEN 'outside' ELSE 'between' END AS "position",
        {q('x + ld + CASE WHEN l IS NOT NULL AND r > l THEN (vec_id - l)::DOUBLE / (r - l) ELSE 0 END * (rd - ld)')} AS fused_x FROM j WHERE ld IS NOT NULL""")
def anchor_fusion(spark, sf):
    p = points(spark, sf)
    a = p.where("vec_id % 7 = 0").select("label", "vec_id", F.col("rx").alias("x"))
    out = trajectory.fused(p.withColumn("t", F.col("vec_id").cast("double")), a, ["label"], frame="vec_id", values=("x",), width=1e5).where("fused_x is not null")
    return out.select("vec_id", "position", quantised("fused_x").alias("fused_x"))


def _rotation(i: int) -> str:
    """Nine entries r0.. of the rotation of the quaternion that begins at ``embedding[i]``, from a row q."""
    return f"""SELECT label, vec_id, 1 - 2 * (y * y + z * z) AS r0, 2 * (x * y - w * z) AS r1, 2 * (x * z + w * y) AS r2, 2 * (x * y + w * z) AS r3, 1 - 2 * (x * x + z * z) AS r4, 2 * (y * z - w * x) AS r5, 2 * (x * z - w * y) AS r6, 2 * (y * z + w * x) AS r7, 1 - 2 * (x * x + y * y) AS r8, p0, p1, p2
        FROM (SELECT label, vec_id, x / l AS x, y / l AS y, z / l AS z, w / l AS w, p0, p1, p2 FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS l FROM (SELECT label, vec_id, embedding[{i}]::DOUBLE AS x, embedding[{i + 1}]::DOUBLE AS y, embedding[{i + 2}]::DOUBLE AS z, embedding[{i + 3}]::DOUBLE AS w, embedding[{i + 4}]::DOUBLE AS p0, embedding[{i + 5}]::DOUBLE AS p1, embedding[{i + 6}]::DOUBLE AS p2 FROM embeddings)))"""


def _step(name: str, table: str) -> str:
    """The motion from the row before, as the camera of each row sees it: t0.. and e0.."""
    turn = ", ".join(f"r{i} * b{j} + r{3 + i} * b{3 + j} + r{6 + i} * b{6 + j} AS e{3 * i + j}" for i in range(3) for j in range(3))
    move = ", ".join(f"r{i} * (o0 - p0) + r{3 + i} * (o1 - p1) + r{6 + i} * (o2 - p2) AS t{i}" for i in range(3))
    before = ", ".join([*[f"lag(r{i}) OVER v AS b{i}" for i in range(9)], *[f"lag(p{i}) OVER v AS o{i}" for i in range(3)]])
    return f"{name} AS (SELECT vec_id, {turn}, {move} FROM (SELECT *, {before} FROM ({table}) WINDOW v AS (PARTITION BY label ORDER BY vec_id)) WHERE b0 IS NOT NULL)"


@query(f"""WITH {_step('e', _rotation(1))}, {_step('f', _rotation(9))}
    SELECT vec_id, {q('sqrt(pow(e.t0 - f.t0, 2) + pow(e.t1 - f.t1, 2) + pow(e.t2 - f.t2, 2))', '1e3')} AS step_error, {q('degrees(acos(greatest(-1, least(1, (' + ' + '.join(f'e.e{i} * f.e{i}' for i in range(9)) + ' - 1) / 2))))', '1e3')} AS turn_error FROM e JOIN f USING (vec_id)""")
def relative_error(spark, sf):
    e = F.col("embedding")
    pose = lambda i: geometry.pose(geometry.quaternion_to_matrix(*[e[i + k].cast("double") for k in range(4)]), *[e[i + 4 + k].cast("double") for k in range(3)])
    rows = table(spark, sf, "embeddings").select("label", "vec_id", pose(0).alias("est"), pose(8).alias("ref"))
    out = trajectory.relative_errors(rows, ["label"], ["vec_id"], width=1e5)
    return _q(out.select("vec_id", "step_error", "turn_error"), "step_error", "turn_error", scale=1e3)


@query(f"WITH {POINTS} SELECT label, vec_id, {q('x', '1e3')} AS x, {q('y', '1e3')} AS y, {q('z', '1e3')} AS z FROM pt")
def window_chain(spark, sf):
    # Windows that agree: each fit changes nothing.
    p = points(spark, sf).select("label", "vec_id", "x", "y", "z")
    w = p.withColumn("window", F.explode(F.array(F.floor(F.col("vec_id") / 200), F.floor(F.col("vec_id") / 200) + 1)))
    return _q(trajectory.chain(w, ["label"], frame="vec_id"), "x", "y", "z", scale=1e3)


@query(f"""WITH {POINTS}, w AS (SELECT label, min(vec_id // 200) AS w FROM pt GROUP BY label)
    SELECT label, vec_id, {q('k * (cos(g) * x - sin(g) * y) + w', '1e3')} AS x, {q('k * (sin(g) * x + cos(g) * y)', '1e3')} AS y, {q('k * z - w', '1e3')} AS z FROM (SELECT *, 1 + w % 3 / 4.0::DOUBLE AS k, 0.7::DOUBLE * w AS g FROM pt JOIN w USING (label))""")
def window_chain_warped(spark, sf):
    """Each window has a scale, turn and shift of its own; the chain is all in the first one's."""
    p = points(spark, sf).select("label", "vec_id", "x", "y", "z")
    w = p.withColumn("window", F.explode(F.array(F.floor(F.col("vec_id") / 200), F.floor(F.col("vec_id") / 200) + 1)))
    k, g, n = 1 + F.col("window") % 3 / 4.0, 0.7 * F.col("window"), F.col("window")
    w = w.withColumns({"x": k * (F.cos(g) * F.col("x") - F.sin(g) * F.col("y")) + n, "y": k * (F.sin(g) * F.col("x") + F.cos(g) * F.col("y")), "z": k * F.col("z") - n})
    return _q(trajectory.chain(w, ["label"], frame="vec_id"), "x", "y", "z", scale=1e3)


# --- clouds ----------------------------------------------------------------------


@query(f"""WITH {POINTS} SELECT label, floor(x / 0.5)::BIGINT AS kx, floor(y / 0.5)::BIGINT AS ky, floor(z / 0.5)::BIGINT AS kz, min(vec_id) AS vec_id FROM pt GROUP BY ALL""")
def voxel_first(spark, sf):
    return cloud.voxel_first(points(spark, sf), ["label"], size=0.5, order=["vec_id"]).select("label", "kx", "ky", "kz", "vec_id")


@query(f"""WITH {POINTS}, v AS (SELECT label, floor(x / 0.5)::BIGINT AS kx, floor(y / 0.5)::BIGINT AS ky, floor(z / 0.5)::BIGINT AS kz, vec_id % 4 AS frame, avg(x) AS px, avg(y) AS py, avg(z) AS pz FROM pt GROUP BY ALL)
    SELECT label, kx, ky, kz, {q('avg(px)')} AS px, {q('avg(py)')} AS py, {q('avg(pz)')} AS pz, {q('count(*)')} AS w FROM v GROUP BY ALL""")
def voxel_mean(spark, sf):
    p = points(spark, sf).withColumn("frame", F.col("vec_id") % 4)
    return _q(cloud.voxel_fuse(p, ["label"], frame="frame", size=0.5), "px", "py", "pz", "w")


@query(f"""WITH {POINTS}, v AS (SELECT label, floor(x / 0.5)::BIGINT AS kx, floor(y / 0.5)::BIGINT AS ky, floor(z / 0.5)::BIGINT AS kz, vec_id % 4 AS frame, avg(x) AS px FROM pt GROUP BY ALL)
    SELECT label, kx, ky, kz, {q('avg(px)')} AS px, {q('count(*)')} AS w FROM v GROUP BY ALL""")
def voxel_capped(spark, sf):
    p = points(spark, sf).withColumn("frame", F.col("vec_id") % 4)
    return _q(cloud.voxel_fuse(p, ["label"], frame="frame", size=0.5, max_weight=20).select("label", "kx", "ky", "kz", "px", "w"), "px", "w")


@query(f"""WITH {POINTS}, s AS (SELECT (i - 1)::BIGINT AS dx, (j - 1)::BIGINT AS dy, (k - 1)::BIGINT AS dz, i * 9 + j * 3 + k AS slot FROM range(3) a(i), range(3) b(j), range(3) c(k)),
    p AS (SELECT vec_id AS point_id, label, x, y, z, slot, floor(x / 0.5)::BIGINT + dx AS kx, floor(y / 0.5)::BIGINT + dy AS ky, floor(z / 0.5)::BIGINT + dz AS kz FROM pt, s),
    m AS (SELECT label, rx, ry, rz, floor(rx / 0.5)::BIGINT AS kx, floor(ry / 0.5)::BIGINT AS ky, floor(rz / 0.5)::BIGINT AS kz FROM pt),
    d AS (SELECT p.label, point_id, slot, pow(x - rx, 2) + pow(y - ry, 2) + pow(z - rz, 2) AS d2 FROM p JOIN m USING (label, kx, ky, kz))
    SELECT label, point_id, {q('min(d2)')} AS d2 FROM d WHERE d2 < 0.25 GROUP BY label, point_id""")
def voxel_nn_join(spark, sf):
    p = points(spark, sf)
    fused = p.select("label", F.col("rx").alias("x"), F.col("ry").alias("y"), F.col("rz").alias("z"))
    out = joins.voxel_neighbours(p.withColumn("point_id", F.col("vec_id")).select("label", "point_id", "x", "y", "z"), fused, ["label"], size=0.5, max_dist=0.5)
    return _q(out.select("label", "point_id", "d2"), "d2")


@query(f"""WITH {POINTS}, p AS (SELECT label, round_even(x * 4 / d + 8, 0)::INT AS u, round_even(y * 4 / d + 8, 0)::INT AS v, d AS z FROM (SELECT *, abs(z) + 1 AS d FROM pt)),
    n AS (SELECT *, min(z) OVER (PARTITION BY label, u, v) AS near FROM p WHERE u BETWEEN 0 AND 15 AND v BETWEEN 0 AND 15)
    SELECT label, u, v, {q('avg(z)')} AS z, count(*) AS n FROM n WHERE z <= near + 0.02 GROUP BY ALL""")
def zbuffer_min(spark, sf):
    p = points(spark, sf).withColumn("z", F.abs("z") + 1)
    return _q(cloud.z_buffer(p, ["label"], fx=4.0, fy=4.0, cx=8.0, cy=8.0, width=16, height=16), "z")


_CROSS = ("y * c - z * b", "z * a - x * c", "x * b - y * a", "a", "b", "c")


@query(f"WITH {POINTS} SELECT label, count(*) AS n, " + ", ".join(f"{q(f'avg(({_CROSS[i]}) * ({_CROSS[j]}))')} AS h{i}{j}" for i in range(6) for j in range(i, 6)) + " FROM pt GROUP BY label")
def hessian_sums(spark, sf):
    out = cloud.hessian(points(spark, sf), ["label"], n=("a", "b", "c"))
    return _q(out, *[c for c in out.columns if c.startswith("h")])


def _conditioning_sql(sweeps: int = 10) -> str:
    """Least over greatest eigenvalue of the 6 x 6 means, by Jacobi's turns of one pair of axes after the other."""
    pairs = [(i, j) for i in range(6) for j in range(i + 1, 6)]
    cell = ", ".join(f"avg(({_CROSS[i]}) * ({_CROSS[j]}))" for i in range(6) for j in range(6))
    side = lambda m, at, there: f"CASE {at} WHEN p THEN c * {m}[{there('p')}] - s * {m}[{there('q')}] WHEN q THEN s * {m}[{there('p')}] + c * {m}[{there('q')}] ELSE {m}[e + 1] END"
    return f"""WITH RECURSIVE {POINTS}, turns(label, k, a) AS (SELECT label, 0, [{cell}] FROM pt GROUP BY label
        UNION ALL SELECT label, k + 1, list_transform(range(36), lambda e: {side("b", "e // 6", lambda v: f"{v} * 6 + e % 6 + 1")}) FROM (
            SELECT *, list_transform(range(36), lambda e: {side("a", "e % 6", lambda v: f"e // 6 * 6 + {v} + 1")}) AS b FROM (
            SELECT *, 1 / sqrt(1 + t * t) AS c, t / sqrt(1 + t * t) AS s FROM (
            SELECT *, CASE WHEN a[p * 6 + q + 1] = 0 THEN 0 ELSE (CASE WHEN o >= 0 THEN 1 ELSE -1 END) / (abs(o) + sqrt(1 + o * o)) END AS t FROM (
            SELECT *, CASE WHEN a[p * 6 + q + 1] = 0 THEN 0 ELSE (a[q * 7 + 1] - a[p * 7 + 1]) / (2 * a[p * 6 + q + 1]) END AS o FROM (
            SELECT *, {[p for p, _ in pairs]}[k % 15 + 1] AS p, {[p for _, p in pairs]}[k % 15 + 1] AS q FROM turns WHERE k < {15 * sweeps}))))))
        SELECT pt.label, {q('greatest(0, w[1] / w[6])')} AS cond, count(*) AS n FROM pt JOIN (SELECT label, list_sort([a[1], a[8], a[15], a[22], a[29], a[36]]) AS w FROM turns WHERE k = {15 * sweeps}) USING (label) GROUP BY ALL"""


@query(_conditioning_sql())
def conditioning(spark, sf):
    return _q(cloud.conditioning(points(spark, sf), ["label"], n=("a", "b", "c")).drop("weak"), "cond")


@query(f"""WITH {POINTS}, h AS (SELECT label, x * a + y * b + z * c AS h, (rx * a + ry * b + rz * c) / (sqrt(rx * rx + ry * ry + rz * rz) * sqrt(a * a + b * b + c * c)) AS cosine, sqrt(a * a + b * b + c * c) AS l FROM pt)
    SELECT label, {q('median(h / l)')} AS height, count(*) AS n FROM h WHERE abs(cosine) >= cos(radians(60.0::DOUBLE)) AND h / l > 0 GROUP BY label HAVING count(*) >= 3""")
def floor_height(spark, sf):
    l = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    n = F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry") + F.col("rz") * F.col("rz"))
    p = points(spark, sf).withColumns({"gx": F.col("a") / l, "gy": F.col("b") / l, "gz": F.col("c") / l, "nx": F.col("rx") / n, "ny": F.col("ry") / n, "nz": F.col("rz") / n})
    return _q(cloud.floor_height(p, ["label"], degrees=60.0, least=3), "height")
