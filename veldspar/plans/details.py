"""Queries of labels, gaps, residuals, alignment and logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display, geometry
from ..operators import cloud, joins, quality
from ..sources.session import odometry_logs
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


@query(f"""WITH {POINTS} SELECT vec_id, {q('210 * rx / d + 50', '1e3')} AS u, {q('220 * ry / d + 60', '1e3')} AS v, {q('210 / d', '1e3')} AS ux, {q('-210 * rx / (d * d)', '1e3')} AS uz, {q('220 / d', '1e3')} AS vy, {q('-220 * ry / (d * d)', '1e3')} AS vz
    FROM (SELECT *, abs(z) + 1 AS d FROM pt)""")
def projection_jacobian(spark, sf):
    u = geometry.project(F.col("rx"), F.col("ry"), F.abs("z") + 1, F.lit(210.0), F.lit(220.0), F.lit(50.0), F.lit(60.0))
    return _q(points(spark, sf).select("vec_id", *[u[c].alias(c) for c in ("u", "v", "ux", "uz", "vy", "vz")]), "u", "v", "ux", "uz", "vy", "vz", scale=1e3)


@query(f"""WITH {POINTS}, c AS (SELECT pt.*, f FROM pt, (SELECT unnest([300.0::DOUBLE, 400.0::DOUBLE, 500.0::DOUBLE, 600.0::DOUBLE]) AS f)),
    d AS (SELECT label, f, abs(abs(x * y) - f / 500) AS d FROM c), m AS (SELECT label, f, median(d) AS m FROM d GROUP BY label, f)
    SELECT label, min_by(f, [m, f])::BIGINT AS focal, {q('min(m)')} AS score, count(*) AS tried FROM m GROUP BY label""")
def focal_argmin(spark, sf):
    grid = spark.createDataFrame([(300.0,), (400.0,), (500.0,), (600.0,)], "f double")
    rows = joins.grid(points(spark, sf), grid).withColumn("d", F.abs(F.abs(F.col("x") * F.col("y")) - F.col("f") / 500))
    scores = quality.percentiles(rows, ["label", "f"], "d", {"m": 0.5})
    out = scores.groupBy("label").agg(F.min_by("f", F.struct("m", "f")).cast("bigint").alias("focal"), F.min("m").alias("score"), F.count("*").alias("tried"))
    return _q(out, "score")


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM ev)
    SELECT user_id, count(*) AS "rows", max(gap) AS gap, coalesce(count(*) > 2 AND max(gap)::DOUBLE * ((count(*) - 1)::DOUBLE / nullif(max(t) - min(t), 0)) > 4, false) AS warns FROM g GROUP BY user_id""")
def largest_gap(spark, sf):
    return quality.largest_gap(events(spark, sf), ["user_id"], order=["event_id"], width=W).drop("hz")


@query(f"WITH {EVENTS} SELECT user_id, {q('avg(cents)')} AS mean, min(cents) AS least, max(cents) AS most, max(cents) - min(cents) AS spread, max(cents) - min(cents) > 9000 AS warns, count(*) FILTER (k > 90) AS clamped FROM ev GROUP BY user_id")
def fov_spread(spark, sf):
    out = quality.spread(events(spark, sf).withColumn("wide", F.col("k") > 90), ["user_id"], "cents", warn=9000, clamped="wide")
    return _q(out, "mean").select("user_id", "mean", "least", "most", "spread", "warns", "clamped")


@query(f"WITH {POINTS} SELECT label, {q('avg(sqrt(pow(x - rx, 2) + pow(y - ry, 2) + pow(z - rz, 2))) / greatest(max(vec_id) - min(vec_id), 1e-6::DOUBLE)')} AS drift FROM pt GROUP BY label")
def drift_rate(spark, sf):
    off = F.sqrt(sum((F.pow(F.col(a) - F.col(f"r{a}"), 2) for a in "yz"), F.pow(F.col("x") - F.col("rx"), 2)))
    out = points(spark, sf).groupBy("label").agg(F.avg(off).alias("e"), (F.max("vec_id") - F.min("vec_id")).cast("double").alias("span"))
    return _q(out.select("label", display.drift_rate(F.col("e"), F.col("span")).alias("drift")), "drift")


@query(f"""WITH {EVENTS}, f AS (SELECT kind, user_id, median(abs(cents - 5000)) FILTER (k <= 90) AS e, count(*) FILTER (k <= 90) AS ne, median(abs(cents - 4000)) FILTER (k > 5) AS r, count(*) FILTER (k > 5) AS nr FROM ev GROUP BY ALL)
    SELECT kind, count(*) AS frames, {q('median(e)')} AS estimate, {q('median(r)')} AS reference FROM f WHERE ne >= 4 AND nr >= 4 GROUP BY kind""")
def compared_residuals(spark, sf):
    rows = events(spark, sf).select("kind", "user_id", F.when(F.col("k") <= 90, F.col("cents") - 5000).alias("e"), F.when(F.col("k") > 5, F.col("cents") - 4000).alias("r"))
    return _q(cloud.compared_residuals(rows, ["kind"], "user_id", estimate="e", reference="r", least=4), "estimate", "reference").select("kind", "frames", "estimate", "reference")


@query("""SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1f MB', n / 1000000.0::DOUBLE) WHEN n >= 1000 THEN printf('%.1f KB', n / 1000.0::DOUBLE) ELSE n || ' B' END AS size,
    CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 07:08:09' ELSE 'session ' || o_orderkey END AS title, o_orderkey % 3 IS NOT NULL AS confidence FROM (SELECT *, floor(o_totalprice)::BIGINT * 8 + 1 AS n FROM orders)""")
def file_labels(spark, sf):
    n = F.floor("o_totalprice").cast("bigint") * 8 + 1  # no number is halfway between two of one digit
    name = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-070809-abcdef"))).otherwise(F.concat(F.lit("session "), F.col("o_orderkey")))
    return table(spark, sf, "orders").select("o_orderkey", display.byte_size(n).alias("size"), display.session_title(name).alias("title"), display.migrated_confidence(F.col("o_orderkey") % 3 > 0).alias("confidence"))


def _near(kind: str, name: str) -> str:
    return f"""{name} AS (SELECT e.event_id, o.event_id AS id, e.t - o.t AS dt FROM ev e JOIN ev o ON o.user_id = e.user_id AND o.kind = '{kind}' WHERE e.kind = 'click'
        QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.t - o.t), o.t, CASE WHEN o.t < e.t THEN -o.event_id ELSE o.event_id END) = 1)"""


@query(f"""WITH {EVENTS}, d AS (SELECT user_id, k, max(event_id) AS id FROM ev WHERE kind = 'view' GROUP BY ALL), {_near('purchase', 'p')}, {_near('signup', 's')}
    SELECT e.event_id, d.id AS depth_event_id, p.id AS location_event_id, p.dt AS location_dt, s.id AS motion_event_id, s.dt AS motion_dt FROM ev e LEFT JOIN d USING (user_id, k) LEFT JOIN p USING (event_id) LEFT JOIN s USING (event_id) WHERE e.kind = 'click'""")
def aligned_streams(spark, sf):
    ev = events(spark, sf)
    of = lambda kind: ev.where(F.col("kind") == kind).withColumn("ordinal", F.col("event_id"))
    out = joins.align(ev.where("kind = 'click'"), ["user_id"], depth=of("view"), depth_values=["event_id"], nearest_streams={"location": (of("purchase"), ["event_id"]), "motion": (of("signup"), ["event_id"])}, frame="k", width=W)
    return out.select("event_id", "depth_event_id", "location_event_id", "location_dt", "motion_event_id", "motion_dt")


@query(f"""WITH {EVENTS}, a AS (SELECT user_id, count(*) AS n, min(k) AS k, max(cents) AS c FROM ev GROUP BY user_id)
    SELECT user_id, n::DOUBLE AS frames, 's' || user_id AS name, k / 100.0::DOUBLE AS median, {q('c / 1000.0::DOUBLE', '1e3')} AS worst, (k % 101)::DOUBLE AS inliers, CASE WHEN n % 2 = 0 THEN k END AS band_frames FROM a""")
def log_numbers(spark, sf):
    a = events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.min("k").alias("k"), F.max("cents").alias("c"))
    head = F.format_string("s%d: %d depth frames, stride 1\n  rotation  median %.2f°  p90 %.3f°\n  ICP inliers: median %d%%\n", "user_id", "n", F.col("k") / 100.0, F.col("c") / 1000.0, F.col("k") % 101)
    text = F.concat(head, F.when(F.col("n") % 2 == 0, F.format_string("  cond < 0.01 %d frames\n", "k")).otherwise(""))
    out = odometry_logs(a.select("user_id", text.alias("log")), "log")
    return out.select("user_id", F.col("frames")[1].alias("frames"), F.col("frames_text")[0].alias("name"), F.col("rpe_rot")[0].alias("median"), quantised(F.col("rpe_rot")[1], 1e3).alias("worst"), F.col("inliers")[0].alias("inliers"), F.get("bands", F.lit(0))["frames"].alias("band_frames"))
