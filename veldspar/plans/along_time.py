"""Queries of the operators along time, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changelog, joins, quality, timeops
from ..operators.ordered import numbered, running
from ..sources import sinks
from .tables import DAY, EVENTS, events, quantised, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Slot of the two-level scans: microseconds.
W = float(30 * DAY)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _asof_sql(left: str, right: str, earlier: str, tolerance: str = "", kept: str = "") -> str:
    return f"""WITH {EVENTS},
        u AS (SELECT user_id, t, 0 AS side, event_id, NULL::BIGINT AS o, NULL AS r FROM ev WHERE kind = '{left}'
            UNION ALL SELECT user_id, t, 1, NULL, event_id, {{'t': t, 'id': event_id, 'c': cents}} FROM ev WHERE kind = '{right}'),
        w AS (SELECT *, last_value(r IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, side, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
            first_value(r IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, side, o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM u),
        c AS (SELECT user_id, event_id, t, CASE WHEN p IS NULL THEN n WHEN n IS NULL OR {earlier} THEN p ELSE n END AS m FROM w WHERE side = 0),
        k AS (SELECT user_id, event_id, t, {f"CASE WHEN abs(t - m.t) <= {tolerance} THEN m END" if tolerance else "m"} AS m FROM c)
        SELECT user_id, event_id, m.id AS near_event_id, m.c AS near_cents, t - m.t AS near_dt FROM k {kept}"""


@query(_asof_sql("purchase", "view", "t - p.t <= n.t - t"))
def asof_nearest(spark, sf):
    ev = events(spark, sf)
    out = timeops.nearest(ev.where("kind = 'purchase'"), ev.where("kind = 'view'"), ["user_id"], right_order=["event_id"], values=["event_id", "cents"], width=W)
    return out.select("user_id", "event_id", "near_event_id", "near_cents", "near_dt")


@query(_asof_sql("error", "click", "t - p.t < n.t - t", str(2 * DAY)))
def asof_tolerance_late_tie(spark, sf):
    ev = events(spark, sf)
    out = timeops.nearest(ev.where("kind = 'error'"), ev.where("kind = 'click'"), ["user_id"], right_order=["event_id"], values=["event_id", "cents"], tie="later", tolerance=2 * DAY, width=W)
    return out.select("user_id", "event_id", "near_event_id", "near_cents", "near_dt")


@query(f"""WITH {EVENTS}, d AS (SELECT user_id, k, max(event_id) AS id, max(cents) FILTER (event_id = m) AS cents, 1 AS hit FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id, k) AS m FROM ev WHERE kind = 'view') GROUP BY user_id, k),
    s AS (SELECT e.user_id, e.event_id, e.t, d.id, d.cents FROM ev e LEFT JOIN d USING (user_id, k) WHERE e.kind = 'click'),
    u AS (SELECT user_id, t, 0 AS side, event_id, NULL::BIGINT AS o, NULL AS r FROM s WHERE id IS NULL
        UNION ALL SELECT user_id, t, 1, NULL, event_id, {{'t': t, 'id': event_id, 'c': cents}} FROM ev WHERE kind = 'view'),
    w AS (SELECT *, last_value(r IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, side, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
        first_value(r IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, side, o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM u),
    c AS (SELECT user_id, event_id, t, CASE WHEN p IS NULL THEN n WHEN n IS NULL OR t - p.t <= n.t - t THEN p ELSE n END AS m FROM w WHERE side = 0)
    SELECT user_id, event_id, id AS depth_event_id, cents AS depth_cents, 0::BIGINT AS depth_dt FROM s WHERE id IS NOT NULL
    UNION ALL SELECT user_id, event_id, m.id, m.c, t - m.t FROM c""")
def exact_or_nearest(spark, sf):
    ev = events(spark, sf)
    out = joins.exact_or_nearest(ev.where("kind = 'click'"), ev.where("kind = 'view'"), ["user_id"], frame="k", order=["event_id"], values=["event_id", "cents"], width=W)
    return out.select("user_id", "event_id", "depth_event_id", "depth_cents", "depth_dt")


@query(f"""WITH {EVENTS}, p AS (SELECT user_id, t AS b, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS a FROM ev WHERE kind = 'purchase')
    SELECT p.user_id, a, b, floor(avg(cents) * 1000 + 0.5)::BIGINT AS mean, count(cents) AS n FROM p LEFT JOIN ev ON ev.kind = 'click' AND ev.user_id = p.user_id AND ev.t BETWEEN a AND b WHERE a IS NOT NULL GROUP BY p.user_id, a, b""")
def interval_avg(spark, sf):
    from ..operators.ordered import previous

    ev = events(spark, sf)
    p = previous(ev.where("kind = 'purchase'"), ["user_id"], ["t", "event_id"], {"a": "t"}, width=W).where("a is not null").select("user_id", "a", F.col("t").alias("b"))
    out = timeops.interval_average(p, ev.where("kind = 'click'"), ["user_id"], start="a", end="b", value="cents", name="m", width=float(DAY))
    return out.select("user_id", "a", "b", quantised("m", 1000).alias("mean"), F.col("m_n").alias("n"))


@query(f"WITH {EVENTS} SELECT user_id, a AS gap_start, t AS gap_end FROM (SELECT user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS a FROM ev) WHERE t - a > {2 * DAY}")
def gap_detect(spark, sf):
    return timeops.gaps(events(spark, sf), ["user_id"], order=["event_id"], threshold=2 * DAY, width=W)


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap, t FROM ev)
    SELECT user_id, t, gap FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, t) AS r FROM g WHERE gap IS NOT NULL) WHERE r <= 5""")
def top_gaps(spark, sf):
    from ..operators.ordered import previous

    rows = previous(events(spark, sf), ["user_id"], ["t", "event_id"], {"a": "t"}, width=W).where("a is not null").withColumn("gap", F.col("t") - F.col("a"))
    return sinks.top_rows(rows, ["user_id"], [F.desc("gap"), "t"], 5).select("user_id", "t", "gap")


@query(f"""WITH {EVENTS}, b AS (SELECT *, count(*) FILTER (kind = 'error') OVER (PARTITION BY user_id ORDER BY t, CASE WHEN kind = 'error' THEN 0 ELSE 1 END, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM ev)
    SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY c) - 1 AS segment FROM b WHERE kind <> 'error'""")
def segment_breaks(spark, sf):
    ev = events(spark, sf)
    return timeops.segments(ev.where("kind <> 'error'"), ev.where("kind = 'error'"), ["user_id"], order=["event_id"], width=W).select("user_id", "event_id", "segment")


@query(f"""WITH {EVENTS}, b AS (SELECT *, count(*) FILTER (kind = 'error') OVER (PARTITION BY user_id ORDER BY t, CASE WHEN kind = 'error' THEN 0 ELSE 1 END, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM ev)
    SELECT user_id, c AS break_no, count(*) AS n FROM b WHERE kind <> 'error' GROUP BY user_id, c HAVING count(*) >= 10""")
def segments_min_rows(spark, sf):
    ev = running(events(spark, sf).withColumn("side", F.when(F.col("kind") == "error", 0).otherwise(1)), ["user_id"], ["t", "side", "event_id"], {"break_no": F.when(F.col("kind") == "error", 1).otherwise(0)}, width=W)
    rows = quality.gate_segments(ev.where("kind <> 'error'"), ["user_id", "break_no"], 10)
    return rows.groupBy("user_id", F.col("break_no").cast("bigint").alias("break_no")).agg(F.count("*").alias("n"))


@query(f"""WITH {EVENTS}, r AS (SELECT user_id, t, event_id, row_number() OVER w - 1 AS i, t - lag(t) OVER w AS dt, abs(cents - lag(cents) OVER w)::DOUBLE AS dc FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)),
    x AS (SELECT *, CASE WHEN dt > 0 THEN dc / dt END AS rate FROM r WHERE i > 0),
    y AS (SELECT *, max(rate) OVER f AS m, count(rate) OVER f AS n FROM x WINDOW f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
    z AS (SELECT user_id, min(i) FILTER (n = 5 AND m < 3e-6) AS first_at, min(dt) AS least, count(*) + 1 AS samples FROM y GROUP BY user_id)
    SELECT z.user_id, samples, CASE WHEN first_at = 1 THEN 0 ELSE (SELECT y.t FROM y WHERE y.user_id = z.user_id AND y.i = z.first_at) - (SELECT min(t) FROM ev WHERE ev.user_id = z.user_id) END::BIGINT AS settled FROM z WHERE samples >= 6 AND least > 0""")
def focus_settle(spark, sf):
    ev = events(spark, sf)
    origin = ev.groupBy("user_id").agg(F.min("t").alias("t0"))
    out = timeops.focus_settle(ev, ["user_id"], fx="cents", origin=origin, quiet=3e-6, width=W)
    return out.select("user_id", "samples", F.col("settled").cast("bigint").alias("settled"))


_LOG = "lg AS (SELECT *, CASE kind WHEN 'error' THEN 'removed' WHEN 'signup' THEN 'added' ELSE 'updated' END AS event FROM ev)"


def _log(spark, sf):
    return events(spark, sf).withColumn("event", F.when(F.col("kind") == "error", "removed").when(F.col("kind") == "signup", "added").otherwise("updated"))


@query(f"WITH {EVENTS}, {_LOG} SELECT user_id, k, event_id, event, cents FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id DESC) AS r FROM lg) WHERE r = 1 AND event <> 'removed'")
def changelog_final(spark, sf):
    return changelog.compact(_log(spark, sf), ["user_id"], key="k", order=["event_id"]).select("user_id", "k", "event_id", "event", "cents")


@query(f"""WITH RECURSIVE {EVENTS}, {_LOG}, o AS (SELECT user_id, k % 5 AS g, event_id, t, event, row_number() OVER (PARTITION BY user_id, k % 5 ORDER BY t, event_id) AS i FROM lg),
    f(user_id, g, i, event_id, passes, last) AS (
        SELECT user_id, g, i, event_id, true, CASE WHEN event = 'removed' THEN NULL ELSE t END FROM o WHERE i = 1
        UNION ALL SELECT o.user_id, o.g, o.i, o.event_id, o.event <> 'updated' OR f.last IS NULL OR o.t - f.last >= {3 * DAY},
            CASE WHEN o.event = 'removed' THEN NULL WHEN o.event <> 'updated' OR f.last IS NULL OR o.t - f.last >= {3 * DAY} THEN o.t ELSE f.last END
        FROM f JOIN o ON o.user_id = f.user_id AND o.g = f.g AND o.i = f.i + 1)
    SELECT user_id, g, event_id FROM f WHERE passes""")
def changelog_throttle(spark, sf):
    log = _log(spark, sf).withColumn("g", F.col("k") % 5)
    return changelog.throttle(log, ["user_id", "g"], order=["event_id"], interval=3 * DAY).select("user_id", "g", "event_id")


def _gate_sql(step: int, name: str) -> str:
    return f"""{name}(user_id, i, event_id, fires, due) AS (
        SELECT user_id, i, event_id, true, t + {step} FROM o WHERE i = 1
        UNION ALL SELECT o.user_id, o.i, o.event_id, o.t >= f.due, CASE WHEN o.t < f.due THEN f.due WHEN o.t - f.due >= {step} THEN o.t + {step} ELSE f.due + {step} END
        FROM {name} f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)"""


_ORDERED = "o AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev)"


@query(f"WITH RECURSIVE {EVENTS}, {_ORDERED}, {_gate_sql(DAY, 'g')} SELECT user_id, event_id, fires FROM g")
def rate_gate(spark, sf):
    ev = events(spark, sf).withColumn("t", F.col("t") / DAY)
    return timeops.rate_gate(ev.withColumn("t", F.col("t") * 1.0), ["user_id"], order=["event_id"], hz=1.0).select("user_id", "event_id", "fires")


@query(f"""WITH RECURSIVE {EVENTS}, {_ORDERED}, {_gate_sql(2 * DAY, 'g')}, {_gate_sql(DAY, 'h')}
    SELECT user_id, event_id, g.fires AS image, g.fires OR h.fires AS depth FROM g JOIN h USING (user_id, event_id)""")
def coupled_gates(spark, sf):
    ev = events(spark, sf).withColumn("t", F.col("t") / DAY)
    return timeops.coupled_gates(ev, ["user_id"], order=["event_id"], image_hz=0.5, depth_hz=1.0).select("user_id", "event_id", "image", "depth")


@query("SELECT source, doc_id, n_chars, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars)::BIGINT AS new_offset FROM documents")
def prefix_offsets(spark, sf):
    return sinks.packed_index(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], length="n_chars", width=10_000.0)


@query("""SELECT source, doc_id, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars)::BIGINT AS new_offset
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3""")
def pack_limit(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return sinks.packed_index(docs, ["source"], ["doc_id"], length="n_chars", limit=3, width=10_000.0).select("source", "doc_id", "new_offset")


@query(f"""WITH {EVENTS}, m AS (SELECT user_id, max(event_id) AS m FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM ev WHERE kind = 'view') WHERE r <= 3 GROUP BY user_id)
    SELECT ev.user_id, event_id FROM ev LEFT JOIN m USING (user_id) WHERE event_id <= coalesce(m, 0)""")
def pack_poses(spark, sf):
    ev = events(spark, sf)
    kept = sinks.packed_index(ev.where("kind = 'view'"), ["user_id"], ["event_id"], length="cents", limit=3, width=1e6)
    return sinks.packed_poses(ev, kept, ["user_id"], frame="event_id").select("user_id", "event_id")


@query(f"""WITH {EVENTS} SELECT user_id, event_id, floor(avg(CASE WHEN cents < 5000 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * 1e6 + 0.5)::BIGINT AS below FROM ev""")
def rolling_below_floor(spark, sf):
    out = quality.rolling_below(events(spark, sf), ["user_id"], ["t", "event_id"], "cents", floor=5000, rows=20, width=W)
    return out.select("user_id", "event_id", quantised("below").alias("below"))


@query(f"""WITH {EVENTS}, r AS (SELECT user_id, event_id, cents, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
    s AS (SELECT DISTINCT user_id, n, unnest(CASE WHEN greatest(n - 8, 0) % 5 = 0 THEN range(0, greatest(n - 8, 0) + 1, 5) ELSE list_append(range(0, greatest(n - 8, 0) + 1, 5), n - 8) END) AS a FROM r)
    SELECT r.user_id, a AS window_start, count(*) AS n, sum(cents)::BIGINT AS cents FROM r JOIN s ON r.user_id = s.user_id AND i >= a AND i < a + 8 GROUP BY r.user_id, a""")
def row_windows_pinned(spark, sf):
    rows = timeops.row_windows(events(spark, sf), ["user_id"], order=["t", "event_id"], size=8, step=5, width=W)
    return rows.groupBy("user_id", "window_start").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query(f"""WITH {EVENTS}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
    s AS (SELECT DISTINCT user_id, n, unnest(CASE WHEN greatest(n - 8, 0) % 5 = 0 THEN range(0, greatest(n - 8, 0) + 1, 5) ELSE list_append(range(0, greatest(n - 8, 0) + 1, 5), n - 8) END) AS a FROM r),
    w AS (SELECT r.user_id, event_id, dense_rank() OVER (PARTITION BY r.user_id ORDER BY a) AS w FROM r JOIN s ON r.user_id = s.user_id AND i >= a AND i < a + 8)
    SELECT x.user_id, x.w, count(*) AS shared, count(*) >= 3 AS enough FROM w x JOIN w y ON x.user_id = y.user_id AND x.event_id = y.event_id AND y.w = x.w + 1 GROUP BY x.user_id, x.w""")
def window_overlap(spark, sf):
    from pyspark.sql import Window

    rows = timeops.row_windows(events(spark, sf), ["user_id"], order=["t", "event_id"], size=8, step=5, width=W)
    starts = rows.select("user_id", "window_start").distinct().withColumn("w", F.row_number().over(Window.partitionBy("user_id").orderBy("window_start")).cast("bigint"))
    return joins.shared_frames(rows.join(starts, ["user_id", "window_start"]), ["user_id"], window="w", frame="event_id")


@query(f"""WITH {EVENTS}, u AS (SELECT user_id, min(t) AS a, max(t) AS b FROM ev GROUP BY user_id), g AS (SELECT user_id, k, a + k * {2 * DAY} AS t FROM (SELECT user_id, a, unnest(range(0, (b - a) // {2 * DAY} + 1)) AS k FROM u)),
    x AS (SELECT user_id, t, 0 AS side, NULL::BIGINT AS k, {{'t': t, 'v': cents::DOUBLE}} AS p FROM ev UNION ALL SELECT user_id, t, 1, k, NULL FROM g),
    y AS (SELECT user_id, k, t, side, last_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
        first_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, side ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM x)
    SELECT user_id, k, t, floor((CASE WHEN r IS NULL OR r.t <= l.t THEN l.v WHEN l IS NULL THEN r.v ELSE l.v + (r.v - l.v) * (t - l.t) / (r.t - l.t) END) * 1000 + 0.5)::BIGINT AS cents FROM y WHERE side = 1""")
def resample_linear(spark, sf):
    out = timeops.resample(events(spark, sf), ["user_id"], value="cents", step=2 * DAY, width=W)
    return out.select("user_id", "k", "t", quantised("cents", 1000).alias("cents"))


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, t, event_id, kind = 'error' AS throttled FROM ev)
    SELECT user_id, event_id, throttled FROM (SELECT *, lag(throttled) OVER (PARTITION BY user_id ORDER BY t, event_id) AS was FROM s) WHERE throttled <> coalesce(was, false)""")
def state_transitions(spark, sf):
    out = changelog.transitions(events(spark, sf), ["user_id"], order=["event_id"], hot=F.col("kind") == "error", width=W)
    return out.select("user_id", "event_id", "throttled")


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, t, event_id, CASE WHEN t - lag(t) OVER w <= {DAY} THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS session FROM g)
    SELECT user_id, session, min(t) AS "start", max(t) AS "end", count(*) AS "rows" FROM s GROUP BY user_id, session""")
def idle_sessions(spark, sf):
    return changelog.idle_sessions(events(spark, sf), ["user_id"], order=["event_id"], quiet=DAY, width=W).withColumn("session", F.col("session").cast("bigint"))


@query(f"""WITH {EVENTS}, n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
    SELECT user_id, event_id FROM n WHERE i % 6 = 0 AND i // 6 > n // 6 - 5""")
def track_thinning(spark, sf):
    return changelog.thinned(events(spark, sf), ["user_id"], ["t", "event_id"], every=6, keep=5, width=W).select("user_id", "event_id")


@query(f"""WITH {EVENTS}, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id DESC) AS r FROM ev WHERE kind = 'view') WHERE r = 1)
    SELECT e.user_id, e.event_id, p.event_id AS pose_event_id, p.cents AS pose_cents FROM ev e JOIN p ON e.user_id = p.user_id AND e.k = p.k WHERE e.kind = 'click'""")
def posed_join(spark, sf):
    ev = events(spark, sf)
    out = joins.posed_images(ev.where("kind = 'click'"), ev.where("kind = 'view'"), ["user_id"], frame="k", pose_order=["event_id"])
    return out.select("user_id", "event_id", "pose_event_id", "pose_cents")


@query(f"""WITH {EVENTS}, p AS (SELECT DISTINCT user_id, k FROM ev WHERE kind = 'view') SELECT e.user_id, count(*) AS candidates, count(p.k) AS matched, count(*) - count(p.k) AS dropped FROM ev e LEFT JOIN p USING (user_id, k) WHERE e.kind = 'click' GROUP BY e.user_id""")
def dropped_accounting(spark, sf):
    ev = events(spark, sf)
    return joins.unmatched(ev.where("kind = 'click'"), ev.where("kind = 'view'"), ["user_id"], ["user_id", "k"])


@query(f"""WITH {EVENTS} SELECT user_id, event_id FROM ev WHERE kind = 'click' AND (user_id, k) IN (SELECT user_id, k FROM ev WHERE kind = 'view') AND (user_id, k) IN (SELECT user_id, k FROM ev WHERE kind = 'purchase')""")
def usable_frames(spark, sf):
    ev = events(spark, sf)
    return joins.usable(ev.where("kind = 'click'"), [ev.where("kind = 'view'"), ev.where("kind = 'purchase'")], ["user_id", "k"]).select("user_id", "event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def pending_anti(spark, sf):
    items = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.pending(table(spark, sf, "orders"), items.where("l_returnflag = 'R'"), items.where("l_linestatus = 'O'"), ["o_orderkey"]).select("o_orderkey")


@query("SELECT r_name, s_suppkey FROM region, supplier")
def arms_cross(spark, sf):
    return joins.grid(table(spark, sf, "supplier").select("s_suppkey"), table(spark, sf, "region").select("r_name"))


@query("SELECT l_orderkey AS key FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def anchors_uncovered(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    return joins.uncovered(a, table(spark, sf, "orders").where("o_orderstatus <> 'P'").withColumnRenamed("o_orderkey", "key"), ["key"])


@query(f"""WITH {EVENTS}, r AS (SELECT user_id, event_id, t, cents, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM ev)
    SELECT user_id, event_id, t - first_value(t) OVER w AS t0, cents - first_value(cents) OVER w AS c0, i AS row_index FROM r WINDOW w AS (PARTITION BY user_id ORDER BY i)""")
def first_row_rebase(spark, sf):
    ev = events(spark, sf)
    first = ev.groupBy("user_id").agg(F.min_by(F.struct("t", "cents"), F.struct("t", "event_id")).alias("f"))
    rows = numbered(ev, ["user_id"], ["t", "event_id"], width=W).join(first, "user_id")
    return rows.select("user_id", "event_id", (F.col("t") - F.col("f.t")).alias("t0"), (F.col("cents") - F.col("f.cents")).alias("c0"), "row_index")


@query(f"""WITH RECURSIVE {EVENTS}, n AS (SELECT user_id, event_id, cents::DOUBLE AS x, t / {DAY}.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM ev),
    d AS (SELECT user_id, coalesce(median(g), 0) AS dt FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY i) AS g FROM n) GROUP BY user_id),
    w AS (SELECT user_id, CASE WHEN dt > 0 THEN dt / (dt + 1 / (2 * pi() * 0.2::DOUBLE)) ELSE 1.0 END AS a FROM d),
    f(user_id, i, y) AS (SELECT user_id, i, x FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, f.y + w.a * (n.x - f.y) FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i + 1 JOIN w ON w.user_id = f.user_id),
    b(user_id, i, z) AS (SELECT f.user_id, f.i, f.y FROM f JOIN n ON n.user_id = f.user_id AND n.i = f.i AND n.i = n.c UNION ALL SELECT f.user_id, f.i, b.z + w.a * (f.y - b.z) FROM b JOIN f ON f.user_id = b.user_id AND f.i = b.i - 1 JOIN w ON w.user_id = b.user_id)
    SELECT b.user_id, event_id, floor(z * 1000 + 0.5)::BIGINT AS smooth FROM b JOIN n ON n.user_id = b.user_id AND n.i = b.i""")
def low_pass(spark, sf):
    ev = events(spark, sf).select("user_id", "event_id", (F.col("t") / DAY).alias("t"), F.col("cents").cast("double").alias("v"))
    return timeops.low_pass(ev, ["user_id"], value="v", cutoff_hz=0.2).select("user_id", "event_id", quantised("smooth", 1000).alias("smooth"))
