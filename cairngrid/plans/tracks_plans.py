"""Catalogue: tracks from events, geometry checks on literals, versions and access rules on orders, customers and events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngrid.functions import geometry as geo
from cairngrid.operators import evaluation, pod, security, tracks, versions
from cairngrid.plans.base import literal, query, rounded, table


def points(spark, d):
    """Events as track points: user as track, t in milliseconds, position from value and id, seq by time."""
    e = table(spark, d, "events")
    p = e.select(F.col("user_id").alias("track_id"), "event_id", (F.col("value") * 100).alias("x"), (F.col("event_id") % 100 * 10).cast("double").alias("y"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    return p.withColumn("seq", F.row_number().over(W.partitionBy("track_id").orderBy("t", "event_id")).cast("long")).drop("event_id")


P = """pts AS (SELECT user_id AS track_id, value * 100e0 AS x, (event_id % 100 * 10)::DOUBLE AS y, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS seq FROM events),
st AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(t) OVER w AS pt FROM pts WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
sd AS (SELECT *, (t - pt) / 1000e0 AS dt, sqrt((x-px)*(x-px)+(y-py)*(y-py)) AS dd FROM st)"""
GAP, SPEED = 86_400.0, 0.05


@query(f"""WITH {P}, a AS (SELECT track_id, count(*) AS n, bool_and(coalesce(dt > 0, true)) AS ordered, round(coalesce(sum(dd), 0e0), 6) AS length_m, round((max(t) - min(t)) / 1000e0, 6) AS duration_s,
 sum(CASE WHEN dt > {GAP}e0 THEN 1 ELSE 0 END)::INTEGER AS n_gaps, sum(CASE WHEN dt > 0 AND dd / dt > {SPEED}e0 THEN 1 ELSE 0 END)::INTEGER AS n_jumps FROM sd GROUP BY 1)
SELECT *, CASE WHEN n_jumps > 0 OR NOT ordered THEN 'suspect' WHEN n_gaps > 0 THEN 'gappy' ELSE 'good' END AS quality FROM a""")
def q29_track_assess(spark, d):
    out = tracks.assess_tracks(points(spark, d), GAP, SPEED)
    return rounded(out.select("track_id", "n", "ordered", "length_m", "duration_s", "n_gaps", "n_jumps", "quality"), 6)


@query(f"""WITH RECURSIVE {P.replace("pts AS", "pts AS", 1)}, walk AS (SELECT track_id, seq, x, y, t, x AS lx, y AS ly, t AS lt, true AS kept FROM pts WHERE seq = 1
 UNION ALL SELECT p.track_id, p.seq, p.x, p.y, p.t, CASE WHEN ok THEN p.x ELSE lx END, CASE WHEN ok THEN p.y ELSE ly END, CASE WHEN ok THEN p.t ELSE lt END, ok
 FROM (SELECT p.*, w.lx, w.ly, w.lt, p.t > w.lt AND sqrt((p.x-w.lx)*(p.x-w.lx)+(p.y-w.ly)*(p.y-w.ly)) / ((p.t - w.lt) / 1000e0) <= {SPEED}e0 AS ok FROM walk w JOIN pts p ON p.track_id = w.track_id AND p.seq = w.seq + 1) p)
SELECT track_id, seq FROM walk WHERE kept""")
def q30_track_clean(spark, d):
    return tracks.clean_tracks(points(spark, d), SPEED).select("track_id", "seq")


@query(f"""WITH {P}, f AS (SELECT track_id, seq, t, sum(CASE WHEN coalesce(dt, 0e0) > {GAP}e0 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY seq) AS part FROM sd), n AS (SELECT *, count(*) OVER (PARTITION BY track_id, part) AS k FROM f)
SELECT track_id, part::BIGINT AS part, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM n WHERE k >= 2 GROUP BY 1, 2""")
def q31_split_gaps(spark, d):
    return tracks.split_at_gaps(points(spark, d), GAP).groupBy("track_id", "part").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))


HALF = 43_200_000


SPEEDS = f"""{P}, w AS (SELECT track_id, seq, t, (SELECT arg_min(struct_pack(x := q.x, y := q.y, t := q.t), q.t * 1000000 + q.seq) FROM pts q WHERE q.track_id = p.track_id AND q.t BETWEEN p.t - {HALF} AND p.t + {HALF}) AS a,
 (SELECT arg_max(struct_pack(x := q.x, y := q.y, t := q.t), q.t * 1000000 + q.seq) FROM pts q WHERE q.track_id = p.track_id AND q.t BETWEEN p.t - {HALF} AND p.t + {HALF}) AS b FROM pts p),
v AS (SELECT track_id, seq, CASE WHEN b.t > a.t THEN sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) / ((b.t - a.t) / 1000e0) ELSE 0e0 END AS s FROM w)"""


@query(f"""WITH {SPEEDS}
SELECT track_id, seq, round(s, 9) AS speed, CASE WHEN s < 0.15e0 THEN 'stationary' WHEN s > 3e0 THEN 'vehicle' ELSE 'foot' END AS kind FROM v""")
def q32_classify(spark, d):
    return tracks.classify(points(spark, d), HALF).select("track_id", "seq", F.round("speed", 9).alias("speed"), "kind")


def _runs_sql(rows: str, name: str) -> str:
    return f"""{name}f AS (SELECT *, CASE WHEN kind = lag(kind) OVER w THEN 0 ELSE 1 END AS nw FROM {rows} WINDOW w AS (PARTITION BY track_id ORDER BY fs)), {name}g AS (SELECT *, sum(nw) OVER (PARTITION BY track_id ORDER BY fs) AS rn FROM {name}f),
{name}h AS (SELECT track_id, any_value(kind) AS kind, min(fs) AS fs, max(te) AS te, arg_min(t0, fs) AS t0, arg_max(t1, te) AS t1, sum(n) AS n FROM {name}g GROUP BY track_id, rn), {name} AS (SELECT *, (coalesce(lead(t0) OVER w, t1) - t0) / 1000e0 AS s, lag(kind) OVER w AS bf, lead(kind) OVER w AS af FROM {name}h WINDOW w AS (PARTITION BY track_id ORDER BY fs))"""


RUN_S = 100_000.0


@query(f"""WITH {SPEEDS}, k0 AS (SELECT v.track_id, CASE WHEN s < 0.15e0 THEN 'stationary' WHEN s > 3e0 THEN 'vehicle' ELSE 'foot' END AS kind, v.seq AS fs, v.seq AS te, t AS t0, t AS t1, 1 AS n FROM v JOIN pts ON pts.track_id = v.track_id AND pts.seq = v.seq),
{_runs_sql("k0", "ra")}, k1 AS (SELECT track_id, CASE WHEN s < {RUN_S}e0 THEN 'foot' ELSE kind END AS kind, fs, te, t0, t1, n FROM ra), {_runs_sql("k1", "rb")},
k2 AS (SELECT track_id, CASE WHEN kind = 'foot' AND s < {RUN_S}e0 AND bf IS NOT NULL AND af IS NOT NULL THEN bf ELSE kind END AS kind, fs, te, t0, t1, n FROM rb), {_runs_sql("k2", "rc")}
SELECT track_id, (row_number() OVER (PARTITION BY track_id ORDER BY fs) - 1)::INTEGER AS segment, kind, fs AS from_seq, te AS to_seq, n::INTEGER AS n, s AS seconds FROM rc WHERE n >= 2""")
def q33_segment(spark, d):
    """Days instead of seconds, as events are: half a day around each point, runs of a day."""
    return tracks.segment_tracks(points(spark, d), RUN_S, HALF)


@query(f"WITH {P}, v AS (SELECT track_id, list_sort(list(dd / dt) FILTER (WHERE dt > 0)) AS v FROM sd GROUP BY 1) SELECT track_id, round(coalesce(v[len(v) // 2 + 1], 0e0), 9) AS median_speed, coalesce(v[len(v) // 2 + 1], 0e0) > 10 AS aircraft FROM v")
def q34_median_speed(spark, d):
    return rounded(tracks.median_speed(points(spark, d)))


SHAPES = {
    "square": [(0.0, 0.0), (400.0, 0.0), (400.0, 400.0), (0.0, 400.0)],
    "bow": [(0.0, 0.0), (300.0, 300.0), (300.0, 0.0), (0.0, 200.0)],
    "line": [(0.0, 0.0), (10.0, 0.0)],
    "flat": [(0.0, 0.0), (10.0, 0.0), (20.0, 0.0)],
    "el": [(0.0, 0.0), (600.0, 0.0), (600.0, 200.0), (200.0, 200.0), (200.0, 500.0), (0.0, 500.0)],
    "wrap": [(0.0, 0.0), (400.0, 0.0), (400.0, 400.0), (0.0, 400.0), (0.0, 0.0), (200.0, 0.0), (200.0, 200.0), (0.0, 200.0)],
}
VERTICES = "vx(geom_id, i, x, y) AS (VALUES " + ", ".join(f"('{k}', {i}, {x}e0, {y}e0)" for k, v in SHAPES.items() for i, (x, y) in enumerate(v)) + "), ed AS (SELECT geom_id, i, x AS x0, y AS y0, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1, count(*) OVER (PARTITION BY geom_id) AS n FROM vx WINDOW w AS (PARTITION BY geom_id ORDER BY i))"


def shapes(spark):
    return literal(spark, "geom_id string, points array<struct<x:double,y:double>>", [(k, v) for k, v in SHAPES.items()])


@query(f"WITH {VERTICES} SELECT geom_id, round(abs(sum(x0*y1 - x1*y0)) / 2e0, 6) AS area_m2 FROM ed GROUP BY 1")
def q39_polygon_area(spark, d):
    return shapes(spark).select("geom_id", F.round(geo.polygon_area(F.col("points")), 6).alias("area_m2"))


@query(f"""WITH {VERTICES}, ar AS (SELECT geom_id, max(n) AS n, abs(sum(x0*y1 - x1*y0)) AS a2 FROM ed GROUP BY 1), cr AS (SELECT s.geom_id, s.i AS i, t.i AS j FROM ed s JOIN ed t ON s.geom_id = t.geom_id AND s.i + 1 < t.i AND NOT (s.i = 0 AND t.i = s.n - 1)
 WHERE sign((s.x1-s.x0)*(t.y0-s.y0)-(s.y1-s.y0)*(t.x0-s.x0)) * sign((s.x1-s.x0)*(t.y1-s.y0)-(s.y1-s.y0)*(t.x1-s.x0)) < 0 AND sign((t.x1-t.x0)*(s.y0-t.y0)-(t.y1-t.y0)*(s.x0-t.x0)) * sign((t.x1-t.x0)*(s.y1-t.y0)-(t.y1-t.y0)*(s.x1-t.x0)) < 0),
f AS (SELECT geom_id, i, j, row_number() OVER (PARTITION BY geom_id ORDER BY i, j) AS k FROM cr)
SELECT geom_id, CASE WHEN n < 3 THEN 'fewer than 3 vertices' ELSE 'zero area' END AS problem FROM ar WHERE n < 3 OR a2 = 0
UNION ALL SELECT geom_id, 'edges ' || i || ' and ' || j || ' intersect' FROM f JOIN ar USING (geom_id) WHERE k = 1 AND n >= 3 AND a2 > 0""")
def q40_validate_polygon(spark, d):
    return geo.validate_polygons(shapes(spark))


@query(f"""WITH {VERTICES}, bx AS (SELECT geom_id, min(x0) AS a, max(x0) AS b, min(y0) AS c, max(y0) AS e FROM ed GROUP BY 1),
la AS (SELECT geom_id, a + (i + 0.5e0) * 20e0 AS px, c, e FROM (SELECT *, unnest(range(greatest(ceil((b-a)/20e0), 1)::BIGINT)) AS i FROM bx)), lt AS (SELECT geom_id, px, c + (j + 0.5e0) * 20e0 AS py FROM (SELECT *, unnest(range(greatest(ceil((e-c)/20e0), 1)::BIGINT)) AS j FROM la)),
wn AS (SELECT l.geom_id, px, py, sum(CASE WHEN y0 <= py AND y1 > py AND (x1-x0)*(py-y0)-(y1-y0)*(px-x0) > 0 THEN 1 WHEN y0 > py AND y1 <= py AND (x1-x0)*(py-y0)-(y1-y0)*(px-x0) < 0 THEN -1 ELSE 0 END) AS w FROM lt l JOIN ed ON l.geom_id = ed.geom_id GROUP BY 1, 2, 3)
SELECT geom_id, round(sum(CASE WHEN w <> 0 AND w % 2 = 0 THEN 400e0 ELSE 0e0 END), 6) AS lost_m2 FROM wn GROUP BY 1""")
def q41_self_overlap(spark, d):
    return rounded(geo.self_overlap_area(shapes(spark)), 6)


SWEEP = "sw(seq, resource, vegetation, slope, responsive) AS (VALUES (0, 'GROUND', 'open', 'any', 40e0), (1, 'GROUND', 'open', 'steep', 30e0))"
SEGMENT = "sg AS (SELECT p_partkey AS seg, 'GROUND' AS resource, CASE WHEN p_size % 5 = 0 THEN 'forest' ELSE 'open' END AS vegetation, CASE WHEN p_size % 3 = 0 THEN 'steep' ELSE 'flat' END AS slope, 5e0 + p_size AS spacing FROM part)"
FOUND = f"{SWEEP}, {SEGMENT}, lk AS (SELECT sg.*, (SELECT responsive FROM sw WHERE sw.resource = sg.resource AND sw.vegetation = sg.vegetation AND (sw.slope = sg.slope OR sw.slope = 'any') ORDER BY (sw.slope <> sg.slope), sw.seq LIMIT 1) AS responsive FROM sg)"


STEEP_ROWS = [("GROUND", "open", "any", 40.0), ("GROUND", "open", "steep", 30.0)]


def segments(spark, d):
    p = table(spark, d, "part")
    s = p.select(F.col("p_partkey").alias("seg"), F.lit("GROUND").alias("resource"), F.when(F.col("p_size") % 5 == 0, "forest").otherwise("open").alias("vegetation"), F.when(F.col("p_size") % 3 == 0, "steep").otherwise("flat").alias("slope"), (F.col("p_size") + 5.0).alias("spacing"))
    return pod.lookup_sweep_width(s, pod.sweep_table(spark, STEEP_ROWS), "seg")


@query(f"""WITH {FOUND}, o(object, share) AS (VALUES ('responsive', 1e0), ('unresponsive', 0.5e0), ('clue', 0.25e0)), c AS (SELECT seg, object, responsive * share / spacing AS coverage FROM lk CROSS JOIN o)
SELECT seg, object, round(coverage, 9) AS coverage, round(1e0 - exp(-coverage), 9) AS pod, CASE WHEN 1e0 - exp(-coverage) >= 0.75e0 THEN 'HIGH' WHEN 1e0 - exp(-coverage) >= 0.5e0 THEN 'MEDIUM' WHEN coverage IS NOT NULL THEN 'LOW' END AS class FROM c""")
def q43_segment_pod(spark, d):
    return rounded(pod.planned_segment_pod(segments(spark, d), "seg"))


@query(f"WITH {FOUND} SELECT seg, responsive, responsive / 2 AS unresponsive, responsive / 4 AS clue FROM lk")
def q44_sweep_lookup(spark, d):
    return segments(spark, d).select("seg", "responsive", "unresponsive", "clue")


R = "rec AS (SELECT o_orderkey AS surface_id, o_custkey % 5 AS incident_id, CASE WHEN o_orderkey > 0 THEN (o_orderkey - 1) // 3 END AS parent_id, o_totalprice FROM orders)"


def records(spark, d):
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(key.alias("surface_id"), (F.col("o_custkey") % 5).alias("incident_id"), F.when(key > 0, F.floor((key - 1) / 3)).alias("parent_id"))


@query(f"WITH {R} SELECT r.surface_id, r.parent_id, EXISTS (SELECT 1 FROM rec s WHERE s.parent_id = r.parent_id AND s.surface_id <> r.surface_id) AS has_sibling FROM rec r")
def q63_history(spark, d):
    return versions.history(records(spark, d)).select("surface_id", "parent_id", "has_sibling")


@query(f"WITH {R} SELECT surface_id FROM rec r WHERE NOT EXISTS (SELECT 1 FROM rec s WHERE s.parent_id = r.surface_id)")
def q64_heads(spark, d):
    return versions.heads(records(spark, d)).select("surface_id")


@query(f"""WITH {R}, it AS (SELECT *, CASE WHEN parent_id IS NULL THEN 0 ELSE surface_id % 2 + 1 END AS iteration FROM rec), j AS (SELECT r.*, p.incident_id AS pi, p.iteration AS pt FROM it r LEFT JOIN it p ON r.parent_id = p.surface_id)
SELECT surface_id, 'parent of another incident' AS problem FROM j WHERE pi <> incident_id UNION ALL SELECT surface_id, 'iteration does not follow parent' FROM j WHERE iteration <> pt + 1""")
def q65_lineage(spark, d):
    r = records(spark, d)
    return versions.lineage_problems(r.withColumn("iteration", F.when(F.col("parent_id").isNull(), 0).otherwise(F.col("surface_id") % 2 + 1)))


@query(f"WITH {R} SELECT surface_id, coalesce(surface_id <> min(surface_id) OVER (PARTITION BY parent_id), false) AND parent_id IS NOT NULL AS divergent FROM rec")
def q66_divergent(spark, d):
    return versions.divergent(records(spark, d)).select("surface_id", "divergent")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS k FROM orders)
SELECT c_custkey AS incident_id, n_name AS area, o_orderkey AS evaluation_id, o_orderstatus AS status FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN l ON o_custkey = c_custkey AND k = 1""")
def q67_list_incidents(spark, d):
    last = security.latest_by(table(spark, d, "orders"), ["o_custkey"], [F.desc_nulls_last("o_orderdate"), F.col("o_orderkey")])
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("incident_id"), F.col("n_name").alias("area"), F.col("o_orderkey").alias("evaluation_id"), F.col("o_orderstatus").alias("status"))


@query("""SELECT event_id, user_id AS incident_id FROM events JOIN customer ON user_id = c_custkey WHERE c_nationkey = 7 AND ts <= TIMESTAMP '2024-01-15' + c_custkey * INTERVAL 1 HOUR""")
def q68_secured_clues(spark, d):
    c = table(spark, d, "customer")
    incidents = c.select(F.col("c_custkey").alias("incident_id"), F.timestamp_millis(F.unix_millis(F.lit("2024-01-15").cast("timestamp")) + F.col("c_custkey") * 3_600_000).alias("cutoff"))
    members = c.select(F.col("c_custkey").alias("incident_id"), F.col("c_nationkey").alias("user_id"))
    clues = table(spark, d, "events").select("event_id", F.col("user_id").alias("incident_id"), F.col("ts").cast("timestamp").alias("available_at"), F.col("props").alias("restricted_payload_ciphertext"))
    out = security.secured_inputs(clues, incidents, members, 7, "trainee")
    return out.select("event_id", "incident_id")


@query("""WITH runs AS (SELECT DISTINCT l_orderkey AS run_id, l_partkey AS surface_id FROM lineitem) SELECT run_id, surface_id FROM runs WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = surface_id AND o_custkey % 2 = run_id % 2)""")
def q69_baselines_anti(spark, d):
    li = table(spark, d, "lineitem")
    runs = li.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.collect_set("l_partkey").alias("baselines")).withColumn("incident_id", F.col("run_id") % 2)
    surfaces = table(spark, d, "orders").select(F.col("o_orderkey").alias("surface_id"), (F.col("o_custkey") % 2).alias("incident_id"))
    return security.missing_baselines(runs, surfaces)


@query("""WITH r AS (SELECT event_id, user_id, event_type AS k, (value > 20) AS body, row_number() OVER w AS n, first_value(value > 20) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id, CASE WHEN n = 1 THEN 'new' WHEN f = body THEN 'replayed' ELSE 'conflict' END AS outcome FROM r""")
def q70_idempotency(spark, d):
    e = table(spark, d, "events").withColumn("body", F.col("value") > 20)
    return security.first_responses(e, ["user_id", "event_type"], ["ts", "event_id"], "body").select("event_id", "outcome")


@query("""SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"region":' || n_regionkey || '}') AS hash FROM nation""")
def q71_value_hash(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", F.sha2(F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("region"))), 256).alias("hash"))


@query("SELECT event_id, 'events' AS entity, CAST(event_id AS VARCHAR) AS entity_id, 'insert' AS action FROM events WHERE event_type = 'signup'")
def q73_audit(spark, d):
    e = table(spark, d, "events").where("event_type = 'signup'")
    a = security.audit_rows(e, "events", "event_id", "insert", "u1")
    return a.select(F.col("entity_id").cast("long").alias("event_id"), "entity", "entity_id", "action")


@query("SELECT c_custkey, c_name AS opened FROM customer")
def q74_sealed_location(spark, d):
    key, aad = F.lit("0123456789abcdef0123456789abcdef").cast("binary"), F.col("c_custkey").cast("string").cast("binary")
    c = table(spark, d, "customer").select("c_custkey", F.base64(F.aes_encrypt(F.col("c_name").cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.lpad(F.hex("c_custkey"), 24, "0")), aad)).alias("sealed"))
    return c.select("c_custkey", security.open_location(F.col("sealed"), aad, key).alias("opened"))


@query("""WITH o AS (SELECT o_orderkey AS surface_id, CASE WHEN o_orderkey > 0 THEN (o_orderkey - 1) // 3 END AS parent_id, o_custkey % 5 AS incident_id, o_custkey % 7 AS domain_id, o_custkey % 7 % 5 AS domain_incident_id FROM orders), j AS (SELECT o.*, p.domain_id AS pd FROM o LEFT JOIN o p ON o.parent_id = p.surface_id)
SELECT surface_id, 'domain of another incident' AS problem FROM j WHERE domain_incident_id <> incident_id UNION ALL SELECT surface_id, 'domain differs from parent''s' FROM j WHERE domain_id <> pd""")
def q77_surface_domain(spark, d):
    c = F.col("o_custkey")
    r = records(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("surface_id"), (c % 7).alias("domain_id"), (c % 7 % 5).alias("domain_incident_id")), "surface_id")
    return versions.domain_problems(r)


@query("""SELECT o_orderkey AS run_id, 'from ' || a || ' to ' || b AS problem FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'locked' ELSE 'revealed' END AS a, CASE o_orderkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'locked' ELSE 'revealed' END AS b FROM orders)
WHERE NOT (a = b OR (a = 'open' AND b = 'locked') OR (a = 'locked' AND b = 'revealed'))""")
def q78_evaluation_transition(spark, d):
    k = F.col("o_orderkey")
    old = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "locked").otherwise("revealed")
    new = F.when(k % 3 == 0, "open").when(k % 3 == 1, "locked").otherwise("revealed")
    none = F.lit(None).cast("string")
    return evaluation.transition_problems(table(spark, d, "orders").select(k.alias("run_id"), old.alias("old_status"), new.alias("new_status"), none.alias("old_metrics"), none.alias("new_metrics")))


@query("""SELECT 'clue' AS kind, user_id AS incident_id, event_id AS item_id FROM events JOIN customer ON user_id = c_custkey WHERE ts <= TIMESTAMP '2024-01-10' + c_nationkey * INTERVAL 1 DAY
UNION ALL SELECT 'route', o_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate <= TIMESTAMP '2024-01-10' + c_nationkey * INTERVAL 1 DAY""")
def q79_evaluation_package(spark, d):
    e, o = table(spark, d, "events"), table(spark, d, "orders")
    tables = {
        "clue": e.select(F.col("user_id").alias("incident_id"), F.col("event_id").alias("item_id"), F.col("ts").cast("timestamp").alias("available_at")),
        "route": o.select(F.col("o_custkey").alias("incident_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").cast("timestamp").alias("available_at")),
    }
    cutoff = F.timestamp_millis(F.unix_millis(F.lit("2024-01-10").cast("timestamp")) + F.col("c_nationkey") * 86_400_000)
    incidents = table(spark, d, "customer").withColumnRenamed("c_custkey", "incident_id")
    return evaluation.evaluation_package(tables, incidents, cutoff).drop("available_at")


@query("""SELECT p_partkey AS seg, coalesce(CASE WHEN p_size % 4 = 0 THEN p_size * 1e0 WHEN p_size % 4 = 1 THEN -1e0 END, 25e0) AS spacing, coalesce(CASE WHEN p_size % 4 = 0 THEN 'DOG' END, 'GROUND') AS resource FROM part WHERE coalesce(CASE WHEN p_size % 4 = 0 THEN p_size * 1e0 WHEN p_size % 4 = 1 THEN -1e0 END, 25e0) > 0""")
def q43b_segment_plans(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_size")
    over = p.where((k % 4).isin(0, 1)).select(F.col("p_partkey").alias("seg"), F.when(k % 4 == 0, k.cast("double")).otherwise(-1.0).alias("spacing"), F.when(k % 4 == 0, "DOG").alias("resource"))
    return pod.segment_plans(p.select(F.col("p_partkey").alias("seg")), literal(spark, "spacing double, resource string", [(25.0, "GROUND")]), over, "seg")
