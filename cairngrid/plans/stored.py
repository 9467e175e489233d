"""Catalogue: evaluation runs as events, sealed tokens, behaviour tables, request checks and trail segments over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairngrid.operators import preview, requests, security, workflow

from cairngrid.plans.base import query, rounded, table
from cairngrid.sources import importers as imp

ROLES = ["evaluator", "instructor", "analyst", "administrator", "trainee"]
KINDS = ["create", "lock", "reveal", "metrics"]


def run_events(spark, d):
    """Users' events as steps of one evaluation run each, by users of all roles, right and wrong ones in any order."""
    i = F.col("event_id")
    pick = lambda v, k: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.min("o_orderkey").alias("own"))
    e = table(spark, d, "events").join(first, "user_id", "left")
    own = F.when(i % 3 != 0, F.col("own")).otherwise(i)
    kind = pick(KINDS, i % 7 % 4)
    when = lambda k, c: F.when(kind == k, c)
    return e.select(
        i.alias("event_id"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("run_id"), kind.alias("kind"), (i % 25).alias("user_id"), pick(ROLES, i % 5).alias("role"), when("create", F.col("user_id")).alias("incident_id"),
        when("create", F.col("ts").cast("timestamp")).alias("information_cutoff"), when("lock", own).alias("surface_id"), when("lock", F.array("own")).alias("baselines"), when("metrics", i.cast("string")).alias("metrics"),
    )


def judged(spark, d):
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("incident_id"), F.col("c_nationkey").cast("long").alias("user_id"))
    surfaces = table(spark, d, "orders").select(F.col("o_orderkey").alias("surface_id"), F.col("o_custkey").alias("incident_id"))
    return workflow.judged_events(run_events(spark, d), members, surfaces, members.where("incident_id % 2 = 0"))


JUDGED = f"""fo AS (SELECT o_custkey AS c, min(o_orderkey) AS own FROM orders GROUP BY 1),
ev AS (SELECT event_id AS id, ts, user_id AS run, {KINDS}[event_id % 7 % 4 + 1] AS kind, event_id % 25 AS usr, {ROLES}[event_id % 5 + 1] AS role, CASE WHEN event_id % 3 <> 0 THEN own ELSE event_id END AS sf, own, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS pos FROM events LEFT JOIN fo ON fo.c = user_id),
ro AS (SELECT ev.*, role IN ('evaluator', 'administrator', 'instructor') AS may, role IN ('evaluator', 'administrator') OR coalesce(cu.c_nationkey = usr, false) AS seen, coalesce(os.o_custkey = run, false) AS fits, coalesce(own IS NULL, false) AS lost,
 role IN ('evaluator', 'administrator') OR (role = 'instructor' AND run % 2 = 0 AND cu.c_custkey IS NOT NULL) AS opens FROM ev LEFT JOIN customer cu ON cu.c_custkey = run LEFT JOIN orders os ON os.o_orderkey = sf),
j1 AS (SELECT *, min(CASE WHEN kind = 'create' AND may AND seen THEN pos END) OVER (PARTITION BY run) AS c FROM ro), j2 AS (SELECT *, seen AND coalesce(pos > c, false) AS vis FROM j1),
j3 AS (SELECT *, min(CASE WHEN kind = 'lock' AND vis AND may AND fits AND NOT lost THEN pos END) OVER (PARTITION BY run) AS l FROM j2), j4 AS (SELECT *, min(CASE WHEN kind = 'reveal' AND vis AND opens AND pos > l THEN pos END) OVER (PARTITION BY run) AS r FROM j3),
j5 AS (SELECT *, min(CASE WHEN kind = 'metrics' AND vis AND may AND pos > r THEN pos END) OVER (PARTITION BY run) AS m FROM j4),
jd AS (SELECT *, CASE kind WHEN 'create' THEN CASE WHEN NOT may OR NOT seen THEN 'not permitted' WHEN pos <> c THEN 'run exists already' END
 WHEN 'lock' THEN CASE WHEN NOT vis THEN 'evaluation run not found' WHEN NOT may THEN 'role may not lock evaluation runs' WHEN pos > l THEN 'run is already locked' WHEN NOT fits THEN 'surface does not belong to this incident' WHEN lost THEN 'every baseline must be a surface of this incident' END
 WHEN 'reveal' THEN CASE WHEN NOT vis THEN 'evaluation run not found' WHEN NOT opens THEN 'role may not reveal outcomes' WHEN NOT coalesce(pos > l, false) THEN 'outcome cannot be revealed before the run is locked' END
 ELSE CASE WHEN NOT vis OR NOT may THEN 'not permitted' WHEN NOT coalesce(pos > r, false) THEN 'metrics follow the reveal' WHEN pos <> m THEN 'metrics are recorded once' END END AS problem FROM j5)"""


@query(f"WITH {JUDGED} SELECT id AS event_id, run AS run_id, kind, problem FROM jd WHERE problem IS NOT NULL")
def q78b_refused_steps(spark, d):
    return judged(spark, d).where("problem is not null").select("event_id", "run_id", "kind", "problem")


@query(f"""WITH {JUDGED} SELECT run AS run_id, CASE WHEN max(r) IS NOT NULL THEN 'revealed' WHEN max(l) IS NOT NULL THEN 'locked' ELSE 'open' END AS status, max(CASE WHEN pos = l THEN sf END) AS surface_id, max(CASE WHEN pos = l THEN usr END) AS locked_by,
max(CASE WHEN pos = r THEN usr END) AS revealed_by, max(CASE WHEN pos = m THEN id::VARCHAR END) AS metrics FROM jd WHERE c IS NOT NULL GROUP BY run""")
def q78c_run_states(spark, d):
    return workflow.run_states(judged(spark, d)).select("run_id", "status", "surface_id", "locked_by", "revealed_by", "metrics")


@query(f"WITH {JUDGED} SELECT id AS event_id, CASE kind WHEN 'create' THEN 'insert' WHEN 'lock' THEN 'lock' WHEN 'reveal' THEN 'restricted_read' ELSE 'update' END AS action, CASE kind WHEN 'reveal' THEN 'found_locations' ELSE 'evaluation_runs' END AS entity, usr AS user_id, run AS incident_id FROM jd WHERE problem IS NULL")
def q78d_run_audit(spark, d):
    return workflow.audit_trail(judged(spark, d)).select("event_id", "action", "entity", "user_id", "incident_id")


KEYS = {"k1": b"0123456789abcdef0123456789abcdef", "k2": b"fedcba9876543210fedcba9876543210"}


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 > 2 THEN NULL ELSE c_name END AS opened, CASE c_custkey % 5 WHEN 3 THEN 'outcome ciphertext does not open' WHEN 4 THEN CASE WHEN c_custkey % 2 = 0 THEN 'outcome key k2 is not configured' ELSE 'unrecognised outcome ciphertext' END END AS problem,
5 AS parts, CASE WHEN c_custkey % 2 = 0 THEN 'v1:k2' ELSE 'v1:k1' END AS head, ceil(octet_length(encode(c_name)) * 4 / 3e0)::INTEGER AS n FROM customer""")
def q74b_sealed_tokens(spark, d):
    """Customers' names sealed under two keys; some are opened for another incident, without their key, or in another form."""
    k, name = F.col("c_custkey"), F.col("c_name")
    turned = dict(reversed(KEYS.items()))
    nonce = lambda p: F.unhex(F.lpad(F.hex(k + p), 24, "0"))
    c = table(spark, d, "customer").select(k, name, F.when(k % 2 == 0, security.seal_token(name, k, turned, nonce(0))).otherwise(security.seal_token(name, k, KEYS, nonce(1))).alias("token"))
    whole = security.open_token(F.when((k % 5 == 4) & (k % 2 == 1), F.concat(F.lit("v0"), F.substring("token", 3, 1000))).otherwise(F.col("token")), F.when(k % 5 == 3, -k).otherwise(k), KEYS)
    partly = security.open_token(F.col("token"), k, {"k1": KEYS["k1"]})
    out = F.when((k % 5 == 4) & (k % 2 == 0), partly).otherwise(whole)
    p = F.split("token", ":")
    return c.select(k, out["text"].alias("opened"), out["problem"].alias("problem"), F.size(p).alias("parts"), F.concat_ws(":", F.get(p, F.lit(0)), F.get(p, F.lit(1))).alias("head"), F.length(F.get(p, F.lit(4))).alias("n"))


@query(f"""WITH w AS (SELECT p_partkey AS id, (['pilot'] || {imp.EXERCISE_CATEGORIES})[p_size % 14 + 1] AS category, ['mountainous', 'flat', 'any'][p_size % 3 + 1] AS terrain FROM part)
SELECT *, CASE WHEN category <> 'pilot' AND terrain <> 'any' THEN false END AS fallback, CASE WHEN category <> 'pilot' AND terrain <> 'any' THEN 1e0 END AS ring25, CASE WHEN category <> 'pilot' AND terrain <> 'any' THEN 10e0 END AS ring95, CASE WHEN category <> 'pilot' AND terrain <> 'any' THEN 150e0 END AS disp95 FROM w""")
def q45b_exercise_lookup(spark, d):
    n, pick = F.col("p_size"), lambda v, k: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    want = table(spark, d, "part").select(F.col("p_partkey").alias("id"), pick(["pilot", *imp.EXERCISE_CATEGORIES], n % 14).alias("category"), pick(["mountainous", "flat", "any"], n % 3).alias("terrain"))
    return imp.lookup_behaviour(want, imp.exercise_table(spark), "id").select("id", "category", "terrain", "fallback", "ring25", "ring95", "disp95")


def saved_rows(spark, d):
    """Twenty tables of parts as behaviour rows, as they might lie in storage, some of them bad."""
    k, n = F.col("p_partkey"), F.col("p_size")
    disp = lambda v: F.when(n % 6 != 0, v.cast("double"))
    return table(spark, d, "part").select(
        (k % 20).alias("file"), F.concat(F.lit("c"), F.floor(k / 40).cast("string")).alias("category"), F.when(n % 7 == 0, " FLAT ").otherwise(F.concat(F.lit("t"), n.cast("string"))).alias("terrain"), F.when(n % 11 == 0, 0).otherwise(n).alias("n"), n.cast("double").alias("ring25"), (n + 1.0).alias("ring50"),
        F.when(n % 9 == 0, n * 1.0).otherwise(n + 2.0).alias("ring75"), (n + 30.0).alias("ring95"), disp(n + 10).alias("disp25"), disp(n * 2 + 10).alias("disp50"), disp(n * 3 + 10).alias("disp75"), F.when(n % 5 != 0, n * 8.0 + 11).alias("disp95"),
    )


SAVED = """s AS (SELECT p_partkey AS k, p_partkey % 20 AS file, 'c' || p_partkey // 40 AS category, CASE WHEN p_size % 7 = 0 THEN ' FLAT ' ELSE 't' || p_size END AS terrain, p_size AS n FROM part),
g AS (SELECT *, count(*) OVER (PARTITION BY file, category, lower(trim(terrain))) AS same, 3 * (n % 6 <> 0)::INTEGER + (n % 5 <> 0)::INTEGER AS given FROM s)"""


@query(f"""WITH {SAVED} SELECT file, category, terrain, 'case counts must be above zero' AS problem FROM g WHERE n % 11 = 0 UNION ALL SELECT file, category, terrain, 'ring distances must increase' FROM g WHERE n % 9 = 0
UNION ALL SELECT file, category, terrain, 'all four dispersions or none' FROM g WHERE given BETWEEN 1 AND 3 UNION ALL SELECT file, category, terrain, 'dispersion angles must increase up to 360' FROM g WHERE given = 4 AND n * 8 + 11 > 360
UNION ALL SELECT file, category, terrain, 'category and terrain occur twice' FROM g WHERE same > 1""")
def q46c_saved_tables(spark, d):
    return imp.saved_table_problems(saved_rows(spark, d))


@query(f"WITH {SAVED} SELECT DISTINCT 'category' AS what, category AS name FROM s UNION ALL SELECT DISTINCT 'terrain of c3', terrain FROM s WHERE category = 'c3'")
def q46d_categories_terrains(spark, d):
    rows = saved_rows(spark, d)
    return imp.categories(rows).select(F.lit("category").alias("what"), F.col("category").alias("name")).unionByName(imp.terrains(rows, "C3").select(F.lit("terrain of c3").alias("what"), F.col("terrain").alias("name")))


@query("""SELECT o_orderkey AS id, 'informationCutoff' AS path FROM orders WHERE o_orderkey % 4 IN (1, 2) UNION ALL SELECT o_orderkey, 'incidentId' FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 'surfaceId' FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT o_orderkey, 'baselineSurfaceIds' FROM orders WHERE o_orderkey % 7 < 2""")
def q95b_run_requests(spark, d):
    """Bodies that create and lock evaluation runs: dates that do not exist, times without an offset, ids of another form, too many baselines."""
    k = F.col("o_orderkey")
    guid = F.format_string("00000000-0000-0000-0000-%012d", k)
    at = F.when(k % 4 == 1, "2024-02-30T10:00:00Z").when(k % 4 == 2, "2024-02-03T10:00:00").when(k % 4 == 3, "2024-02-29T23:59:59.5-07:00").otherwise("2024-02-03T10:00Z")
    create = F.to_json(F.struct(F.when(k % 5 == 0, "x").otherwise(guid).alias("incidentId"), at.alias("informationCutoff")))
    many = F.when(k % 7 == 0, F.array_repeat(guid, 11)).when(k % 7 == 1, F.array(guid, F.lit("no"))).when(k % 7 == 2, F.array_repeat(guid, 10))
    lock = F.to_json(F.struct(F.when(k % 6 != 0, guid).alias("surfaceId"), many.alias("baselineSurfaceIds"), F.create_map(F.lit("core"), F.lit("1")).alias("modelVersions")))
    o = table(spark, d, "orders").select(k.alias("id"), create.alias("create"), lock.alias("lock"))
    return requests.create_run_problems(o, "id", "create").unionByName(requests.lock_run_problems(o, "id", "lock"))


@query("""WITH RECURSIVE n AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE s_suppkey + 1 END AS nx FROM supplier), l AS (SELECT k, k * 13e0 % 900 - 450 AS x0, k * 0e0 + 300 + k // 10 * 7 AS y0, (k + 1) * 13e0 % 900 - 450 AS x1, 300 + k // 10 * 7e0 AS y1 FROM n WHERE nx IS NOT NULL),
j AS (SELECT k // 10 AS g, min(k) AS line, count(*) AS legs, sum(abs(x1 - x0)) AS total FROM l GROUP BY 1), p AS (SELECT *, greatest(1, floor(total / 500 + 0.5e0))::BIGINT AS n FROM j)
SELECT 'all' AS file, line AS line_id, piece::INTEGER AS piece, round(total / n, 6) AS length, 1 AS n_rings FROM (SELECT *, unnest(range(1, n + 1)) AS piece FROM p)""")
def q84b_trail_segments(spark, d):
    """Suppliers as legs of level trails, nine of which meet end to end: joined, cut into pieces of half a kilometre and drawn as outlines."""
    k = F.col("s_suppkey")
    spot = lambda v: F.struct((v * 13 % 900 - 450.0).alias("x"), (300.0 + F.floor(k / 10) * 7).alias("y"))
    ends = F.when(k % 2 == 0, F.array(spot(k), spot(k + 1))).otherwise(F.array(spot(k + 1), spot(k)))
    lines = table(spark, d, "supplier").where(k % 10 != 9).select(F.lit("all").alias("file"), k.alias("line_id"), F.posexplode(ends).alias("seq", "p")).select("file", "line_id", "seq", "p.*")
    out = preview.trail_segments(lines, [(0.0, 100_000.0)], 500.0, 2.0 * 2.5, "file")
    return rounded(out.select("file", "line_id", "piece", "length", F.size("rings").alias("n_rings")), 6)


