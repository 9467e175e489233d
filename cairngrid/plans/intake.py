"""Catalogue: readers and rules over files and rows that are made from the tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from cairngrid.functions import geometry as geo
from cairngrid.functions import terrain
from cairngrid.functions import text as txt
from cairngrid.operators import requests, security, trails, versions
from cairngrid.plans import maps, surfaces
from cairngrid.plans.base import CELLS, cells, query, rounded, table
from cairngrid.sources import importers as imp
from cairngrid.streaming import feeds


@query("""WITH b AS (SELECT p_partkey AS line_no, p_partkey % 20 AS file, p_size, p_partkey % 20 < 5 AND p_partkey % 7 = 0 AS bad FROM part)
SELECT file, line_no, 'ring distances must increase' AS problem, NULL::DOUBLE AS ring25 FROM b WHERE bad
UNION ALL SELECT file, line_no, NULL, p_size * 1e0 FROM b WHERE file NOT IN (SELECT file FROM b WHERE bad)""")
def q46b_behaviour_of_parts(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    bad = (k % 20 < 5) & (k % 7 == 0)
    line = F.format_string("c%d,flat,5,%d,%d,%d,%d", k, s, s + F.when(bad, 0).otherwise(1), s + 2, s + 3)
    good, problems = imp.parse_behaviour_csv(table(spark, d, "part").select((k % 20).alias("file"), k.alias("line_no"), line.alias("line")))
    return problems.withColumn("ring25", F.lit(None).cast("double")).unionByName(good.select("file", "line_no", F.lit(None).cast("string").alias("problem"), "ring25"))


@query("WITH s AS (SELECT s_nationkey AS file, s_suppkey % 80 + 0.5e0 AS lat, -(s_suppkey % 170) * 1e0 AS lng, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT file, 0::BIGINT AS line, i::INTEGER AS i, lat, lng FROM s WHERE n >= 2")
def q85_trail_files(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("file"), k, F.format_string('<rtept lat="%d.5" lon="-%d"/>', k % 80, k % 170).alias("pt"))
    points = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "pt"))), lambda r: r["pt"])
    files = s.groupBy("file").agg(F.concat(F.lit("<gpx><rte>"), F.array_join(points, ""), F.lit("</rte></gpx>")).alias("text"))
    lines, _ = imp.import_trails(files)
    return lines.select("file", "line", F.posexplode("points").alias("i", "p")).select("file", "line", "i", "p.lat", "p.lng")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'First ' || c_custkey || chr(10) || 'café' END AS text, CASE WHEN c_custkey % 5 = 0 THEN 'no reader for this kind of file' END AS problem FROM customer")
def q86_rich_text(spark, d):
    k = F.col("c_custkey")
    rtf = F.format_string(r"{\rtf1{\*\generator x}First %d\par caf\'e9}", k)
    files = table(spark, d, "customer").select(F.concat(k.cast("string"), F.when(k % 5 == 0, ".pdf").otherwise(".rtf")).alias("name"), F.encode(rtf, "utf-8").alias("content"))
    return imp.read_documents(files).select(F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("id"), "text", "problem")


@query("""SELECT o_orderkey AS surface_id, CASE WHEN o_orderkey % 11 = 0 THEN 'deleted' WHEN o_orderkey % 13 = 0 THEN 'changed' ELSE 'lock changed' END AS problem FROM orders
WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR (o_orderkey % 17 = 0 AND o_orderkey % 2 = 0)""")
def q87_append_only(spark, d):
    k = F.col("o_orderkey")
    old = table(spark, d, "orders").select(k.alias("surface_id"), F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").alias("z"), F.when(k % 2 == 0, "t1").alias("locked_at"))
    i = F.col("surface_id")
    new = old.where(i % 11 != 0).withColumns({"kind": F.when(i % 13 == 0, "other").otherwise(F.col("kind")), "locked_at": F.when(i % 17 == 0, "t2").otherwise(F.col("locked_at"))})
    return versions.changed_after_commit(old, new)


@query("SELECT c_custkey AS user_id, ['trainee', 'analyst', 'evaluator', 'guest'][c_nationkey % 4 + 1] AS role FROM customer WHERE c_acctbal > 0 AND c_nationkey % 4 <> 3")
def q88_active_roles(spark, d):
    names = F.array(*map(F.lit, ("trainee", "analyst", "evaluator", "guest")))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.element_at(names, F.col("c_nationkey") % 4 + 1).alias("role"), (F.col("c_acctbal") > 0).alias("active"))
    roles = users.select("role").distinct().withColumn("enabled", F.col("role") != "guest")
    return security.active_roles(users, roles)


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size + 0.125e0 END AS lat, CASE WHEN p_partkey % 2 = 0 THEN -(p_size * 3 + 0.5e0) END AS lng, ['IPP', 'LKP', 'PLS'][p_partkey % 3 + 1] AS point_kind,
CASE WHEN p_partkey % 2 = 0 THEN [0e0, 45e0, 247.5e0][p_size % 3 + 1] ELSE p_size * 1e0 END AS bearing, CASE WHEN p_size % 2 = 0 THEN 'hiker' ELSE 'child' END AS category, CASE WHEN p_size % 5 < 3 THEN 'mountainous' ELSE 'flat' END AS terrain FROM part""")
def q60e_reader_of_parts(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    where = F.when(k % 2 == 0, F.concat(F.format_string("at %d.125, -%d.500 heading ", s, s * 3), pick(["north", "north-east", "WSW"], s % 3))).otherwise(F.format_string("bearing %d degrees", s))
    note = F.concat(F.when(s % 2 == 0, "A hiker ").otherwise("A small child "), where, F.when(s % 5 < 3, " from the ridge. ").otherwise(" over flat farmland. "), pick(["IPP", "LKP", "PLS"], k % 3))
    return table(spark, d, "part").select(k.alias("id"), note.alias("t")).select("id", *[c.alias(n) for n, c in txt.read_local(F.col("t")).items()])


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOUR, true) THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM s GROUP BY user_id, k HAVING count(*) >= 2""")
def q90_gap_sessions(spark, d):
    """The streaming sessions over a finished table; a stream gives the same rows once its watermark has passed."""
    e = table(spark, d, "events").select(F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("at"))
    return feeds.gap_sessions(e, gap_s=43_200).select(F.col("track_id").alias("user_id"), F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("SELECT s_nationkey AS incident_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place, s_acctbal::DOUBLE AS v, 0.25e0 AS outside FROM supplier")
def q91_surface_codec(spark, d):
    """Values of each nation's suppliers in order packed, unpacked and sent as base64: every value comes out of the codec as it went in."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("k")["v"].to_numpy()
        back, outside = versions.decode_surface(versions.encode_surface(values, 0.25), len(values))
        again, rest = versions.values_from_base64(versions.values_to_base64(back, outside))
        return pd.DataFrame({"incident_id": pdf["incident_id"].iloc[0], "place": range(len(again)), "v": again, "outside": rest})

    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("incident_id"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").cast("double").alias("v")).groupBy("incident_id").applyInPandas(run, "incident_id int, place long, v double, outside double")


def _hash_sql(i: str, j: str) -> str:
    h = f"xor((({i}) * 374761393::HUGEINT + ({j}) * 668265263::HUGEINT) % 4294967296, 1540483477::HUGEINT)"
    m = f"((xor({h}, ({h}) // 8192)) * 1274126177::HUGEINT) % 4294967296"
    return f"(xor({m}, ({m}) // 65536)::DOUBLE / 4294967295e0)"


@query(f"""WITH {CELLS}, n AS (SELECT cell_id, cx, cy, cx / 900e0 AS x, cy / 900e0 AS y, floor(cx / 900e0)::BIGINT AS i, floor(cy / 900e0)::BIGINT AS j FROM cells),
c AS (SELECT *, {_hash_sql("i", "j")} AS a, {_hash_sql("i + 1", "j")} AS b, {_hash_sql("i", "j + 1")} AS c, {_hash_sql("i + 1", "j + 1")} AS d, (x - i) * (x - i) * (3 - 2 * (x - i)) AS u, (y - j) * (y - j) * (3 - 2 * (y - j)) AS v FROM n)
SELECT cell_id, round(a + (b - a) * u + (c - a) * v + (a - b - c + d) * u * v, 9) AS noise, ((cx - 4550) / 420) * ((cx - 4550) / 420) + ((cy - 3650) / 300) * ((cy - 3650) / 300) > 1 AS land FROM c""")
def q92_exercise_terrain(spark, d):
    x, y = F.col("cx"), F.col("cy")
    return cells(spark, d).select("cell_id", F.round(terrain.value_noise(x / 900, y / 900), 9).alias("noise"), terrain.land_mask(x, y).alias("land"))


def _noise_sql(x: str, y: str) -> str:
    i, j = f"floor({x})::BIGINT", f"floor({y})::BIGINT"
    ease = lambda t: f"(({t}) * ({t}) * (3 - 2 * ({t})))"
    u, v = ease(f"({x}) - {i}"), ease(f"({y}) - {j}")
    a, b, c, d = _hash_sql(i, j), _hash_sql(f"{i} + 1", j), _hash_sql(i, f"{j} + 1"), _hash_sql(f"{i} + 1", f"{j} + 1")
    return f"({a} + ({b} - {a}) * {u} + ({c} - {a}) * {v} + ({a} - {b} - {c} + {d}) * {u} * {v})"


def _far_sql(line) -> str:
    return surfaces._line_sql([(float(x), float(y)) for x, y in line])


@query(f"""WITH {CELLS}, d AS (SELECT cell_id, cx, cy, {_far_sql(terrain.CREEK)} AS creek, {_far_sql(terrain.CLIFF)} AS cliff, {_far_sql(terrain.TRAIL)} AS trail FROM cells)
SELECT cell_id, round(1450 + cy * 0.12e0 + abs(cx - 3000) * 0.05e0 + 160 * {_noise_sql("cx / 900e0", "cy / 900e0")} + 60 * {_noise_sql("cx / 300e0 + 7", "cy / 300e0 + 3")} - 70 * exp(-creek / 220e0) + CASE WHEN cliff < 60 THEN 40 ELSE 0 END, 6) AS elevation,
cliff < 45 AS cliff, CASE WHEN trail < 200 THEN 0 WHEN creek < 250 THEN 1 WHEN cy > 3000 THEN 2 WHEN cx > 3000 THEN 3 ELSE 4 END AS zone FROM d""")
def q92b_elevation_zones(spark, d):
    x, y = F.col("cx"), F.col("cy")
    return cells(spark, d).select("cell_id", F.round(terrain.elevation(x, y), 6).alias("elevation"), terrain.on_cliff(x, y).alias("cliff"), terrain.zone(x, y).alias("zone"))


@query(f"""WITH {maps.TL}, lf AS (SELECT line_id, seq - 1 AS leg, x0, y0, x, y, len, coalesce(sum(len) OVER (PARTITION BY line_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before, greatest(1, ceil(len / 20e0))::BIGINT AS n, row_number() OVER (PARTITION BY line_id ORDER BY seq) AS i FROM le),
pk AS (SELECT *, unnest(range(CASE WHEN i = 1 THEN 0 ELSE 1 END, n + 1)) AS k FROM lf), pw AS (SELECT *, before + k / n::DOUBLE * len AS way FROM pk), kp AS (SELECT * FROM pw WHERE NOT (way > 2600 AND way < 3400) AND NOT (way > 5000 AND way < 5100))
SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY leg, k) AS seq, round(x0 + k / n::DOUBLE * (x - x0), 6) AS x, round(y0 + k / n::DOUBLE * (y - y0), 6) AS y, floor(1784399400000 + way * 1000 / 1.2e0 + 0.5e0)::BIGINT AS t FROM kp""")
def q92c_walks(spark, d):
    """Walks along the suppliers' lines with the receiver off in two places."""
    return rounded(trails.walk_lines(maps.trail_lines(spark, d), 1_784_399_400_000, 1.2, [(2600.0, 3400.0), (5000.0, 5100.0)]), 6)


@query("SELECT s_suppkey AS id, 100e0 * (1 + s_suppkey % 3) + s_suppkey AS x, 250e0 * (1 + s_suppkey % 3) AS y, 180000e0 * (1 + s_suppkey % 3) * (1 + s_suppkey % 3) AS area_m2 FROM supplier")
def q93_label_points(spark, d):
    k = F.col("s_suppkey")
    shape = [(0, 0), (600, 0), (600, 200), (200, 200), (200, 500), (0, 500), (0, 0)]
    size = (1 + k % 3).cast("double")
    ring = F.array(*[F.struct((F.lit(float(x)) * size + k).alias("x"), (F.lit(float(y)) * size).alias("y")) for x, y in shape])
    out = table(spark, d, "supplier").select(k.alias("id"), geo.label_point(ring).alias("p"), geo.ring_area(ring).alias("area_m2"))
    return rounded(out.select("id", "p.x", "p.y", "area_m2"), 6)


@query("""SELECT p_partkey AS id, CASE WHEN v >= 5 * p THEN 5 * p WHEN v >= 2 * p THEN 2 * p ELSE p END AS nice, CASE p_size % 6 WHEN 0 THEN 'ring' WHEN 1 THEN NULL WHEN 2 THEN 'wedge' WHEN 3 THEN 'trail' WHEN 4 THEN 'area' ELSE 'sector' END AS kind
FROM (SELECT *, p_retailprice * p_size + 1e0 AS v, pow(10e0, floor(log10(p_retailprice * p_size + 1e0))) AS p FROM part)""")
def q94_preview_helpers(spark, d):
    s = F.col("p_size") % 6
    geometry = F.when(s == 0, "LineString").when(s == 1, "Point").otherwise("Polygon")
    title = F.when(s == 3, "T-1").when(s == 4, "A-2").when(s == 5, "S25 N")
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), geo.nice_distance(F.col("p_retailprice") * F.col("p_size") + 1.0).alias("nice"), geo.feature_kind(geometry, title, F.when(s > 2, "Assignment")).alias("kind"))


@query("""WITH o AS (SELECT o_orderkey AS k, ['prior', 'clue_update', 'manual_adjustment', 'other'][o_orderkey % 4 + 1] AS kind, o_orderkey % 3 = 0 AS parent, o_orderkey % 5 <> 0 AS why, o_orderkey % 7 <> 0 AS evidence FROM orders)
SELECT k AS id, 'parentSurfaceId' AS path FROM o WHERE kind <> 'other' AND (kind = 'prior') = parent UNION ALL SELECT k, 'surfaceType' FROM o WHERE kind = 'other' UNION ALL SELECT k, 'normalizationConstant' FROM o WHERE k % 11 = 0
UNION ALL SELECT k, 'rationale' FROM o WHERE kind IN ('clue_update', 'manual_adjustment') AND NOT why UNION ALL SELECT k, 'evidence' FROM o WHERE kind = 'clue_update' AND NOT evidence UNION ALL SELECT k, 'adjustment' FROM o WHERE kind = 'manual_adjustment' AND NOT why""")
def q95_commit_requests(spark, d):
    k = F.col("o_orderkey")
    guid = F.format_string("00000000-0000-0000-0000-%012d", k)
    kind = F.element_at(F.array(*map(F.lit, ("prior", "clue_update", "manual_adjustment", "other"))), (k % 4 + 1).cast("int"))
    body = F.to_json(
        F.struct(
            guid.alias("searchDomainId"), F.when(k % 3 == 0, guid).alias("parentSurfaceId"), kind.alias("surfaceType"), F.repeat(F.lit("A"), F.lit(24)).alias("valuesBase64"), F.when(k % 11 == 0, 0.0).otherwise(0.5).alias("normalizationConstant"),
            F.struct(F.lit("core").alias("component"), F.lit("1").alias("version")).alias("modelVersion"), F.when(k % 5 != 0, "a reason of some length").alias("rationale"),
            F.when(k % 7 != 0, F.struct(F.lit("clue").alias("evidenceType"), guid.alias("evidenceId"), F.lit("kernel").alias("method"), F.lit("0123456789").alias("previewHash"))).alias("evidence"), F.struct(F.lit("factors").alias("method")).alias("adjustment"),
        )
    )
    return requests.commit_problems(table(spark, d, "orders").select(k.alias("id"), body.alias("body")), "id", "body")
