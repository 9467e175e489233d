"""Catalogue: compositions of several operators, and importers and readers over texts made from the tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngrid.functions import spherical as sph
from cairngrid.functions import text as txt
from cairngrid.operators import pod, preview, security, updates
from cairngrid.plans import maps, surfaces, tracks_plans
from cairngrid.plans.base import CELLS, cells, grid, query, rounded, table
from cairngrid.sources import importers as imp

S = surfaces


@query(f"""WITH {CELLS}, {S.UNIFORM}, {S.LR}, {S.GAUSS}, {S.PODS},
m AS (SELECT u.cell_id, u.p AS m0, u.p * coalesce(l.lr, 1e0) AS m1, u.p * coalesce(l.lr, 1e0) * (0.58e0 + 0.42e0 * (SELECT count(*) FROM gk) * gk.f) AS m2,
 u.p * coalesce(l.lr, 1e0) * (0.58e0 + 0.42e0 * (SELECT count(*) FROM gk) * gk.f) * (1e0 - coalesce(pods.pod, 0e0)) AS m3 FROM uni u LEFT JOIN lrs l ON u.cell_id = l.cell_id JOIN gk ON u.cell_id = gk.cell_id LEFT JOIN pods ON u.cell_id = pods.cell_id),
s AS (SELECT sum(m0) + 0.2e0 AS s0, sum(m1) + 0.1e0 AS s1, sum(m2) + 0.058e0 AS s2, sum(m3) + 0.058e0 AS s3 FROM m)
SELECT cell_id, round(m3 / s3, 9) AS p, round(0.058e0 / s3, 9) AS outside, round(s1 / s0, 9) AS z1, round(s2 / s1, 9) AS z2, round(s3 / s2, 9) AS z3 FROM m CROSS JOIN s""")
def q17b_update_chain(spark, d):
    kernel = updates.kernel_likelihood(S.gauss(spark, d), 0.42)
    missed = S.tax_pod(spark, d).select("cell_id", (1 - F.col("pod")).alias("lr"))
    return rounded(updates.chain_updates(S.uniform(spark, d), [(S.likelihood(spark, d), 0.5), (kernel, 0.58), (missed, 1.0)]))


WIDTHS = "sw(resource, vegetation, responsive) AS (VALUES ('GROUND', 'open', 60e0), ('GROUND', 'light', 40e0), ('GROUND', 'moderate', 20e0), ('GROUND', 'dense', 10e0), ('DOG_TRAIL', 'open', 100e0), ('DOG_TRAIL', 'light', 80e0), ('DOG_TRAIL', 'moderate', 60e0), ('DOG_TRAIL', 'dense', 40e0), ('AIR', 'open', 200e0), ('AIR', 'light', 100e0), ('AIR', 'moderate', 40e0), ('AIR', 'dense', 10e0))"


@query(f"""WITH {WIDTHS}, sg AS (SELECT p_partkey AS seg, ['GROUND', 'DOG_TRAIL', 'AIR', 'BOAT'][p_size % 4 + 1] AS resource, ['open', 'light', 'moderate', 'dense', 'none'][p_partkey % 5 + 1] AS vegetation, 5e0 + p_size AS spacing FROM part)
SELECT seg, object, round(responsive * share / spacing, 9) AS coverage, round(1e0 - exp(-responsive * share / spacing), 9) AS pod FROM sg LEFT JOIN sw ON sg.resource = sw.resource AND sg.vegetation = sw.vegetation CROSS JOIN (VALUES ('responsive', 1e0), ('unresponsive', 0.5e0), ('clue', 0.25e0)) AS o(object, share)""")
def q44b_exercise_widths(spark, d):
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    s = table(spark, d, "part").select(F.col("p_partkey").alias("seg"), pick(["GROUND", "DOG_TRAIL", "AIR", "BOAT"], F.col("p_size")).alias("resource"), pick(["open", "light", "moderate", "dense", "none"], F.col("p_partkey")).alias("vegetation"), F.lit("any").alias("slope"), (F.col("p_size") + 5.0).alias("spacing"))
    found = pod.lookup_sweep_width(s, pod.sweep_table(spark), "seg")
    return rounded(pod.planned_segment_pod(found, "seg").select("seg", "object", "coverage", "pod"))


DETAIL = """WITH i AS (SELECT c_custkey AS incident_id, TIMESTAMP '2024-01-15' + c_custkey * INTERVAL 1 HOUR AS cutoff FROM customer WHERE {who}),
x AS (SELECT user_id AS incident_id, 'clue' AS kind, event_id AS item_id, ts AS moment, '{{"event_type":"' || event_type || '"}}' AS details FROM events
 UNION ALL SELECT o_custkey, 'assignment', o_orderkey, o_orderdate, '{{"status":"' || o_orderstatus || '"}}' FROM orders
 UNION ALL SELECT c_custkey, 'subject', c_custkey, NULL, '{{"segment":"' || c_mktsegment || '"}}' FROM customer
 UNION ALL SELECT c_custkey, 'domain', c_nationkey, NULL, '{{}}' FROM customer
 UNION ALL SELECT o_custkey, 'planning point', o_orderkey, o_orderdate + INTERVAL 30 DAY, '{{"priority":"' || o_orderpriority || '"}}' FROM orders
 UNION ALL SELECT user_id, 'route', event_id, ts - INTERVAL 2 HOUR, '{{}}' FROM events WHERE event_type = 'view')
SELECT x.incident_id, kind, item_id::VARCHAR AS item_id, epoch_us(moment) // 1000 AS at_ms, details FROM x JOIN i ON x.incident_id = i.incident_id WHERE {cut}"""


def _detail(spark, d, role, full):
    c, o, e = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "events")
    hours = lambda at, n: F.timestamp_millis(F.unix_millis(at.cast("timestamp")) + n * 3_600_000)
    incidents = c.select(F.col("c_custkey").alias("incident_id"), hours(F.lit("2024-01-15"), F.col("c_custkey")).alias("cutoff"))
    members = c.select(F.col("c_custkey").alias("incident_id"), F.col("c_nationkey").alias("user_id"))
    key, at = lambda n: F.col(n).alias("incident_id"), lambda c: c.cast("timestamp").alias("available_at")
    secret = F.lit("sealed").alias("restricted_payload_ciphertext")
    inputs = {
        "clue": (e.select(key("user_id"), F.col("event_id").alias("item_id"), at(F.col("ts")), "event_type", secret), True),
        "assignment": (o.select(key("o_custkey"), F.col("o_orderkey").alias("item_id"), at(F.col("o_orderdate")), F.col("o_orderstatus").alias("status")), True),
        "subject": (c.select(key("c_custkey"), F.col("c_custkey").alias("item_id"), F.col("c_mktsegment").alias("segment")), False),
        "domain": (c.select(key("c_custkey"), F.col("c_nationkey").alias("item_id")), False),
        "planning point": (o.select(key("o_custkey"), F.col("o_orderkey").alias("item_id"), hours(F.col("o_orderdate"), 720).alias("available_at"), F.col("o_orderpriority").alias("priority")), True),
        "route": (e.where("event_type = 'view'").select(key("user_id"), F.col("event_id").alias("item_id"), hours(F.col("ts"), -2).alias("available_at")), True),
    }
    out = security.incident_detail(incidents, inputs, members, 7, role, full)
    return out.select("incident_id", "kind", "item_id", F.unix_millis("available_at").alias("at_ms"), "details")


@query(DETAIL.format(who="c_nationkey = 7", cut="moment IS NULL OR moment <= cutoff"))
def q80_incident_detail(spark, d):
    """A trainee who asks for the full timeline still gets the cut."""
    return _detail(spark, d, "trainee", True)


@query(DETAIL.format(who="true", cut="true"))
def q80b_incident_detail_full(spark, d):
    return _detail(spark, d, "evaluator", True)


@query("SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY ts, event_id) AS listed FROM events GROUP BY 1")
def q81_string_agg(spark, d):
    return security.listed_by(table(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("SELECT o_orderkey, array_to_string(CASE WHEN o_orderstatus = 'O' THEN [o_orderstatus, o_orderpriority] ELSE [o_orderpriority, 'O'] END, '|') AS members FROM orders")
def q81b_array_member(spark, d):
    a = security.with_member(F.array("o_orderpriority"), F.lit("O"))
    b = security.with_member(security.with_member(F.array("o_orderstatus"), F.col("o_orderpriority")), F.lit("O"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.when(F.col("o_orderstatus") == "O", b).otherwise(a), "|").alias("members"))


REGIONS = [(46.0, -118.0, 49.0, -112.0), (51.0, -119.5, 54.5, -110.0)]


@query(f"WITH {maps.PT} SELECT id, (lat BETWEEN 46 AND 49 AND lng BETWEEN -118 AND -112) OR (lat BETWEEN 51 AND 54.5e0 AND lng BETWEEN -119.5e0 AND -110) AS inside FROM pt")
def q82_inside_coverage(spark, d):
    return maps.places(spark, d).select("id", sph.inside_coverage(F.col("lat"), F.col("lng"), REGIONS).alias("inside"))


PREVIEW = f"""WITH RECURSIVE {tracks_plans.P}, walk AS (SELECT track_id, seq, x, y, t, x AS lx, y AS ly, t AS lt, true AS kept FROM pts WHERE seq = 1
 UNION ALL SELECT p.track_id, p.seq, p.x, p.y, p.t, CASE WHEN ok THEN p.x ELSE lx END, CASE WHEN ok THEN p.y ELSE ly END, CASE WHEN ok THEN p.t ELSE lt END, ok
 FROM (SELECT p.*, w.lx, w.ly, w.lt, p.t > w.lt AND sqrt((p.x-w.lx)*(p.x-w.lx)+(p.y-w.ly)*(p.y-w.ly)) / ((p.t - w.lt) / 1000e0) <= {tracks_plans.SPEED}e0 AS ok FROM walk w JOIN pts p ON p.track_id = w.track_id AND p.seq = w.seq + 1) p),
kp AS (SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lag(t) OVER w AS before FROM walk WHERE kept WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
lg AS (SELECT ax, ay, x AS ex, y AS ey, sqrt((x-ax)*(x-ax)+(y-ay)*(y-ay)) AS len FROM kp WHERE ax IS NOT NULL AND (t - before) / 1000e0 <= {tracks_plans.GAP}e0),
pn AS (SELECT *, greatest(1, ceil(len / 25e0))::BIGINT AS n FROM lg WHERE len > 0), pc AS (SELECT len / n AS part, ax + (ex-ax) * ((k + 0.5e0) / n) AS x, ay + (ey-ay) * ((k + 0.5e0) / n) AS y FROM (SELECT *, unnest(range(n)) AS k FROM pn)),
lc AS (SELECT (floor(y / 100e0) * 50 + floor(x / 100e0))::BIGINT AS cell_id, sum(part) AS length FROM pc WHERE x >= 0 AND x < 5000e0 AND y >= 0 AND y < 1000000e0 GROUP BY 1),
{CELLS}, {S.UNIFORM}, ac AS (SELECT c.cell_id, CASE WHEN {S._inside_sql(S.POLYGON)} OR {S.EDGE} <= 50e0 THEN coalesce(l.length * 20e0 / 10000e0, 0e0) ELSE 0e0 END AS coverage FROM cells c LEFT JOIN lc l ON c.cell_id = l.cell_id),
z AS (SELECT sum(u.p * exp(-a.coverage)) + 0.2e0 AS z FROM uni u JOIN ac a ON u.cell_id = a.cell_id)
SELECT u.cell_id, round(a.coverage, 9) AS coverage, round(1e0 - exp(-a.coverage), 9) AS pod, round(u.p, 9) AS prior, round(u.p * exp(-a.coverage) / z.z, 9) AS posterior, round(0.2e0 / z.z, 9) AS outside, round(z.z, 9) AS z FROM uni u JOIN ac a ON u.cell_id = a.cell_id CROSS JOIN z"""


@query(PREVIEW)
def q83_search_preview(spark, d):
    p = tracks_plans.points(spark, d)
    return rounded(preview.search_preview(S.uniform(spark, d), cells(spark, d), p, grid(10_000), S.POLYGON, 20.0, 50.0, tracks_plans.SPEED, tracks_plans.GAP))


BANDED = ", ".join(maps.CLIP("lg WHERE x0 IS NOT NULL", f"b{i}", a, b) for i, (a, b) in enumerate([(0.0, 1500.0), (2000.0, 2600.0)]))


@query(f"""WITH {maps.TL}, {BANDED}, pt AS (SELECT 0 AS band, line_id, part, i, ax, ay, ex, ey FROM b0 UNION ALL SELECT 1, line_id, part, i, ax, ay, ex, ey FROM b1), ln AS (SELECT *, sqrt((ex-ax)*(ex-ax) + (ey-ay)*(ey-ay)) AS len FROM pt),
cu AS (SELECT *, sum(len) OVER (PARTITION BY line_id, band, part ORDER BY i) AS upto, sum(len) OVER (PARTITION BY line_id, band, part) AS total FROM ln), ct AS (SELECT line_id, band, part, max(total) AS total, greatest(1, floor(max(total) / 800e0 + 0.5e0))::BIGINT AS n FROM cu GROUP BY ALL),
pc AS (SELECT *, unnest(range(1, n + 1)) AS piece FROM ct), nm AS (SELECT *, total / n AS length, 'T-' || row_number() OVER (ORDER BY line_id, band, part, piece) AS name FROM pc),
lo AS (SELECT nm.name, ax, ay, ex, ey, len, greatest(upto - len, (piece - 1) * length) - (upto - len) AS f0, least(upto, piece * length) - (upto - len) AS f1 FROM nm JOIN cu ON cu.line_id = nm.line_id AND cu.band = nm.band AND cu.part = nm.part),
sb AS (SELECT name, ax + (ex-ax)*f0/len AS x0, ay + (ey-ay)*f0/len AS y0, ax + (ex-ax)*f1/len AS x1, ay + (ey-ay)*f1/len AS y1 FROM lo WHERE f1 > f0),
ce AS (SELECT p_partkey AS cell_id, (p_partkey % 50 + 0.5e0) * 100 AS cx, (p_partkey // 50 + 0.5e0) * 100 AS cy FROM part),
hit AS (SELECT DISTINCT name, cell_id FROM (SELECT *, greatest(0e0, least(1e0, ((cx-x0)*(x1-x0) + (cy-y0)*(y1-y0)) / ((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)))) AS t FROM sb JOIN ce ON cx BETWEEN least(x0, x1) - 150 AND greatest(x0, x1) + 150 AND cy BETWEEN least(y0, y1) - 150 AND greatest(y0, y1) + 150) WHERE sqrt(pow(cx - x0 - t*(x1-x0), 2) + pow(cy - y0 - t*(y1-y0), 2)) <= 150e0)
SELECT nm.name, line_id, band, piece::INTEGER AS piece, round(length, 6) AS length, count(cell_id) AS n_cells FROM nm LEFT JOIN hit ON hit.name = nm.name GROUP BY ALL""")
def q84_trail_corridors(spark, d):
    """Clipped, split and named pieces of the suppliers' trails with the number of cells in each corridor."""
    named, members = preview.trail_corridors(cells(spark, d), maps.trail_lines(spark, d), [(0.0, 1200.0), (1000.0, 1500.0), (2000.0, 2600.0)], 800.0, 150.0)
    n = members.groupBy("name").agg(F.count("*").alias("n_cells"))
    return rounded(named.join(n, "name", "left").select("name", "line_id", "band", "piece", "length", F.coalesce("n_cells", F.lit(0)).alias("n_cells")), 6)


EMAIL, TITLED = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", r"\b(?:Mr|Mrs|Ms|Miss|Dr)\.?\s+[A-Z][\w''-]*"
RUN, LOWER = r"\b[A-Z][a-z''’-]+(?:\s+[A-Z][a-z''’-]+)*\b", r"\b[a-z][a-z''’-]+\b"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"


@query(f"""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}')) AS email, regexp_replace(text, '{EMAIL}', '[contact]', 'g') AS a, list_distinct(regexp_extract_all(text, '{LOWER}')) AS low FROM documents),
u AS (SELECT doc_id, email, low, len(regexp_extract_all(a, '{TITLED}')) AS titled, regexp_replace(a, '{TITLED}', '[person]', 'g') AS b FROM t),
r AS (SELECT doc_id, low, unnest(regexp_extract_all(b, '{RUN}')) AS run FROM u),
n AS (SELECT doc_id, count(*) AS n FROM r WHERE NOT regexp_matches(run, '\\b(?:{"|".join(txt.PLACE_WORDS)})\\b') AND len(list_filter(regexp_split_to_array(run, '\\s+'), lambda w: NOT list_contains({_LIST(txt.COMMON_WORDS)}, w) AND NOT coalesce(list_contains(low, lower(w)), false))) > 0 GROUP BY 1)
SELECT u.doc_id, coalesce(email, 0)::INTEGER AS email, (coalesce(titled, 0) + coalesce(n.n, 0))::INTEGER AS name FROM u LEFT JOIN n ON u.doc_id = n.doc_id""")
def q59c_redacted_names(spark, d):
    """Counts of the redaction itself, names by runs of capitalised words included."""
    return txt.redact(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "email", "name")


@query("""WITH e AS (SELECT event_id AS id, event_id % 5 AS k, event_id % 120 AS la, event_id % 200 AS lo, event_id % 400 AS b FROM events)
SELECT id, CASE WHEN k = 0 AND la <= 90 AND lo <= 180 THEN la * 1e0 END AS lat, CASE WHEN k = 0 AND la <= 90 AND lo <= 180 THEN lo * 1e0 END AS lng, CASE WHEN k = 0 THEN 'IPP' END AS kind, CASE WHEN k = 3 AND b <= 360 THEN b * 1e0 END AS bearing,
CASE WHEN k = 1 THEN '(reply was not JSON)' WHEN k = 2 THEN '(reply was not an object)' WHEN k = 3 THEN CASE WHEN b > 360 THEN 'travelBearingDeg,x' ELSE 'x' END WHEN k = 4 THEN 'lat'
 WHEN la > 90 AND lo > 180 THEN 'lat,lng' WHEN la > 90 THEN 'lat,lng' WHEN lo > 180 THEN 'lng,lat' ELSE '' END AS discarded FROM e""")
def q60c_replies(spark, d):
    i = F.col("event_id")
    point = F.format_string('{"lat": %d, "lng": %d, "pointKind": "IPP"}', i % 120, i % 200)
    turn = F.format_string('```json\n{"travelBearingDeg": %d, "x": 1}\n```', i % 400)
    reply = F.when(i % 5 == 0, point).when(i % 5 == 1, "I would say north").when(i % 5 == 2, "[1]").when(i % 5 == 3, turn).otherwise('{"lat": 10}')
    out = txt.parse_replies(table(spark, d, "events").select(i.alias("id"), reply.alias("reply")), "id", "reply")
    return out.select("id", "lat", "lng", F.col("pointKind").alias("kind"), F.col("travelBearingDeg").alias("bearing"), F.array_join("discarded", ",").alias("discarded"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN round(p_size + 0.1234e0, 6) WHEN 1 THEN round(p_size + 30.5e0 / 60, 6) END AS lat, CASE p_partkey % 3 WHEN 0 THEN round(-(p_size * 3 + 0.5e0), 6) WHEN 1 THEN round(-(p_size * 2 + 15.25e0 / 60), 6) END AS lng,
CASE p_partkey % 3 WHEN 0 THEN 'decimal' WHEN 1 THEN 'degrees-minutes' END AS format FROM part""")
def q58b_coordinates(spark, d):
    s, k = F.col("p_size"), F.col("p_partkey") % 3
    text = F.when(k == 0, F.format_string("%d.1234, -%d.5", s, s * 3)).when(k == 1, F.format_string("N%d 30.500 W%d 15.250", s, s * 2)).otherwise("near the hut")
    return rounded(txt.parse_coordinates(table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("t")), "id", "t").select("id", "lat", "lng", "format"), 6)


@query("""WITH e AS (SELECT user_id AS file, event_id % 170 * 1e0 AS x, event_id % 80 * 1e0 AS y, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT file, seq::INTEGER AS seq, x, y, t FROM e WHERE n >= 2""")
def q76b_gpx_of_events(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("file"), "event_id", F.format_string('<trkpt lat="%d" lon="%d"><time>%s</time></trkpt>', F.col("event_id") % 80, F.col("event_id") % 170, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("pt"))
    text = F.concat(F.lit("<gpx><trk><trkseg>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "pt"))), lambda r: r["pt"]), ""), F.lit("</trkseg></trk></gpx>"))
    return imp.import_gpx(e.groupBy("file").agg(text.alias("text")))[0].select("file", "seq", "x", "y", "t")


@query("""WITH s AS (SELECT s_nationkey AS file, s_suppkey::VARCHAR AS source_id, s_suppkey % 3 AS k, s_suppkey + 1e0 AS n, 'B' || s_suppkey || ' ' || s_name AS name FROM supplier)
SELECT file, source_id, 'assignment' AS kind, name AS label, i::INTEGER AS i, [0e0, n, n, 0e0][i + 1] AS x, [0e0, 0e0, 9e0, 9e0][i + 1] AS y, NULL::BIGINT AS t FROM (SELECT *, unnest(range(4)) AS i FROM s WHERE k = 0)
UNION ALL SELECT file, source_id, 'assignment', name, i::INTEGER, [0e0, n, n][i + 1], [0e0, 0e0, 9e0][i + 1], NULL FROM (SELECT *, unnest(range(3)) AS i FROM s WHERE k = 1)
UNION ALL SELECT file, source_id, 'track', NULL, i::INTEGER, [0e0, n][i + 1], [0e0, n][i + 1], 1700000000000 + i * 60000 FROM (SELECT *, unnest(range(2)) AS i FROM s WHERE k = 2)""")
def q75b_geojson_of_suppliers(spark, d):
    k = F.col("s_suppkey")
    square, triangle = "[[[0,0],[%d,0],[%d,9],[0,9],[0,0]]]", "[[[0,0],[0,0],[%d,0],[%d,9]]]"
    line = "[[0,0,5,1700000000000],[%d,%d,5,1700000060000]]"
    geometry = F.when(k % 3 == 2, F.format_string('{"type":"LineString","coordinates":' + line + "}", k + 1, k + 1)).when(k % 3 == 0, F.format_string('{"type":"Polygon","coordinates":' + square + "}", k + 1, k + 1)).otherwise(F.format_string('{"type":"Polygon","coordinates":' + triangle + "}", k + 1, k + 1))
    props = F.when(k % 3 == 2, '{"class":"Track"}').otherwise(F.format_string('{"class":"Assignment","letter":"B","number":"%d","title":"%s"}', k, "s_name"))
    f = F.format_string('{"type":"Feature","id":"%d","geometry":%s,"properties":%s}', k, geometry, props)
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}"))
    files = table(spark, d, "supplier").select(F.col("s_nationkey").alias("file"), f.alias("f")).groupBy("file").agg(text.alias("text"))
    a, t, _ = imp.import_geojson(files)
    none = F.lit(None)
    rows = a.select("file", "source_id", "label", F.posexplode("points").alias("i", "p")).select("file", "source_id", F.lit("assignment").alias("kind"), "label", "i", "p.x", "p.y", none.cast("long").alias("t"))
    place = F.row_number().over(W.partitionBy("file", "source_id").orderBy("t")) - 1
    return rows.unionByName(t.select("file", "source_id", F.lit("track").alias("kind"), none.cast("string").alias("label"), place.alias("i"), "x", "y", "t"))
