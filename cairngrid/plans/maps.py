"""Catalogue: spherical geometry, search maps, trails, lookups, text and importers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairngrid.functions import spherical as sph
from cairngrid.functions import text as txt
from cairngrid.operators import outlines, searchmap, trails
from cairngrid.plans.base import cells, literal, query, rounded, table
from cairngrid.sources import importers as imp

PT = "pt AS (SELECT s_suppkey AS id, 45e0 + s_suppkey % 20 * 0.5e0 AS lat, -120e0 + s_suppkey * 0.11e0 AS lng, s_suppkey * 37 % 360 * 1e0 AS bearing, 500e0 + s_suppkey * 90 AS m FROM supplier)"


def places(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), (45.0 + k % 20 * 0.5).alias("lat"), (-120.0 + k * 0.11).alias("lng"), (k * 37 % 360).cast("double").alias("bearing"), (500.0 + k * 90).alias("m"))


def _dest(lat: str, lng: str, brg: str, m: str) -> tuple[str, str]:
    a, p, t = f"(({m}) / {sph.RADIUS}e0)", f"radians({lat})", f"radians({brg})"
    la = f"asin(sin({p})*cos({a}) + cos({p})*sin({a})*cos({t}))"
    lo = f"((degrees(radians({lng}) + atan2(sin({t})*sin({a})*cos({p}), cos({a}) - sin({p})*sin({la}))) + 540e0) % 360e0 - 180e0)"
    return f"degrees({la})", lo


LA, LO = _dest("lat", "lng", "bearing", "m")


@query(f"WITH {PT} SELECT id, round({LA}, 7) AS lat2, round({LO}, 7) AS lng2 FROM pt")
def q47_destination(spark, d):
    a, b = sph.destination(F.col("lat"), F.col("lng"), F.col("bearing"), F.col("m"))
    return places(spark, d).select("id", F.round(a, 7).alias("lat2"), F.round(b, 7).alias("lng2"))


@query(f"WITH {PT} SELECT id, round(2e0 * {sph.RADIUS}e0 * asin(least(1e0, sqrt(pow(sin((radians(51.2e0) - radians(lat)) / 2e0), 2) + cos(radians(lat)) * cos(radians(51.2e0)) * pow(sin(radians(-115.8e0 - lng) / 2e0), 2)))), 4) AS m FROM pt")
def q48_haversine(spark, d):
    return places(spark, d).select("id", F.round(sph.haversine(F.col("lat"), F.col("lng"), F.lit(51.2), F.lit(-115.8)), 4).alias("m"))


def _all(df, column, *names):
    """Points as the functions give them, with seven decimals."""
    return df.select("id", *names, F.posexplode(column).alias("i", "p")).select("id", *names, "i", F.col("p.lat").alias("lat2"), F.col("p.lng").alias("lng2"))


RA, RO = _dest("lat", "lng", "(i % 72) * 5e0", "m")


RING_LINES = f"WITH {PT}, k AS (SELECT unnest(range(73))::INTEGER AS i) SELECT id, i, floor({RA} * 1e7 + 0.5e0) / 1e7 AS lat2, floor({RO} * 1e7 + 0.5e0) / 1e7 AS lng2 FROM pt CROSS JOIN k"


@query(RING_LINES)
def q49_ring_line(spark, d):
    return _all(sph.spread(places(spark, d), "id"), sph.ring_line(F.col("lat"), F.col("lng"), F.col("m")))


WA, WO = _dest("lat", "lng", "bearing - 45e0 + 5e0 * (i - 1)", "m")


WEDGES = f"WITH {PT}, k AS (SELECT unnest(range(21))::INTEGER AS i) SELECT id, i, floor((CASE WHEN i BETWEEN 1 AND 19 THEN {WA} ELSE lat END) * 1e7 + 0.5e0) / 1e7 AS lat2, floor((CASE WHEN i BETWEEN 1 AND 19 THEN {WO} ELSE lng END) * 1e7 + 0.5e0) / 1e7 AS lng2 FROM pt CROSS JOIN k"


@query(WEDGES)
def q50_wedge(spark, d):
    return _all(sph.spread(places(spark, d), "id"), sph.wedge_polygon(F.col("lat"), F.col("lng"), F.col("m"), F.col("bearing"), F.lit(90.0)))


SA, SO = _dest("lat", "lng", "s * 45e0 - 22.5e0 + 5e0 * (CASE WHEN i < 10 THEN i WHEN i < 20 THEN 19 - i ELSE 0 END)", "CASE WHEN i < 10 OR i = 20 THEN m ELSE m / 2e0 END")


SECTORS = f"WITH {PT}, k AS (SELECT unnest(range(21))::INTEGER AS i), s AS (SELECT unnest(range(8))::INTEGER AS s) SELECT id, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][s + 1] AS sector, i, floor({SA} * 1e7 + 0.5e0) / 1e7 AS lat2, floor({SO} * 1e7 + 0.5e0) / 1e7 AS lng2 FROM pt CROSS JOIN k CROSS JOIN s"


@query(SECTORS)
def q51_sectors(spark, d):
    s = sph.spread(places(spark, d), "id").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(7))))
    poly = sph.sector_polygon(F.col("lat"), F.col("lng"), F.col("m") / 2, F.col("m"), F.col("s") * 45 - 22.5, F.col("s") * 45 + 22.5)
    return _all(s.withColumn("sector", sph.sector_name(F.col("s"), 8)), poly, "sector")


BAND_SQL = "bd AS (SELECT s_nationkey AS k, s_suppkey * 37 % 500 * 10e0 AS a, s_suppkey * 37 % 500 * 10e0 + 100 + s_suppkey % 7 * 200 AS b FROM supplier)"


@query(f"WITH {BAND_SQL}, f AS (SELECT *, CASE WHEN coalesce(a > max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS n FROM bd), g AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS r FROM f) SELECT k AS key, min(a) AS inner_m, max(b) AS outer_m FROM g GROUP BY k, r")
def q52_merge_bands(spark, d):
    """The suppliers of a nation as bands."""
    k = F.col("s_suppkey")
    bands = table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), (k * 37 % 500 * 10.0).alias("inner"), (k * 37 % 500 * 10.0 + 100 + k % 7 * 200).alias("outer"))
    return sph.merge_bands(bands, "key").withColumnsRenamed({"inner": "inner_m", "outer": "outer_m"})


def trail_lines(spark, d):
    """Suppliers' points as lines of ten in local metres."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(F.floor(k / 10).alias("line_id"), (k % 10).cast("int").alias("seq"), (k * 7919 % 6000 - 3000.0).alias("x"), (k * 104729 % 6000 - 3000.0).alias("y"))


TL = "tl AS (SELECT s_suppkey // 10 AS line_id, s_suppkey % 10 AS seq, s_suppkey * 7919 % 6000 - 3000e0 AS x, s_suppkey * 104729 % 6000 - 3000e0 AS y FROM supplier), lg AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM tl WINDOW w AS (PARTITION BY line_id ORDER BY seq)), le AS (SELECT *, sqrt((x-x0)*(x-x0)+(y-y0)*(y-y0)) AS len FROM lg WHERE x0 IS NOT NULL)"


CLIP = lambda src, name, inner, outer: f"""{name}e AS (SELECT line_id, seq - 1 AS leg, x0, y0, x - x0 AS dx, y - y0 AS dy FROM {src}), {name}q AS (SELECT *, dx*dx + dy*dy AS a, x0*dx + y0*dy AS b, x0*x0 + y0*y0 AS c FROM {name}e),
{name}t AS (SELECT *, list_sort(list_distinct([0e0, 1e0] || list_filter([{", ".join(f"CASE WHEN a > 0 AND b*b - a*(c - {r}e0*{r}e0) > 0 THEN (-b {s} sqrt(b*b - a*(c - {r}e0*{r}e0))) / a END" for r in ([inner] * (inner > 0) + [outer]) for s in "-+")}], lambda v: v > 0 AND v < 1))) AS t FROM {name}q),
{name}p AS (SELECT line_id, leg, k, x0 + dx*ta AS ax, y0 + dy*ta AS ay, x0 + dx*tb AS ex, y0 + dy*tb AS ey, sqrt(pow(x0 + dx*(ta + tb)/2, 2) + pow(y0 + dy*(ta + tb)/2, 2)) BETWEEN {inner}e0 AND {outer}e0 AS ok FROM (SELECT *, t[k] AS ta, t[k + 1] AS tb FROM (SELECT *, unnest(range(1, len(t))) AS k FROM {name}t))),
{name}n AS (SELECT *, CASE WHEN ok AND NOT coalesce(lag(ok) OVER (PARTITION BY line_id ORDER BY leg, k), false) THEN 1 ELSE 0 END AS nw FROM {name}p), {name}r AS (SELECT *, sum(nw) OVER (PARTITION BY line_id ORDER BY leg, k) AS part FROM {name}n),
{name} AS (SELECT *, row_number() OVER (PARTITION BY line_id, part ORDER BY leg, k) AS i FROM {name}r WHERE ok AND sqrt((ex-ax)*(ex-ax) + (ey-ay)*(ey-ay)) > 1e-9)"""  # noqa: E731


@query(f"""WITH {TL}, {CLIP("lg WHERE x0 IS NOT NULL", "cl", 1000.0, 2500.0)} SELECT line_id, part::BIGINT AS part, 0 AS seq, round(ax, 6) AS x, round(ay, 6) AS y FROM cl WHERE i = 1 UNION ALL SELECT line_id, part::BIGINT, i::INTEGER, round(ex, 6), round(ey, 6) FROM cl""")
def q53_clip_band(spark, d):
    return rounded(trails.clip_to_band(trail_lines(spark, d), 1000.0, 2500.0), 6)


@query(f"""WITH {TL}, cu AS (SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY seq) AS t1, sum(len) OVER (PARTITION BY line_id) AS total FROM le), n AS (SELECT line_id, max(total) AS total, greatest(1, floor(max(total) / 2000e0 + 0.5e0))::BIGINT AS n FROM cu GROUP BY 1)
SELECT line_id, i::INTEGER AS piece, round(total / n, 6) AS length FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM n)""")
def q54_split_evenly(spark, d):
    return rounded(trails.split_evenly(trail_lines(spark, d), 2000.0).select("line_id", "piece", "length"), 6)


@query("""WITH RECURSIVE sp AS (SELECT s_suppkey AS k, s_suppkey * 7919 % 10007 AS line, CASE s_suppkey % 100 WHEN 57 THEN s_suppkey - 29 WHEN 89 THEN 1000000 + s_suppkey WHEN 99 THEN s_suppkey - 9 ELSE s_suppkey + 1 END AS b FROM supplier),
ln AS (SELECT line, CASE WHEN k % 3 = 0 THEN list_reverse(p) ELSE p END AS p FROM (SELECT *, CASE WHEN k % 2 = 0 THEN [{'x': k * 10e0, 'y': 0e0}, {'x': k * 10e0 + 4, 'y': 3e0}, {'x': b * 10e0, 'y': 0e0}] ELSE [{'x': k * 10e0, 'y': 0e0}, {'x': b * 10e0, 'y': 0e0}] END AS p FROM sp)),
tip AS (SELECT line, 0 AS e, p[1] AS s FROM ln UNION ALL SELECT line, 1, p[-1] FROM ln),
two AS (SELECT s FROM tip GROUP BY s HAVING count(*) = 2 AND count(DISTINCT line) = 2),
nx AS (SELECT f.line, 1 - f.e AS way, t.line AS nline, t.e AS nway FROM tip f JOIN two USING (s) JOIN tip t ON t.s = f.s AND t.line <> f.line),
wk AS (SELECT line AS start, d AS dir, 0 AS i, line, d AS way FROM ln CROSS JOIN (VALUES (0), (1)) v(d) UNION ALL SELECT w.start, w.dir, w.i + 1, nx.nline, nx.nway FROM wk w JOIN nx ON nx.line = w.line AND nx.way = w.way WHERE nx.nline <> w.start),
ok AS (SELECT start FROM wk GROUP BY start HAVING min(line) = start),
ch AS (SELECT start, i AS pos, line, way FROM wk JOIN ok USING (start) WHERE dir = 0 UNION ALL SELECT b.start, -b.i, b.line, 1 - b.way FROM wk b JOIN ok USING (start) WHERE b.dir = 1 AND b.i > 0 AND NOT EXISTS (SELECT 1 FROM wk f WHERE f.start = b.start AND f.dir = 0 AND f.line = b.line)),
pl AS (SELECT start, pos, CASE WHEN way = 1 THEN list_reverse(p) ELSE p END AS p, len(p) AS n, coalesce(sum(len(p) - 1) OVER (PARTITION BY start ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS far FROM ch JOIN ln ON ln.line = ch.line),
pp AS (SELECT start, pos, n, far, unnest(p) AS q, generate_subscripts(p, 1) - 1 AS k FROM pl)
SELECT 'all' AS file, start AS joined, (far + k)::BIGINT AS seq, q.x AS x, q.y AS y FROM pp WHERE pos = 0 OR (pos > 0 AND k > 0) OR (pos < 0 AND k < n - 1)""")
def q55_join_lines(spark, d):
    """All suppliers as the lines of one file: long paths, reversed lines, a junction and a loop in every hundred."""
    k, spot = F.col("s_suppkey"), lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(y).alias("y"))
    b = F.when(k % 100 == 57, k - 29).when(k % 100 == 89, 1_000_000 + k).when(k % 100 == 99, k - 9).otherwise(k + 1)
    p = F.when(k % 2 == 0, F.array(spot(k * 10, 0.0), spot(k * 10 + 4, 3.0), spot(b * 10, 0.0))).otherwise(F.array(spot(k * 10, 0.0), spot(b * 10, 0.0)))
    lines = table(spark, d, "supplier").select(F.lit("all").alias("file"), (k * 7919 % 10007).alias("line_id"), F.posexplode(F.when(k % 3 == 0, F.reverse(p)).otherwise(p)).alias("seq", "p"))
    return trails.join_lines(lines.select("file", "line_id", "seq", "p.*"), "file")


CORRIDORS = f"""WITH {TL} SELECT DISTINCT line_id, p_partkey AS cell_id FROM part CROSS JOIN le WHERE (SELECT sqrt(pow((p_partkey % 50 + 0.5e0)*100 - (x0 + t*(x-x0)), 2) + pow((p_partkey // 50 + 0.5e0)*100 - (y0 + t*(y-y0)), 2)) FROM (SELECT greatest(0e0, least(1e0, (((p_partkey % 50 + 0.5e0)*100 - x0)*(x-x0) + ((p_partkey // 50 + 0.5e0)*100 - y0)*(y-y0)) / (len*len))) AS t)) <= 150e0"""


@query(CORRIDORS)
def q55b_corridor_cells(spark, d):
    return trails.corridor_cells(cells(spark, d), trail_lines(spark, d), 150.0)


@query(CORRIDORS)
def q55c_corridor_outlines(spark, d):
    """The cells inside the outlines of the same corridors, drawn to a millimetre."""
    rings = outlines.corridor_outlines(trail_lines(spark, d), 150.0, tolerance=0.001)
    return outlines.in_rings(cells(spark, d), rings, "line_id", "cell_id", "cx", "cy")


@query(f"WITH {PT}, b AS (SELECT id, lat, lng, degrees((m + 6000e0) / {sph.RADIUS}e0) AS dl, degrees((m + 6000e0) / ({sph.RADIUS}e0 * cos(radians(lat)))) AS dg FROM pt), i AS (SELECT *, unnest(range(floor((lat - dl - 40e0) / 0.25e0)::BIGINT, floor((lat + dl - 40e0) / 0.25e0)::BIGINT + 1)) AS i FROM b), j AS (SELECT *, unnest(range(floor((lng - dg + 130e0) / 0.4e0)::BIGINT, floor((lng + dg + 130e0) / 0.4e0)::BIGINT + 1)) AS j FROM i) SELECT id, i || '_' || j AS tile FROM j")
def q57_tiles_for(spark, d):
    return sph.tiles_for(places(spark, d).withColumn("radius_m", F.col("m")), "id", 0.25, 0.4, 40.0, -130.0)


@query("WITH r AS (SELECT p_partkey // 4 AS key, [25, 50, 75, 95][p_partkey % 4 + 1] AS percent, (p_partkey % 4 + 1) * 6e0 + p_size / 10e0 AS distance FROM part), w AS (SELECT *, lag(distance, 1, 0e0) OVER (PARTITION BY key ORDER BY percent) AS inner_m FROM r) SELECT key, percent, round(inner_m, 9) AS inner_m, round(distance, 9) AS outer_m FROM w WHERE percent IN (50, 95)")
def q52b_bands_for(spark, d):
    """Four parts each as the rings of one table."""
    k = F.col("p_partkey")
    rings = table(spark, d, "part").select(F.floor(k / 4).alias("key"), F.element_at(F.array(*map(F.lit, (25, 50, 75, 95))), (k % 4 + 1).cast("int")).alias("percent"), ((k % 4 + 1) * 6.0 + F.col("p_size") / 10.0).alias("distance"))
    return rounded(sph.bands_for(rings, "key", [50, 95]).withColumnsRenamed({"inner": "inner_m", "outer": "outer_m"}))


@query(f"WITH {PT} SELECT id, CASE WHEN m / 1000 < 10 THEN rtrim(rtrim(printf('%.2f', m / 1000), '0'), '.') ELSE regexp_replace(printf('%.1f', m / 1000), '\\.0$', '') END AS km FROM pt")
def q51b_format_km(spark, d):
    return places(spark, d).select("id", sph.format_km(F.col("m") / 1000).alias("km"))


CSV = ["category,terrain,n,ring25,ring50,ring75,ring95,disp25,disp50,disp75,disp95", "# note", "Hiker,mountainous,50,1,2,3,5,,,,", "hiker,,20,0.5,1,2,4,10,20,30,40", "", "child,flat,7,0.2,0.4,0.8,1.5"]
ENTRY_SQL = "be(category, terrain, ring25, ring95) AS (VALUES ('hiker', 'mountainous', 1.609e0, 8.047e0), ('hiker', 'any', 0.805e0, 6.437e0), ('child', 'flat', 0.322e0, 2.414e0))"


def csv_lines(spark):
    rows = [("good", i + 1, x) for i, x in enumerate(CSV)]
    return literal(spark, "file string, line_no int, line string", rows)


@query(f"""WITH {ENTRY_SQL}, w AS (SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'hiker' WHEN 1 THEN 'child' ELSE 'pilot' END AS category, CASE WHEN p_size % 2 = 0 THEN 'mountainous' ELSE 'flat' END AS terrain FROM part),
e AS (SELECT w.id, be.*, be.terrain <> w.terrain AS fb, row_number() OVER (PARTITION BY w.id ORDER BY (be.terrain <> w.terrain)) AS k FROM w JOIN be ON w.category = be.category AND (w.terrain = be.terrain OR be.terrain = 'any'))
SELECT w.id, w.category, w.terrain, e.fb AS fallback, e.ring25, e.ring95 FROM w LEFT JOIN e ON w.id = e.id AND e.k = 1""")
def q45_behaviour_lookup(spark, d):
    good, _ = imp.parse_behaviour_csv(csv_lines(spark), miles=True)
    k = F.col("p_size")
    want = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(k % 3 == 0, "hiker").when(k % 3 == 1, "child").otherwise("pilot").alias("category"), F.when(k % 2 == 0, "mountainous").otherwise("flat").alias("terrain"))
    return imp.lookup_behaviour(want, good, "id").select("id", "category", "terrain", "fallback", "ring25", "ring95")


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+(?:\\.[0-9A-Za-z_-]+)+')) AS email, len(regexp_extract_all(text, '\\b(?:Mr|Mrs|Ms|Miss|Dr)\\.?\\s+[A-Z]')) AS titled FROM documents")
def q59_redact_counts(spark, d):
    c = txt.contact_counts(F.col("text"))
    return table(spark, d, "documents").select("doc_id", c["email"].alias("email"), c["titled"].alias("titled"))


@query()
def q59b_redact(spark, d):
    return txt.redact(table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\bhik(?:er|ing)\\b') THEN 'hiker' WHEN regexp_matches(text, '(?i)\\bhunt(?:er|ing)\\b') THEN 'hunter' END AS category, CASE WHEN regexp_matches(text, '(?i)\\b(?:mount(?:ain(?:s|ous)?)?|mt|alpine|subalpine|ridge|glacier|scree|peak|summit|canyon|col)\\b') THEN 'mountainous' WHEN regexp_matches(text, '(?i)\\b(?:prairie|flat|grassland|farmland|lowland|plains?)\\b') THEN 'flat' END AS terrain FROM conversations""")
def q60_local_reader(spark, d):
    f = txt.read_local(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", f["category"].alias("category"), f["terrain"].alias("terrain"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(url), '\\.docx$') THEN 'docx' WHEN regexp_matches(lower(url), '\\.(txt|md|csv|json|eml|log|rtf)$') THEN 'text' ELSE 'unsupported' END AS kind FROM pages")
def q61_doc_kind(spark, d):
    return table(spark, d, "pages").select("page_id", imp.doc_kind(F.col("url")).alias("kind"))


@query("SELECT doc_id, substring(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 1, 40) AS label FROM documents")
def q62_label_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", imp.clean_label(F.col("text")).alias("label"))


@query("""WITH RECURSIVE nb AS (SELECT * FROM (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) t(a,b)),
m AS (SELECT p_partkey AS cell_id, CASE WHEN p_size < 48 THEN p_size / 10e0 END AS mult FROM part),
e AS (SELECT x.cell_id AS i, y.cell_id AS k, 100e0 * (CASE WHEN a <> 0 AND b <> 0 THEN sqrt(2e0) ELSE 1e0 END) * (x.mult + y.mult) / 2 AS w FROM m x CROSS JOIN nb JOIN m y ON y.cell_id = x.cell_id + a * 50 + b AND x.cell_id % 50 + b BETWEEN 0 AND 49 WHERE x.mult IS NOT NULL AND y.mult IS NOT NULL),
r(cell_id, cost) USING KEY (cell_id) AS (SELECT min(cell_id), 0e0 FROM m WHERE mult IS NOT NULL UNION SELECT e.k, min(r.cost + e.w) FROM r JOIN e ON e.i = r.cell_id LEFT JOIN recurring.r AS o ON o.cell_id = e.k WHERE o.cost IS NULL OR r.cost + e.w < o.cost GROUP BY e.k)
SELECT m.cell_id, round(coalesce(r.cost, 'inf'::DOUBLE), 9) AS cost FROM m LEFT JOIN r ON m.cell_id = r.cell_id""")
def q12_cost_distance(spark, d):
    """The whole part raster as one grid, from its first cell that can be entered."""
    c = cells(spark, d).select(F.lit(0).alias("grid_id"), "cell_id", F.when(F.col("p_size") < 48, F.col("p_size") / 10.0).alias("mult"))
    start = c.where("mult is not null").groupBy("grid_id").agg(F.min("cell_id").alias("cell_id"))
    return rounded(trails.cost_distance(c, start, 50, 100.0).select("cell_id", "cost"))


FOLDER_ROWS = ", ".join(f"({i}, '{t}', '{u}')" for i, (t, u) in enumerate(searchmap.FOLDERS.items()))
KM = lambda e: f"CASE WHEN {e} < 10 THEN rtrim(rtrim(printf('%.2f', {e}), '0'), '.') ELSE regexp_replace(printf('%.1f', {e}), '\\.0$', '') END"
NUM = lambda e: f"regexp_replace(({e})::VARCHAR, '\\.0$', '')"
MAPS = f"""fo(no, folder, fid) AS (VALUES {FOLDER_ROWS}),
rq AS (SELECT s_suppkey AS id, 45e0 + s_suppkey % 20 * 0.5e0 AS lat, -120e0 + s_suppkey % 1000 * 0.125e0 AS lng, s_suppkey * 37 % 360 * 1e0 AS brg, 1e0 + s_suppkey % 13 * 0.25e0 AS base, [4, 8, 12, 16][s_suppkey % 4 + 1] AS sec, CASE WHEN s_suppkey % 2 = 0 THEN [25, 50, 75] ELSE [50] END AS bands, ['IPP', 'LKP', 'PLS'][s_suppkey % 3 + 1] AS kind FROM supplier),
rg AS (SELECT rq.*, i, [25, 50, 75, 95][i] AS pct, base * [1, 2, 4, 10][i] AS km, CASE WHEN i = 1 THEN 0e0 ELSE base * [1, 2, 4, 10][i - 1] END AS km0 FROM rq CROSS JOIN (SELECT unnest(range(1, 5)) AS i)),
sd AS (SELECT id, sha256('{{"dispersion":[{{"angleDeg":90,"percent":50}},{{"angleDeg":120,"percent":75}}],"dispersionSource":"exercise","label":"EX-' || id || '","planningPoint":{{"kind":"' || kind || '","lat":' || {NUM("lat")} || ',"lng":' || {NUM("lng")} || '}},"ringSource":"exercise","rings":[' ||
 (SELECT string_agg('{{"distanceKm":' || {NUM("g.km")} || ',"percent":' || g.pct || '}}', ',' ORDER BY g.i) FROM rg g WHERE g.id = rq.id) || '],"segments":{{"inRings":[' || array_to_string(bands, ',') || '],"sectors":' || sec || '}},"travelBearingDeg":' || {NUM("brg")} || '}}') AS seed FROM rq),
ft AS (SELECT id, no, folder, fid, NULL AS key, 'Folder' AS class, folder AS title, NULL::DOUBLE AS m, NULL::DOUBLE AS bearing, 0 AS n FROM rq CROSS JOIN fo
 UNION ALL SELECT id, 8, '{searchmap.POINTS}', NULL, 'planning-point', 'Marker', kind, 0e0, 0e0, 1 FROM rq
 UNION ALL SELECT id, 8 + i, '{searchmap.RANGES}', NULL, 'ring:' || pct, 'Shape', pct || '% ' || {KM("km")} || ' km', km * 1000, 0e0, 73 FROM rg
 UNION ALL SELECT id, 11 + i, '{searchmap.RANGES}', NULL, 'wedge:' || pct, 'Shape', pct || '% dispersion ' || a || '°', km * 1000, brg - a / 2e0, a // 5 + 3 FROM (SELECT *, CASE i WHEN 2 THEN 90 ELSE 120 END AS a FROM rg WHERE i IN (2, 3))
 UNION ALL SELECT id, 14 + row_number() OVER (PARTITION BY id ORDER BY i, k), '{searchmap.SEGMENTS}', NULL, 'segment:' || t, 'Assignment', t, km * 1000, k * 360e0 / sec - 180e0 / sec, (ceil(72e0 / sec)::INTEGER + 1) * CASE WHEN i = 1 THEN 1 ELSE 2 END + CASE WHEN i = 1 THEN 2 ELSE 1 END
 FROM (SELECT *, 'R' || i || '-' || CASE sec WHEN 8 THEN ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][k + 1] WHEN 4 THEN ['N', 'E', 'S', 'W'][k + 1] ELSE 'S' || (k + 1) END AS t FROM (SELECT *, unnest(range(sec)) AS k FROM rg WHERE list_contains(bands, pct)))),
fh AS (SELECT ft.*, sha256('"' || seed || ':' || key || '"') AS h FROM ft JOIN sd ON ft.id = sd.id)"""


def map_requests(spark, d):
    """One request for a search map per supplier."""
    k, pick = F.col("s_suppkey"), lambda v, i: F.element_at(F.array(*[F.lit(x) for x in v]), (i + 1).cast("int"))
    base = 1.0 + k % 13 * 0.25
    rings = F.array(*[F.struct(F.lit(p).alias("percent"), (base * m).alias("km")) for p, m in ((25, 1), (50, 2), (75, 4), (95, 10))])
    wedges = F.array(*[F.struct(F.lit(p).alias("percent"), F.lit(a).alias("degrees")) for p, a in ((50, 90), (75, 120))])
    return table(spark, d, "supplier").select(
        k.alias("request_id"), F.concat(F.lit("EX-"), k.cast("string")).alias("label"), pick(["IPP", "LKP", "PLS"], k % 3).alias("kind"), (45.0 + k % 20 * 0.5).alias("lat"), (-120.0 + k % 1000 * 0.125).alias("lng"),
        (k * 37 % 360).cast("double").alias("bearing"), rings.alias("rings"), F.lit("exercise").alias("ring_source"), wedges.alias("dispersion"), F.lit("exercise").alias("dispersion_source"),
        pick([4, 8, 12, 16], k % 4).alias("sectors"), F.when(k % 2 == 0, F.array(F.lit(25), F.lit(50), F.lit(75))).otherwise(F.array(F.lit(50))).alias("in_rings"),
    )


@query(f"""WITH {MAPS} SELECT id AS request_id, no::BIGINT AS no, coalesce(fid, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS id, folder, class, title, n::INTEGER AS n_points FROM fh""")
def q56_search_map(spark, d):
    """Every feature of the suppliers' search maps, with its id and the number of its points."""
    m = searchmap.search_maps(map_requests(spark, d))
    return m.select("request_id", "no", "id", "folder", "class", "title", F.coalesce(F.size(F.get("coordinates", F.lit(0))), F.lit(0)).alias("n_points"))


MA, MO = _dest("lat", "lng", "bearing", "m")


@query(f"""WITH {MAPS} SELECT ft.id AS request_id, no::BIGINT AS no, title, class, CASE WHEN class = 'Assignment' THEN 'GROUND' END AS resource, CASE WHEN class <> 'Folder' THEN (SELECT fid FROM fo WHERE fo.folder = ft.folder) END AS folder_id,
CASE WHEN m > 0 THEN floor({MA} * 1e7 + 0.5e0) / 1e7 WHEN m = 0 THEN lat END AS lat, CASE WHEN m > 0 THEN floor({MO} * 1e7 + 0.5e0) / 1e7 WHEN m = 0 THEN lng END AS lng FROM ft JOIN rq ON ft.id = rq.id""")
def q56b_geojson(spark, d):
    """The suppliers' search maps as GeoJSON text, read again: some properties and a first point on each outer arc."""
    m = searchmap.to_geojson(searchmap.search_maps(map_requests(spark, d)))
    read = F.from_json("value", "geometry struct<type:string,coordinates:string>, properties struct<title:string,class:string,resourceType:string,folderId:string>")
    m = m.select("request_id", "no", read.alias("v"))
    f = lambda path: F.col(f"v.{path}")
    text, kind = f("geometry.coordinates"), f("geometry.type")
    ring = F.when(kind == "Polygon", F.get(F.from_json(text, "array<array<array<double>>>"), F.lit(0))).when(kind == "LineString", F.from_json(text, "array<array<double>>")).when(kind == "Point", F.array(F.from_json(text, "array<double>")))
    at = F.when(f("properties.title").contains("dispersion") & (kind == "Polygon"), 1).otherwise(0)
    p = F.get(ring, at)
    return m.select("request_id", "no", f("properties.title").alias("title"), f("properties.class").alias("class"), f("properties.resourceType").alias("resource"), f("properties.folderId").alias("folder_id"), F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lng"))


@query("""SELECT p_partkey AS request_id, array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'planning point must be a valid latitude and longitude' END, CASE WHEN p_size % 5 = 0 THEN 'label looks like a person''s name; use a place and date instead' END,
CASE WHEN p_partkey % 3 = 0 THEN 'ring source is required: name the table and subject category the distances come from' END, CASE WHEN p_partkey % 4 = 1 THEN 'ring 2: percent and distance must both increase' END, CASE WHEN p_partkey % 7 = 0 THEN 'segments: sectors must be 4, 8, 12 or 16' END,
CASE WHEN p_size % 2 = 0 THEN 'segments: there is no 60% ring band' END, CASE WHEN p_size < 5 THEN 'trails: corridor half-width must be 5 to 1000 m' END], lambda x: x IS NOT NULL), '; ') AS problems FROM part""")
def q56c_map_problems(spark, d):
    k, n, none = F.col("p_partkey"), F.col("p_size"), F.lit(None)
    rings = F.array(F.struct(F.lit(25).alias("percent"), F.lit(1.0).alias("km")), F.struct(F.lit(50).alias("percent"), F.when(k % 4 == 1, 1.0).otherwise(2.0).alias("km")))
    requests = table(spark, d, "part").select(
        k.alias("request_id"), F.when(n % 5 == 0, "Jane Doe").otherwise("Mirror Lake 1").alias("label"), F.lit("LKP").alias("kind"), (n * 2.2).alias("lat"), F.lit(10.0).alias("lng"), rings.alias("rings"), F.when(k % 3 != 0, "table").alias("ring_source"),
        F.when(k % 7 == 0, 5).otherwise(8).alias("sectors"), F.array(F.lit(25), F.when(n % 2 == 0, 60).otherwise(50)).alias("in_rings"), F.array(F.lit(50)).alias("trail_rings"), n.cast("double").alias("half_width"), F.lit(1000.0).alias("piece_length"), none.cast("double").alias("bearing"),
    )
    return searchmap.map_problems(requests).select("request_id", F.array_join("problems", "; ").alias("problems"))


@query("""WITH sp AS (SELECT s_suppkey AS id, s_suppkey * 37 % 1600 - 800e0 AS cx, s_suppkey * 53 % 1600 - 800e0 AS cy, 200e0 + s_suppkey * 7 % 700 AS h, s_suppkey % 3 = 0 AS lake FROM supplier),
rg AS (SELECT id, 1e0 AS w, [{'x': cx - h, 'y': cy - h}, {'x': cx + h, 'y': cy - h / 2}, {'x': cx + h, 'y': cy + h}, {'x': cx - h / 2, 'y': cy + h}] AS p FROM sp UNION ALL SELECT id, -1e0, [{'x': cx - h / 5, 'y': cy - h / 5}, {'x': cx + h / 5, 'y': cy - h / 5}, {'x': cx + h / 5, 'y': cy + h / 5}, {'x': cx - h / 5, 'y': cy + h / 5}] FROM sp WHERE lake),
ed AS (SELECT id, w, i, p[i].x AS ax, p[i].y AS ay, p[i % 4 + 1].x AS ex, p[i % 4 + 1].y AS ey FROM (SELECT *, unnest(range(1, 5)) AS i FROM rg)),
ray AS (SELECT k, 2 * pi() * k / 720 + 1.7e-8 AS f FROM (SELECT unnest(range(720)) AS k)),
tc AS (SELECT id, w, i, ax, ay, ex, ey, -(ax * sin(f) - ay * cos(f)) / ((ex - ax) * sin(f) - (ey - ay) * cos(f)) AS t FROM ed CROSS JOIN ray WHERE (ax * sin(f) - ay * cos(f)) * (ex * sin(f) - ey * cos(f)) < 0),
ts AS (SELECT * FROM tc UNION ALL SELECT *, 0e0 FROM ed UNION ALL SELECT *, 1e0 FROM ed),
sg AS (SELECT *, lead(t) OVER (PARTITION BY id, w, i ORDER BY t) AS t2 FROM ts),
pq AS (SELECT id, w, ax + (ex - ax) * t AS px, ay + (ey - ay) * t AS py, ax + (ex - ax) * t2 AS qx, ay + (ey - ay) * t2 AS qy FROM sg WHERE t2 > t),
wd AS (SELECT *, 2 * pi() / 720 * (floor((atan2(py + qy, px + qx) - 1.7e-8) / (2 * pi() / 720)) + 0.5e0) + 1.7e-8 AS m FROM pq),
cr AS (SELECT id, w, px, py, qx, qy, r, s, r * cos(pi() / 720) AS a, px * cos(m) + py * sin(m) AS np, qx * cos(m) + qy * sin(m) AS nq FROM wd CROSS JOIN (VALUES (350e0, 1e0), (600e0, -1e0), (1000e0, 1e0)) c(r, s)),
ar AS (SELECT id, w, s, CASE WHEN np <= a AND nq <= a THEN px * qy - qx * py WHEN np >= a AND nq >= a THEN (px * qy - qx * py) * (a / np) * (a / nq)
 WHEN np < a THEN (px * yy - xx * py) + (xx * qy - qx * yy) * (a / nq) ELSE (px * yy - xx * py) * (a / np) + (xx * qy - qx * yy) END / 2 AS v
 FROM (SELECT *, px + (qx - px) * (a - np) / nullif(nq - np, 0) AS xx, py + (qy - py) * (a - np) / nullif(nq - np, 0) AS yy FROM cr))
SELECT id AS geom_id, round(sum(w * s * v), 1) AS area_m2 FROM ar GROUP BY id HAVING sum(w * s * v) > 0.05e0""")
def q53b_areas_in_bands(spark, d):
    """The suppliers' four-sided areas, some with a lake, in two bands: the areas of all parts, worked out in SQL as integrals over the sides of the circles."""
    k, spot = F.col("s_suppkey"), lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    cx, cy, h = k * 37 % 1600 - 800.0, k * 53 % 1600 - 800.0, 200.0 + k * 7 % 700
    outer = F.array(spot(cx - h, cy - h), spot(cx + h, cy - h / 2), spot(cx + h, cy + h), spot(cx - h / 2, cy + h))
    lake = F.array(*[spot(cx + a * h / 5, cy + b * h / 5) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    rings = table(spark, d, "supplier").select(k.alias("geom_id"), F.posexplode(F.when(k % 3 == 0, F.array(outer, lake)).otherwise(F.array(outer))).alias("ring", "p"))
    areas = outlines.areas_in_bands(rings.select("geom_id", "ring", F.posexplode("p").alias("seq", "q")).select("geom_id", "ring", "seq", "q.*"), [(600.0, 1000.0), (0.0, 350.0)], crumb_m2=0.0)
    return rounded(areas.groupBy("geom_id").agg(F.sum("area_m2").alias("area_m2")).where("area_m2 > 0.05"), 1)
