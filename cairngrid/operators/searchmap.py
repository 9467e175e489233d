"""Search maps from a table of requests: a planning point with range rings, dispersion wedges, sector, area and trail segments as map features.

A request is one row. Its columns, all but the first six optional (left out or null): ``request_id``, ``label``, ``kind`` (of the planning point), ``lat``, ``lng``,
``rings`` array<struct<percent, km>>, ``ring_source``, ``category``, ``bearing``, ``dispersion`` array<struct<percent, degrees>>, ``dispersion_source``, ``sectors`` and
``in_rings`` array<int> (a band is named by its outer ring's percent), ``area_rings``, ``area_source``, ``trail_rings``, ``half_width``, ``piece_length``,
``pods`` map<name, struct<resource, responsive, unresponsive, clue>> and ``pod_source``. Any number of requests is worked out in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairngrid.functions import spherical as sph

# The template's folder titles and their ids, in the template's order.
FOLDERS = {
    "1 - Important Points": "bfae8b57-66c1-4f19-b300-fa67d2dc0cf1",
    "2 - Clues": "49a8bc63-d833-4caa-a4b1-34a287dde302",
    "3 - Range rings and Dispersion angles": "296a4f7d-82c4-48b7-944d-d3fd610e4aeb",
    "4 - Op 1 Air Tracks": "9dbbeff9-63bd-4eea-84d6-007fcdb1300d",
    "5 - OP 1 Ground Tracks": "2105ac92-0106-4225-a9fb-ee132565047a",
    "6 - Air Assignments": "dab108f2-73da-4e1c-849f-f42aef09155b",
    "7 - Ground Assignments": "233a79cd-fd46-4a51-a1a1-ecc51605a192",
    "8 - Unassigned Segments": "458ef425-d0f7-45f3-9712-d1d1008d9f5e",
}
POINTS, RANGES, SEGMENTS = ("1 - Important Points", "3 - Range rings and Dispersion angles", "8 - Unassigned Segments")
SHOWN = ("6 - Air Assignments", "7 - Ground Assignments", "8 - Unassigned Segments")
# Stroke colour, stroke width, stroke opacity, fill opacity of each kind of feature; fills have the stroke's colour.
STYLES = {"ring": ("#00FF00", 4, 0.8, None), "wedge": ("#FFAA00", 2, 1.0, 0.15), "trail": ("#0000FF", 2, 1.0, 0.1), "segment": ("#FF0000", 2, 1.0, 0.05)}
# Words that make two capitalised words a place and not a person.
PLACES = "Lake Canyon Creek River Mountain Mount Peak Pass Valley Trail Glacier Falls Ridge Park".split()
SECTOR_COUNTS = (4, 8, 12, 16)
VERSION = "search maps 1"
MODE_NOTE = "Generated in training and research mode. Not approved for operational use."
RING, WEDGE, POD = "array<struct<percent:double,km:double>>", "array<struct<percent:double,degrees:double>>", "map<string,struct<resource:string,responsive:string,unresponsive:string,clue:string>>"
COLUMNS = {
    "request_id": None, "label": "string", "kind": "string", "lat": "double", "lng": "double", "rings": RING, "ring_source": "string", "category": "string", "bearing": "double", "dispersion": WEDGE,
    "dispersion_source": "string", "sectors": "int", "in_rings": "array<double>", "area_rings": "array<double>", "area_source": "string", "trail_rings": "array<double>", "half_width": "double",
    "piece_length": "double", "pods": POD, "pod_source": "string",
}


def _complete(requests: DataFrame) -> DataFrame:
    """All columns of a request, with their types; missing ones are null."""
    have = {c.lower() for c in requests.columns}
    return requests.select(*[(F.col(c) if kind is None else F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)).alias(c) for c, kind in COLUMNS.items()])


def _number(c: Column) -> Column:
    """A number as text, whole ones without a point."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _given(c: str) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def _band_problems(what: str, chosen: str) -> Column:
    unknown = F.filter(chosen, lambda p: ~F.exists("rings", lambda r: r["percent"] == p))
    told = F.transform(unknown, lambda p: F.concat(F.lit(f"{what}: there is no "), _number(p), F.lit("% ring band")))
    return F.when(F.col(chosen).isNotNull() & (F.size(chosen) == 0), F.array(F.lit(f"{what}: choose at least one ring band"))).otherwise(told)


def map_problems(requests: DataFrame) -> DataFrame:
    """(request_id, problems): what keeps each request from being drawn, in the order of its fields; an empty array where nothing does.

    Null is as bad as blank for label, kind, coordinates, rings and sources. A label names a place and a date, never a person: two capitalised words in a
    row without a place word, or ten digits like a phone number, are refused.
    """
    df = _complete(requests)
    if_ = lambda bad, text: F.when(F.coalesce(bad, F.lit(True)), F.array(F.lit(text) if isinstance(text, str) else text))
    ok_ring = lambda i: F.concat(F.lit("ring "), (i + 1).cast("string"))
    before = lambda i: F.get("rings", i - 1)
    each_ring = F.flatten(
        F.transform(
            "rings",
            lambda r, i: F.array_compact(
                F.array(
                    F.when(~F.coalesce((r["percent"] > 0) & (r["percent"] < 100), F.lit(False)), F.concat(ok_ring(i), F.lit(": percent must be between 0 and 100"))),
                    F.when(~F.coalesce((r["km"] > 0) & (r["km"] <= 200), F.lit(False)), F.concat(ok_ring(i), F.lit(": distance must be between 0 and 200 km"))),
                    F.when((i > 0) & ~F.coalesce((r["percent"] > before(i)["percent"]) & (r["km"] > before(i)["km"]), F.lit(False)), F.concat(ok_ring(i), F.lit(": percent and distance must both increase"))),
                )
            ),
        )
    )
    wedge = lambda i: F.concat(F.lit("dispersion "), (i + 1).cast("string"))
    each_wedge = F.flatten(
        F.transform(
            "dispersion",
            lambda w, i: F.array_compact(
                F.array(
                    F.when(~F.coalesce((w["degrees"] > 0) & (w["degrees"] <= 360), F.lit(False)), F.concat(wedge(i), F.lit(": angle must be between 0 and 360 degrees"))),
                    F.when(~F.exists("rings", lambda r: r["percent"] == w["percent"]), F.concat(wedge(i), F.lit(": there is no "), _number(w["percent"]), F.lit("% ring to set its length"))),
                )
            ),
        )
    )
    pods = F.map_entries("pods")
    level = lambda c: F.coalesce(c.isin("LOW", "MEDIUM", "HIGH"), F.lit(False))
    each_pod = F.flatten(
        F.transform(
            pods,
            lambda p: F.array_compact(
                F.array(
                    F.when(~(level(p["value"]["responsive"]) & level(p["value"]["unresponsive"]) & level(p["value"]["clue"])), F.concat(F.lit("segment "), p["key"], F.lit(": POD must be LOW, MEDIUM or HIGH"))),
                    F.when(~F.coalesce(p["value"]["resource"].rlike("^[A-Z_]{2,20}$"), F.lit(False)), F.concat(F.lit("segment "), p["key"], F.lit(": resource type must be a name such as GROUND"))),
                )
            ),
        )
    )
    label, trails = F.col("label"), F.col("trail_rings").isNotNull()
    person = label.rlike(r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b") & ~label.rlike(rf"({'|'.join(PLACES)})\b")
    checks = [
        if_(~(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180)), "planning point must be a valid latitude and longitude"),
        if_(~F.coalesce(F.col("kind").isin("IPP", "LKP", "PLS"), F.lit(False)), "planning point must be an IPP, LKP or PLS"),
        if_(_blank("label") | (F.length("label") > 40), "label must be 1 to 40 characters"),
        F.when(person, F.array(F.lit("label looks like a person's name; use a place and date instead"))),
        F.when(~F.col("category").rlike(r"^[a-z0-9][a-z0-9 ,()/-]{0,39}$"), F.array(F.lit("subject category must be a short lower-case name such as hiker"))),
        F.when(label.rlike(r"\d{3}[\s.-]?\d{3}[\s.-]?\d{4}"), F.array(F.lit("label looks like it contains a phone number"))),
        if_(_blank("ring_source"), "ring source is required: name the table and subject category the distances come from"),
        if_(~_given("rings"), "at least one range ring is required"),
        each_ring,
        F.when(_given("dispersion") & _blank("dispersion_source"), F.array(F.lit("dispersion source is required when dispersion angles are given"))),
        F.when(_given("dispersion") & ~F.coalesce((F.col("bearing") >= 0) & (F.col("bearing") < 360), F.lit(False)), F.array(F.lit("dispersion angles need a direction of travel between 0 and 359 degrees"))),
        each_wedge,
        F.when(F.col("in_rings").isNotNull() & ~F.coalesce(F.col("sectors").isin(*SECTOR_COUNTS), F.lit(False)), F.array(F.lit("segments: sectors must be 4, 8, 12 or 16"))),
        F.when(F.col("sectors").isNotNull() & F.col("in_rings").isNull(), F.array(F.lit("segments: choose at least one ring band"))),
        _band_problems("segments", "in_rings"),
        _band_problems("area segments", "area_rings"),
        F.when(F.col("area_rings").isNotNull() & _blank("area_source"), F.array(F.lit("area segments need a source line"))),
        _band_problems("trails", "trail_rings"),
        F.when(trails & ~F.coalesce(F.col("half_width").between(5, 1000), F.lit(False)), F.array(F.lit("trails: corridor half-width must be 5 to 1000 m"))),
        F.when(trails & ~F.coalesce(F.col("piece_length").between(100, 20_000), F.lit(False)), F.array(F.lit("trails: piece length must be 100 m to 20 km"))),
        F.when(F.coalesce(F.size("pods") > 0, F.lit(False)) & _blank("pod_source"), F.array(F.lit("segment PODs need a source line"))),
        each_pod,
    ]
    return df.select("request_id", F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in checks])).alias("problems"))


def _quoted(c: Column) -> Column:
    """A string as JSON."""
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _canonical() -> Column:
    """A request as JSON with sorted keys, without its shapes, so that equal requests get equal ids."""
    numbers = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, _number), ","), F.lit("]"))
    pair = lambda name, value, there=None: F.when(F.col(there or name).isNotNull(), F.concat(F.lit(f'"{name}":'), value))
    both = lambda c, one, a, two, b: F.concat(F.lit("["), F.array_join(F.transform(c, lambda r: F.concat(F.lit(f'{{"{one}":'), _number(r[a]), F.lit(f',"{two}":'), _number(r[b]), F.lit("}"))), ","), F.lit("]"))
    place = F.concat(F.lit('{"kind":'), _quoted(F.col("kind")), F.lit(',"lat":'), _number(F.col("lat")), F.lit(',"lng":'), _number(F.col("lng")), F.lit("}"))
    parts = [
        pair("areas", F.concat(F.lit('{"inRings":'), numbers("area_rings"), F.lit(',"source":'), _quoted(F.col("area_source")), F.lit("}")), "area_rings"),
        pair("dispersion", both("dispersion", "angleDeg", "degrees", "percent", "percent")),
        pair("dispersionSource", _quoted(F.col("dispersion_source")), "dispersion_source"),
        pair("label", _quoted(F.col("label"))),
        F.concat(F.lit('"planningPoint":'), place),
        pair("ringSource", _quoted(F.col("ring_source")), "ring_source"),
        pair("rings", both("rings", "distanceKm", "km", "percent", "percent")),
        pair("segmentPodSource", _quoted(F.col("pod_source")), "pod_source"),
        pair("segmentPods", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("pods")))), "pods"),
        pair("segments", F.concat(F.lit('{"inRings":'), numbers("in_rings"), F.lit(',"sectors":'), F.col("sectors").cast("string"), F.lit("}")), "in_rings"),
        pair("subjectCategory", _quoted(F.col("category")), "category"),
        pair("trails", F.concat(F.lit('{"halfWidthM":'), _number(F.col("half_width")), F.lit(',"inRings":'), numbers("trail_rings"), F.lit(',"pieceLengthM":'), _number(F.col("piece_length")), F.lit("}")), "trail_rings"),
        pair("travelBearingDeg", _number(F.col("bearing")), "bearing"),
    ]
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}"))


def feature_id(seed: Column, key: Column) -> Column:
    """An id of UUID form from the request's hash and the feature's key."""
    h = F.sha2(F.concat(F.lit('"'), seed, F.lit(":"), key, F.lit('"')), 256)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def provenance(requests: DataFrame) -> DataFrame:
    """(request_id, provenance): the one note of each map: mode, case, sources and version. No feature carries a description."""
    df = _complete(requests)
    line = lambda there, *parts: F.when(there, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    c = F.col
    lines = [
        F.lit(MODE_NOTE),
        F.concat(F.lit("Case: "), c("label"), F.lit(".")),
        F.concat(F.lit("Rings: "), c("ring_source")),
        line(_given("dispersion"), "Dispersion around ", _number(c("bearing")), "° true: ", c("dispersion_source")),
        line(F.size("pods") > 0, "Segment PODs are planned, not achieved: ", c("pod_source")),
        line(c("area_rings").isNotNull(), "Area segments follow ridges, creeks and lakes: ", c("area_source")),
        line(c("trail_rings").isNotNull(), "Trail segments: ", _number(c("half_width")), " m either side of trails from the planner's file, about ", sph.format_km(c("piece_length") / 1000), " km long."),
        F.lit(f"({VERSION})"),
    ]
    return df.select("request_id", F.concat_ws(" ", *lines).alias("provenance"))


def _sector(s: Column) -> Column:
    return F.when(F.col("sectors") == 8, sph.sector_name(s, 8)).when(F.col("sectors") == 4, sph.sector_name(s, 4)).otherwise(sph.sector_name(s, 12))


def search_maps(requests: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """(request_id, no, id, folder, class, title, geometry, coordinates, properties): all features of all maps, in the order of their files.

    First the template's eight folders, then the planning point, rings, wedges and the sectors of the chosen bands; then ``shapes`` (request_id, type "area"
    or "trail", name, rings array<array<struct<x,y>>> in metres around the planning point, outer ring first), areas before trails, each by the number in its
    name. ``coordinates`` are rings of (lng, lat, 0, 0) with seven decimals: one ring for a line, one of one point for a marker. ``properties`` is JSON. The same request gives
    the same ids. A request with problems raises an error that names them; ``map_problems`` tells them beforehand.
    """
    told = map_problems(requests).where(F.size("problems") > 0).select(F.col("request_id").alias("r_"), "problems")
    df = sph.spread(_complete(requests), "request_id").join(told, F.col("request_id") == F.col("r_"), "left")
    bad = F.raise_error(F.concat(F.lit("request "), F.col("request_id").cast("string"), F.lit(": "), F.array_join("problems", "; "))).cast("string")
    df = df.withColumn("seed", F.when(F.col("problems").isNotNull(), bad).otherwise(F.sha2(_canonical(), 256)))

    def feature(kind: str, key, title, folder: str, inner=0.0, outer=0.0, a=0.0, b=0.0) -> Column:
        col = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
        return F.struct(F.lit(kind).alias("type"), col(key, "string").alias("key"), col(title, "string").alias("title"), F.lit(folder).alias("folder"), *[col(v, "double").alias(n) for n, v in (("inner", inner), ("outer", outer), ("a", a), ("b", b))])

    none = F.array().cast("array<struct<type:string,key:string,title:string,folder:string,inner:double,outer:double,a:double,b:double>>")
    folders = F.array(*[feature("folder", f, f, f) for f in FOLDERS])
    point = F.array(feature("point", "planning-point", F.col("kind"), POINTS))
    rings = F.transform("rings", lambda r: feature("ring", F.concat(F.lit("ring:"), _number(r["percent"])), F.concat(_number(r["percent"]), F.lit("% "), sph.format_km(r["km"]), F.lit(" km")), RANGES, outer=r["km"] * 1000))
    reach = lambda p: F.get(F.filter("rings", lambda r: r["percent"] == p), F.lit(0))["km"] * 1000
    wedges = F.transform("dispersion", lambda w: feature("wedge", F.concat(F.lit("wedge:"), _number(w["percent"])), F.concat(_number(w["percent"]), F.lit("% dispersion "), _number(w["degrees"]), F.lit("°")), RANGES, 0.0, reach(w["percent"]), F.col("bearing") - w["degrees"] / 2, F.col("bearing") + w["degrees"] / 2))
    bands = F.filter(F.transform("rings", lambda r, i: F.struct(i.alias("i"), r["percent"].alias("percent"), (r["km"] * 1000).alias("outer"), F.coalesce(F.get("rings", i - 1)["km"] * 1000, F.lit(0.0)).alias("inner"))), lambda r: F.array_contains("in_rings", r["percent"]))
    name = lambda r, s: F.concat(F.lit("R"), (r["i"] + 1).cast("string"), F.lit("-"), _sector(s))
    width = F.lit(360.0) / F.col("sectors")
    sectors = F.flatten(F.transform(bands, lambda r: F.transform(F.sequence(F.lit(0), F.col("sectors") - 1), lambda s: feature("segment", F.concat(F.lit("segment:"), name(r, s)), name(r, s), SEGMENTS, r["inner"], r["outer"], s * width - width / 2, s * width + width / 2))))
    every = F.concat(folders, point, rings, F.coalesce(wedges, none), F.coalesce(sectors, none))
    rows = df.select("request_id", "seed", "lat", "lng", "pods", F.posexplode(every).alias("no", "f")).select("request_id", "seed", "lat", "lng", "pods", "no", "f.*")
    lat, lng = F.col("lat"), F.col("lng")
    spot = F.array(F.struct(sph.round_half_up(lat).alias("lat"), sph.round_half_up(lng).alias("lng")))
    wedge = F.concat(spot, sph.arc(lat, lng, F.col("outer"), F.col("a"), F.col("b")), spot)
    line = F.when(F.col("type") == "point", spot).when(F.col("type") == "ring", sph.ring_line(lat, lng, F.col("outer"))).when(F.col("type") == "wedge", wedge).when(F.col("type") == "segment", sph.sector_polygon(lat, lng, F.col("inner"), F.col("outer"), F.col("a"), F.col("b")))
    four = lambda c: F.transform(c, lambda p: F.array(p["lng"], p["lat"], F.lit(0.0), F.lit(0.0)))
    rows = rows.select("request_id", "seed", "pods", "type", "key", "title", "folder", F.col("no").cast("long").alias("no"), F.when(F.col("type") != "folder", F.array(four(line))).alias("coordinates"))
    if shapes is not None:
        base = F.size("rings") + F.coalesce(F.size("dispersion"), F.lit(0)) + F.coalesce(F.size("in_rings") * F.col("sectors"), F.lit(0)) + len(FOLDERS) + 1

        def placed(ring):
            def at(p):
                la, lo = sph.to_lnglat(p["x"], p["y"], lat, lng)
                return F.array(sph.round_half_up(lo), sph.round_half_up(la), F.lit(0.0), F.lit(0.0))

            return F.transform(ring, at)

        more = shapes.select("request_id", "type", F.col("name").alias("title"), F.col("rings").alias("outline")).join(df.drop("problems", "r_"), "request_id")
        number = F.regexp_extract("title", r"(\d+)$", 1).cast("long") + F.when(F.col("type") == "trail", 1 << 40).otherwise(0)
        rows = rows.unionByName(more.select("request_id", "seed", "pods", "type", F.concat("type", F.lit(":"), "title").alias("key"), "title", F.lit(SEGMENTS).alias("folder"), (base + number).alias("no"), F.transform("outline", placed).alias("coordinates")))
    kind = F.col("type")
    assignment, shape = kind.isin("segment", "area", "trail"), kind.isin("ring", "wedge")
    ids = F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair])
    style = F.create_map(*[x for n, (colour, w, stroke, fill) in {**STYLES, "area": STYLES["segment"]}.items() for x in (F.lit(n), F.struct(F.lit(colour).alias("colour"), F.lit(w).alias("width"), F.lit(stroke).alias("stroke"), F.lit(fill).cast("double").alias("fill")))])
    look = F.try_element_at(style, kind)
    pod = F.try_element_at("pods", F.col("title"))
    marker = lambda v: F.when(kind == "point", F.lit(v))
    cls = F.when(kind == "folder", "Folder").when(kind == "point", "Marker").when(shape, "Shape").otherwise("Assignment")
    fields = {
        "class": cls, "title": F.col("title"), "visible": F.when(kind == "folder", F.col("folder").isin(*SHOWN)), "labelVisible": F.when(kind == "folder", F.lit(True)),
        "marker-symbol": marker("cp"), "marker-color": marker("#ff0000"), "marker-size": marker(1), "marker-rotation": marker(0),
        "letter": F.when(assignment, F.col("title")), "status": F.when(assignment, "DRAFT"), "resourceType": F.when(assignment, F.coalesce(pod["resource"], F.lit("GROUND"))),
        "responsivePOD": F.when(assignment, pod["responsive"]), "unresponsivePOD": F.when(assignment, pod["unresponsive"]), "cluePOD": F.when(assignment, pod["clue"]),
        "stroke": look["colour"], "stroke-width": look["width"], "stroke-opacity": look["stroke"], "pattern": F.when(look.isNotNull(), "solid"),
        "fill": F.when(look["fill"].isNotNull(), look["colour"]), "fill-opacity": look["fill"], "folderId": F.when(kind != "folder", F.try_element_at(ids, F.col("folder"))),
    }
    geometry = F.when(kind == "point", "Point").when(kind == "ring", "LineString").when(kind != "folder", "Polygon")
    own = F.when(kind == "folder", F.try_element_at(ids, F.col("folder"))).otherwise(feature_id(F.col("seed"), F.col("key")))
    return rows.select("request_id", "no", own.alias("id"), "folder", cls.alias("class"), "title", geometry.alias("geometry"), "coordinates", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("properties"))


def to_geojson(features: DataFrame) -> DataFrame:
    """(request_id, no, value): one GeoJSON feature per row."""
    first = F.get("coordinates", F.lit(0))
    c = F.when(F.col("geometry") == "Polygon", F.to_json("coordinates")).when(F.col("geometry") == "Point", F.to_json(F.get(first, F.lit(0)))).otherwise(F.to_json(first))
    geometry = F.when(F.col("geometry").isNull(), F.lit("null")).otherwise(F.concat(F.lit('{"type":"'), F.col("geometry"), F.lit('","coordinates":'), c, F.lit("}")))
    return features.select("request_id", "no", F.concat(F.lit('{"type":"Feature","id":"'), F.col("id"), F.lit('","geometry":'), geometry, F.lit(',"properties":'), F.col("properties"), F.lit("}")).alias("value"))


def file_name(label: Column) -> Column:
    """A map's file name, with the mode in it."""
    safe = F.regexp_replace(F.regexp_replace(label, r"[^A-Za-z0-9_-]+", "_"), "_+", "_")
    return F.concat(F.substring(safe, 1, 40), F.lit("_TRAINING_search_map.json"))
