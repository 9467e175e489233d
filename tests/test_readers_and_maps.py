"""Readers on texts with known contents, and search maps on requests with known faults."""

import json

import pytest
from pyspark.sql import functions as F

from cairngrid.functions import text as txt
from cairngrid.operators import outlines, searchmap
from cairngrid.sources import importers as imp


def frame(spark, ddl, rows):
    return spark.createDataFrame(rows, ddl)


def test_behaviour_csv_problems(spark):
    bad = ["hiker,flat,1,1,2,3", "skier,flat,2,3,2,4,5", "camper,any,3,1,2,3,4,5,,,", "child,any,1,1,2,3,4", "child,any,1,1,2,3,4"]
    got = imp.parse_behaviour_csv(frame(spark, "file string, line_no int, line string", [("bad", i + 1, x) for i, x in enumerate(bad)]))[1]
    assert sorted(tuple(r) for r in got.select("line_no", "problem").collect()) == [(1, "fewer than 7 cells"), (2, "ring distances must increase"), (3, "all four dispersions or none"), (4, "category and terrain occur twice"), (5, "category and terrain occur twice")]


def test_reader_fields(spark):
    notes = [(1, "Hiker last seen at 51.2034, -115.6120, heading north-east from the ridge. LKP"), (2, "Two skiers, bearing 215.5 degrees, 45.123 S 170.456 E"), (3, "Child walking towards the NW on flat farmland"), (4, None), (5, "travelling west-southwest; IPP 50.100 N 116.200 W")]
    df = frame(spark, "id int, t string", notes)
    got = df.select("id", *[c.alias(n) for n, c in txt.read_local(F.col("t")).items()]).orderBy("id").collect()
    assert [(r.lat, r.lng, r.point_kind, r.bearing, r.category, r.terrain) for r in got] == [(51.2034, -115.612, "LKP", 45.0, "hiker", "mountainous"), (-45.123, 170.456, None, 215.5, None, None), (None, None, None, 315.0, "child", "flat"), (None,) * 6, (50.1, -116.2, "IPP", 247.5, None, None)]


def test_coordinates(spark):
    rows = [(1, "51.2034, -115.6120"), (2, "N51 12.204 W115 36.720"), (3, "51 12 12.24 N, 115 36 43.2 W"), (4, "-115.612 51.2034"), (5, "nowhere"), (6, "31N 500000 0000000"), (7, "91, 10"), (8, "")]
    got = {r.id: (r.lat and round(r.lat, 6), r.lng and round(r.lng, 6), r.format) for r in txt.parse_coordinates(frame(spark, "id int, t string", rows), "id", "t").collect()}
    place = (51.2034, -115.612)
    assert got == {1: (*place, "decimal"), 2: (*place, "degrees-minutes"), 3: (*place, "degrees-minutes-seconds"), 4: (*place, "decimal"), 5: (None,) * 3, 6: (0.0, 3.0, "utm"), 7: (10.0, 91.0, "decimal"), 8: (None,) * 3}


def test_geojson_and_gpx(spark):
    feature = lambda i, kind, c, p: {"id": i, "type": "Feature", "geometry": {"type": kind, "coordinates": c}, "properties": p}
    doc = [
        {"id": "f0", "type": "Feature", "geometry": None, "properties": {"class": "Folder"}}, feature("a1", "Polygon", [[[0, 0], [0, 0], [1, 0], [1, 1], [0, 0]]], {"class": "Assignment", "letter": "A", "number": "7", "title": "north   side"}),
        feature("h", "Polygon", [[[0, 0], [9, 0], [9, 9]], [[1, 1], [2, 1], [2, 2]]], {}), feature("t", "LineString", [[0, 0, 5, 1700000000000], [1, 1, 5, 1700000060000]], {"class": "Track"}), feature("u", "LineString", [[0, 0], [1, 1]], {}), feature("m", "Point", [0, 0], {"class": "Marker"}),
    ]
    a, t, s = imp.import_geojson(frame(spark, "file string, text string", [("f", json.dumps({"type": "FeatureCollection", "features": doc}))]))
    assert [(r.source_id, r.label, len(r.points)) for r in a.collect()] == [("a1", "A7 north side", 3)] and t.count() == 2
    assert {r.source_id: r.reason for r in s.collect()} == {"h": "polygon with holes", "u": "line without times", "m": "not an assignment or a track"}
    gpx = '<gpx><trk><trkseg><trkpt lat="1" lon="2"><time>2024-01-01T00:00:00Z</time></trkpt><trkpt lat="1.1" lon="2"><time>2024-01-01T00:01:00Z</time></trkpt></trkseg><trkseg><trkpt lat="x" lon="2"><time>2024-01-01T00:00:00Z</time></trkpt></trkseg></trk></gpx>'
    p, s = imp.import_gpx(frame(spark, "file string, text string", [("f", gpx)]))
    assert sorted((r.source_id, r.x, r.y, r.t) for r in p.collect()) == [("trkseg 0", 2.0, 1.0, 1704067200000), ("trkseg 0", 2.0, 1.1, 1704067260000)] and [r.source_id for r in s.collect()] == ["trkseg 1"]


def test_trail_files_of_many_features(spark):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[k, 0], [k, 1]]}, "properties": {}} for k in range(21_500)]}
    lines, _ = imp.import_trails(frame(spark, "file string, text string", [("f", json.dumps(doc))]))
    assert lines.select("line").distinct().count() == 21_500


GOOD = {
    "request_id": 1, "label": "Test Lake 2026-07-18", "kind": "IPP", "lat": 51.2, "lng": -115.8, "rings": [(25.0, 0.5), (50.0, 1.0), (95.0, 3.0)], "ring_source": "test values", "category": None, "bearing": None, "dispersion": None, "dispersion_source": None,
    "sectors": None, "in_rings": None, "area_rings": None, "area_source": None, "trail_rings": None, "half_width": None, "piece_length": None, "pods": None, "pod_source": None,
}
DDL = ", ".join(f"{c} {k or 'int'}" for c, k in searchmap.COLUMNS.items())
POD = ("GROUND", "HIGH", "LOW", "MEDIUM")


def test_problems_of_requests(spark):
    cases = [
        ({}, []), ({"lat": 91.0}, ["latitude and longitude"]), ({"lng": None}, ["latitude and longitude"]), ({"kind": "XXX"}, ["IPP, LKP or PLS"]), ({"label": "  "}, ["1 to 40"]), ({"label": "x" * 41}, ["1 to 40"]), ({"label": "Jane Doe"}, ["person"]), ({"label": "Jane Doe Creek"}, []),
        ({"category": "Hiker!"}, ["subject category"]), ({"label": "call 403 555-1234"}, ["phone"]), ({"ring_source": " "}, ["ring source"]), ({"rings": []}, ["at least one"]), ({"rings": None}, ["at least one"]), ({"rings": [(0.0, 1.0)]}, ["ring 1: percent must"]), ({"rings": [(50.0, 201.0)]}, ["ring 1: distance"]),
        ({"rings": [(50.0, 2.0), (25.0, 3.0)]}, ["ring 2: percent and distance"]), ({"dispersion": [(50.0, 60.0)], "bearing": 10.0}, ["dispersion source"]), ({"dispersion": [(50.0, 60.0)], "dispersion_source": "s"}, ["direction of travel"]), ({"dispersion": [(50.0, 361.0)], "dispersion_source": "s", "bearing": 0.0}, ["dispersion 1: angle"]),
        ({"dispersion": [(60.0, 10.0)], "dispersion_source": "s", "bearing": 0.0}, ["dispersion 1: there is no 60% ring"]), ({"sectors": 5, "in_rings": [50.0]}, ["sectors must be"]), ({"sectors": 8, "in_rings": []}, ["segments: choose"]), ({"sectors": 8}, ["segments: choose"]), ({"sectors": 8, "in_rings": [75.0]}, ["segments: there is no 75% ring band"]),
        ({"area_rings": [75.0], "area_source": "s"}, ["area segments: there is no 75% ring band"]), ({"area_rings": [50.0], "area_source": " "}, ["source line"]), ({"trail_rings": [50.0], "half_width": 4.0, "piece_length": 50.0}, ["half-width", "piece length"]),
        ({"pods": {"R1-N": POD}}, ["PODs need a source"]), ({"pods": {"R1-N": ("ground", "HIGH", "NONE", "LOW")}, "pod_source": "s"}, ["LOW, MEDIUM or HIGH", "resource type"]),
    ]
    df = frame(spark, DDL, [tuple({**GOOD, **more, "request_id": i}[c] for c in searchmap.COLUMNS) for i, (more, _) in enumerate(cases)])
    got = {r.request_id: r.problems for r in searchmap.map_problems(df).collect()}
    for i, (more, want) in enumerate(cases):
        assert len(got[i]) == len(want) and all(w in g for g, w in zip(got[i], want, strict=True)), (more, got[i])
    with pytest.raises(Exception, match="latitude and longitude"):
        searchmap.search_maps(df.where("request_id = 1")).collect()


def test_whole_map_with_areas_and_trails(spark):
    request = {**GOOD, "bearing": 90.0, "dispersion": [(50.0, 90.0)], "dispersion_source": "d", "sectors": 4, "in_rings": [25.0, 95.0], "area_rings": [50.0], "area_source": "test polygons", "trail_rings": [50.0], "half_width": 50.0, "piece_length": 1000.0, "pods": {"R1-N": POD, "A-2": POD}, "pod_source": "planned"}
    df = frame(spark, DDL, [tuple(request[c] for c in searchmap.COLUMNS)])
    rect = lambda k, x0, x1: [("g", k, s, x, y) for s, (x, y) in enumerate([(x0, -2000.0), (x1, -2000.0), (x1, 2000.0), (x0, 2000.0)])]
    polygons = frame(spark, "geom_id string, ring int, seq int, x double, y double", [("w", 0, *r[2:]) for r in rect(0, -2000.0, 0.0)] + [("e", 0, *r[2:]) for r in rect(0, 0.0, 2000.0)])
    areas = outlines.areas_in_bands(polygons, [(500.0, 1000.0)]).select(F.lit(1).alias("request_id"), F.lit("area").alias("type"), "name", "rings")
    trail = frame(spark, "line_id string, seq int, x double, y double", [("T-1", 0, 600.0, 0.0), ("T-1", 1, 900.0, 0.0)])
    trails = outlines.corridor_outlines(trail, 50.0).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("ring", "points"))).alias("r")).select(F.lit(1).alias("request_id"), F.lit("trail").alias("type"), F.col("line_id").alias("name"), F.col("r.points").alias("rings"))
    maps = searchmap.search_maps(df, areas.unionByName(trails))
    rows = maps.orderBy("no").collect()
    assert [r.title for r in rows[:9]] == [*searchmap.FOLDERS, "IPP"] and [r.title for r in rows[9:13]] == ["25% 0.5 km", "50% 1 km", "95% 3 km", "50% dispersion 90°"]
    assert [r.title for r in rows[13:]] == [f"R{i}-{s}" for i in (1, 3) for s in "NESW"] + ["A-1", "A-2", "T-1"] and len({r.id for r in rows}) == len(rows)
    props = {r.title: json.loads(r.properties) for r in rows}
    assert props["A-2"] == {"class": "Assignment", "title": "A-2", "letter": "A-2", "status": "DRAFT", "resourceType": "GROUND", "responsivePOD": "HIGH", "unresponsivePOD": "LOW", "cluePOD": "MEDIUM", "stroke": "#FF0000", "stroke-width": 2, "stroke-opacity": 1.0, "pattern": "solid", "fill": "#FF0000", "fill-opacity": 0.05, "folderId": searchmap.FOLDERS[searchmap.SEGMENTS]}
    assert props["IPP"]["marker-symbol"] == "cp" and props["T-1"]["stroke"] == "#0000FF" and "fill" not in props["50% 1 km"] and props["2 - Clues"] == {"class": "Folder", "title": "2 - Clues", "visible": False, "labelVisible": True}
    assert "responsivePOD" not in props["A-1"] and "description" not in props["A-1"]
    ring = next(r for r in rows if r.title == "A-1").coordinates[0]
    assert ring[0] == ring[-1] and all(abs(p[0] + 115.8) < 0.02 and abs(p[1] - 51.2) < 0.02 for p in ring)
    again = {r.title: r.id for r in searchmap.search_maps(df, areas.unionByName(trails)).collect()}
    assert again == {r.title: r.id for r in rows}
    lines = [json.loads(r.value) for r in searchmap.to_geojson(maps).orderBy("no").collect()]
    assert lines[0]["geometry"] is None and lines[8]["geometry"] == {"type": "Point", "coordinates": [-115.8, 51.2, 0.0, 0.0]} and len(lines[9]["geometry"]["coordinates"]) == 73
    note = searchmap.provenance(df).first().provenance
    assert note.startswith(searchmap.MODE_NOTE + " Case: Test Lake 2026-07-18. Rings: test values Dispersion around 90° true: d Segment PODs are planned, not achieved: planned Area segments follow ridges, creeks and lakes: test polygons Trail segments: 50 m either side")
    assert note.endswith("about 1 km long. (search maps 1)")
    assert df.select(searchmap.file_name(F.col("label")).alias("n")).first().n == "Test_Lake_2026-07-18_TRAINING_search_map.json"
