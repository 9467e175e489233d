import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairngrid.functions import text as txt
from cairngrid.operators import security, tracks, trails, versions
from cairngrid.sources import importers as imp


def pts(spark, rows, track=1):
    return spark.createDataFrame([(track, i, float(x), float(y), int(t)) for i, (x, y, t) in enumerate(rows)], "track_id long, seq long, x double, y double, t long")


def test_clean_and_split(spark):
    p = pts(spark, [(0, 0, 0), (60, 0, 30_000), (5000, 0, 60_000), (120, 0, 90_000), (180, 0, 460_000)])
    r = tracks.assess_tracks(p).first()
    assert r.quality == "suspect" and r.n_gaps == 1 and 2 in r.jumps
    kept = tracks.clean_tracks(p)
    assert sorted(x.seq for x in kept.collect()) == [0, 1, 3, 4]
    assert tracks.split_at_gaps(kept).count() == 3


def legs(parts):
    x = t = 0.0
    rows = [(0, 0, 0)]
    for seconds, speed in parts:
        for _ in range(seconds // 5):
            t, x = t + 5, x + speed * 5
            rows.append((x, 0, t * 1000))
    return rows


@pytest.mark.parametrize(("parts", "kinds"), [([(600, 1), (300, 10), (300, 0), (600, 1)], ["foot", "vehicle", "stationary", "foot"]), ([(600, 1), (30, 0), (600, 1)], ["foot"]), ([(900, 0)], ["stationary"])])
def test_segments(spark, parts, kinds):
    got = tracks.segment_tracks(pts(spark, legs(parts))).orderBy("segment").collect()
    assert [r.kind for r in got] == kinds


def test_upper_median(spark):
    assert tracks.median_speed(pts(spark, [(0, 0, 0), (1, 0, 1000), (3, 0, 2000), (6, 0, 3000), (10, 0, 4000)])).first().median_speed == 3


def test_cost_goes_round_a_wall(spark):
    wall = {2, 7}
    cells = spark.createDataFrame([(1, i, None if i in wall else 1.0) for i in range(15)], "grid_id int, cell_id long, mult double")
    got = {r.cell_id: r.cost for r in trails.cost_distance(cells, spark.createDataFrame([(1, 0)], "grid_id int, cell_id long"), 5, 10.0).collect()}
    assert got[2] == float("inf") and got[4] > 40 and got[12] < float("inf") and got[6] == pytest.approx(10 * 2**0.5)


def test_split_and_clip(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 2500.0, 0.0)], "line_id int, seq int, x double, y double")
    got = trails.split_evenly(line, 1000.0).orderBy("piece").collect()
    assert [round(r.length, 3) for r in got] == [833.333] * 3 and got[-1].x1 == 2500
    parts = trails.clip_to_band(line, 500.0, 1000.0).orderBy("seq").collect()
    assert [(r.x, r.y) for r in parts] == [(500.0, 0.0), (1000.0, 0.0)]


def test_join_lines(spark):
    rows = [("f", 1, 0, 0.0), ("f", 1, 1, 10.0), ("f", 2, 0, 20.0), ("f", 2, 1, 10.0), ("f", 3, 0, 50.0), ("f", 3, 1, 60.0)]
    df = spark.createDataFrame(rows, "file string, line_id int, seq int, x double").withColumn("y", F.lit(0.0))
    got = trails.join_lines(df, "file").orderBy("joined", "seq").collect()
    assert [(r.joined, r.x) for r in got] == [(1, 0.0), (1, 10.0), (1, 20.0), (3, 50.0), (3, 60.0)]


def test_store(spark, tmp_path):
    s = versions.SurfaceStore(spark, str(tmp_path / "s"))
    surf = lambda a: spark.createDataFrame([(0, a, 0.2), (1, 0.8 - a, 0.2)], "cell_id long, p double, outside double")
    prior = s.commit(surf(0.4), "i", "prior", "me")
    a = s.commit(surf(0.5), "i", "update", "me", 0.9, prior["surface_id"], "a clue was found")
    b = s.commit(surf(0.3), "i", "update", "me", 0.9, prior["surface_id"], "another clue was found")
    c = s.rollback("i", prior["surface_id"], a["surface_id"], "me", "the clue was wrong")
    assert (a["divergent"], b["divergent"], c["iteration"]) == (False, True, 2)
    assert {r.surface_id for r in s.heads("i").collect()} == {b["surface_id"], c["surface_id"]} and s.history("i").count() == 4
    assert c["values_hash"] == prior["values_hash"] and s.lock(a["surface_id"], "t1") == s.lock(a["surface_id"], "t2") == "t1"
    assert versions.lineage_problems(s.records).count() == 0
    for bad in (dict(kind="update", parent_id=None), dict(kind="prior", parent_id=None, z=0.0), dict(kind="update", parent_id="nobody", rationale="x" * 12)):
        with pytest.raises(ValueError):
            s.commit(surf(0.4), "i", created_by="me", **bad)
    with pytest.raises(ValueError):
        s.commit(spark.createDataFrame([(0, 0.9, 0.2)], "cell_id long, p double, outside double"), "i", "prior", "me")


def test_codec_and_hashes():
    v = np.array([0.1, 0.7])
    assert versions.decode_surface(versions.encode_surface(v, 0.2), 2)[1] == 0.2
    assert versions.values_from_base64(versions.values_to_base64(v, 0.2))[0].tolist() == v.tolist()
    with pytest.raises(ValueError):
        versions.decode_surface(versions.encode_surface(v, 0.2), 3)
    assert versions.canonical_json({"b": 1.0, "a": [float("nan"), 0.5]}) == '{"a":[{"$nonFinite":"NaN"},0.5],"b":1}'
    assert versions.hash_values(v, 0.2) != versions.hash_values(v, 0.3)


def test_access(spark):
    incidents = spark.createDataFrame([("i1", "2024-01-02"), ("i2", "2024-01-02")], "incident_id string, c string").select("incident_id", F.col("c").cast("timestamp").alias("cutoff"))
    members = spark.createDataFrame([("i1", "u")], "incident_id string, user_id string")
    clues = spark.createDataFrame([("i1", "2024-01-02", "x"), ("i1", "2024-01-03", "x"), ("i2", "2024-01-01", "x")], "incident_id string, a string, restricted_payload_ciphertext string").withColumn("available_at", F.col("a").cast("timestamp"))
    see = lambda user, role: security.secured_inputs(clues, incidents, members, user, role)
    assert see("u", "trainee").count() == 1 and see("v", "trainee").count() == 0 and see("e", "evaluator").count() == 3 and see("u", None).count() == 0
    assert "restricted_payload_ciphertext" not in see("e", "evaluator").columns
    users = spark.createDataFrame([("u", "trainee", True), ("x", "trainee", False)], "user_id string, role string, active boolean")
    roles = spark.createDataFrame([("trainee", True)], "role string, enabled boolean")
    assert security.current_role(users, roles, "u") == "trainee" and security.current_role(users, roles, "x") is None


def test_redaction():
    t = "Jane Doe (555-123-4567, jane@mail.example.org) has dementia and takes medication. Dr. Smith called. Last seen near Lake Louise."
    text, phones, mails, names, health = txt.redact_text(t)
    assert (phones, mails, names, health) == (1, 1, 2, 2) and "Lake Louise" in text and "Jane" not in text
    assert txt.redact_text("11U 594123 5677123 and 51.2034, -115.6120")[1] == 0


def test_reply_and_coordinates():
    fields, gone = txt.parse_reply('```json\n{"lat": 51, "lng": 500, "pointKind": "IPP", "x": 1}\n```')
    assert fields == {"pointKind": "IPP"} and set(gone) == {"lng", "x", "lat"}
    c = txt.parse_coordinate("11U 594123 5677123")
    assert c["format"] == "utm" and 51 < c["lat"] < 52 and -116 < c["lng"] < -115
    assert txt.utm_to_latlng(31, 500_000, 4_649_776.22)[1] == pytest.approx(3) and txt.utm_to_latlng(31, 500_000, 4_649_776.22)[0] == pytest.approx(42, abs=1e-6)
    assert "error" in txt.parse_coordinate("51 60 0, 1 2 3") and txt.parse_coordinate("45.5 S, 170 E")["lat"] == -45.5


def test_documents(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One &amp; two</w:t></w:p><w:p><w:tab/><w:t>three</w:t></w:p>")
    rows = [("a.docx", b.getvalue()), ("b.rtf", rb"{\rtf1{\*\x y}caf\'e9\par two}"), ("c.pdf", b"%PDF"), ("d.docx", b"junk")]
    got = {r.name: (r.text, r.problem) for r in imp.read_documents(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert got["a.docx"][0] == "One & two\n\tthree" and got["b.rtf"][0] == "café\ntwo" and got["c.pdf"][1] and got["d.docx"][1]


def test_trails_without_times(spark):
    gpx = '<gpx><rte><rtept lat="1" lon="2"/><rtept lat="2" lon="2"/></rte><trk><trkseg><trkpt lat="5" lon="6"/><trkpt lat="6" lon="6"/></trkseg><trkseg><trkpt lat="5" lon="6"/></trkseg></trk></gpx>'
    geo = '{"type":"Feature","geometry":{"type":"MultiLineString","coordinates":[[[0,0],[1,1]],[[2,2],[3,3]]]},"properties":{}}'
    lines, skipped = imp.import_trails(spark.createDataFrame([("g", gpx), ("j", geo)], "file string, text string"))
    got = sorted((r.file, r.line, r.points[0].lat) for r in lines.collect())
    assert [x[2] for x in got if x[0] == "g"] == [5.0, 1.0] and [x[2] for x in got if x[0] == "j"] == [0.0, 2.0]
    assert [(r.file, r.skipped) for r in skipped.collect()] == [("g", 1)]
