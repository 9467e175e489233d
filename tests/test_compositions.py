import re

import pytest
from pyspark.sql import functions as F

from cairngrid.functions import text as txt
from cairngrid.functions.geometry import Grid
from cairngrid.operators import pod, preview, priors, security, updates

TEN = Grid(0, 0, 100, 10, 10)


def surf(spark, values, outside):
    return spark.createDataFrame([(i, float(v), float(outside)) for i, v in enumerate(values)], "cell_id long, p double, outside double")


def test_chained_updates_equal_single_ones_and_read_the_prior_twice(spark, tmp_path):
    path = str(tmp_path / "prior")
    surf(spark, [0.1, 0.2, 0.3, 0.2], 0.2).write.parquet(path)
    prior = spark.read.parquet(path)
    fields = [(spark.createDataFrame([(i, 0.5 + i * k) for i in range(4)], "cell_id long, lr double"), 0.9 + 0.05 * k) for k in range(1, 6)]
    out = updates.chain_updates(prior, fields)
    step, zs = prior, []
    for field, lr_outside in fields:
        done = updates.apply_likelihood(step, field, lr_outside)
        zs.append(done.first().z)
        step = surf(spark, [r.p for r in done.orderBy("cell_id").collect()], done.first().outside)
    got = out.orderBy("cell_id").collect()
    assert [r.p for r in got] == pytest.approx([r.p for r in step.orderBy("cell_id").collect()])
    assert [got[0][f"z{k}"] for k in range(1, 6)] == pytest.approx(zs) and got[0].outside == pytest.approx(step.first().outside)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[[^\]]*outside", plan)) <= 2


def test_ring_prior_shuffles_no_cell(spark):
    out = priors.distance_ring_prior(spark, TEN.cells(spark), (400.0, 400.0), [(0.0, 200.0, 0.6), (200.0, 500.0, 0.4)], 100.0, 80.0)
    assert abs(out.agg(F.sum("p") + F.max("outside")).first()[0] - 1) < 1e-12
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(cell_id", plan)


def test_mixture_refuses_different_grids(spark):
    with pytest.raises(Exception, match="same grid"):
        priors.mixture([("a", 0.5, surf(spark, [0.5, 0.5], 0)), ("b", 0.5, surf(spark, [0.3, 0.3, 0.4], 0))]).collect()


def test_replies_never_fail(spark):
    assert txt.parse_reply("no json") == ({}, ["(reply was not JSON)"]) and txt.parse_reply("[1]") == ({}, ["(reply was not an object)"])
    assert txt.parse_reply("[" * 100_000)[1] == ["(reply was not JSON)"]
    df = spark.createDataFrame([(1, '{"lat": 1, "lng": 2}'), (2, None), (3, "```json\n{\"terrain\": \"flat\"}\n```")], "id int, r string")
    got = {r.id: r for r in txt.parse_replies(df, "id", "r").collect()}
    assert (got[1].lat, got[1].lng, got[2].lat, got[2].discarded, got[3].terrain) == (1.0, 2.0, None, ["(reply was not JSON)"], "flat")


def test_incidents_are_read_after_redaction(spark):
    df = spark.createDataFrame([(1, "Jane Doe, hiker, last seen at 51.2034, -115.6120 heading north. Call 555-123-4567.")], "id int, t string")
    r = txt.read_incidents(df, "id", "t").first()
    assert "Jane" not in r.sent and r.phone == 1 and (r.lat, r.bearing, r.category) == (51.2034, 0.0, "hiker")
    with pytest.raises(ValueError):
        txt.read_incidents(df, "id", "t", enabled=False)


def test_strict_redaction_sees_through_addresses():
    t = "Contact john.smith@example.org today. John Smith left the hut."
    assert "John Smith" in txt.redact_text(t)[0]  # the rule as given: both words stand in lower case in the text
    assert "John" not in txt.redact_text(t, strict=True)[0]


def test_exercise_widths(spark):
    rows = pod.sweep_table(spark).collect()
    assert len(rows) == 12 and all(r.unresponsive == r.responsive / 2 and r.clue == r.responsive / 4 for r in rows)


def test_trail_corridors_by_hand(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 50.0), (1, 1, 900.0, 50.0)], "line_id long, seq int, x double, y double")
    named, members = preview.trail_corridors(TEN.cells(spark), lines, [(100.0, 300.0), (250.0, 500.0), (700.0, 800.0)], 200.0, 40.0)
    got = named.orderBy("x0").collect()
    assert [r.name for r in got] == ["T-1", "T-2", "T-3"] and [r.band for r in got] == [0, 0, 1]
    ends = [(r.x0, r.x1) for r in got]
    lo = (100.0**2 - 50.0**2) ** 0.5
    assert ends[0][0] == pytest.approx(lo) and ends[0][1] == pytest.approx(ends[1][0]) and got[0].length == pytest.approx(got[1].length)
    cells = {}
    for r in members.collect():
        cells.setdefault(r.name, set()).add(r.cell_id)
    want = {r.name: {c for c in range(10) if max(r.x0 - (c * 100 + 50), (c * 100 + 50) - r.x1, 0) <= 40} for r in got}
    assert cells == {k: v for k, v in want.items() if v}
    with pytest.raises(ValueError):
        preview.trail_corridors(TEN.cells(spark), lines, [(0.0, 1.0)], 200.0, 4.0)


def test_lists_and_members(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None), (2, 1, None)], "k int, o int, v string")
    assert {r.k: (r.n, r.listed) for r in security.listed_by(df, ["k"], "v", ["o"]).collect()} == {1: (2, "a,b"), 2: (0, "")}
    one = spark.createDataFrame([(["a"],), (["b"],), (None,)], "x array<string>").select(security.with_member(F.col("x"), F.lit("b")).alias("y"))
    assert [r.y for r in one.collect()] == [["a", "b"], ["b"], ["b"]]


def test_full_timeline_is_for_privileged_roles(spark):
    i = spark.createDataFrame([(1, "2024-01-02")], "incident_id int, c string").select("incident_id", F.col("c").cast("timestamp").alias("cutoff"))
    m = spark.createDataFrame([(1, "u")], "incident_id int, user_id string")
    clue = spark.createDataFrame([(1, 5, "2024-01-01", "s"), (1, 6, "2024-01-03", "s")], "incident_id int, item_id int, a string, restricted_payload_ciphertext string").withColumn("available_at", F.col("a").cast("timestamp"))
    see = lambda role, full: security.incident_detail(i, {"clue": (clue, True), "subject": (clue.select("incident_id", "item_id"), False)}, m, "u", role, full)
    assert see("trainee", True).count() == 3 and see("evaluator", True).count() == 4 and see("evaluator", False).count() == 3 and see(None, True).count() == 0
    assert "restricted" not in "".join(r.details for r in see("evaluator", True).collect())


def test_request_bodies(spark):
    from cairngrid.operators import requests

    guid = "0000000a-0000-0000-0000-00000000000b"
    good = '{"searchDomainId":"%s","parentSurfaceId":null,"surfaceType":"prior","valuesBase64":"AAAAAAAAAAAAAAAA","normalizationConstant":1,"modelVersion":{"component":"c","version":"1"}}' % guid
    rows = [(1, good), (2, "[]"), (3, None), (4, good.replace('"prior"', '"search_update"')), (5, good.replace("AAAAAAAAAAAAAAAA", "AA").replace(guid, "x")), (6, "{")]
    got = {}
    for r in requests.commit_problems(spark.createDataFrame(rows, "id int, b string"), "id", "b").collect():
        got.setdefault(r.id, []).append(r.path)
    assert 1 not in got and got[2] == got[3] == ["body"] and got[4] == ["evidence", "parentSurfaceId", "rationale"] and got[5] == ["searchDomainId", "valuesBase64"] and len(got[6]) > 3
    back = spark.createDataFrame([(1, '{"headSurfaceId":"%s","targetSurfaceId":"%s","rationale":"  ten signs  "}' % (guid, guid)), (2, '{"rationale":"short"}')], "id int, b string")
    assert [(r.id, r.path) for r in requests.rollback_problems(back, "id", "b").orderBy("id", "path").collect()] == [(1, "rationale"), (2, "headSurfaceId"), (2, "rationale"), (2, "targetSurfaceId")]
