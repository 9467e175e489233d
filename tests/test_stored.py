"""The surface store with several writers, digests, evaluation events, tokens and saved tables."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairngrid.operators import preview, requests, security, versions, workflow
from cairngrid.sources import importers as imp


def surface(spark, values, outside=0.2):
    return spark.createDataFrame([(k, float(v), outside) for k, v in enumerate(values)], "cell_id long, p double, outside double")


def test_two_writers_at_once_both_stand(spark, tmp_path):
    path = str(tmp_path / "store")
    prior = versions.SurfaceStore(spark, path).commit(surface(spark, [0.4, 0.4]), "i", "prior", "me")
    got, failed = {}, []

    def write(k):
        try:
            store = versions.SurfaceStore(spark, path)
            got[k] = store.commit(surface(spark, [0.1 * (k + 1), 0.8 - 0.1 * (k + 1)]), "i", "update", f"writer {k}", 0.9, prior["surface_id"], "a clue was found")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = versions.SurfaceStore(spark, path)
    records = store.records.orderBy("seq").collect()
    assert not failed and len(records) == 5 and [r.seq for r in records] == [0, 1, 2, 3, 4] and [r.divergent for r in records] == [False, False, True, True, True]
    assert {r.surface_id for r in store.heads("i").collect()} == {g["surface_id"] for g in got.values()}
    for k, g in got.items():
        assert [r.p for r in store.get(g["surface_id"]).orderBy("cell_id").collect()] == [0.1 * (k + 1), 0.8 - 0.1 * (k + 1)]
    assert store.damaged().count() == 0 and versions.lineage_problems(store.records).count() == 0


def test_damage_and_expected_hashes(spark, tmp_path):
    store = versions.SurfaceStore(spark, str(tmp_path / "s"))
    v = np.array([0.25, 0.55])
    good = store.commit(surface(spark, v), "i", "prior", "me", expected_hash=versions.hash_values(v, 0.2), cell_count=2)
    assert good["values_hash"] == versions.hash_values(v, 0.2)
    for more in ({"expected_hash": "0" * 64}, {"cell_count": 3}):
        with pytest.raises(ValueError):
            store.commit(surface(spark, v), "i", "prior", "me", **more)
    surface(spark, [0.3, 0.5]).select("cell_id", "p").write.mode("overwrite").parquet(f"{store.path}/cells/surface_id={good['surface_id']}")
    assert [tuple(r) for r in store.damaged().collect()] == [(good["surface_id"], "values do not match their hash")]
    with pytest.raises(ValueError, match="hash"):
        store.get(good["surface_id"])


def test_digests_of_many_surfaces(spark):
    r = np.random.default_rng(1)
    values = {k: r.random(int(n)) for k, n in enumerate([1, 5, 30_000, 700])}
    rows = [(k, c, float(p), 0.1 * k) for k, v in values.items() for c, p in enumerate(v)]
    order = r.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "s int, cell_id long, p double, outside double")
    got = {x.s: (x.values_hash, x.n) for x in versions.surface_digests(df, ["s"]).collect()}
    assert got == {k: (versions.hash_values(v, 0.1 * k), len(v)) for k, v in values.items()}
    assert versions.surface_digests(df.where("s = 2")).first().values_hash == versions.hash_values(values[2], 0.2)


def test_evaluation_events(spark):
    ev = lambda i, run, kind, user, role, incident=None, surface=None, baselines=None, metrics=None: (i, None, run, kind, user, role, incident, None, surface, baselines, metrics)
    rows = [
        ev(1, 1, "lock", 1, "evaluator", surface=10, baselines=[11]), ev(2, 1, "create", 1, "analyst", 7), ev(3, 1, "create", 1, "evaluator", 7), ev(4, 1, "create", 1, "evaluator", 7), ev(5, 1, "reveal", 1, "evaluator"), ev(6, 1, "lock", 1, "trainee", surface=10),
        ev(7, 1, "lock", 1, "evaluator", surface=20), ev(8, 1, "lock", 1, "evaluator", surface=10, baselines=[11, 20]), ev(9, 1, "metrics", 1, "evaluator", metrics="m0"), ev(10, 1, "lock", 5, "instructor", surface=10, baselines=[11]), ev(11, 1, "lock", 2, "instructor", surface=10, baselines=[11]), ev(12, 1, "lock", 1, "administrator", surface=11),
        ev(13, 1, "reveal", 2, "analyst"), ev(14, 1, "reveal", 2, "instructor"), ev(15, 1, "reveal", 1, "evaluator"), ev(16, 1, "metrics", 1, "evaluator", metrics="m1"), ev(17, 1, "metrics", 1, "evaluator", metrics="m2"), ev(18, 1, "shout", 1, "evaluator"), ev(19, 2, "create", 2, "instructor", 8), ev(20, 3, "create", 2, None, 7),
    ]
    members = spark.createDataFrame([(7, 2), (8, 2)], "incident_id long, user_id long")
    surfaces = spark.createDataFrame([(10, 7), (11, 7), (20, 8)], "surface_id long, incident_id long")
    judged = workflow.judged_events(spark.createDataFrame(rows, workflow.EVENTS), members, surfaces, spark.createDataFrame([(8,)], "incident_id long"))
    got = {r.event_id: r.problem for r in judged.collect()}
    gone, late = "evaluation run not found", "run is already locked"
    assert got == {
        1: gone, 2: "not permitted", 3: None, 4: "run exists already", 5: "outcome cannot be revealed before the run is locked", 6: gone, 7: "surface does not belong to this incident", 8: "every baseline must be a surface of this incident", 9: "metrics follow the reveal", 10: gone, 11: None, 12: late,
        13: "role may not reveal outcomes", 14: "role may not reveal outcomes", 15: None, 16: None, 17: "metrics are recorded once", 18: "unknown kind of event", 19: None, 20: "not permitted",
    }
    states = {r.run_id: (r.incident_id, r.status, r.surface_id, r.baselines, r.locked_by, r.revealed_by, r.metrics) for r in workflow.run_states(judged).collect()}
    assert states == {1: (7, "revealed", 10, [11], 2, 1, "m1"), 2: (8, "open", None, None, None, None, None)}
    assert [(r.event_id, r.action) for r in workflow.audit_trail(judged).orderBy("event_id").collect()] == [(3, "insert"), (11, "lock"), (15, "restricted_read"), (16, "update"), (19, "insert")]
    assert sorted(r.surface_id for r in workflow.locked_surfaces(judged).collect()) == [10, 11]
    found = workflow.run_metrics(workflow.run_states(judged), spark.createDataFrame([(10, 0.5), (11, 0.25), (20, 1.0)], "surface_id long, capture double"))
    assert sorted((r.surface_id, r.candidate, r.capture) for r in found.collect()) == [(10, True, 0.5), (11, False, 0.25)]


def test_tokens(spark):
    keys = {"new": b"n" * 32, "old": b"o" * 32}
    df = spark.createDataFrame([(1, '{"x":1}'), (2, ""), (3, "ä" * 500), (4, None)], "incident long, t string")
    sealed = df.withColumn("token", security.seal_token(F.col("t"), F.col("incident"), {"old": b"o" * 32}))
    rows = sealed.select("incident", "t", "token", security.open_token(F.col("token"), F.col("incident"), keys).alias("o")).orderBy("incident").collect()
    assert [r.o.text for r in rows[:1] + rows[2:3]] == ['{"x":1}', "ä" * 500] and rows[0].token.startswith("v1:old:") and all(c not in rows[2].token for c in "+/=\n")
    bad = lambda c: sealed.where("incident = 1").select(security.open_token(c, F.col("incident"), keys)["problem"].alias("p")).first().p
    token = rows[0].token
    flipped = token[:-2] + ("A" if token[-2] != "A" else "B") + token[-1]
    assert bad(F.lit(flipped)) == "outcome ciphertext does not open" and bad(F.lit("v1:x:y")) == "unrecognised outcome ciphertext" and bad(F.lit(token.replace(":old:", ":lost:"))) == "outcome key lost is not configured"
    assert bad(F.lit(token)) is None and bad(F.lit(None).cast("string")) == "unrecognised outcome ciphertext"
    with pytest.raises(ValueError):
        security.seal_token(F.col("t"), F.col("incident"), {"a:b": b"o" * 32})


def test_exercise_table_is_a_good_table(spark):
    table = imp.exercise_table(spark)
    assert imp.saved_table_problems(table, []).count() == 0 and table.count() == 26
    assert {r.terrain for r in imp.terrains(table, "Hiker").collect()} == {"mountainous", "flat"} and imp.categories(table).count() == 13


def test_bodies_of_runs(spark):
    guid = "00000000-0000-0000-0000-000000000001"
    rows = [(1, f'{{"incidentId":"{guid}","informationCutoff":"2024-01-01T00:00:00Z"}}'), (2, '{"incidentId":"x"}'), (3, "[]")]
    df = spark.createDataFrame(rows, "id int, body string")
    assert sorted(tuple(r) for r in requests.create_run_problems(df, "id", "body").collect()) == [(2, "incidentId"), (2, "informationCutoff"), (3, "body")]
    rows = [(1, f'{{"surfaceId":"{guid}"}}'), (2, f'{{"surfaceId":"{guid}","baselineSurfaceIds":["x"],"modelVersions":{{"a":null}}}}')]
    assert sorted(tuple(r) for r in requests.lock_run_problems(spark.createDataFrame(rows, "id int, body string"), "id", "body").collect()) == [(2, "baselineSurfaceIds"), (2, "modelVersions")]


def test_trail_segments_make_one_corridor_of_joined_trails(spark):
    lines = spark.createDataFrame([("f", 5, 0, 0.0, 300.0), ("f", 5, 1, 600.0, 300.0), ("f", 2, 0, 1200.0, 300.0), ("f", 2, 1, 600.2, 300.0)], "file string, line_id int, seq int, x double, y double")
    got = preview.trail_segments(lines, [(0.0, 5000.0)], 1000.0, 50.0, "file").collect()
    assert [(r.name, r.line_id, round(r.length), len(r.rings)) for r in got] == [("T-1", 2, 1200, 1)] and got[0].rings[0][0] == got[0].rings[0][-1]
    with pytest.raises(ValueError):
        preview.trail_segments(lines, [(0.0, 5000.0)], 50.0, 50.0, "file")
