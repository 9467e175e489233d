"""Steps whose work must grow no faster than their input."""

import random


import pyarrow as pa
from pyspark.sql import functions as F

from cairngrid.functions import spherical as sph
from cairngrid.functions import text
from cairngrid.operators import trails, workflow
from tests.test_distributed_lines import cheapest


def test_cost_distance_of_a_long_strip_takes_few_rounds(spark, monkeypatch):
    r, cols = random.Random(5), 3
    mult = {i: r.choice([1.0, 1.5, 2.0, None if i % cols else 1.0]) for i in range(cols * 600)}
    cells = spark.createDataFrame([(0, i, m) for i, m in mult.items()], "grid_id int, cell_id long, mult double")
    rounds, inner = [], trails.checkpointed
    monkeypatch.setattr(trails, "checkpointed", lambda df: rounds.append(1) or inner(df))
    got = {x.cell_id: x.cost for x in trails.cost_distance(cells, spark.createDataFrame([(0, 0)], "grid_id int, cell_id long"), cols, 10.0, tile=16).collect()}
    assert got == cheapest(mult, cols, [0], 10.0)
    assert len(rounds) < 20  # tiles of 16 x 16 took a round for every 16 of the 600 rows


def tasks(df):
    return df.rdd.getNumPartitions()


def test_rows_that_become_many_are_dealt_out(spark):
    """A small table is one file and one task; what is made of its rows is not."""
    places = spark.range(40).coalesce(1).select("id", F.lit(50.0).alias("lat"), F.lit(10.0).alias("lng"), F.lit(9000.0).alias("radius_m"))
    assert tasks(sph.tiles_for(places, "id", 0.25, 0.4, 40.0, -130.0)) >= 8


def test_format_km_rounds_by_the_exact_value(spark):
    """10.85 is stored below its half, 10.25 and 0.125 are halves and go to the even digit."""
    values = [10.85, 10.25, 10.75, 0.125, 0.375, 1.005, 9.995, 9.994, 0.0, 20.0, 100.04, 12345.65, *(0.5 + 0.09 * k for k in range(2000))]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", sph.format_km(F.col("v")).alias("t")).collect()
    shown = lambda v: f"{v:.2f}".rstrip("0").rstrip(".") if v < 10 else f"{v:.1f}".removesuffix(".0")
    assert [x.t for x in got] == [shown(x.v) for x in got]


def test_events_without_a_surface_do_not_meet_in_one_task(spark):
    """All nulls of a join's key have one hash; most events have neither a surface nor an incident."""
    rows = [(i, 1, 1, "lock" if i % 9 == 0 else "reveal", i % 5, "evaluator", 7 if i % 9 == 0 else None) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, t long, run_id long, kind string, user_id long, role string, surface_id long").selectExpr("event_id", "timestamp_seconds(t) AS at", "run_id", "kind", "user_id", "role", "CAST(NULL AS long) AS incident_id", "CAST(NULL AS timestamp) AS information_cutoff", "surface_id", "array(surface_id) AS baselines", "CAST(NULL AS string) AS metrics")
    members, surfaces = spark.createDataFrame([(1, 1)], "incident_id long, user_id long"), spark.createDataFrame([(7, 1)], "surface_id long, incident_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = workflow.judged_events(events, members, surfaces, members)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(by_#" in plan and not any(f"hashpartitioning({c}#" in plan for c in ("surface_id", "incident_id", "incident"))


def test_redaction_hands_its_texts_on_in_parts(spark, monkeypatch):
    """A task holds a bounded part of its texts, nulls and empty texts included."""
    frames = spark.createDataFrame([(1, "write to jane@x.org"), (2, None), (3, "")], "id long, t string")
    assert [tuple(r) for r in text.redact(frames, "id", "t").orderBy("id").collect()] == [(i, *text.redact_text(t)) for i, t in ((1, "write to jane@x.org"), (2, None), (3, ""))]
    seen = []
    monkeypatch.setattr(type(frames), "mapInArrow", lambda df, run, ddl: seen.append(run))
    text.redact(frames, "id", "t")
    batch = pa.record_batch({"id": list(range(60)), "t": ["word " * 40_000] * 60})
    parts = [b.num_rows for b in seen[0]([batch])]
    assert sum(parts) == 60 and max(parts) <= 21
