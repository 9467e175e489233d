from pyspark.sql import functions as F

from cairngrid.streaming import feeds


def test_feeds(spark, tmp_path):
    rows = [(1, 0), (1, 120), (1, 241), (2, 0), (2, 50), (2, 50)]
    df = spark.createDataFrame(rows, "track_id int, s long").select("track_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = []

    def run(q, name):
        feeds.commit_batches(q, lambda b, n: got.extend((name, *r) for r in b.collect()), str(tmp_path / name)).awaitTermination()

    run(feeds.available(stream, "2023-11-14 22:15:20", "at"), "cut")
    run(feeds.new_uploads(stream, ["track_id", "at"]), "new")
    assert len([g for g in got if g[0] == "cut"]) == 5 and len([g for g in got if g[0] == "new"]) == 5
    batch = feeds.gap_sessions(df).collect()
    assert sorted((r.track_id, r.n) for r in batch) == [(1, 2), (2, 3)]


def test_stateful_streams_equal_the_tables_after_a_restart(spark, tmp_path):
    """Every file is one run of the query from its checkpoint: what a track kept last and which requests were seen goes on."""
    import random

    from cairngrid.operators import security, tracks

    r = random.Random(1)
    points = [(k, s, float(r.randint(0, 40)), 0.0, s * 10_000 - (25_000 if r.random() < 0.1 else 0)) for k in range(5) for s in range(40)]
    requests = [(i, r.randint(0, 8), i * 10, r.choice("ab")) for i in range(60)]
    frames = {"points": (points, "track_id long, seq long, x double, y double, t long", 1), "requests": (requests, "event_id long, user long, at long, body string", 2)}
    got = {"points": [], "requests": []}
    for name, (rows, ddl, place) in frames.items():
        rows = sorted(rows, key=lambda x: x[place])
        for part in range(3):
            spark.createDataFrame(rows[part * len(rows) // 3 : (part + 1) * len(rows) // 3], ddl).coalesce(2).write.mode("append").parquet(str(tmp_path / name))
            stream = spark.readStream.schema(ddl).parquet(str(tmp_path / name))
            out = feeds.clean_points(stream, 2.0) if name == "points" else feeds.request_outcomes(stream, ["user"], "at", "body")
            feeds.commit_batches(out, lambda b, n, name=name: got[name].extend(tuple(x) for x in b.collect()), str(tmp_path / f"{name}-checkpoint")).awaitTermination()
    whole = tracks.clean_tracks(spark.createDataFrame(points, frames["points"][1]), 2.0)
    assert sorted(got["points"]) == sorted(tuple(x) for x in whole.collect()) and 0 < len(got["points"]) < len(points)
    answers = security.first_responses(spark.createDataFrame(requests, frames["requests"][1]), ["user"], ["at", "event_id"], "body").select("event_id", "outcome")
    assert sorted(got["requests"]) == sorted(tuple(x) for x in answers.collect()) and {o for _, o in got["requests"]} == {"new", "replayed", "conflict"}
