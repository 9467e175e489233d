import random

import xxhash
from pyspark.sql import Row

from cairngrid.llm import simhash


def slow_fp(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    out = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    return out - (1 << 64) if out >> 63 else out


def brute(ids, fps, bits):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if ((a ^ b) & (2**64 - 1)).bit_count() <= bits:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in ids}


def test_fingerprint_matches_definition():
    rnd = random.Random(3)
    texts = ["", "  \n", "One", "one TWO", "É a b\tc", " ".join(rnd.choice("abcdef") for _ in range(500))]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fp(t) for t in texts]
    assert simhash.fingerprint(None) == 0


def test_chunks_do_not_change_a_long_text(monkeypatch):
    t = " ".join(str(i * i % 97) for i in range(1000))
    want = slow_fp(t)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(t) == want


def test_links_lose_nothing(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(6):
            y = x
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                y ^= 1 << b
            fps.add(y - (1 << 64) if y >> 63 else y)
    fps = sorted(fps) + []
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and want


def test_classes_nulls_ties_and_odd_columns(spark):
    base = " ".join(f"w{i % 83}x{i % 7}" for i in range(900))
    near = base + " tail"
    rows = [Row(doc_id=5, text=base, fp=1, id="x"), Row(doc_id=3, text=base, fp=2, id=None), Row(doc_id=9, text=near, fp=3, id=""), Row(doc_id=2, text=None, fp=4, id="n"), Row(doc_id=1, text=" ", fp=5, id="n"), Row(doc_id=7, text="entirely other words stand here", fp=6, id="z"), Row(doc_id=7, text="entirely other words stand here", fp=6, id="z")]
    got = sorted((r.id, r.fp, r.component_id) for r in simhash.simhash_dedup(spark.createDataFrame(rows)).collect())
    by = {5: base, 3: base, 9: near, 2: "", 1: "", 7: rows[5].text}
    want = brute(list(by), [slow_fp(t) for t in by.values()], 3)
    assert [(i, f) for i, f, _ in got] == sorted((r.doc_id, slow_fp(r.text or "")) for r in rows)
    assert all(c == want[i] for i, _, c in got)


def test_empty_table(spark):
    assert simhash.simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_an_id_link_others(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a, **k: docs.select("id", "fp"))
    rows = [(1, 0), (None, 7), (2, 63), (None, 0x0FF1CE5ADD1E5), (None, 0x0FF1CE5ADD1E5)]
    got = [(r.id, r.fp, r.component_id) for r in simhash.simhash_dedup(spark.createDataFrame(rows, "id long, fp long")).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1), (None, 7, 1), (2, 63, 1), (None, 0x0FF1CE5ADD1E5, None), (None, 0x0FF1CE5ADD1E5, None)], key=str)


def test_hot_fingerprints_are_broadcast_and_lose_nothing(spark):
    from cairngrid.llm.common import join_named

    rows = spark.createDataFrame([(i, i % 3) for i in range(300)] + [(1000, 7)], "id long, fp long")
    named = spark.createDataFrame([(0, 100, 5), (1, 100, 6), (2, 100, 8), (7, 1, 9)], "fp long, size long, c long")
    for hot in (10**6, 99, 0):
        got = sorted((r.id, r.c) for r in join_named(rows, named, "fp", "size", hot).collect())
        assert got == sorted([(i, [5, 6, 8][i % 3]) for i in range(300)] + [(1000, 9)])


def test_components_of_few_links_take_few_tasks(spark):
    """Every step is some stages, and the driver keeps a record of each of their tasks."""
    from cairngrid.llm.common import connected_components

    sc, edges = spark.sparkContext, spark.createDataFrame([(k, k + 1) for k in range(40) if k % 8 != 7], "a long, b long")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("components", "components")
    try:
        got = {r.id: r.component_id for r in connected_components(edges, "a", "b").collect()}
        stages = {s: i.numTasks for j in sc.statusTracker().getJobIdsForGroup("components") for s in sc.statusTracker().getJobInfo(j).stageIds if (i := sc.statusTracker().getStageInfo(s))}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: k // 8 * 8 for k in range(40)}
    assert sum(n == 64 for n in stages.values()) < 10
