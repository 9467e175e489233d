import numpy as np
from pyspark.sql import functions as F

from cairngrid.llm import features, langid

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_codewords_are_far_apart():
    for k in (2, 3, 4, 6, 12, 40):
        m = langid.codebook(k)
        d = (m.shape[1] - m @ m.T) / 2
        assert d[~np.eye(k, dtype=bool)].min() >= (1 if k == 2 else 2)


def test_histogram_is_chunk_independent(monkeypatch):
    t = "Eauouon né à " * 50
    want = features.histogram(t)
    raw = (" " + t.lower() + " ").encode()
    assert want.sum() == 2 * len(raw) - 3
    for size in (7, 64, len(raw) - 1, len(raw)):
        monkeypatch.setattr(features, "CHUNK", size)
        assert (features.histogram(t) == want).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    got = langid.op1_langid_ecoc(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    n, ok = got.where("held_out").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert n > 100 and ok > 0.97
    assert got.where("score < 0 or score > 1").count() == 0 and got.count() == docs.count()


def test_defined_cases(spark):
    train = spark.createDataFrame([(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", None) for i in range(40)], "doc_id long, text string, lang string, score double")
    model = langid.train(train)
    rows = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "12 !!", 0), (4, "the dog and the cat", 0), (4, "the dog and the cat", 0), (None, "die katze und der hund", 0)], "doc_id long, text string, lang_pred int")
    got = sorted([(r.id or 0, r.lang_pred, r.ambiguous) for r in langid.identify(rows, model).collect()])
    assert got == [(0, "de", False), (1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (4, "en", False)]
    assert langid.identify(rows.limit(0), model).count() == 0
    none = langid.train(train.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(rows, none).collect()} == {"und"}
    one = langid.train(train.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.identify(rows.where("doc_id = 4"), one).collect()} == {"en"}


def test_decoding_against_brute_force():
    rnd = np.random.default_rng(6)
    for k in (1, 2, 3, 5, 9):
        codes = langid.codebook(k)
        b = codes.shape[1]
        m = langid.Model([f"l{i}" for i in range(k)], codes, rnd.normal(size=(12, b)), rnd.normal(size=b), rnd.uniform(0.1, 2, b))
        x = rnd.normal(size=(50, 12))
        best, p, gap = m.decode(x)
        for row, i, q, g in zip(x, best, p, gap, strict=True):
            f = row @ m.weights + m.bias
            loss = [sum(w * np.log1p(np.exp(-c * v)) for w, c, v in zip(m.bit_weight, code, f, strict=True)) for code in codes]
            order = sorted(range(k), key=lambda j: loss[j])
            assert order[0] == i and np.isclose(q, np.exp(-loss[i]) / sum(np.exp(-v) for v in loss))
            assert np.isclose(g, loss[order[1]] - loss[i]) if k > 1 else np.isinf(g)


def test_vectors_come_to_the_driver_in_parts(spark):
    """No task's result holds all of them, and not more rows come than are asked for."""
    from cairngrid.llm import features

    made = spark.range(500).selectExpr("id", "repeat('x', 100) AS x").coalesce(1)
    sc = spark.sparkContext
    sc.setJobGroup("gathered", "gathered")
    try:
        assert len({r.id for r in features.gathered(made, 300)}) == 300
        assert len(sc.statusTracker().getJobIdsForGroup("gathered")) >= features.GATHERED_PARTS
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
