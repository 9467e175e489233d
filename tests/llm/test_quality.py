import numpy as np
from pyspark.sql import functions as F

from cairngrid.llm import quality

SF = "/root/testdata/sf0.01"


def auc(p, y):
    p, y = np.array(p), np.array(y)
    return np.mean((p[y == 1][:, None] > p[y == 0][None]) + 0.5 * (p[y == 1][:, None] == p[y == 0][None]))


def test_held_out_quality_and_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    fit = labels.where(~out)
    models = {"quality": quality.train(docs, fit, F.col("quality") == 1), "toxic": quality.train(docs, fit, F.col("toxic") == 1)}
    got = quality.score(docs.join(labels.where(out), "doc_id"), models).collect()
    assert auc([r.quality_score for r in got], [r.quality for r in got]) > 0.85
    assert auc([r.toxic_score for r in got], [r.toxic for r in got]) > 0.7
    assert all(0 <= r.quality_score <= 1 and 0 <= r.quality_meta_score <= 1 for r in got)
    assert sum(map(sum, models["quality"].added)) > 0


def test_views_teach_each_other(spark):
    rnd = np.random.default_rng(0)
    y = rnd.integers(0, 2, 900)
    rows = [(i, ("fine good words " if k else "bad junk noise ") * 3 + str(rnd.integers(99)), "a" if k else "b", "en", 50) for i, k in enumerate(y.tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(y.tolist()) if i < 60], "doc_id long, quality int")
    m = quality.train(docs.where("doc_id < 600"), labels, F.col("quality") == 1)
    p, t, v = m.scores(quality.features.text_vectors([r[1] for r in rows[600:]], m.words), quality.meta_vectors([r[2:] for r in rows[600:]]))
    assert all(auc(x, y[600:]) > 0.99 for x in (p, t, v)) and min(m.added[0]) > 0


def test_a_round_takes_the_surest_of_all_unlabelled_rows(spark):
    """Scores and picks against plain numpy over the whole pool."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("k"), "text", F.col("source").alias("m0"), F.col("lang").alias("m1"), F.col("n_chars").alias("m2")).where("text is not null")
    docs = docs.withColumn("key", F.xxhash64("text", "m0", "m1", "m2"))
    words = {"the": 0, "und": 1}
    rnd = np.random.default_rng(1)
    views = {"q": ((rnd.normal(size=(1026, 1)).astype(np.float32), np.zeros(1, np.float32)), (rnd.normal(size=(quality.META_BUCKETS, 1)).astype(np.float32), np.ones(1, np.float32)))}
    scored = quality.pool_scores(docs, words, views).cache()
    rows = docs.collect()
    x = quality.features.text_vectors([r.text for r in rows], words)
    want = {r.k: float(p) for r, p in zip(rows, quality._prob(x, *views["q"][0]), strict=True)}
    got = {r.k: r.q_t for r in scored.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-5 for k, v in want.items())
    key = {r.k: r.key for r in rows}
    top = {}
    for k, v in got.items():
        if v >= 0.7:
            top[key[k]] = max(top.get(key[k], 0), round(v, 3))
    picked = [r.key for r in quality.surest(scored, "q_t", 1, 25, 0.7, None).collect()]
    least = sorted(top.values(), reverse=True)[min(25, len(top)) - 1]
    assert len(set(picked)) == len(picked) == min(25, len(top)) and min(top[k] for k in picked) == least
    gone = spark.createDataFrame([(k,) for k in picked], "key long")
    assert not set(picked) & {r.key for r in quality.surest(scored, "q_t", 1, 25, 0.7, gone).collect()}


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "s", "en", 0), (2, "", "s", "en", 0), (None, "x " * 50000, "s", "fr", -5)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality_filter(docs, labels).collect()
    assert len(got) == 4 and {r.quality_score for r in got} == {0.5}
    assert quality.quality_filter(docs.limit(0), labels).count() == 0


def test_ids_with_two_labels_and_views_that_are_never_sure(spark):
    """Scores do not depend on the order of rows that label one id twice; a view that gets no pseudo-label is told."""
    import warnings

    docs = spark.createDataFrame([(i, ("fine words of prose " if i % 2 else "junk junk click here ") * 5, "en", "s", 100) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = [(i, i % 2, 0) for i in range(40)] + [(i, 1 - i % 2, 0) for i in range(6)]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, quality int, toxic int").coalesce(1)
    scores = []
    for r in (rows, rows[::-1]):
        with warnings.catch_warnings(record=True) as told:
            warnings.simplefilter("always")
            model = quality.train(docs, frame(r), F.col("quality") == 1, sure=1.0)
        assert sum("no pseudo-label" in str(w.message) for w in told) == 2
        scores.append([x.q_score for x in quality.score(docs, {"q": model}).orderBy("doc_id").collect()])
    assert scores[0] == scores[1]
