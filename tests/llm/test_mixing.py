import numpy as np
from pyspark.sql import functions as F

from cairngrid.llm import mixing

SF = "/root/testdata/sf0.01"


def projected(n, p, target, steps=20000):
    """Plain projected gradient on the same least squares."""
    m = (p * n[:, None]).T @ p
    r, g = np.ones(len(n)), np.linalg.pinv(m)
    for _ in range(steps):
        r = np.maximum(r - p @ g @ ((r * n) @ p - target), 0)
    return r


def test_rates_meet_targets_and_brute_force(spark):
    rnd = np.random.default_rng(3)
    p, n = rnd.dirichlet([0.3, 0.3, 0.3], 200), rnd.integers(0, 500, 200)
    target = np.array([0.7, 0.3, 0.0]) * n.sum()
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "mix_tokens long, mix_p array<double>").coalesce(2).cache()
    weigh = np.linalg.pinv((p * n[:, None]).T @ p)
    off = lambda s: (s - target) @ weigh @ (s - target)
    fit = mixing.fit_rates(df, target)
    r, got = mixing._rates(p, fit.steps), fit.totals
    want = projected(n, p, target)
    assert (r >= 0).all() and np.allclose((r * n) @ p, got)
    assert off(got) <= off((want * n) @ p) + 0.01 * off(n @ p)
    feasible = np.array([0.4, 0.35, 0.25]) * n.sum()
    fit = mixing.fit_rates(df, feasible, tolerance=1e-6)
    assert fit.converged and np.abs(fit.totals - feasible).sum() <= 1e-5 * n.sum()
    rare = 30 * feasible  # rates beyond any fixed bound
    fit = mixing.fit_rates(df, rare)
    assert fit.converged and np.abs(fit.totals - rare).sum() <= 2e-4 * rare.sum() and mixing._rates(p, fit.steps).max() > 20
    assert not mixing.fit_rates(df, target, max_steps=1).converged


def test_posteriors_and_totals_on_the_table(spark):
    out = mixing.op4_soft_mixing(spark, SF).cache()
    labels = mixing.labelled(spark.read.parquet(f"{SF}/labels.parquet"))
    both = out.withColumnRenamed("domain", "guess").join(labels, "doc_id").where("domain is not null")
    ok = both.agg(F.avg((F.col("guess") == F.col("domain")).cast("double"))).first()[0]
    assert ok > 0.85
    tokens = out.agg(F.sum("n_tokens")).first()[0]
    good = out.agg(F.sum(F.col("rate") * F.col("n_tokens") * F.get("posterior", F.lit(0)))).first()[0]
    assert abs(good / tokens - mixing.TARGETS["good"]) < 0.001
    assert out.where("rate < 0 or copies < 0 or abs(copies - rate) > 1").count() == 0


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), mixing.labelled(spark.read.parquet(f"{SF}/labels.parquet")).where("domain is not null")
    fit = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = mixing.train(docs, fit, sorted(mixing.TARGETS))
    rest = mixing.score(docs.join(labels.join(fit, "doc_id", "left_anti"), "doc_id"), model)
    rows = rest.select("domain", "mix_p").collect()
    assert len(rows) > 50 and np.mean([sorted(mixing.TARGETS)[int(np.argmax(r.mix_p))] == r.domain for r in rows]) > 0.8  # one label in twenty is noise


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "some words here", None), (3, "some words here", None), (None, "x " * 9000, "c")], "doc_id long, text string, domain string")
    labels = spark.createDataFrame([(1, "good"), (None, "junk"), (3, None)], "doc_id long, domain string")
    got = mixing.mix(docs, labels, {"good": 1, "junk": 3}).collect()
    assert len(got) == 5 and all(r.mix_rate >= 0 for r in got)
    assert sorted(r.mix_tokens for r in got) == [0, 0, 3, 3, 9000]
    assert mixing.mix(docs.limit(0), labels, {"good": 1}).count() == 0


def test_targets_change_the_mix_and_what_is_reached_is_told(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), mixing.labelled(spark.read.parquet(f"{SF}/labels.parquet"))
    out = mixing.mixture(docs.withColumn("mix_rate", F.lit("x")), labels, mixing.TARGETS)
    assert out.converged and all(abs(out.attained[d] - v) < 2e-4 * sum(out.wanted.values()) for d, v in out.wanted.items())
    known = out.rows.join(labels, "doc_id").groupBy("domain").agg(F.avg("mix_rate")).collect()
    rate = {r[0]: r[1] for r in known}
    assert rate["good"] > 1 and rate["junk"] < 0.4 and rate["toxic"] < 0.3
    with __import__("pytest").warns(UserWarning):
        mixing.mix(docs, labels, {"good": 1, "toxic": 0}, max_steps=1)


def test_a_step_of_the_fit_is_one_stage(spark):
    """No shuffle: a fit takes dozens of steps, and each stage of many tasks is kept by the driver."""
    df = spark.createDataFrame([(k, [0.2 + k % 3 / 5, 0.8 - k % 3 / 5]) for k in range(60)], "mix_tokens long, mix_p array<double>").repartition(3).localCheckpoint()
    sc = spark.sparkContext
    sc.setJobGroup("fit", "fit")
    try:
        mixing.fit_rates(df, np.array([600.0, 900.0]))
        jobs = sc.statusTracker().getJobIdsForGroup("fit")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs and all(len(sc.statusTracker().getJobInfo(j).stageIds) == 1 for j in jobs)
