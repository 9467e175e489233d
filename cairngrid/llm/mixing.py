"""Mixing to target weights with soft domain membership.

A classifier fitted on the labelled table gives every document a posterior over domains. Rates r >= 0 per
document are fitted so that the expected tokens of each domain, sum of r * tokens * posterior, match their
targets: projected gradient descent on the least squares of the differences, each step one pass over
(tokens, posterior), kept for that in few partitions, with no shuffle. Only a partition's sums per domain reach the driver.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairngrid.llm import features
from cairngrid.llm.common import append, stored

MAX_TRAIN_ROWS = 4000
SPARE = 2
MAX_STEPS = 200
TOLERANCE = 1e-4
#: Documents of a partition of (tokens, posterior), about: the fit passes over them up to MAX_STEPS times.
PART_ROWS = 250_000

#: Domains of the labels table, and their shares of the mixed tokens. A share of zero could not be met: every posterior is above zero, so only ever
#: fewer documents would keep a rate; with these, documents that look toxic get rate 0, junk about a seventh, and good ones 1.2.
TARGETS = {"good": 0.98, "junk": 0.015, "toxic": 0.005}


def label_domain() -> Column:
    """Domain of a row of labels: toxic before junk before good; null without labels."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "good")


@dataclass
class DomainModel:
    domains: list[str]
    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    def posterior(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full((len(texts), len(self.domains)), 1 / len(self.domains))
        return features.softmax(features.text_vectors(texts, self.words) @ self.weights + self.bias)


def train(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> DomainModel:
    """Fit domain posteriors on about ``max_rows`` labelled documents, drawn by a hash of the id, and never more than ``SPARE`` times as many.

    ``labels`` has ``id_col`` and ``domain``; rows with a null or unknown domain, or without a text, are left out, and an
    id with several domains counts as the first of them in order. Without any labelled document every posterior is uniform.
    """
    known = labels.select(F.col(id_col).alias("label_id"), "domain").where(F.col("domain").isin(domains)).groupBy("label_id").agg(F.min("domain").alias("domain"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.col("label_id").cast("string"), F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(draw < max_rows / n) if n > max_rows else known
    # about max_rows ids with a short domain each: bounded
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(drawn), "label_id").select("text", F.col("domain").alias("class"))
    words = {w: i for i, w in enumerate(features.choose_words(rows))}
    got, x = features.sampled_vectors(rows, words, SPARE * max_rows)
    if len(set(got)) < 2:
        return DomainModel(domains)
    w, c = features.fit_softmax(x, np.array([[d == k for k in domains] for (d,) in got], float))
    return DomainModel(domains, words, w, c)


def score(docs: DataFrame, model: DomainModel, text_col: str = "text", prefix: str = "mix_") -> DataFrame:
    """``docs`` plus ``mix_tokens`` (white-space-separated words) and ``mix_p`` (posterior), stored. A null text has no tokens."""

    def make(columns):
        texts = columns[0]
        p = model.posterior(texts)
        return [pa.array([len((t or "").split()) for t in texts], pa.int64()), pa.array(list(p.astype(np.float64)), pa.list_(pa.float64()))]

    return stored(append(docs, [text_col], f"{prefix}tokens long, {prefix}p array<double>", make))


def _rates(p: np.ndarray, steps: list[tuple[float, np.ndarray]]) -> np.ndarray:
    """Rates after the given (momentum, gradient) steps, from rate 1: a document's rate follows from its posterior alone."""
    before = r = np.ones(len(p))
    for beta, g in steps:
        before, r = r, np.maximum(r + beta * (r - before) - p @ g, 0)
    return r


@dataclass
class Fit:
    """Gradient steps (momentum, gradient), the expected totals they lead to, and whether these stand still or meet the targets."""

    steps: list[tuple[float, np.ndarray]]
    totals: np.ndarray
    converged: bool


def fit_rates(tokens_and_p: DataFrame, targets: np.ndarray, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> Fit:
    """Gradient steps whose rates bring the expected domain totals to ``targets`` (tokens); the frame has the tokens and the posterior.

    Differences are weighed by the inverse of the documents' second moment, so a full step is stable and,
    while no rate is at zero, exact. Totals are linear in the rates, so the accelerated step's gradient needs no further pass;
    momentum starts anew when the objective rises. Ends when the totals meet the targets, or stand still over five steps
    at the least squares; not converged after ``max_steps``.
    """
    k = len(targets)

    def totals(steps):
        def run(batches):
            s, m = np.zeros(k), np.zeros((k, k))
            for b in batches:
                p = b.column(1)
                n, p = b.column(0).to_numpy(zero_copy_only=False).astype(float), p.flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1)
                s += (_rates(p, steps) * n) @ p
                if not steps:
                    m += (p * n[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([s, m.ravel()]).tolist()], pa.list_(pa.float64()))], names=["v"])

        parts = [r.v for r in tokens_and_p.mapInArrow(run, "v array<double>").collect()]  # one short row per partition
        out = np.array([math.fsum(v) for v in zip(*parts, strict=True)]) if parts else np.zeros(k + k * k)  # exact, so in any order
        return out[:k], out[k:].reshape(k, k)

    steps: list[tuple[float, np.ndarray]] = []
    s, moment = totals(steps)
    weigh = np.linalg.pinv(moment, rcond=1e-9) if moment.any() else np.zeros((k, k))
    goal, before, age, still = max(1.0, float(np.abs(targets).sum())), s, 0, 0
    off = lambda v: float((v - targets) @ weigh @ (v - targets))
    while np.abs(s - targets).sum() > tolerance * goal and still < 5 and weigh.any():
        if len(steps) == max_steps:
            return Fit(steps, s, False)
        beta = age / (age + 3)
        steps.append((beta, weigh @ (s + beta * (s - before) - targets)))
        before, (s, _) = s, totals(steps)
        age = age + 1 if off(s) <= off(before) else 0
        still = still + 1 if np.abs(s - before).sum() <= tolerance * goal / 20 else 0
    return Fit(steps, s, True)


@dataclass
class Mixture:
    """The mixed documents, and per domain the tokens wanted and the expected tokens of the fitted rates."""

    rows: DataFrame
    wanted: dict[str, float]
    attained: dict[str, float]
    converged: bool


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", total_tokens: float | None = None, max_train_rows: int = MAX_TRAIN_ROWS, prefix: str = "mix_", max_steps: int = MAX_STEPS) -> Mixture:
    """Rows: ``docs`` plus mix_tokens, mix_p, mix_domain (largest posterior; ties: first by name), mix_rate and mix_copies.

    ``targets`` are weights per domain (any positive scale); ``total_tokens`` defaults to the tokens there are.
    ``mix_copies`` rounds the rate up or down by a hash of id and text, so that its mean over documents is the rate. Rates have no upper bound.
    Null texts have no tokens and the empty text's posterior; repeated rows get equal rates; an empty
    table gives an empty result. Columns of these names are replaced, unless another ``prefix`` is given; others may be anything.
    """
    domains = sorted(targets)
    weight = np.array([float(targets[d]) for d in domains])
    if (weight < 0).any() or not weight.sum() > 0:
        raise ValueError("target weights must be nonnegative and not all zero")
    model = train(docs, labels, domains, id_col, text_col, max_train_rows)
    scored = score(docs, model, text_col, prefix)
    tokens = f"{prefix}tokens"
    n, there = scored.agg(F.count("*"), F.coalesce(F.sum(tokens), F.lit(0))).first()
    total = float(total_tokens if total_tokens is not None else there)
    wanted = weight / weight.sum() * total
    fit = fit_rates(stored(scored.select(tokens, f"{prefix}p").coalesce(max(1, -(-n // PART_ROWS)))), wanted, max_steps)

    def make(columns):
        p = np.array(columns[0], float).reshape(len(columns[0]), -1)
        return [pa.array([domains[i] for i in p.argmax(axis=1)]), pa.array(_rates(p, fit.steps))]

    out = append(scored, [f"{prefix}p"], f"{prefix}domain string, {prefix}rate double", make)
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    rows = out.withColumn(f"{prefix}copies", F.floor(F.col(f"{prefix}rate") + draw).cast("long"))
    return Mixture(rows, dict(zip(domains, wanted.tolist(), strict=True)), dict(zip(domains, fit.totals.tolist(), strict=True)), fit.converged)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """The rows of ``mixture``; a fit that has not converged is told by a warning with the totals reached."""
    out = mixture(docs, labels, targets, **options)
    if not out.converged:
        warnings.warn(f"mixing rates have not converged: wanted {out.wanted}, reached {out.attained}", stacklevel=2)
    return out.rows


def labelled(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.select(id_col, label_domain().alias("domain"))


def op4_soft_mixing(spark, sf_dir):
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), labelled(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS)
    return out.select("doc_id", F.col("mix_tokens").alias("n_tokens"), F.col("mix_domain").alias("domain"), F.col("mix_p").alias("posterior"), F.col("mix_rate").alias("rate"), F.col("mix_copies").alias("copies"))
