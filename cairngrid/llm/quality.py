"""Quality scores by co-training.

Two views of a document are classified apart: its text (byte n-grams and telling words) and its metadata (source,
language, length). Over several rounds each view's classifier labels the unlabelled documents it is surest of, and
these become training rows of the other view. All unlabelled documents are scored in every round; the surest of each
class are found by a distributed top-k. At the end each view is calibrated on labelled rows that trained
neither, and the calibrated views are combined into one score for every document.
"""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairngrid.llm import features
from cairngrid.llm.common import append, cut, stored

#: Labelled documents to learn from, about; SPARE times as many at most.
MAX_LABELLED = 3000
SPARE = 2
ROUNDS = 3
SURE = 0.95
#: Pseudo-labels that a view gives another one per round, split over the classes as the labels are.
PER_ROUND = 300
META_BUCKETS = 96
META = ("source", "lang", "n_chars")


def meta_vectors(rows: list[tuple]) -> np.ndarray:
    """Metadata as hashed indicators: each value of source and language, and the length by powers of two; null is a value."""
    x = np.zeros((len(rows), META_BUCKETS), np.float32)
    for k, (source, lang, n_chars) in enumerate(rows):
        for name in (f"source={source}", f"lang={lang}", f"size={int(n_chars).bit_length() if n_chars is not None and n_chars >= 0 else None}"):
            x[k, zlib.crc32(name.encode("utf-8", "surrogatepass")) % META_BUCKETS] = 1
    return x


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _prob(x, w, c) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w + c, -30, 30)[:, 0]))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic fit on few columns by Newton steps with a small ridge."""
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(x.shape[1])
    t = (y * (y.sum() + 1) / (y.sum() + 2)) + (1 - y) / ((1 - y).sum() + 2)  # smoothed targets
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], w[-1:]


@dataclass
class Model:
    words: dict[str, int]
    text: tuple[np.ndarray, np.ndarray]
    meta: tuple[np.ndarray, np.ndarray]
    calibrate: list[tuple[np.ndarray, np.ndarray]]
    combine: tuple[np.ndarray, np.ndarray]
    added: list[tuple[int, int]]

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, text and metadata probability; each view is calibrated."""
        view = [1 / (1 + np.exp(-(_logit(_prob(x, *w))[:, None] @ a + b))) for x, w, (a, b) in zip((xt, xm), (self.text, self.meta), self.calibrate, strict=True)]
        a, b = self.combine
        return 1 / (1 + np.exp(-(np.column_stack([_logit(v) for v in view]) @ a + b))), *view


@dataclass
class Learner:
    """What co-training holds for one label: labelled rows (some to fit, some to calibrate), and the pseudo-labelled rows each view was given."""

    y: np.ndarray
    cal: np.ndarray
    xt: np.ndarray
    xm: np.ndarray
    given_text: list[tuple[np.ndarray, float]]
    given_meta: list[tuple[np.ndarray, float]]

    @staticmethod
    def fitted(x: np.ndarray, y: np.ndarray, given: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
        if given:
            x, y = np.concatenate([x, np.array([v for v, _ in given], np.float32)]), np.concatenate([y, [k for _, k in given]])
        return features.fit_logistic(x, y[:, None], steps=200)

    def views(self):
        fit = ~self.cal
        return self.fitted(self.xt[fit], self.y[fit], self.given_text), self.fitted(self.xm[fit], self.y[fit], self.given_meta)

    def model(self, words: dict[str, int], added: list[tuple[int, int]]) -> Model:
        views = self.views()
        y = self.y[self.cal]
        logits = [_logit(_prob(x[self.cal], *w)) for x, w in zip((self.xt, self.xm), views, strict=True)]
        each = [_platt(z[:, None], y) for z in logits]
        both = np.column_stack([z[:, None] @ a + b for z, (a, b) in zip(logits, each, strict=True)])
        return Model(words, *views, each, _platt(both, y), added)


def _learner(y: np.ndarray, xt: np.ndarray, xm: np.ndarray) -> Learner | None:
    """Every third labelled row calibrates. None if either part holds one class only."""
    known = ~np.isnan(y)
    y, xt, xm = y[known], xt[known], xm[known]
    cal = np.arange(len(y)) % 3 == 2
    if len(set(y[~cal])) < 2 or len(set(y[cal])) < 2:
        return None
    return Learner(y, cal, xt, xm, [], [])


def pool_scores(pool: DataFrame, words: dict[str, int], views: dict[str, tuple]) -> DataFrame:
    """(k, key) and per label <name>_t and <name>_m, both views' probabilities, for every row of ``pool`` (k, key, text, m0, m1, m2)."""
    names = [f"{n}_{v}" for n in views for v in "tm"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, features.BATCH):
                part = b.slice(at, features.BATCH)
                xt = features.Texts(part.column(2).to_pylist()).vectors(words)
                xm = meta_vectors(list(zip(*(part.column(k).to_pylist() for k in (3, 4, 5)), strict=True)))
                p = [pa.array(_prob(x, *w).astype(np.float64)) for pair in views.values() for x, w in zip((xt, xm), pair, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *p], names=["k", "key", *names])

    schema = T.StructType([pool.schema["k"], T.StructField("key", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    return pool.select("k", "key", "text", "m0", "m1", "m2").mapInArrow(run, schema)


def surest(scored: DataFrame, column: str, label: int, most: int, sure: float, taken: DataFrame | None) -> DataFrame:
    """The ``most`` keys that a view is surest of to be of class ``label`` (at least ``sure``), ties by a hash of the key; contents that occur often count once."""
    sureness = F.round(F.col(column) if label else 1 - F.col(column), 3)
    rows = scored.where((F.col(column) if label else 1 - F.col(column)) >= sure)
    rows = rows if taken is None else rows.join(F.broadcast(taken), "key", "left_anti")
    return rows.groupBy("key").agg(F.max(sureness).alias("sure")).orderBy(F.desc("sure"), F.xxhash64("key")).limit(most).select("key")


def train_all(docs: DataFrame, labels: DataFrame, targets: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", meta_cols=META, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, sure: float = SURE, per_round: int = PER_ROUND) -> dict[str, Model | None]:
    """Co-train one model per named target on about ``max_labelled`` labelled documents, drawn by a hash of the id, and on all unlabelled ones.

    A target is a boolean over the columns of ``labels``; rows where all are null, and null texts, are left out; an id with
    several labels counts with the lowest of each target. In each round both
    views score every unlabelled document, and each hands the other its ``per_round`` surest ones. None for a target whose labels hold one class only.
    """
    spark = docs.sparkSession
    named = [label.cast("double").alias(f"y{i}") for i, label in enumerate(targets.values())]
    known = cut(labels.select(F.col(id_col).alias("k"), *named).where(F.col("k").isNotNull() & F.coalesce(*[f"y{i}" for i in range(len(named))]).isNotNull()).groupBy("k").agg(*[F.min(f"y{i}").alias(f"y{i}") for i in range(len(named))]))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("labelled")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < max_labelled / n) if n > max_labelled else known
    meta = [F.col(c).alias(f"m{i}") for i, c in enumerate(meta_cols)]
    view = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text"), *meta)
    view = view.withColumn("key", F.xxhash64("text", "m0", "m1", "m2"))
    # about max_labelled ids and labels: bounded
    sample = view.join(F.broadcast(chosen), "k").select("text", "key", "m0", "m1", "m2", *[f"y{i}" for i in range(len(named))])
    both = F.concat_ws(" ", *[F.coalesce(F.col(f"y{i}").cast("int").cast("string"), F.lit("-")) for i in range(len(named))])
    words = {w: i for i, w in enumerate(features.choose_words(sample.select("text", both.alias("class"))))}
    got, xt = features.sampled_vectors(sample, words, SPARE * max_labelled)
    xm = meta_vectors([g[1:4] for g in got])
    y = np.array([[np.nan if v is None else v for v in g[4:]] for g in got], float).reshape(len(got), len(named))
    learners = {name: _learner(y[:, i], xt, xm) for i, name in enumerate(targets)}
    live = {name: v for name, v in learners.items() if v}
    added: dict[str, list[tuple[int, int]]] = {name: [] for name in live}
    taken: dict[tuple[str, str], set[int]] = {(name, v): set() for name in live for v in "tm"}
    for _ in range(rounds if live else 0):
        scored = stored(pool_scores(view, words, {name: v.views() for name, v in live.items()}).join(known.select("k"), "k", "left_anti"))
        wanted = []
        for name, learner in live.items():
            for teacher in "tm":
                pupil, rate = ("m" if teacher == "t" else "t"), learner.y.mean()
                gone = taken[name, pupil]
                gone = spark.createDataFrame([(k,) for k in sorted(gone)], "key long") if gone else None  # rounds * per_round keys at most
                for label in (1, 0):
                    most = max(1, round(per_round * (rate if label else 1 - rate)))
                    wanted.append(surest(scored, f"{name}_{teacher}", label, most, sure, gone).select("key", F.lit(name).alias("target"), F.lit(pupil).alias("pupil"), F.lit(label).alias("label")))
        picks = [tuple(r) for r in reduce(DataFrame.unionByName, wanted).collect()]
        if not picks:
            break
        keys = spark.createDataFrame([(k,) for k in sorted({p[0] for p in picks})], "key long")
        # whatever row holds a picked content will do, so no text moves before the picks are found
        rows = view.join(F.broadcast(keys), "key", "left_semi").groupBy("key").agg(*[F.first(c).alias(c) for c in ("text", "m0", "m1", "m2")])
        found, vectors = features.sampled_vectors(rows.select("text", "key", "m0", "m1", "m2"), words, len(picks))
        place = {g[0]: i for i, g in enumerate(found)}
        metas = meta_vectors([g[1:4] for g in found])
        new = {name: {"t": 0, "m": 0} for name in live}
        for key, name, pupil, label in sorted(picks):
            if key in place and key not in taken[name, pupil]:
                taken[name, pupil].add(key)
                learner = live[name]
                (learner.given_text if pupil == "t" else learner.given_meta).append(((vectors if pupil == "t" else metas)[place[key]], float(label)))
                new[name][pupil] += 1
        for name in live:
            added[name].append((new[name]["m"], new[name]["t"]))
    for name, handed in added.items():
        for view, k in (("metadata", 0), ("text", 1)):
            if not sum(n[k] for n in handed):
                warnings.warn(f"{name}: the {view} view was handed no pseudo-label, since the other was never sure enough", stacklevel=2)
    return {name: v and v.model(words, added[name]) for name, v in learners.items()}


def train(docs: DataFrame, labels: DataFrame, label: Column, **options) -> Model | None:
    """``train_all`` for one label."""
    return train_all(docs, labels, {"label": label}, **options)["label"]


def score(docs: DataFrame, models: dict[str, Model | None], text_col: str = "text", meta_cols=META) -> DataFrame:
    """``docs`` plus, for each named model, <name>_score, <name>_text_score and <name>_meta_score (0 to 1).

    A null text counts as empty. A model without both classes gives 0.5 everywhere. Repeated rows get equal scores; an empty table
    gives an empty result; columns of ``docs`` with these names are replaced.
    """
    names = [f"{n}_{s}" for n in models for s in ("score", "text_score", "meta_score")]

    def make(columns):
        texts, metas = [t or "" for t in columns[0]], list(zip(*columns[1:], strict=True))
        xm, xt, vectors, out = meta_vectors(metas), features.Texts(texts), {}, []
        for m in models.values():
            if m and id(m.words) not in vectors:  # models trained together share their words
                vectors[id(m.words)] = xt.vectors(m.words)
            got = m.scores(vectors[id(m.words)], xm) if m else [np.full(len(texts), 0.5)] * 3
            out += [pa.array(np.asarray(g, float).ravel()) for g in got]
        return out

    return append(docs, [text_col, *meta_cols], ", ".join(f"{n} double" for n in names), make)


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """``docs`` plus the scores for quality and toxicity and ``kept``: quality reaches the threshold and toxicity does not."""
    out = score(docs, train_all(docs, labels, {"quality": F.col("quality") == 1, "toxic": F.col("toxic") == 1}, id_col))
    return out.withColumn("kept", (F.col("quality_score") >= threshold) & (F.col("toxic_score") < threshold))


def op8_cotraining(spark, sf_dir):
    out = quality_filter(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", (F.col("quality_score") * (1 - F.col("toxic_score"))).alias("score"), "quality_score", "toxic_score", F.col("quality_text_score").alias("text_score"), F.col("quality_meta_score").alias("meta_score"), "kept")
