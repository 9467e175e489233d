"""Hashed byte n-gram histograms of whole texts, and the small linear models fitted on them."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 256
BUCKETS = 4096
ORDERS = (2, 3)
CHUNK = 1 << 20
HISTOGRAM_WEIGHT = 4
#: Parts in which sampled vectors come to the driver.
GATHERED_PARTS = 16


def _buckets(b: np.ndarray, n: int, buckets: int) -> np.ndarray:
    h = b[: len(b) - n + 1].astype(np.uint32)
    for i in range(1, n):
        h = (h << np.uint32(8)) | b[i : len(b) - n + 1 + i]
    return (((h + np.uint32(n << 26)) * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(buckets)


def histogram(text: str | None, buckets: int = BUCKETS, lower: bool = True) -> np.ndarray:
    """Counts of the text's byte 2- and 3-grams by hash bucket, over the whole text, in chunks of bounded memory."""
    out = np.zeros(buckets, np.int64)
    t = text or ""
    raw = np.frombuffer((" " + (t.lower() if lower else t) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK + max(ORDERS) - 1]
        for n in ORDERS:
            if at and len(part) < max(ORDERS):
                part_n = raw[at : at + CHUNK + n - 1]
            else:
                part_n = part[: CHUNK + n - 1]
            if len(part_n) >= n:
                out += np.bincount(_buckets(part_n, n, buckets), minlength=buckets)
    return out


def matrix(texts, buckets: int = BUCKETS, lower: bool = True) -> np.ndarray:
    """One row per text: square roots of the histogram, scaled to unit length."""
    x = np.zeros((len(texts), buckets), np.float32)
    for k, t in enumerate(texts):
        h = histogram(t, buckets, lower)
        x[k] = np.sqrt(h / max(1, h.sum()))
    return x


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x outputs) and biases of one logistic regression per column of ``y`` (0..1), by accelerated gradient descent."""
    y = y.astype(np.float32)
    n, b = y.shape
    s = np.ones((n, 1), np.float32) if weight is None else weight.astype(np.float32).reshape(n, -1)
    s = s / s.sum(axis=0)
    v = np.ones(x.shape[1], np.float32) / np.sqrt(x.shape[1])
    for _ in range(20):  # largest eigenvalue of the second moment, for the step
        u = x.T @ (s[:, :1] * (x @ v)[:, None])[:, 0] + 1e-12
        top = float(np.linalg.norm(u))
        v = (u / top).astype(np.float32)
    rate = 1 / (0.25 * (top + 1) + ridge)
    w, c = np.zeros((x.shape[1], b), np.float32), np.zeros(b, np.float32)
    w0, c0 = w, c
    for k in range(steps):
        m = k / (k + 3)
        wm, cm = w + m * (w - w0), c + m * (c - c0)
        p = 1 / (1 + np.exp(-np.clip(x @ wm + cm, -30, 30)))
        g = s * (p - y)
        w0, c0 = w, c
        w, c = wm - rate * (x.T @ g + ridge * wm), cm - rate * g.sum(axis=0)
    return w, c


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words without their outer punctuation."""
    return {w.strip(".,;:!?\"'()[]*#%&$|") for w in (text or "").lower().split()}


def choose_words(rows: DataFrame, most: int = 1000, least_docs: int = 5, least_z: float = 4) -> list[str]:
    """The words whose presence tells the classes of ``rows`` (text, class) apart best by their deviation from chance; at most ``most``.

    Words are counted per batch of texts in the executors and added up in Spark; only the chosen ones reach the driver.
    """
    total = {r[0]: r[1] for r in rows.groupBy("class").count().collect()}
    n_all = sum(total.values())

    def run(batches):
        for b in batches:
            seen: dict[str, Counter] = {}
            for c, t in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True):
                seen.setdefault(c, Counter()).update(words_of(t))
            out = [(c, w, n) for c, own in seen.items() for w, n in own.items()]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["class", "word", "n"])

    if len(total) < 2:
        return []
    by_class = rows.select("class", "text").mapInArrow(run, "class string, word string, n long").groupBy("word").agg(*[F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).alias(f"c{k}") for k, c in enumerate(total)])
    n = sum((F.col(f"c{k}") for k in range(len(total))), F.lit(0))
    shares = [v / n_all for v in total.values()]
    z = [F.abs(F.col(f"c{k}") - F.col("n") * s) / F.sqrt(F.col("n") * s * (1 - s) + 1) for k, s in enumerate(shares)]
    best = by_class.withColumn("n", n).where(F.col("n") >= least_docs).select("word", F.greatest(*z).alias("z")).where(F.col("z") >= least_z)
    return [r.word for r in best.orderBy(F.desc("z"), "word").limit(most).collect()]


class Texts:
    """What all text models need of a batch: its case-sensitive n-gram histograms (of length HISTOGRAM_WEIGHT) and word sets."""

    def __init__(self, texts, buckets: int = 1024):
        self.histograms = HISTOGRAM_WEIGHT * matrix(texts, buckets, lower=False)
        self.words = [words_of(t) for t in texts]

    def vectors(self, words: dict[str, int]) -> np.ndarray:
        """The histogram followed by a 0/1 column for each chosen word."""
        n = self.histograms.shape[1]
        x = np.zeros((len(self.words), n + len(words)), np.float32)
        x[:, :n] = self.histograms
        known = words.keys()
        for k, own in enumerate(self.words):
            for w in own & known:
                x[k, n + words[w]] = 1
        return x


def text_vectors(texts, words: dict[str, int]) -> np.ndarray:
    """Vectors of many texts, in batches: word sets are large."""
    parts = [Texts(texts[k : k + BATCH]).vectors(words) for k in range(0, len(texts), BATCH)]
    return np.concatenate(parts) if parts else Texts([]).vectors(words)


def gathered(vectors: DataFrame, most: int):
    """At most ``most`` rows, part by part: the driver's JVM holds a task's whole result several times over while it takes it in."""
    return vectors.limit(most).repartition(GATHERED_PARTS).toLocalIterator()


def sampled_vectors(rows: DataFrame, words: dict[str, int], most: int) -> tuple[list[tuple], np.ndarray]:
    """The columns of ``rows`` but ``text``, and the vectors of their texts (half precision on the way), of at most ``most`` rows, in the order of the columns.

    Vectors are made in the executors, so no text reaches the driver.
    """
    others = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches):
        for b in batches:
            text = b.column(0)
            for at in range(0, b.num_rows, BATCH):
                x = Texts(text.slice(at, BATCH).to_pylist()).vectors(words).astype(np.float16)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, BATCH) for k in range(1, b.num_columns)), pa.array([v.tobytes() for v in x], pa.binary())], names=[*(f.name for f in others), "x"])

    made = rows.select("text", *[f.name for f in others]).mapInArrow(run, T.StructType([*others, T.StructField("x", T.BinaryType())]))
    got = [(tuple(r)[:-1], bytes(r.x)) for r in gathered(made, most)]
    got.sort(key=lambda g: (repr(g[0]), g[1]))
    x = np.zeros((len(got), 1024 + len(words)), np.float32)
    for k, (_, v) in enumerate(got):
        x[k] = np.frombuffer(v, np.float16)
    return [g for g, _ in got], x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by accelerated gradient descent; ``y`` is one-hot (n x k)."""
    y = y.astype(np.float32)
    n, k = y.shape
    v = np.ones(x.shape[1], np.float32) / np.sqrt(x.shape[1])
    for _ in range(20):
        u = x.T @ (x @ v) / n + 1e-12
        top = float(np.linalg.norm(u))
        v = (u / top).astype(np.float32)
    rate = 1 / (0.5 * (top + 1) + ridge)
    w, c = np.zeros((x.shape[1], k), np.float32), np.log(y.mean(axis=0) + 1e-6).astype(np.float32)
    w0, c0 = w, c
    for t in range(steps):
        m = t / (t + 3)
        wm, cm = w + m * (w - w0), c + m * (c - c0)
        g = (softmax(x @ wm + cm) - y) / n
        w0, c0 = w, c
        w, c = wm - rate * (x.T @ g + ridge * wm), cm - rate * g.sum(axis=0)
    return w, c
