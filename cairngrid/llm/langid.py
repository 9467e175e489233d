"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. One binary classifier on hashed byte n-grams of the whole text
predicts each bit; decoding weighs each bit's loss by how reliable that classifier is and takes the
nearest codeword. A text whose two nearest codewords are nearly as far away is flagged as ambiguous.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngrid.llm import features
from cairngrid.llm.common import append

UNKNOWN = "und"
MAX_TRAIN_ROWS = 2400
SPARE = 2
MARGIN = 0.2
BATCH = 256


def codebook(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of -1 and +1 (rows). Up to six languages: every distinct split; more: the best of many random codes."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 6:
        return np.array([[1 if i == k - 1 else -1 if c >> i & 1 else 1 for c in range(1, 2 ** (k - 1))] for i in range(k)], float)
    rnd, bits, best, found = np.random.default_rng(seed), math.ceil(10 * math.log2(k)), -1, None
    for _ in range(200):
        m = rnd.choice([-1.0, 1.0], (k, bits))
        m[:, np.abs(m.sum(axis=0)) == k] *= np.where(np.arange(k) % 2, 1, -1)[:, None]
        d = (bits - m @ m.T) / 2
        least = d[~np.eye(k, dtype=bool)].min()
        if least > best:
            best, found = least, m
    return found


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of the soft minimum (0..1) and the distance to the runner-up."""
        f = x @ self.weights + self.bias
        loss = np.logaddexp(0, -f[:, None, :] * self.codes[None]) @ self.bit_weight
        order = np.argsort(loss, axis=1, kind="stable")
        first = np.take_along_axis(loss, order[:, :1], 1)
        p = 1 / np.exp(first - loss).sum(axis=1)
        gap = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - first[:, 0] if loss.shape[1] > 1 else np.full(len(x), np.inf)
        return order[:, 0], p, gap


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit the bit classifiers on a bounded sample of the labelled rows: at most about ``max_rows`` in all, spread evenly over the languages.

    Language counts cover all labelled rows; the sample is drawn by a hash of id and text, so it is the same on every run. Rows that are alike in both
    are drawn together or not at all; ``SPARE`` times the bound is never passed.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    count = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}
    languages = sorted(count)
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((features.BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.ones(1))
    each = max(1, max_rows // len(languages))
    share = F.create_map(*[v for k in languages for v in (F.lit(k), F.lit(min(1.0, each / count[k])))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share[F.col(lang_col).cast("string")])

    def vectors(batches):
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                x = features.matrix(b.column(0).slice(at, BATCH).to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1).slice(at, BATCH)], names=["x", "lang"])

    made = sample.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(vectors, "x binary, lang string")
    got = sorted((r.lang, bytes(r.x)) for r in features.gathered(made, SPARE * max_rows))
    lang = np.searchsorted(languages, [k for k, _ in got])
    x = np.empty((len(got), features.BUCKETS), np.float32)
    for k in range(len(got)):
        x[k], got[k] = np.frombuffer(got[k][1], np.float16), None
    codes = codebook(len(languages))
    want = codes[lang] > 0
    w, c = features.fit_logistic(x, want)
    good = (((x @ w + c) > 0) == want).mean(axis=0)
    trust = np.log((good + 1e-2) / (1 - good + 1e-2)).clip(0.05)
    return Model(languages, codes, w, c, trust / trust.mean())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """(id, lang_pred, score, ambiguous) for every row.

    A null text, a text without a letter, or a model without languages gives ``und`` with score 0. Ties go to
    the language that sorts first. Repeated rows come back as often as they came, a null id stays null, other columns are ignored;
    an empty table gives an empty result. Only the text is an input.
    """

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = with_language(rows, model, "text", margin)
    return out.select("id", F.col("pred_lang").alias("lang_pred"), F.col("pred_score").alias("score"), F.col("pred_ambiguous").alias("ambiguous"))


def with_language(docs: DataFrame, model: Model, text_col: str = "text", margin: float = MARGIN, prefix: str = "pred_") -> DataFrame:
    """``docs`` plus pred_lang, pred_score and pred_ambiguous, as ``identify`` defines them; columns of these names are replaced, unless another prefix is given."""

    def make(columns):
        text = columns[0]
        ok = np.array([bool(model.languages) and has_letter(t) for t in text])
        pred, score, close = [UNKNOWN] * len(text), np.zeros(len(text)), np.ones(len(text), bool)
        if ok.any():
            best, p, gap = model.decode(features.matrix([t for t, k in zip(text, ok, strict=True) if k]))
            score[ok], close[ok] = p, gap < margin
            for k, i in zip(np.nonzero(ok)[0], best, strict=True):
                pred[k] = model.languages[i]
        return [pa.array(pred), pa.array(score), pa.array(close)]

    return append(docs, [text_col], f"{prefix}lang string, {prefix}score double, {prefix}ambiguous boolean", make)


def held_out(id_col: str = "doc_id"):
    """True for the rows no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op1_langid_ecoc(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return identify(docs, model).withColumnRenamed("id", "doc_id").withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
