"""Ranked lexical search over document shards.

Documents are dealt into shards of bounded size; a shard is one row that holds its terms, for each of them the documents it
stands in (compressed sparse rows) and there an integer impact, which depends on the document only and is computed when the
index is made. A search brings in each query term's weight, adds weight times impact term by term into a dense array of
the shard's documents, and takes the k best with their ties resolved; tasks merge the bests of their shards and Spark those of the tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngrid.llm.arrow_text import WORD_TABLE, grouped, parts, split
from cairngrid.llm.common import numbered, stored

TOP = 20
#: Bytes of text in a shard; one longer document is a shard of its own.
SHARD = 8 << 20
#: Terms of items that are searched at once; more items are searched in blocks.
BLOCK_TERMS = 500_000
#: Lanes in which the bests of tasks are merged before they meet.
LANES = 256


@dataclass
class Index:
    """``shards``: one row per shard; ``n_docs``: documents with a term; ``n_terms``: all their terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with a term, all terms with repeats)."""

    def run(batches):
        for b in parts(batches, 0, SHARD):
            _, doc = split(b.column(0), WORD_TABLE)
            yield pa.RecordBatch.from_arrays([pa.array([len(np.unique(doc))]), pa.array([len(doc)])], names=["docs", "terms"])

    got = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return got[0] or 0, got[1] or 0


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Per posting (10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L for a document of n terms."""
    m = 75 + (25 * n_docs * n) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Two passes over the texts: the corpus' size, then the shards, which are stored in the shared folder, each as a row group of its own.

    Columns of a shard: ``ids`` in ascending order (missing ones last), ``terms``, ``dfs`` (documents of each term), and as
    32-bit integers in bytes ``docs`` (places in ``ids``) and ``impacts`` of all terms' documents, one after the other.
    """
    n_docs, n_terms = corpus_size(docs, text_col)

    def run(batches):
        for b in parts(batches, 1, SHARD):
            b = b.take(pc.sort_indices(b, sort_keys=[("id", "ascending")], null_placement="at_end"))
            word, doc = split(b.column(1), WORD_TABLE)
            coded = word.dictionary_encode()
            key, tf, _ = grouped(coded.indices.to_numpy().astype(np.int64) * b.num_rows + doc, np.ones(len(doc), np.int64))
            term, at = np.divmod(key, b.num_rows)
            score = impacts(tf, np.bincount(doc, minlength=b.num_rows)[at], n_docs, n_terms) if len(key) else tf
            dfs = np.bincount(term, minlength=len(coded.dictionary)).astype(np.int32)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [one(b.column(0)), one(coded.dictionary), one(pa.array(dfs)), pa.array([at.astype("<i4").tobytes()]), pa.array([score.astype("<i4").tobytes()])]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "terms", "dfs", "docs", "impacts"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return Index(stored(rows.mapInArrow(run, f"ids array<{kind}>, terms array<string>, dfs array<int>, docs binary, impacts binary"), group=1), n_docs, n_terms)


def item_terms(items: DataFrame, number: str, text_col: str) -> DataFrame:
    """(item, term, times) of every item row."""

    def run(batches):
        for b in parts(batches, 1, SHARD):
            word, row = split(b.column(1), WORD_TABLE)
            coded = word.dictionary_encode()
            key, times, _ = grouped(row * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), np.ones(len(row), np.int64))
            row, term = np.divmod(key, max(1, len(coded.dictionary)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), coded.dictionary.take(pa.array(term)), pa.array(times)], names=["item", "term", "times"])

    return items.select(F.col(number).alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "item long, term string, times long")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores above 0; of those equal to the last one the first places count."""
    some = np.flatnonzero(scores > 0)
    if len(some) <= k:
        return some
    s = scores[some]
    last = s[np.argpartition(s, len(s) - k)[len(s) - k]]
    above = some[s > last]
    return np.concatenate([above, some[s == last][: k - len(above)]])


def _merge(held: list, more: list, k: int) -> list:
    return sorted(held + more, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:k]


def _search_block(index: Index, block: DataFrame, k: int) -> DataFrame:
    """(item, lane, doc_id, score): every task's ``k`` best for every item of ``block`` (item, term, times)."""
    terms = block.select("term").distinct()
    df = index.shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select("t.*").join(F.broadcast(terms), F.col("terms") == F.col("term"), "left_semi").groupBy("terms").agg(F.sum("dfs").alias("df"))
    got = block.join(F.broadcast(df), F.col("term") == F.col("terms")).select("item", "term", "times", "df").orderBy("item", "term").toArrow()  # BLOCK_TERMS rows or one item's
    wanted = pc.unique(got.column("term"))
    code = pc.index_in(got.column("term"), value_set=wanted).to_numpy()
    factor = np.array([weight(index.n_docs, d) for d in got.column("df").to_pylist()], np.int64) * got.column("times").to_numpy()
    item = got.column("item").to_numpy()
    cuts = [*np.flatnonzero(np.r_[True, item[1:] != item[:-1]][: len(item)]), len(item)]
    plan = block.sparkSession.sparkContext.broadcast((wanted, [(int(item[a]), code[a:e], factor[a:e]) for a, e in zip(cuts[:-1], cuts[1:], strict=True)]))

    def run(batches):
        wanted, queries = plan.value
        tops: dict[int, list] = {}
        for b in batches:
            for r in range(b.num_rows):
                ids, dfs = b.column(0)[r].values, b.column(2)[r].values.to_numpy()
                docs, impact = (np.frombuffer(b.column(c)[r].as_buffer(), "<i4") for c in (3, 4))
                offsets = np.r_[0, np.cumsum(dfs, dtype=np.int64)]
                place = pc.fill_null(pc.index_in(wanted, value_set=b.column(1)[r].values), -1).to_numpy()
                for number, codes, factors in queries:
                    at = place[codes]
                    scores = np.zeros(len(ids), np.int64)
                    for t, f in zip(at[at >= 0].tolist(), factors[at >= 0].tolist(), strict=True):
                        a, e = offsets[t], offsets[t + 1]
                        scores[docs[a:e]] += f * impact[a:e].astype(np.int64)
                    top = best(scores, k)
                    if len(top):
                        tops[number] = _merge(tops.get(number, []), list(zip(scores[top].tolist(), ids.take(pa.array(top)).to_pylist(), strict=True)), k)
        flat = [(n, s, i) for n, held in tops.items() for s, i in held]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[2] for x in flat], kind), pa.array([x[1] for x in flat], pa.int64())], names=["item", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = index.shards.schema["ids"].dataType.elementType
    kind = to_arrow_type(id_type)
    return index.shards.mapInArrow(run, f"item long, doc_id {id_type.simpleString()}, score long").withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))


def search(index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item row's ``k`` highest-scoring documents with a score above 0, equal scores by ascending doc_id.

    Every item row is a search of its own, also where ids repeat or are null; null and wordless items and items of which no term occurs find
    nothing. Documents that are null or without a term are never found; documents of one id are found each by itself, those without an id
    come last among equals. Empty tables give no rows; other columns are ignored. Items are searched in blocks of about ``block_terms`` terms.
    """
    rows, number = numbered(items)
    terms = stored(item_terms(rows, number, text_col))
    blocks = max(1, -(-terms.count() // block_terms))
    found = None
    for b in range(blocks):
        got = _search_block(index, terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k)
        found = got if found is None else found.unionByName(got)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", "lane"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    names = rows.select(F.col(number).alias("item"), F.col(id_col).alias("item_id"))
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")


def op12_impact_shards(spark, sf_dir):
    return search(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
