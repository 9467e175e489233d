"""Phrase collocations: word sequences that occur more often than their parts let expect.

Identical pieces of text (between punctuation marks) become one row with a multiplicity. Weighted n-grams are
added up within a task, dealt out by a hash of language and phrase, and every hash bucket is counted by duckdb, which spills
to disk where a bucket exceeds its memory. A phrase can only reach the least count if its parts do, so words are counted first,
then pairs of frequent words, then longer runs of frequent pairs; what is frequent is told by a bitmap of fixed size, whose
false hits cost time and change no count. Candidates then ask for the counts of their parts: requests are shuffled to where the parts are counted.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngrid.llm.arrow_text import PIECE_TABLE, grouped, parts, split
from cairngrid.llm.common import stored

LEAST = 100
MAX_WORDS = 5
TOP = 2000
UNKNOWN = "und"
#: Bytes of text that a task counts at once.
PART = 8 << 20
#: Bits of the bitmap of frequent words or pairs (16 MB), whatever the corpus; a power of two.
BITMAP_BITS = 1 << 27
DUCKDB_MB = 256
COUNTS = "lang string, phrase string, n long"


def pieces(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, piece, n): every different piece with a word in it and how often it stands in the texts."""

    def run(batches):
        for b in parts(batches, 1, PART):
            piece, doc = split(b.column(1), PIECE_TABLE, "\n")
            langs = b.column(0).dictionary_encode()
            texts = piece.dictionary_encode()
            width = max(1, len(langs.dictionary))
            key, n, _ = grouped(texts.indices.to_numpy().astype(np.int64) * width + langs.indices.to_numpy()[doc], np.ones(len(doc), np.int64))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key % width)), texts.dictionary.take(pa.array(key // width)), pa.array(n)], names=["lang", "piece", "n"])

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def _word_hashes(lang: list, word: list) -> np.ndarray:
    seeds = {x: xxhash.xxh64_intdigest(x) for x in set(lang)}
    return np.fromiter((xxhash.xxh64_intdigest(w, seeds[x]) for x, w in zip(lang, word, strict=True)), np.uint64, len(word))


def _pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def frequent_bitmap(counts: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """The bitmap of the words or pairs in ``counts``, as 64-bit words; tasks send what they set, and no more than the bitmap comes to the driver."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                word = pc.split_pattern(b.column(1), " ")
                size = np.diff(word.offsets.to_numpy())
                h = _word_hashes(np.repeat(np.array(b.column(0).to_pylist(), object), size).tolist(), word.flatten().to_pylist())
                first = np.r_[0, np.cumsum(size)[:-1]]
                h = np.where(size == 2, _pair_hashes(h[first], h[np.minimum(first + 1, len(h) - 1)]), h[first])
                slot = np.concatenate(_slots(h, bits))
                yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], names=["at", "b"])

    got = counts.where("phrase <> ''").select("lang", "phrase").mapInArrow(run, "at long, b long").groupBy("at").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("at").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def _holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    hit = lambda s: (bitmap[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1)
    a, b = _slots(h, len(bitmap) * 64)
    return (hit(a) & hit(b)).astype(bool)


def grams(found: DataFrame, sizes: tuple[int, ...], bitmap=None) -> DataFrame:
    """(lang, phrase, n) of the n-grams of ``sizes`` in pieces, added up by task: (1,) all words, with all of a language under the empty phrase;
    (2,) pairs of words in ``bitmap`` (a broadcast); more: runs of pairs in ``bitmap``."""

    def run(batches):
        for b in parts(batches, 1, PART):
            word, piece = split(b.column(1), None)
            if not len(word):
                continue
            langs, words, weight = b.column(0).dictionary_encode(), word.dictionary_encode(), b.column(2).to_numpy()[piece]
            width = len(langs.dictionary)
            lang = langs.indices.to_numpy()[piece].astype(np.int64)
            ids, sums, place = grouped(words.indices.to_numpy().astype(np.int64) * width + lang, weight)

            def out(n, at, phrase, lang=lang, langs=langs):
                return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[at])), phrase, pa.array(n)], names=["lang", "phrase", "n"])

            if sizes == (1,):
                yield out(sums, place, word.take(pa.array(place)))
                _, all_of, at = grouped(lang, weight)
                yield out(all_of, at, pa.array([""] * len(at)))
                continue
            bits = bitmap.value
            own = np.searchsorted(ids, words.indices.to_numpy().astype(np.int64) * width + lang)
            h = _word_hashes(langs.dictionary.take(pa.array(lang[place])).to_pylist(), word.take(pa.array(place)).to_pylist())
            inside = piece[1:] == piece[:-1]
            if sizes == (2,):
                good = _holds(bits, h)[own]
                ok = inside & good[1:] & good[:-1]
            else:
                ok = np.zeros(len(inside), bool)
                at = np.flatnonzero(inside)
                ok[at] = _holds(bits, _pair_hashes(h[own[at]], h[own[at + 1]]))
            level = own
            for size in range(2, max(sizes) + 1):  # ``at``: where an n-gram of this size starts, ``level``: its number
                at = np.flatnonzero(ok)
                if not len(at):
                    break
                ids, sums, first = grouped(level[at] * (int(level.max()) + 1) + level[at + 1], weight[at])
                if size in sizes:
                    first = at[first]
                    yield out(sums, first, pc.binary_join_element_wise(*[word.take(pa.array(first + k)) for k in range(size)], " "))
                following = np.zeros(len(word), np.int64)
                following[at] = np.searchsorted(ids, level[at] * (int(level.max()) + 1) + level[at + 1])
                level, ok = following, np.r_[ok[:-1] & ok[1:], False]

    return found.select("lang", "piece", "n").mapInArrow(run, COUNTS)


def count_buckets(some: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n) with all partial counts of a phrase added up, of those that reach ``least`` (and the empty phrases).

    One partition is one hash bucket. duckdb spills into a folder of this task's own among Spark's local folders, as Spark's own sorts
    do; it is removed when the task ends.
    """

    def run(batches):
        import duckdb

        first = next(iter(batches := iter(batches)), None)
        if first is None:
            return
        scratch = tempfile.mkdtemp(prefix="counts-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        con = duckdb.connect(config={"threads": "1", "memory_limit": f"{DUCKDB_MB}MB", "temp_directory": scratch, "preserve_insertion_order": "false"})
        try:
            con.register("grams", pa.RecordBatchReader.from_batches(first.schema, (x for y in ([first], batches) for x in y)))
            yield from con.sql(f"SELECT lang, phrase, sum(n)::BIGINT AS n FROM grams GROUP BY lang, phrase HAVING sum(n) >= {int(least)} OR phrase = ''").to_arrow_reader(50_000)
        finally:
            con.close()
            shutil.rmtree(scratch, ignore_errors=True)

    return some.repartition("lang", "phrase").mapInArrow(run, COUNTS)


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, max_words: int = MAX_WORDS, bits: int = BITMAP_BITS) -> DataFrame:
    """(lang, phrase, n) of all phrases of 1 to ``max_words`` words with ``least`` occurrences or more; n of the empty phrase is that of all words."""
    sc, found = docs.sparkSession.sparkContext, stored(pieces(docs, lang_col, text_col))
    out = words = stored(count_buckets(grams(found, (1,)), least))
    if max_words > 1:
        pairs = stored(count_buckets(grams(found, (2,), sc.broadcast(frequent_bitmap(words, bits))), least))
        out = out.unionByName(pairs)
    if max_words > 2:
        more = stored(count_buckets(grams(found, tuple(range(3, max_words + 1)), sc.broadcast(frequent_bitmap(pairs, bits))), least))
        out = out.unionByName(more)
    return out


def _join_words(words: Column, at: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def _lowest_cuts(found: DataFrame, counts: DataFrame, max_words: int) -> DataFrame:
    """(lang, phrase, a, n, k, l, r, score): every candidate with its lowest-scoring cut.

    Each part of each cut is a request for the part's count, shuffled to it; a part that many candidates ask for is a
    skewed key of a plain join, which Spark splits. The answers come back as grouped maxima.
    """
    size, words = F.size("words"), F.col("words")
    cuts = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.array(F.struct(k.alias("k"), F.lit(0).alias("side"), _join_words(words, 1, k).alias("part")), F.struct(k.alias("k"), F.lit(1).alias("side"), _join_words(words, k + 1, size - k).alias("part"))))
    asked = found.select("lang", "phrase", F.explode(F.flatten(cuts)).alias("q")).select("lang", "phrase", "q.*")
    told = asked.join(counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    sides = [F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{'lr'[s]}{k}") for k in range(1, max_words) for s in (0, 1)]
    rows = found.select("lang", "phrase", "a", "n").join(told.groupBy("lang", "phrase").agg(*sides), ["lang", "phrase"])
    score = lambda k: F.expr(f"(CAST(1000 AS DECIMAL(38,0)) * a * n) div (CAST(l{k} AS DECIMAL(38,0)) * r{k})")
    each = [F.when(F.col(f"l{k}").isNotNull() & F.col(f"r{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, max_words)]
    return rows.select("lang", "phrase", "a", "n", F.array_min(F.array(*each)).alias("c")).select("lang", "phrase", "a", "n", "c.*")


def _inside_longer(found: DataFrame) -> DataFrame:
    """(lang, phrase, most): how often the most frequent longer candidate around it occurs, for every phrase of two words or more inside one."""
    size, words = F.size("words"), F.col("words")
    inner = F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: _join_words(words, i, n)))
    return found.where(size > 2).select("lang", F.explode(F.flatten(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, max_words: int = MAX_WORDS, top: int = TOP, bits: int = BITMAP_BITS) -> DataFrame:
    """Each language's ``top`` phrases by score: (lang, rank, phrase, a, l, r, n, score, cut).

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs. A phrase of 2 to ``max_words`` words with
    a >= ``least`` occurrences scores floor(1000 a n / (l r)) at its lowest cut (l, r: counts of both parts; ties: first cut; n: all words of the language), in exact
    arithmetic; one inside a longer phrase that occurs as often is left out. Order: score, a, then the phrase's bytes. A null language is ``und``; null, empty and
    wordless texts have no words; repeated rows count as often as they came; an empty table gives no rows; other columns are ignored. A long text is one
    value of a task, but its pieces are counted in shares.
    """
    counts = phrase_counts(docs, lang_col, text_col, least, max_words, bits)
    words = counts.where("phrase <> ''")
    total = counts.where("phrase = ''").select("lang", F.col("n").alias("all_words"))
    found = words.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1).join(total, "lang").select("lang", "phrase", "words", F.col("n").alias("a"), F.col("all_words").alias("n"))
    found = stored(found)
    free = _lowest_cuts(found, words, max_words).join(_inside_longer(found), ["lang", "phrase"], "left").where("most is null or most < a")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    long = [F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score", "k")]
    return free.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *long[:5], long[5].alias("cut"))


def op13_weighted_ngrams(spark, sf_dir):
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("cut")
