"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Every window of consecutive benchmark words is looked up through its rarest words. One pass over the corpus counts
how often each benchmark word occurs; a second one stores the postings (document, position, word) of the
two rarest occurring words of every window, with a few words of context for the rarest. Postings minus the word's place in the item
give diagonals; lists are intersected on (item, document, diagonal), and what is left is compared word by
word with the context: exact phrases. Where both words of a window stand near their places in it, that is a proximity
match. Every document comes back with what was found.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngrid.llm.common import cut, stored

WINDOW = 10
RAREST = 2
#: Words by which a proximity match may be off.
SLOP = 5
#: Windows that one block may broadcast; a larger benchmark is matched in blocks.
BLOCK_WINDOWS = 200_000
#: ASCII signs that are neither digits nor letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(text: Column) -> Column:
    """Words in order after lower-casing A-Z; the first and the last element may be empty and are no words."""
    return F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), SEPARATORS)


def _count_words(words: Column) -> Column:
    empty = lambda at: F.coalesce((F.element_at(words, at) == "").cast("long"), F.lit(0).cast("long"))
    n = F.size(words).cast("long")
    return F.when(words.isNull(), F.lit(0).cast("long")).when(n == 1, 1 - empty(1)).otherwise(n - empty(1) - empty(-1))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, item_id, at, words) for every window of every item; ``item`` numbers the rows, a short item is one window."""
    w = F.filter(split_words(F.col(text_col).cast("string")), lambda x: x != "")
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), w.alias("all")).where(F.size("all") > 0)
    rows = cut(rows.select(F.xxhash64("item_id", "all").alias("item"), "item_id", "all").distinct())
    n = F.greatest(F.lit(1), F.size("all") - (window - 1))
    return rows.select("item", "item_id", "all", F.explode(F.sequence(F.lit(0), n - 1)).alias("at")).select("item", "item_id", "at", F.slice("all", F.col("at") + 1, window).alias("words"))


def _words(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), split_words(F.col(text_col).cast("string")).alias("words"))


def term_counts(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, n): how often each benchmark word occurs in all documents; a word that never occurs has n 0."""
    vocabulary = windows.select(F.explode("words").alias("term")).distinct()
    seen = _words(docs, id_col, text_col).select(F.explode("words").alias("term")).join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return vocabulary.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def rarest_terms(windows: DataFrame, counts: DataFrame, keep: int = RAREST) -> DataFrame:
    """windows plus ``anchors``: its ``keep`` rarest words that do occur, as structs (n, place, term), rarest first, and ``whole``: all its words occur.

    Windows of which no word occurs are left out.
    """
    places = windows.select("item", "at", F.posexplode("words").alias("place", "term")).join(counts, "term")
    ranked = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("n", "place", "term"))))
    best = places.groupBy("item", "at").agg(F.slice(ranked, 1, keep).alias("anchors"), (F.min("n") > 0).alias("whole"))
    return windows.join(best.where(F.size("anchors") > 0), ["item", "at"])


def build_index(docs: DataFrame, anchored: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """The stored postings of the anchors' words: (row, doc_id, n_words, head, pos, term, context_at, context).

    Each document has one ``head`` row with its word count; ``term`` is null where a row is no posting. ``context`` has as many words on
    both sides as the longest window takes that the word is the rarest of. ``row`` is the number in ``row_col``, or given here.
    """
    reach = F.when(F.col("whole") & (F.col("rank") == 0), F.size("words"))
    wanted = anchored.select("whole", "words", F.posexplode("anchors").alias("rank", "a")).groupBy(F.col("a.term").alias("term")).agg(F.max(reach).alias("reach"))
    exploded = _words(docs, id_col, text_col, row_col).select("row", "doc_id", "words", F.posexplode_outer("words").alias("pos", "word"))
    hit = exploded.join(F.broadcast(wanted), F.col("word") == F.col("term"), "left").where(F.col("term").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True)))
    start = F.greatest(F.col("pos") - (F.col("reach") - 1), F.lit(0))
    out = hit.select("row", "doc_id", _count_words(F.col("words")).alias("n_words"), F.coalesce(F.col("pos") == 0, F.lit(True)).alias("head"), "pos", "term", F.when(F.col("reach") > 0, start).alias("context_at"), F.when(F.col("reach") > 0, F.slice("words", start + 1, 2 * F.col("reach") - 1)).alias("context"))
    return stored(out)


def _diagonals(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """(item, row, place, diagonal, context_at, context): every posting of an anchor, shifted by the anchor's place in its item."""
    probes = anchored.select("item", F.explode("anchors").alias("a"), "at").select("item", (F.col("at") + F.col("a.place")).alias("place"), F.col("a.term").alias("term")).distinct()
    postings = index.where("term is not null").select("row", "pos", "term", "context_at", "context")
    return postings.join(F.broadcast(probes), "term").withColumn("diagonal", F.col("pos") - F.col("place"))


def phrase_matches(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """(row, start, length, item, item_id, at): exact occurrences of windows."""
    anchored = anchored.where("whole")
    lists = _diagonals(index, anchored).groupBy("item", "row", "diagonal").agg(F.collect_list("place").alias("places"), F.collect_list(F.when(F.col("context").isNotNull(), F.struct("place", "context_at", "context"))).alias("around"))
    # an item has as many anchors as words at most, and so has a diagonal
    some = anchored.groupBy("item").agg(F.min(F.size("anchors")).alias("least"))
    lists = lists.join(F.broadcast(some), "item").where(F.size("places") >= F.col("least"))
    w = anchored.select("item", "item_id", "at", "words", F.transform("anchors", lambda a: F.col("at") + a["place"]).alias("need"))
    both = lists.join(F.broadcast(w), "item").where((F.size(F.array_except("need", "places")) == 0) & (F.col("diagonal") + F.col("at") >= 0))
    around = F.filter("around", lambda c: c["place"] == F.get("need", F.lit(0)))
    both = both.withColumn("c", F.get(around, F.lit(0))).withColumn("start", F.col("diagonal") + F.col("at"))
    same = F.slice(F.col("c.context"), F.col("start") - F.col("c.context_at") + 1, F.size("words")) == F.col("words")
    return both.where(same).select("row", "start", F.size("words").alias("length"), "item", "item_id", "at")


def proximity_matches(index: DataFrame, anchored: DataFrame, slop: int = SLOP) -> DataFrame:
    """(row, item, item_id, first_pos, second_pos): the two rarest occurring words of a window stand in one document up to ``slop`` words off their places in the window.

    Exact occurrences are among them. Windows with one occurring word have no second one and are left out.
    """
    if slop < 0:
        raise ValueError("slop must not be negative")
    a, b = F.get("anchors", F.lit(0)), F.get("anchors", F.lit(1))
    pairs = anchored.where(F.size("anchors") > 1).select("item", "item_id", a["term"].alias("ta"), (F.col("at") + a["place"]).alias("pa"), b["term"].alias("tb"), (F.col("at") + b["place"]).alias("pb")).distinct()
    postings = index.where("term is not null").select("row", "pos", "term")
    side = lambda k: postings.join(F.broadcast(pairs.withColumnRenamed(f"t{k}", "term")), "term").select("row", "item", "item_id", "pa", "pb", "pos", (F.col("pos") - F.col(f"p{k}")).alias("start"))
    size = slop + 1
    x = side("a").withColumnRenamed("pos", "first_pos").withColumn("cell", F.floor(F.col("start") / size))
    y = side("b").select("row", "item", "pa", "pb", F.col("pos").alias("second_pos"), F.col("start").alias("other"), F.explode(F.array(*[F.floor(F.col("start") / size) + d for d in (-1, 0, 1)])).alias("cell"))
    near = (F.abs(F.col("start") - F.col("other")) <= slop) & (F.col("first_pos") != F.col("second_pos"))
    return x.join(y, ["row", "item", "pa", "pb", "cell"]).where(near).select("row", "item", "item_id", "first_pos", "second_pos").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, slop: int | None = SLOP) -> DataFrame:
    """Per document: (doc_id, n_words, n_hit, n_items, item_ids, contaminated, near_ids).

    A document word inside any occurrence of a window is hit. ``near_ids`` are the items with a proximity match, exact ones included
    (without ``slop`` they are not searched, and the column is left out). Null and wordless texts have no words and no
    hits; null and wordless items are left out; an item without an id hits words but is not listed; items
    with the same id count once. Repeated documents come back as often as they came, a null id stays null. Empty tables give
    no rows or no hits. Other columns are ignored. ``block_windows`` bounds what is broadcast at once: a larger benchmark is matched in blocks of windows.
    """
    windows = cut(item_windows(items, item_id_col, item_text_col, window))
    blocks = max(1, -(-windows.count() // block_windows))
    row = None
    if blocks > 1:  # every block must see the same row numbers
        row = "row"
        docs = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
        id_col, text_col = "id", "text"
    heads, found, close = None, None, None
    for k in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("item", "at"), F.lit(blocks)) == k)
        anchored = cut(rarest_terms(part, term_counts(docs, part, id_col, text_col)))
        index = build_index(docs, anchored, id_col, text_col, row)
        heads = index.where("head").select("row", "doc_id", "n_words") if heads is None else heads
        got = phrase_matches(index, anchored)
        found = got if found is None else found.unionByName(got)
        if slop is not None:
            near = proximity_matches(index, anchored, slop).select("row", "item_id")
            close = near if close is None else close.unionByName(near)
    found = cut(found)
    spans = found.select("row", "start", (F.col("start") + F.col("length")).alias("end")).groupBy("row", "start").agg(F.max("end").alias("end"))
    before = F.max("end").over(W.partitionBy("row").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    hits = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))).groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    listed = found.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    out = heads.join(hits.join(listed, "row"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    columns = ["doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated")]
    if slop is not None:
        # an exact occurrence of a one-word window has no pair of words
        either = close.unionByName(found.select("row", "item_id"))
        out = out.join(either.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("near_ids")), "row", "left")
        columns.append(F.coalesce("near_ids", F.array().cast("array<string>")).alias("near_ids"))
    return out.select(*columns)


def op3_inverted_index(spark, sf_dir):
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated", F.size("near_ids").cast("long").alias("n_near"))
