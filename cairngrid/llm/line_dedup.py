"""Lines that repeat across documents, in DataFrame operations only.

Every line's key is hashed to 128 bits; hashes are range-partitioned and sorted by document and position, and one pass over
the sorted rows hands every line the first document of its hash. What comes back is no text but a bitmap per
document of the lines it keeps, compressed to runs (start, length).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngrid.llm.common import BROADCAST_IDS, HOT_ROWS, cut, numbered, stored

MIN_CHARS = 10
BLANKS = " \t\n\x0b\x0c\r"
#: Keys that may be broadcast because they have many rows each.
HOT_KEYS = 100_000
#: One in so many lines is counted to find keys with many rows; it decides on the way they take, not on results.
HOT_SAMPLE = 64


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_hashes(rows: DataFrame, row_col: str, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, doc_id, pos, h1, h2) of every line whose key has ``min_chars`` code points or more; ``h1`` and ``h2`` are two 64-bit hashes of it."""
    low = F.translate(F.col(text_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    lines = rows.select(F.col(row_col).alias("row"), F.col(id_col).alias("doc_id"), F.posexplode(split_lines(low)).alias("pos", "line"))
    keys = lines.select("row", "doc_id", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("row", "doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _first_of_hot(lines: DataFrame) -> DataFrame:
    """(h1, h2, first): the first document row of the keys with many rows, HOT_KEYS at most, by a grouped minimum."""
    least = max(HOT_ROWS, lines.count() // HOT_KEYS)
    some = lines.where(F.pmod(F.xxhash64("row", "pos"), F.lit(HOT_SAMPLE)) == 0)
    hot = cut(some.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") * HOT_SAMPLE > least).orderBy(F.desc("n"), "h1", "h2").limit(HOT_KEYS).select("h1", "h2"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    return cut(lines.join(F.broadcast(hot), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min(order)["row"].alias("first")))


def dropped_lines(lines: DataFrame) -> DataFrame:
    """(row, pos) of the lines whose key stands in an earlier document: smaller id (rows without one come last), then smaller row.

    Hashes are range-partitioned, sorted by document and position, and streamed. A key with many rows, which would make one
    partition large, is settled before: its first document is a minimum that tasks find for their own rows first, and its rows stay where they are.
    """
    first = _first_of_hot(lines)
    hot = lines.join(F.broadcast(first), ["h1", "h2"]).where("row <> first").select("row", "pos")
    rest = lines.join(F.broadcast(first), ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2")
    place = W.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "row", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rest.withColumn("first", F.first("row").over(place)).where("row <> first").select("row", "pos").unionByName(hot)


def dropped_runs(dropped: DataFrame) -> DataFrame:
    """(row, starts, ends, n_dropped) of every row that loses lines: first and last position of each run of dropped lines."""
    each = dropped.groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    starts = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1))
    ends = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) != x + 1))
    return each.select("row", starts.alias("starts"), ends.alias("ends"), F.size("p").cast("long").alias("n_dropped"))


def _keep(n_lines: Column) -> Column:
    """Runs (at, n) of kept lines between the runs of dropped ones."""
    none = F.array().cast("array<int>")
    left = F.concat(F.array(F.lit(0)), F.transform(F.coalesce("ends", none), lambda e: e + 1))
    right = F.concat(F.coalesce("starts", none), F.array(n_lines.cast("int")))
    return F.filter(F.zip_with(left, right, lambda a, b: F.struct(a.alias("at"), (b - a).alias("n"))), lambda r: r["n"] > 0)


def _runs_of(rows: DataFrame, row_col: str, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    runs = cut(dropped_runs(dropped_lines(stored(line_hashes(rows, row_col, id_col, text_col, min_chars)))))
    n, parts = runs.agg(F.count("*"), F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()
    return F.broadcast(runs) if n <= BROADCAST_IDS and parts <= 4 * BROADCAST_IDS else runs


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, with_text: bool = False) -> DataFrame:
    """Per document: (doc_id, n_lines, n_dropped, keep), and its kept ``text`` on demand.

    A key is a line without blanks at its ends, A-Z in lower case. Keys of ``min_chars`` code points or more that stand in
    two documents or more lose all their lines but those of the first document: that of the smallest id; rows without one come last, and rows
    of one id are documents of their own in the order of their place in the table. ``keep`` is the document's bitmap
    of kept lines as runs (at, n), from line 0; ``keep_lines`` applies it. A null or empty text is one empty line, which is kept.
    Repeated rows come back as often as they came, all but the first without their long lines; an empty table gives no rows; other columns are ignored.
    """
    rows, number = numbered(docs)
    runs = _runs_of(rows, number, id_col, text_col, min_chars).withColumnRenamed("row", number)
    out = rows.select(number, F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(runs, number, "left")
    out = out.withColumn("lines", split_lines(F.col("text"))).withColumn("n_lines", F.size("lines").cast("long"))
    out = out.withColumn("keep", _keep(F.col("n_lines")))
    kept = F.when(F.col("n_dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(keep_lines(F.col("lines"), F.col("keep")))
    return out.select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep", *[kept.alias("text")] * with_text)


def keep_lines(lines: Column, keep: Column) -> Column:
    """The lines of the runs ``keep``, joined by a line feed."""
    return F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["at"] + 1, r["n"]))), "\n")


def op11_line_bitmaps(spark, sf_dir):
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
