"""SimHash near-duplicates by segment popcounts.

A fingerprint is cut into 2-bit segments and mapped to the vector of its segments' bit counts. Flipping
one bit moves that vector by one, so the Manhattan distance of two vectors never exceeds the Hamming
distance of their fingerprints: it is a lower bound. The vectors are joined on a grid of that space:
split into ``BLOCKS`` blocks of segments, a pair within Manhattan distance 3 lies within distance
``3 // BLOCKS`` in at least one block, so one side is put into its own cell of each block and the other
also into the cells one count away. Candidates that meet in a cell are held against the bound over all
segments and then verified exactly on the 64 bits, inside the join condition: a hot cell never
emits its pairs, only its links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngrid.llm.common import connected_components, cut, join_named

MAX_BITS = 3
SEGMENT_BITS = 2
BLOCKS = 2
SEED = 42
CHUNK = 1 << 16


def _bits(shingles: list[bytes], sums: np.ndarray) -> int:
    """Add the shingles' hash bits to ``sums``; a long text comes in chunks."""
    h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), dtype="<u8", count=len(shingles))
    sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return len(h)


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a whole text, as a signed long; no word gives 0."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    sums, n = np.zeros(64, np.int64), 0
    if len(w) < words:
        n = _bits([b" ".join(w)], sums)
    for at in range(0, len(w) - words + 1, CHUNK):
        part = w[at : at + CHUNK + words - 1]
        n += _bits([b" ".join(x) for x in zip(*(part[i:] for i in range(words)), strict=False)], sums)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp long) for every row; null or wordless text has fingerprint 0."""

    def run(batches):
        for b in batches:  # one text at a time: a batch of long ones is large
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x.as_py(), words) for x in b.column(1)], pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _segment_counts(fp):
    """Per 2-bit segment its bit count, kept in the segment's two bits (0, 1 or 2)."""
    low = F.lit(0x5555555555555555)
    odd, even = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return odd.bitwiseXOR(even).bitwiseOR(F.shiftleft(odd.bitwiseAND(even), 1))


def _manhattan(a, b):
    """Manhattan distance of two packed count vectors: per segment the counts 0, 1, 2 become 00, 01, 11 (unary), whose Hamming distance is the difference."""
    low = F.lit(0x5555555555555555)

    def unary(v):
        two = F.shiftrightunsigned(v, 1).bitwiseAND(low)
        return v.bitwiseOR(two)

    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ by ``max_bits`` bits or fewer (at most 3).

    ``fps`` has a column ``fp`` of distinct non-null values.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")
    width, per_block = 64 // BLOCKS, 64 // SEGMENT_BITS // BLOCKS
    v = fps.select("fp", _segment_counts(F.col("fp")).alias("v"))
    block = [F.shiftrightunsigned("v", width * k).bitwiseAND(F.lit((1 << width) - 1)) for k in range(BLOCKS)]
    own = v.select("fp", "v", F.posexplode(F.array(*block)).alias("block", "cell"))
    one = [F.lit(1 << (SEGMENT_BITS * i)) for i in range(per_block)]
    count = [F.shiftrightunsigned("cell", SEGMENT_BITS * i).bitwiseAND(F.lit(3)) for i in range(per_block)]
    near = [F.when(count[i] < 2, F.col("cell") + one[i]) for i in range(per_block)] + [F.when(count[i] > 0, F.col("cell") - one[i]) for i in range(per_block)]
    probe = own.select("fp", "v", "block", F.explode(F.array_compact(F.array(F.col("cell"), *near))).alias("cell"))
    x, y = probe.select(F.col("fp").alias("a"), F.col("v").alias("va"), "block", "cell"), own.select(F.col("fp").alias("b"), F.col("v").alias("vb"), F.col("block").alias("block_b"), F.col("cell").alias("cell_b"))
    meets = (F.col("block") == F.col("block_b")) & (F.col("cell") == F.col("cell_b"))
    close = (F.col("a") < F.col("b")) & (_manhattan(F.col("va"), F.col("vb")) <= max_bits) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return x.join(y, meets & close).select("a", "b").distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """Near-duplicate class of every row: (id, fp, component_id).

    Rows link where their fingerprints differ by ``max_bits`` bits or fewer; component_id is the smallest
    id reachable. Equal fingerprints meet as one class first (a grouped minimum), components are found on
    fingerprints and named by their smallest id afterwards, so thousands of copies cost one row in the join and rows without an id
    still link others. Defined results: null and wordless texts have fingerprint 0 and link with
    one another; repeated rows and equal ids come back as often as they came; a null id stays null, and its component is that of its
    fingerprint's class, null where all ids of a component are; an empty table gives an empty result; other columns are
    ignored.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words))
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    roots = connected_components(cut(links(classes.select("fp"), max_bits)), "a", "b").select(F.col("id").alias("fp"), F.col("component_id").alias("root"))
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = cut(rooted.join(least, "root").select("fp", "size", "component_id"))
    return join_named(rows, named, "fp", "size").select("id", "fp", "component_id")


def op6_simhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_dedup(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
