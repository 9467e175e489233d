"""Token ids of whole documents as ORC files.

Documents are range-partitioned and sorted by id before they are encoded, so every file holds one id range in
ascending order. Ids are integers in ORC stripes, which the format run-length encodes; row indexes and a
Bloom filter on ``doc_id`` let readers skip stripes and row groups, and readers split files by stripe.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngrid.llm.arrow_text import parts
from cairngrid.llm.common import shared_dir

END_ID = 1
MEMO_WORDS = 150_000
#: Bytes of text encoded at once.
PART = 1 << 20
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd"}

#: The parts of a tokenizers file that the shortcuts below hold for, as its JSON states them; fixed values.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Where a text holds nothing else than these letters, ASCII without an apostrophe, and plain white space, its runs of letters
#: and its runs of other signs are encoded apart by this tokenizer: cutting there changes no id.
_PLAIN = re.compile("[\x00-\x08\x0e-\x1b\x21-\x26\x28-\x7eÀ-ÖØ-öø-ÿ\t\n\r ]*")
#: For the Latin-1 bytes of such a text: their lower case, and their kind, white space 0, a letter 1, another sign 2.
_LOWER = bytes(b + 32 if 65 <= b <= 90 or 192 <= b <= 222 and b != 215 else b for b in range(256))
_KIND = np.array([0 if b in b"\t\n\r " else 1 if chr(b).isascii() and chr(b).isalpha() or b >= 192 and b not in (215, 247) else 2 for b in range(256)], np.uint8)
_WORD = re.compile("[a-zà-öø-ÿ]+")
#: The byte-level tokenizer's signs for bytes without a printable one: the code points from 256 on, in byte order.
_BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b < 256))}
_SPACE = re.compile("[\t\n\r ]+")


class Encoder:
    """Encodes whole texts with one tokenizers file, looking repeated words up.

    A tokenizer with the normaliser and the splitter below drops white space and merges inside words only, so a text's ids are those
    of its white-space-free chunks in order. Each worker keeps about ``MEMO_WORDS`` of them. With any other file whole texts are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        self.known = form["normalizer"] == NORMALIZER and form["pre_tokenizer"] == SPLITTER and form["post_processor"] is None and not form["model"].get("dropout")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str | bytes, bytes] = {}
        self.older: dict[str | bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.known:
            return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        plain = [bool(_PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        rest = [[] if ok else [x for x in _SPACE.split(t) if x] for t, ok in zip(texts, plain, strict=True)]
        runs, owner = _plain_runs([t if ok else "" for t, ok in zip(texts, plain, strict=True)])
        coded = runs.dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._look_up(set(words).union(*rest))
        # every run's ids are gathered from those of the different words
        ids = [self.memo[w] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        code = coded.indices.to_numpy()
        length = size[code]
        place = np.repeat((np.cumsum(size) - size)[code] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        flat = np.frombuffer(b"".join(ids), np.int32)[place]
        ends = np.r_[0, np.cumsum(length)][np.searchsorted(owner, np.arange(len(texts) + 1))]
        return [flat[a:e] if ok else np.frombuffer(b"".join(map(self.memo.__getitem__, p)), np.int32) for a, e, ok, p in zip(ends[:-1], ends[1:], plain, rest, strict=True)]

    def _look_up(self, seen: set) -> None:
        """Bring the ids of all chunks of ``seen`` into ``memo``: Latin-1 bytes of plain texts, strings of others."""
        if len(self.memo) > MEMO_WORDS // 2:  # the older half goes, what is still in use moves over word by word
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        new = seen - memo.keys()
        known = new & older.keys()
        for w in known:
            memo[w] = older[w]
        merge, other = self.tokenizer.model.tokenize, []
        for w in new - known:
            text = w.decode("latin-1") if isinstance(w, bytes) else w
            if _WORD.fullmatch(text):  # the normaliser and the splitter leave such a word as it is: only merging is left
                memo[w] = array("i", [t.id for t in merge(text if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_SIGNS))]).tobytes()
            else:
                other.append((w, text))
        for (w, _), e in zip(other, self.tokenizer.encode_batch_fast([t for _, t in other], add_special_tokens=False), strict=True):
            memo[w] = array("i", e.ids).tobytes()


def _plain_runs(texts: list[str]) -> tuple[pa.BinaryArray, np.ndarray]:
    """The runs of letters and of other signs of plain texts in lower case, as Latin-1 bytes one after the other, and the text that each comes from."""
    raw = [t.encode("latin-1") for t in texts]
    data = np.frombuffer(b"\n".join(raw).translate(_LOWER), np.uint8)
    kind = _KIND[data]
    change = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if len(kind) else np.zeros(0, np.int64)
    ink = kind[change] > 0
    start, size = change[ink], np.diff(np.r_[change, len(kind)])[ink]
    offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[kind > 0].tobytes())])
    return runs, np.searchsorted(np.cumsum([len(x) + 1 for x in raw]), start, side="right")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and worker process."""
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, seq, ids) in ascending id order: partitions hold id ranges, ``seq`` counts the rows of a partition.

    Rows are dealt out by id before anything is encoded; sampling for the ranges reads the table only.
    """

    def run(batches):
        enc, seq = encoder(tokenizer_path), 0
        for b in parts(batches, 1, PART):
            coded = [np.append(x, np.int32(end_id)) for x in enc.encode([t or "" for t in b.column(1).to_pylist()])]
            offsets = np.cumsum([0, *map(len, coded)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.arange(seq, seq + b.num_rows)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded)))], names=["doc_id", "seq", "ids"])
            seq += b.num_rows

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # ranges and files have one order: id, hash of the text, text
    placed = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return placed.mapInArrow(run, "doc_id long, seq long, ids array<int>").withColumn("part", F.spark_partition_id())


def write_orc(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> str:
    """Encode and write; returns the path. Columns: part and seq (file order), doc_id, ids."""
    w = encode(docs, tokenizer_path, id_col, text_col, end_id).write.mode("errorifexists")
    for k, v in ORC_OPTIONS.items():
        w = w.option(k, v)
    w.orc(path)
    return path


def read_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The token files, or the given documents of them; the id predicate reaches stripe statistics and Bloom filters."""
    df = spark.read.schema("doc_id long, seq long, ids array<int>, part int").orc(path)
    return df.where(F.col("doc_id").isin(doc_ids)) if doc_ids is not None else df


def digest(stored: DataFrame) -> DataFrame:
    """Per stored document: start (ids of all documents before it), n_tokens and the crc32 of its ids as little-endian 32-bit integers."""

    def run(batches):
        for b in batches:
            ids = b.column(3)
            flat, off = ids.values.to_numpy(), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[s:e].astype("<u4").tobytes()) for s, e in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "seq", "n_tokens", "ids_crc32"])

    rows = stored.select("doc_id", "part", "seq", "ids").mapInArrow(run, "doc_id long, part int, seq long, n_tokens long, ids_crc32 long")
    # one row per file order key: sums per part are as many rows as there are files
    sums = stored.groupBy("part").agg(F.sum(F.size("ids").cast("long")).alias("n"))
    before = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    inside: Column = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(before, "part").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the token files, read them back and describe every document: (doc_id, start, n_tokens, ids_crc32).

    A null or empty text is the end id alone. Rows without an id come first; rows with the same id stand in
    the order of a hash of their texts, so repeated rows are stored as often as they came. An empty table writes
    no document. Other columns are ignored, whatever their names. Without ``path`` the files go below the shared checkpoint folder.
    """
    spark = docs.sparkSession
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    target = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return digest(read_orc(spark, write_orc(docs, target, tokenizer_path, id_col, text_col)))


def op5_token_orc(spark, sf_dir):
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
