"""Exact removal of long repeated byte strings by a distributed difference cover.

Only the order of the first ``length`` bytes of suffixes matters here, so a cover modulo ``v`` with v close to ``length`` takes the place of the
cover modulo 3: for any two positions i and j some shift below v brings both into the sample, and equal strings of ``length`` bytes at i and j then
have equal tuples of ``length - v + 1`` bytes at the two sampled positions.

1. Sampled tuples: the tuples at all positions of the cover are named and sorted. A name that occurs once is settled: none of the
   windows that rest on it alone repeats. Only the others go on.
2. Names of names: the windows (suffixes cut after ``length`` bytes) that hold a repeated tuple are taken in units of consecutive starts, which the
   smallest gram in each window marks off, and a unit is named by its gram and all bytes its windows cover. Sorted by these names, every unit
   but the first of its name only repeats earlier windows.
3. Remaining suffixes: where one gram owns units of different names, the windows of the first unit of each
   name are named themselves, merged and sorted; neighbours of equal prefix are compared, all but the first repeat.
4. The removed windows' bytes are united per document.

Names are 64-bit hashes of the bytes, in pairs where they decide (gram with unit name, gram with window). Names of step 1 only leave things out: there, few bits
are sent, and a collision costs work, not bytes. Positions are (document, byte) packed into a long, so "earlier" is an integer comparison.
"""

from __future__ import annotations

import functools
import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngrid.llm.common import cut, join_named, stored

LENGTH = 100
GRAM = 32
PIECE = 1 << 20
#: Sampled tuples that meet in one bucket, at most about; and the least number of buckets, so that partitions hold about equally many.
BUCKET = 1 << 21
LEAST_BUCKETS = 256
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.uint64((1 << 21) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.cumprod(np.full(n - 1, base, np.uint64))
    return out


class _Tables:
    """Random bytes' values and powers of the base, made once per worker."""

    def __init__(self):
        self.byte = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.up, self.down = _powers(_BASE, 2 * PIECE), _powers(_INVERSE, 2 * PIECE)


_TABLES: list[_Tables] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sums(raw: np.ndarray) -> np.ndarray:
    if not _TABLES:
        _TABLES.append(_Tables())
    t = _TABLES[0]
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(t.byte[raw] * t.up[: len(raw)], out=out[1:])
    return out


def _name(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) of the piece whose prefix sums are given."""
    return _mix((sums[end] - sums[start]) * _TABLES[0].down[start])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def units(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Units of a piece of concatenated documents: first and last window start, gram hash, name of all bytes.

    ``ends`` gives, for every byte, the end of its document in the piece; windows do not leave their document.
    """
    n, empty = len(raw), np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums = _sums(raw)
    at = np.arange(n - GRAM + 1)
    gram = _name(sums, at, at + GRAM)
    key = (gram & ~_LOW) | (_LOW - at.astype(np.uint64))  # of equal hashes the rightmost
    least = _sliding_min(key, length - GRAM + 1)
    owner = (_LOW - (least & _LOW)).astype(np.int64)
    ok = np.arange(len(owner)) + length <= ends[: len(owner)]
    owner[~ok] = -1
    cut = np.nonzero(owner[1:] != owner[:-1])[0] + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(owner)]]) - 1
    keep = owner[lo] >= 0
    lo, hi = lo[keep], hi[keep]
    return lo, hi, gram[owner[lo]], _name(sums, lo, hi + length) + (hi - lo).astype(np.uint64)


def _pieces(numbers, texts, length):
    """Documents joined into pieces of at most PIECE bytes; a longer document is cut with an overlap of length - 1 bytes.

    Yields (bytes, end of the document per byte, document per part, offset of the part in its document, first byte of the part).
    """
    parts, size = [], 0
    for n, t in zip(numbers, texts, strict=True):
        raw = (t or "").encode("utf-8", "surrogatepass")
        for s in range(0, max(1, len(raw) - length + 1), PIECE):
            part = raw[s : s + PIECE + length - 1]
            if size + len(part) > PIECE and parts:
                yield _join(parts)
                parts, size = [], 0
            parts.append((n, s, part))
            size += len(part)
    if parts:
        yield _join(parts)


def _join(parts):
    sizes = np.array([len(p) for _, _, p in parts])
    stop = np.cumsum(sizes)
    return np.frombuffer(b"".join(p for _, _, p in parts), np.uint8), np.repeat(stop, sizes), np.array([n for n, _, _ in parts], np.int64), np.array([s for _, s, _ in parts], np.int64), stop - sizes


def _repeats(*names: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """True where an equal name stands at a smaller position of the same batch: hot names are thinned before any shuffle."""
    order = np.lexsort((pos, *names))
    same = np.ones(len(pos) - 1, bool)
    for x in names:
        same &= x[order][1:] == x[order][:-1]
    out = np.zeros(len(pos), bool)
    out[order[1:]] = same
    return out


@functools.cache
def difference_cover(v: int) -> list[int]:
    """Residues such that every difference modulo ``v`` occurs between two of them: a perfect difference set where one exists, else a greedy cover."""
    k = next((k for k in range(2, 40) if k * (k - 1) + 1 == v), 0)

    def extend(found: list[int], used: set[int]) -> list[int] | None:
        if len(found) == k:
            return found
        for x in range(found[-1] + 1, v):
            new = {(x - y) % v for y in found} | {(y - x) % v for y in found}
            if len(new) == 2 * len(found) and not new & used and (got := extend([*found, x], used | new)):
                return got
        return None

    if k and k < 10 and (got := extend([0, 1], {1, v - 1})):
        return got
    found, missing = [0], set(range(1, v))
    while missing:
        x = max(range(1, v), key=lambda x: len(missing & {d for y in found for d in ((x - y) % v, (y - x) % v)}))
        missing -= {d for y in found for d in ((x - y) % v, (y - x) % v)}
        found.append(x)
    return sorted(found)


def cover_modulus(length: int) -> int:
    """The largest k(k - 1) + 1 up to 0.6 of the length: longer tuples than that would hardly be rarer."""
    return max(k * (k - 1) + 1 for k in range(2, 10) if k * (k - 1) + 1 <= max(3, 0.6 * length))


def _sampled(lengths: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, byte in the part) of the cover's positions, in order, for parts of documents at the given offsets; parts shorter than ``length`` have no window."""
    v = cover_modulus(length)
    member = np.zeros(v, bool)
    member[difference_cover(v)] = True
    count = np.where(lengths >= length, lengths - (length - v), 0)
    part = np.repeat(np.arange(len(lengths)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    keep = np.flatnonzero(member[(at + offsets[part]) % v])
    return part[keep], at[keep]


def _packed(x: np.ndarray) -> bytes:
    """Ascending numbers as 16-bit differences, or as they are where one does not fit."""
    d = np.diff(x, prepend=0)
    return b"d" + d.astype("<u2").tobytes() if not len(d) or d.max() < 1 << 16 else b"w" + x.astype("<u4").tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, "<u2", offset=1), dtype=np.int64) if b[:1] == b"d" else np.frombuffer(b, "<u4", offset=1).astype(np.int64)


def _tuples(docs: DataFrame, bits: int, length: int, buckets: int) -> DataFrame:
    """(bucket, piece, names, samples, parts): per piece of text and bucket of names, 32 bits of each tuple's name and its number in the piece.

    A name that a piece holds several times goes out once, and its samples are told as repeated at once, so a hot tuple costs one entry per piece. A row
    without a bucket lists the piece's parts (document, offset, length).
    """
    width = length - cover_modulus(length) + 1

    def run(batches):
        for b in batches:
            for raw, _, number, offset, first in _pieces(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), length):
                lengths = np.diff(np.append(first, len(raw)))
                part, at = _sampled(lengths, offset, length)
                if not len(at):
                    continue
                start = first[part] + at
                name = _name(_sums(raw), start, start + width)
                order = np.argsort(name, kind="stable")
                fresh = np.ones(len(order), bool)
                fresh[1:] = name[order][1:] != name[order][:-1]
                alone = np.append(fresh[1:], True) & fresh
                piece = int((number[0] << bits) + offset[0])
                again, sent = np.sort(order[~alone]), order[fresh]
                bucket = ((name[sent] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                by = np.lexsort((sent, bucket))
                sent, bucket = sent[by], bucket[by]
                edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
                low = (name[sent] & np.uint64(0xFFFFFFFF)).astype("<u4")
                groups = list(zip(edge[:-1], edge[1:], strict=True))
                parts = [{"n": int(n), "s": int(s), "len": int(k)} for n, s, k in zip(number, offset, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*(int(bucket[x]) for x, _ in groups), None], pa.int32()),
                        pa.array([piece] * (len(groups) + 1), pa.int64()),
                        pa.array([*(low[x:y].tobytes() for x, y in groups), None], pa.binary()),
                        pa.array([*(_packed(sent[x:y]) for x, y in groups), _packed(again)], pa.binary()),
                        pa.array([None] * len(groups) + [parts], _PARTS),
                    ],
                    names=["bucket", "piece", "names", "samples", "parts"],
                )

    return docs.select("n", "text").mapInArrow(run, "bucket int, piece long, names binary, samples binary, parts array<struct<n:long,s:long,len:long>>")


_PARTS = pa.list_(pa.struct([("n", pa.int64()), ("s", pa.int64()), ("len", pa.int64())]))


def _repeated_tuples(tuples: DataFrame) -> DataFrame:
    """(piece, samples, parts): of every bucket the samples whose name another piece has too."""

    def run(batches):
        held: list[tuple] = []
        bucket = None
        for b in batches:
            for k, piece, names, samples, parts in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if k != bucket and held:
                    yield settle(held)
                    held = []
                bucket = k
                if k is None:
                    yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([samples], pa.binary()), pa.array([parts], _PARTS)], names=["piece", "samples", "parts"])
                else:
                    held.append((piece, np.frombuffer(names, "<u4"), samples))
        if held:
            yield settle(held)

    def settle(held):
        name = np.concatenate([x for _, x, _ in held])
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        again = np.zeros(len(name), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        edge, pieces, samples = np.cumsum([0, *(len(x) for _, x, _ in held)]), [], []
        for (piece, _, packed), x, y in zip(held, edge[:-1], edge[1:], strict=True):
            if again[x:y].any():
                pieces.append(piece)
                samples.append(_packed(_unpacked(packed)[again[x:y]]))
        return pa.RecordBatch.from_arrays([pa.array(pieces, pa.int64()), pa.array(samples, pa.binary()), pa.nulls(len(pieces), _PARTS)], names=["piece", "samples", "parts"])

    deal = F.coalesce(F.col("bucket").cast("long"), F.xxhash64("piece"))
    return tuples.withColumn("deal", deal).repartition("deal").sortWithinPartitions("bucket").drop("deal").mapInArrow(run, "piece long, samples binary, parts array<struct<n:long,s:long,len:long>>")


def candidate_marks(docs: DataFrame, bits: int, length: int) -> DataFrame:
    """(n, marks): per document the places of its repeated sampled tuples, packed; documents without any are left out."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    v = cover_modulus(length)
    buckets = max(LEAST_BUCKETS, -(-total * len(difference_cover(v)) // (v * BUCKET)))
    found = _repeated_tuples(_tuples(docs, bits, length, int(buckets)))
    listed = found.groupBy("piece").agg(F.collect_list("samples").alias("samples"), F.max("parts").alias("parts"))

    def run(batches):
        for b in batches:
            numbers, marks = [], []
            for samples, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = np.unique(np.concatenate([_unpacked(x) for x in samples]))
                if not len(at):
                    continue
                part, byte = _sampled(np.array([p["len"] for p in parts]), np.array([p["s"] for p in parts]), length)
                part, byte = part[at], byte[at]
                edge = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
                for x, y in zip(edge[:-1], edge[1:], strict=True):
                    p = parts[part[x]]
                    numbers.append(p["n"])
                    marks.append(_packed(byte[x:y] + p["s"]))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(marks, pa.binary())], names=["n", "marks"])

    parts = stored(listed.select("samples", "parts").mapInArrow(run, "n long, marks binary"))
    return parts.groupBy("n").agg(F.collect_list("marks").alias("marks"))


def _all_units(marked: DataFrame, bits: int, length: int) -> DataFrame:
    """(again, gram, name, pos, len) of every unit with a window that holds a repeated sampled tuple; rows: n, text, marks. ``again``: an equal unit stands earlier in the same piece."""
    v = cover_modulus(length)

    def run(batches):
        for b in batches:
            numbers = b.column(0).to_pylist()
            marks = dict(zip(numbers, b.column(2).to_pylist(), strict=True))
            for raw, ends, number, offset, first in _pieces(numbers, (x.as_py() for x in b.column(1)), length):
                lo, hi, gram, name = units(raw, ends, length)
                if not len(lo):
                    continue
                part = np.searchsorted(first, lo, side="right") - 1
                held = np.zeros(len(raw) + 1, np.int64)  # prefix sums: marked bytes of the piece
                size = np.diff(np.append(first, len(raw)))
                for n, s, f, k in zip(number.tolist(), offset.tolist(), first.tolist(), size.tolist(), strict=True):
                    for m in marks[n]:
                        at = _unpacked(m) - s
                        held[1 + f + at[(at >= 0) & (at < k)]] = 1
                np.cumsum(held, out=held)
                keep = np.flatnonzero(held[np.minimum(hi + v, len(raw))] > held[lo])  # a sample in reach of some window start
                lo, hi, gram, name, part = (x[keep] for x in (lo, hi, gram, name, part))
                if not len(lo):
                    continue
                pos = (number[part] << bits) + offset[part] + lo - first[part]
                again = _repeats(gram, name, pos=pos) if len(pos) > 1 else np.zeros(len(pos), bool)
                yield pa.RecordBatch.from_arrays([pa.array(again), pa.array(gram.view(np.int64)), pa.array(name.view(np.int64)), pa.array(pos), pa.array((hi - lo + 1).astype(np.int32))], names=["again", "gram", "name", "pos", "len"])

    return marked.select("n", "text", "marks").mapInArrow(run, "again boolean, gram long, name long, pos long, len int")


def _windows(rows: DataFrame, bits: int, length: int) -> DataFrame:
    """(again, gram, name, pos) of every window of the units listed per document; rows: n, text, units(at, len, gram)."""

    def run(batches):
        for b in batches:
            parts, size = [], 0
            for n, t, listed in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), (x.as_py() for x in b.column(2)), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                for u in listed:
                    for s in range(u["at"], u["at"] + u["len"], PIECE // 2):
                        k = min(PIECE // 2, u["at"] + u["len"] - s)
                        parts.append((raw[s : s + k + length - 1], (n << bits) + s, u["gram"]))
                        size += k + length - 1
                        if size > PIECE:
                            yield emit(parts)
                            parts, size = [], 0
            if parts:
                yield emit(parts)

    def emit(parts):
        raw = np.frombuffer(b"".join(p for p, _, _ in parts), np.uint8)
        sizes = np.array([len(p) for p, _, _ in parts])
        first, count = np.cumsum(sizes) - sizes, sizes - length + 1
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(first, count) + inside
        sums = _sums(raw)
        name, pos = _name(sums, start, start + length).view(np.int64), np.repeat(np.array([p for _, p, _ in parts], np.int64), count) + inside
        gram = np.repeat(np.array([g for _, _, g in parts], np.int64), count)
        again = _repeats(gram, name, pos=pos) if len(pos) > 1 else np.zeros(len(pos), bool)
        return pa.RecordBatch.from_arrays([pa.array(again), pa.array(gram), pa.array(name), pa.array(pos)], names=["again", "gram", "name", "pos"])

    return rows.mapInArrow(run, "again boolean, gram long, name long, pos long")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(n, id, text) with n unique and in the order of ids, and the bits that a position inside a document takes.

    Unique nonnegative ids that leave room are taken as they are; else rows are sorted by (id, text) in ranges, stored and numbered.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    low, high, longest, count, ids = rows.agg(F.min("id"), F.max("id"), F.max(F.octet_length("text")), F.count("*"), F.count("id")).first()
    bits = max(1, int(longest or 0).bit_length())
    plain = count == ids and (not count or low >= 0 and high < 1 << (62 - bits))
    if plain and rows.groupBy("id").count().where("count > 1").limit(1).count() == 0:
        return rows.withColumn("n", F.col("id")), bits

    def run(batches):
        seq = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(seq, seq + b.num_rows))], names=["id", "text", "seq"])
            seq += b.num_rows

    order = [F.col("id").asc_nulls_first(), F.col("text")]
    part = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "id long, text string, seq long").withColumn("part", F.spark_partition_id()))
    sizes = part.groupBy("part").count()  # one row per partition
    before = sizes.select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("before"))
    return part.join(F.broadcast(before), "part").select((F.col("before") + F.col("seq")).alias("n"), "id", "text"), bits


def _release(spark) -> None:
    """Let Spark drop the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(docs: DataFrame, bits: int, length: int) -> DataFrame:
    """(n, runs, starts): window starts of document n whose window also starts earlier, in runs and one by one."""
    place = lambda: (F.shiftright("pos", bits).alias("n"), F.col("pos").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("at"))
    marks = stored(candidate_marks(docs, bits, length))
    _release(docs.sparkSession)
    # equal rows of one piece are dealt out by position instead of by name, so a hot name does not meet in one task
    spread = F.when(F.col("again"), F.col("pos")).otherwise(F.col("name"))
    order = F.row_number().over(W.partitionBy("again", "key", "gram").orderBy("pos"))
    seen = _all_units(docs.join(marks, "n"), bits, length).withColumn("key", spread).withColumn("first", ~F.col("again") & (order == 1))
    seen = stored(seen.select("pos", "len", "gram", "name", "first"))
    _release(docs.sparkSession)
    firsts = seen.where("first")
    grams = cut(firsts.groupBy("gram").agg(F.min("name").alias("a"), F.max("name").alias("b"), F.count("*").alias("size")).where("a <> b").select("gram", "size"))
    listed = join_named(firsts, grams, "gram", "size").select(*place(), "len", "gram").groupBy("n").agg(F.collect_list(F.struct("at", "len", "gram")).alias("units"))
    windows = _windows(docs.join(listed, "n").select("n", "text", "units"), bits, length)
    key = F.when(F.col("again"), F.col("pos")).otherwise(F.col("name"))
    rank = F.row_number().over(W.partitionBy("again", "key", "gram").orderBy("pos"))
    rest = windows.withColumn("key", key).withColumn("rank", rank).where("again or rank > 1").select(*place())
    single = stored(rest.groupBy("n").agg(F.collect_list("at").alias("starts")))
    _release(docs.sparkSession)
    return seen.where("not first").select(*place(), "len").groupBy("n").agg(F.collect_list(F.struct("at", "len")).alias("runs")).join(single, "n", "full")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans).

    Every byte is removed that a string of ``length`` bytes covers which also starts earlier: in a document with a smaller id, or
    earlier in the same one. Overlaps count, strings are judged on the input. ``spans`` are the maximal removed
    runs as (start, end) bytes. A null text is empty. Rows with the same id stand in the order of their texts, so of repeated rows the first
    stays; rows without an id come before all others. An empty table gives an empty result; other columns are ignored.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    rows, bits = _numbered(docs, id_col, text_col)
    found = repeated_spans(rows, bits, length)

    def run(batches):
        for b in batches:
            out = []
            for i, t, runs, starts in zip(b.column(0).to_pylist(), *((x.as_py() for x in b.column(k)) for k in (1, 2, 3)), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                change = np.zeros(len(raw) + 1, np.int32)
                for at, n in [(r["at"], r["len"]) for r in runs or []]:
                    change[at] += 1
                    change[at + n - 1 + length] -= 1
                s = np.array(starts or [], np.int64)
                np.add.at(change, s, 1)
                np.add.at(change, s + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                kept = raw if not len(edge) else np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((i, len(raw), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), [{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)]))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return rows.join(found, "n", "left").select("id", "text", "runs", "starts").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def op7_suffix_cover(spark, sf_dir):
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
