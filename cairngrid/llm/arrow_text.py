"""Whole texts as Arrow buffers inside tasks: parts of bounded size, bytes mapped by a table, words split in C++."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: A-Z in lower case, every ASCII sign that is neither letter nor digit a blank.
WORD_TABLE = bytes(_LOWER[b] if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: A-Z in lower case, the signs that end a piece a line feed.
PIECE_TABLE = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else _LOWER[b] for b in range(256))


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)


def parts(batches: Iterable[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of at most ``size`` bytes of the string column ``column``, or of one row."""
    held, n = [], 0
    for b in batches:
        ends = _offsets(b.column(column))[1:].astype(np.int64)
        at, base = 0, int(_offsets(b.column(column))[0])
        while at < b.num_rows:
            to = int(np.searchsorted(ends, base + size - n, side="right"))
            if to <= at and held:
                yield pa.concat_batches(held)
                held, n = [], 0
                continue
            to = max(at + 1, to)
            held.append(b.slice(at, to - at))
            n += int(ends[to - 1]) - base
            at, base = to, int(ends[to - 1])
    if held:
        yield pa.concat_batches(held)


def mapped(texts: pa.Array, table: bytes | None) -> pa.StringArray:
    """``texts`` with every byte mapped; null becomes empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if table is None or not len(texts):
        return texts
    at = _offsets(texts)
    data = bytes(memoryview(texts.buffers()[2])[at[0] : at[-1]]) if at[-1] > at[0] else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(data.translate(table)))


def split(texts: pa.Array, table: bytes | None, at: str | None = None) -> tuple[pa.Array, np.ndarray]:
    """(pieces, number of the text that each comes from), without empty ones: split at runs of ASCII white space, or at the sign ``at`` and trimmed."""
    lists = pc.ascii_split_whitespace(mapped(texts, table)) if at is None else pc.split_pattern(mapped(texts, table), at)
    flat, place = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    if at is not None:
        flat = pc.ascii_trim(flat, " \t")
    some = pc.not_equal(flat, "")
    return flat.filter(some), place[some.to_numpy(zero_copy_only=False)]


def grouped(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys in order, sum of weights of each as integers, a place of each)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[starts], np.add.reduceat(weight[order], starts) if len(k) else np.zeros(0, np.int64), order[starts]
