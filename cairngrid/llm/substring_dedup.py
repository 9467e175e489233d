"""Near-duplicate passages by compact windows.

For each of a few hash functions, the hashes of a document's five-word shingles are arranged as a Cartesian tree: the node of
the smallest hash stands for all subsequences that contain it and no smaller one, a compact window (left, centre,
right) whose subsequences share one min-hash. Only nodes at least ``least`` shingles wide are kept, about two per ``least``
shingles and function. Windows of equal min-hash meet in a shuffle.

Windows of one min-hash are put into classes by all shingles that their runs of ``least`` shingles cover; the first occurrence stands for
its class, and the other members repeat it word by word. Classes of one min-hash are compared by sketches: min-hashes of Classes of one min-hash are compared by sketches: min-hashes of further
functions over three parts of the window. All earlier classes that agree often enough in some part are a class's partners. Of few classes each passes on all
partners; of many (a common line in many contexts, a passage in very many variants) the best of each part, and so many that no other partner repeats a further place of
the runs around the centre, told by the shingles themselves. What is passed on is joined to passages by alignment and verified shingle by shingle.

A class repeats another one in part: every run of ``least`` shingles of the first ones (function 0) is therefore named itself and is
a candidate with its first occurrence, so verbatim repeats never depend on hashing luck.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngrid.llm.common import stored
from cairngrid.llm.suffix_dedup import _mix, _name, _numbered, _release, _TABLES, _sums

WORDS = 5
LEAST_WORDS = 50
SIMILARITY = 0.8
HASHES = 3
#: Further functions per part of a window; on so many of them two windows must agree in some part.
SKETCH = 8
ENOUGH = 3
#: A class alone of its min-hash has no partner to choose.
MANY = 1
#: Classes of one min-hash of which all that agree are verified; of more of them, those that repeat something that no other one does.
FEW = 8
#: Classes that a task compares at once, and those of one min-hash whose partners it finds.
CHUNK = 2048
BLOCK = 1 << 14
#: Classes of one min-hash that are compared with each other; more of them are looked up, with the same result.
TILE = 512
DRIFT = 64
PIECE = 1 << 17
LIST = 500
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], np.uint64)
_WORD_BASE = 0xD6E8FEB86659FD93


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for every word, A-Z lower-cased; words are separated by plain white space."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    ink = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ink, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    out = np.empty(len(start), np.uint64)
    size = 1 << 19  # bounded pieces: prefix sums restart where a word begins
    k = 0
    while k < len(start):
        last = max(k + 1, int(np.searchsorted(end, start[k] + size, side="right")))
        s, e = start[k:last], end[k:last]
        if e[-1] - s[0] > size:  # a single word longer than a piece
            out[k] = xxhash.xxh64_intdigest(raw[s[0] : e[0]].tobytes())
            k += 1
            continue
        sums = _sums(raw[s[0] : e[-1]])
        s, e = s - s[0], e - s[0]
        out[k:last] = _mix((sums[e] - sums[s]) * _TABLES[0].down[s] + (e - s).astype(np.uint64))
        k = last
    return out


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hash of every run of ``words`` consecutive words."""
    w = word_hashes(text)
    n = len(w) - words + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = w[:n].copy()
    for k in range(1, words):
        out = out * np.uint64(_WORD_BASE) + w[k : n + k]
    return _mix(out)


def compact_windows(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right), ends inclusive, of all Cartesian-tree nodes at least ``least`` wide over the ranges [lo, hi).

    The centre of such a node is the smallest of some ``least`` values in a row, and so is the nearest smaller value on either side: only these are
    taken in order, on a stack. Of equal values the leftmost is smallest.
    """
    n, e = len(values), np.zeros(0, np.int64)
    keep = hi - lo >= least
    lo, hi = lo[keep], hi[keep]
    if not len(lo):
        return e, e, e
    starts = n - least + 1
    low = values
    for k in _steps(least):
        low = np.minimum(low[:-k], low[k:])
    whole = np.zeros(starts + 1, np.int32)  # runs that lie within a range; the others are no reason to take a value
    np.add.at(whole, lo, 1)
    np.subtract.at(whole, hi - least + 1, 1)
    low = np.where(np.cumsum(whole[:-1]) > 0, low, np.uint64(0))
    pad = np.zeros(least - 1, np.uint64)
    high = np.concatenate([pad, low, pad])
    for k in _steps(least):
        high = np.maximum(high[:-k], high[k:])
    at = np.flatnonzero(high == values)
    part = np.searchsorted(lo, at, side="right") - 1
    inside = (part >= 0) & (at < hi[part])
    at, part = at[inside], part[inside]
    before, after = np.full(len(at), -1), np.full(len(at), -1)
    stack: list[int] = []
    now, before_, after_ = -1, before.tolist(), after.tolist()
    v = values[at].tolist()
    for k, (x, own) in enumerate(zip(v, part.tolist(), strict=True)):
        if own != now:
            stack, now = [], own
        while stack and v[stack[-1]] > x:
            after_[stack.pop()] = k
        if stack:
            before_[k] = stack[-1]
        stack.append(k)
    before, after = np.array(before_, np.int64), np.array(after_, np.int64)
    left = np.where(before >= 0, at[before] + 1, lo[part])
    right = np.where(after >= 0, at[after], hi[part]) - 1
    wide = right - left + 1 >= least
    return left[wide], at[wide], right[wide]


def _steps(width: int) -> list[int]:
    """Shifts that make a minimum over ``width`` values in a row from minima over two."""
    out, have = [], 1
    while have < width:
        out.append(min(have, width - have))
        have += out[-1]
    return out


def _windows(docs: DataFrame, least: int, hashes: int) -> DataFrame:
    """(again, key, f, n, c, l, r, name, on, oc) of every compact window; positions are shingle numbers.

    ``name`` is a hash of the shingles that runs of ``least`` around the centre cover. ``again``: the window repeats the one
    around (on, oc) of the same batch; such windows are kept for function 0 only, since a repeat has a window of every function.
    A document of more than PIECE shingles is cut into pieces that overlap by four times ``least``.
    """

    def run(batches):
        for b in batches:
            parts, size = [], 0
            for n, t in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True):
                s = shingles(t)
                for at in range(0, max(1, len(s) - 4 * least), PIECE):
                    piece = s[at : at + PIECE + 4 * least]
                    if len(piece) >= least:
                        parts.append((n, at, piece))
                        size += len(piece)
                    if size > PIECE:
                        yield emit(parts)
                        parts, size = [], 0
            if parts:
                yield emit(parts)

    def emit(parts):
        s = np.concatenate([p for _, _, p in parts])
        hi = np.cumsum([len(p) for _, _, p in parts])
        lo = hi - np.array([len(p) for _, _, p in parts])
        number, offset = np.array([n for n, _, _ in parts], np.int64), np.array([a for _, a, _ in parts], np.int64)
        cols, sums = [], _prefix(s)
        for f in range(hashes):
            v = _mix(s ^ _SEEDS[f])
            left, centre, right = compact_windows(v, lo, hi, least)
            part = np.searchsorted(lo, centre, side="right") - 1
            shift = offset[part] - lo[part]
            near, far = _reach(left, centre, right, least)
            name = _name(sums, near, far + 1) + (centre - near).astype(np.uint64)
            n, c = number[part], (centre + shift).astype(np.int32)
            first = _first_of(name, n, c)
            on, oc = n[first], c[first]
            again = (first != np.arange(len(c))) & ((n != on) | (c - oc >= least))
            keep = np.flatnonzero(~again) if f else slice(None)
            cols.append([x[keep] for x in (again, v[centre].view(np.int64), np.full(len(c), f, np.int32), n, c, (left + shift).astype(np.int32), (right + shift).astype(np.int32), name.view(np.int64), on, oc)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols, strict=True)], names=["again", "key", "f", "n", "c", "l", "r", "name", "on", "oc"])

    return docs.select("n", "text").mapInArrow(run, "again boolean, key long, f int, n long, c int, l int, r int, name long, on long, oc int")


def _first_of(name: np.ndarray, n: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For every window the place of the first one, by (n, c), with its name."""
    order = np.lexsort((c, n, name))
    head = np.ones(len(name), bool)
    head[1:] = name[order][1:] != name[order][:-1]
    out = np.empty(len(name), np.int64)
    out[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1] if len(name) else order
    return out


def _prefix(s: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``_name`` tells ranges of shingles."""
    _sums(np.zeros(0, np.uint8))  # makes the tables
    out = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(s * _TABLES[0].up[: len(s)], out=out[1:])
    return out


def _reach(left: np.ndarray, centre: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last shingle of the runs of ``least`` shingles that lie in the window and contain its centre."""
    return np.maximum(left, centre - least + 1), np.minimum(right, centre + least - 1)


def run_names(s: np.ndarray, least: int) -> np.ndarray:
    """Hash of every run of ``least`` consecutive shingles, joined from runs of powers of two."""
    n = len(s) - least + 1
    part, width, out, done = s, 1, None, 0
    while True:
        if least & width:
            out = part[:n] if out is None else _mix(out * np.uint64(_WORD_BASE) + part[done : done + n])
            done += width
        if done == least:
            return out
        part = _mix(part[:-width] * np.uint64(_WORD_BASE) + part[width:])
        width *= 2


def sketches(s: np.ndarray, left: np.ndarray, c: np.ndarray, right: np.ndarray, least: int, functions: int = SKETCH) -> np.ndarray:
    """One row per window: for the runs of ``least`` shingles that end at, lie around, and begin at its centre, clipped to the window, one byte of the min-hash under each function."""
    half = (least - 1) // 2
    spans = [(np.maximum(left, c - least + 1), c), (np.maximum(left, c - half), np.minimum(right, c + half)), (c, np.minimum(right, c + least - 1))]
    out = np.empty((len(c), len(spans), functions), np.uint8)
    for g in range(functions):
        table = [(_mix(s ^ _SEEDS[g] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)]
        while 2 << (len(table) - 1) <= least and len(table[-1]) > 1 << (len(table) - 1):
            k = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-k], table[-1][k:]))
        for k, (lo, hi) in enumerate(spans):
            level = np.frexp((hi - lo + 1).astype(float))[1] - 1
            for v in np.unique(level):
                at = level == v
                low = np.minimum(table[v][lo[at]], table[v][hi[at] - (1 << v) + 1])
                out[at, k, g] = low & np.uint32(255)
    return out.reshape(len(c), -1)


def _unfold(docs: DataFrame, units: DataFrame, least: int) -> DataFrame:
    """From the texts, for ``units`` (n, key, f, c, l, r, classes): a row (key: name, n, c: start) for every run of ``least`` shingles of those of function 0, and a row with a sketch for all that stand for a class among several, with the shingles around its centre (32 of their bits) where these are more than FEW."""
    fields = ("key", "f", "c", "l", "r", "classes")

    def run(batches):
        for b in batches:
            held, size = [], 0
            for number, text, want in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), b.column(2), strict=True):
                held.append((number, shingles(text), {k: want.values.field(k).to_numpy().astype(np.int64) for k in fields}))
                size += len(held[-1][1])
                if size > PIECE:
                    yield from emit(held)
                    held, size = [], 0
            yield from emit(held)

    def emit(held):
        """Documents are taken together: their shingles side by side, units moved to their place."""
        if not held:
            return
        s = np.concatenate([x for _, x, _ in held])
        base = np.cumsum([0, *(len(x) for _, x, _ in held)])[:-1]
        unit = {k: np.concatenate([q[k] for _, _, q in held]) for k in fields}
        doc = np.repeat(np.arange(len(held)), [len(q["c"]) for _, _, q in held])
        number, shift = np.array([n for n, _, _ in held], np.int64), base[doc]
        left, c, right = (unit[k] + shift for k in ("l", "c", "r"))
        zero = unit["f"] == 0
        near, far = _reach(left[zero], c[zero], right[zero], least)
        count = far - near - least + 2
        at = np.unique(np.repeat(near - np.cumsum(count) + count, count) + np.arange(count.sum()))
        if len(at):
            own = np.searchsorted(base, at, side="right") - 1
            none = pa.nulls(len(at), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(run_names(s, least)[at].view(np.int64)), none, pa.array(number[own]), pa.array((at - base[own]).astype(np.int32)), none, none, none, *[pa.nulls(len(at), pa.binary())] * 2], names=names)
        several = unit["classes"] > 1
        if several.any():
            sketch = sketches(s, left[several], c[several], right[several], least)
            ints = [pa.array(unit[k][several].astype(np.int32)) for k in ("f", "c", "l", "r", "classes")]
            low, many = s.astype("<u4"), unit["classes"][several] > FEW
            near, far = _reach(left[several], c[several], right[several], least)
            reach = [low[a : e + 1].tobytes() if k else None for a, e, k in zip(near.tolist(), far.tolist(), many.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(unit["key"][several]), ints[0], pa.array(number[doc[several]]), *ints[1:], pa.array([v.tobytes() for v in sketch], pa.binary()), pa.array(reach, pa.binary())], names=names)

    names = ["key", "f", "n", "c", "l", "r", "classes", "sketch", "reach"]
    listed = units.groupBy("n").agg(F.collect_list(F.struct(*fields)).alias("want"))
    return docs.join(listed, "n").select("n", "text", "want").mapInArrow(run, "key long, f int, n long, c int, l int, r int, classes int, sketch binary, reach binary")


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """On how many of its eight bytes each pair of words agrees."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    t = x ^ y
    return np.bitwise_count(~(((t & low) + low) | t | low))


def _best_earlier(words: np.ndarray, enough: int) -> np.ndarray:
    """For every word the earlier one that agrees with it on most bytes, ties to the first; -1 where none agrees on ``enough``.

    Words that agree on some choice of bytes are equal under its mask: for each choice, most bytes first, the first equal word is looked up, so no two words are
    compared and the work does not grow with the square of their number.
    """
    own = np.arange(len(words))
    best = np.full(len(words), -1)
    for level in range(8, enough - 1, -1):
        if (best[1:] >= 0).all():
            break
        low = own
        for some in itertools.combinations(range(8), level):
            _, first, which = np.unique(words & np.uint64(sum(255 << 8 * i for i in some)), return_index=True, return_inverse=True)
            low = np.minimum(low, first[which])
        found = (best < 0) & (low < own)
        best[found] = low[found]
    return best


def _agreeing(sketch: np.ndarray, start: np.ndarray, size: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (later, earlier) of rows of one group: every row with its best earlier row for each part (a word of the sketch), ties to the first, if they agree on ``enough`` bytes.

    Rows of a group are in order. Groups above TILE rows are looked up by masks, others compared; both give the same pairs.
    """
    later, earlier = [], []
    for k in map(int, np.unique(size[size > 1])):
        at = start[size == k]
        for part in range(sketch.shape[1]):
            if k > TILE:
                for s in at:
                    best = _best_earlier(sketch[s : s + k, part], enough)
                    ok = np.flatnonzero(best >= 0)
                    later.append(s + ok)
                    earlier.append(s + best[ok])
                continue
            bar = np.triu(np.ones((k, k), bool))
            for some in np.array_split(at, max(1, len(at) * k * k >> 18)):
                rows = some[:, None] + np.arange(k)
                own = sketch[rows, part]
                agree = _agreement(own[:, :, None], own[:, None, :]).astype(np.int8)
                agree[:, bar] = -1
                best = agree.argmax(axis=2)
                ok = np.take_along_axis(agree, best[:, :, None], 2)[:, :, 0] >= enough
                later.append(rows[ok])
                earlier.append((some[:, None] + best)[ok])
    none = np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(later or [none]), np.concatenate(earlier or [none])]), axis=1)
    return pairs[0], pairs[1]


def _all_agreeing(sketch: np.ndarray, start: np.ndarray, size: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (later, earlier) of rows of one group that agree on ``enough`` bytes of some part."""
    later, earlier = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in map(int, np.unique(size[size > 1])):
        x, y = np.tril_indices(k, -1)
        at = start[size == k][:, None]
        x, y = (at + x).ravel(), (at + y).ravel()
        ok = (_agreement(sketch[x], sketch[y]) >= enough).any(axis=1)
        later.append(x[ok])
        earlier.append(y[ok])
    return np.concatenate(later), np.concatenate(earlier)


def _between(lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    at = np.arange(width, dtype=np.int16)
    return (at >= lo[:, None]) & (at <= hi[:, None])


def _covered(hits: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int, need: int) -> np.ndarray:
    """Per row the places that ``matched`` marks between ``lo`` and ``hi``, ends inclusive: those of windows of ``least`` with ``need`` hits, from a hit to a hit."""
    m, width = hits.shape
    out = np.zeros((m, width), bool)
    some = np.flatnonzero(hits.sum(axis=1) >= need)
    hits, lo, hi = hits[some], lo[some], hi[some]
    total = np.zeros((len(some), width + 1), np.int16)
    np.cumsum(hits, axis=1, out=total[:, 1:])
    ok = (total[:, least:] - total[:, :-least] >= need) & _between(lo, hi - least + 1, width - least + 1)
    any_ = ok.any(axis=1)
    some, hits, ok = some[any_], hits[any_], ok[any_]
    change = np.zeros((len(some), width + 1), np.int16)
    change[:, : width - least + 1] += ok
    change[:, least:] -= ok
    inside = np.cumsum(change, axis=1)[:, :-1] > 0
    at, edge = np.arange(width, dtype=np.int16), np.zeros((len(some), 1), bool)
    first = np.maximum.accumulate(np.where(inside & ~np.hstack([edge, inside[:, :-1]]), at, 0), axis=1)
    last = np.minimum.accumulate(np.where(inside & ~np.hstack([inside[:, 1:], edge]), at, width)[:, ::-1], axis=1)[:, ::-1]
    before = np.maximum.accumulate(np.where(hits, at, -1), axis=1)
    after = np.minimum.accumulate(np.where(hits, at, width)[:, ::-1], axis=1)[:, ::-1]
    out[some] = inside & (before >= first) & (after <= last)
    return out


@dataclass
class _Classes:
    """Classes side by side, those of a group in order: ``group`` numbers groups, ``v`` has the shingles around the centre (32 bits, below the group's number) where ``lo`` <= place <= ``hi``."""

    group: np.ndarray
    n: np.ndarray
    c: np.ndarray
    l: np.ndarray  # noqa: E741
    r: np.ndarray
    word: np.ndarray
    v: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def take(self, at) -> _Classes:
        return _Classes(*(getattr(self, k.name)[at] for k in fields(self)))

    def join(self, other: _Classes) -> _Classes:
        return _Classes(*(np.concatenate([getattr(self, k.name), getattr(other, k.name)]) for k in fields(self)))


def _choices(xs: _Classes, ys: _Classes, before: np.ndarray, covered: np.ndarray, least: int, need: int, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y): partners of every x among the agreeing ``ys`` of its group that stand before ``before``, so many that no other one covers a further place of x.

    ``covered`` says what is covered, and is brought up to date. What all ys together share with x bounds what one of them can add, so an x that has reached this bound is
    done; the best of each part are tried first. A window allows for ``least - need`` misses: whoever matches it has one of its rarest ``least - need + 1`` shingles, so
    only the ys that have one of these in a window that may add something are compared.
    """
    width, none = 2 * least - 1, np.zeros(0, np.int64)
    there = _between(ys.lo, ys.hi, width)
    if not there.any() or not len(xs.n):
        return none, none
    value, owner = ys.v[there], np.nonzero(there)[0]
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]  # a class that has a shingle several times counts once
    value, owner = value[new], owner[new]
    head = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    number, step = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(value)))), len(ys.n) + 1
    which = np.minimum(np.searchsorted(value[head], xs.v), len(head) - 1)
    begin = head[which]
    count = np.where(_between(xs.lo, xs.hi, width) & (value[begin] == xs.v), np.searchsorted(number * step + owner, which * step + before[:, None]) - begin, 0)
    bound = _covered(count > 0, xs.lo, xs.hi, least, need)
    later, earlier = [none], [none]

    def fit(x, y):
        """Those pairs of a group that may be partners."""
        el, er = np.minimum(xs.c[x] - xs.l[x], ys.c[y] - ys.l[y]), np.minimum(xs.r[x] - xs.c[x], ys.r[y] - ys.c[y])
        ok = (el + er + 1 >= least) & ((xs.n[x] != ys.n[y]) | (xs.c[x] - ys.c[y] >= least))
        ok &= (_agreement(xs.word[x], ys.word[y]) >= enough).any(axis=1)
        return x[ok], y[ok]

    def compare(x, y):
        """Keeps the pairs that cover something new, in order; those of one x stand together."""
        for k in range(0, len(x), 4096):
            i, j = x[k : k + 4096], y[k : k + 4096]
            lo, hi = np.maximum(xs.lo[i], ys.lo[j]), np.minimum(xs.hi[i], ys.hi[j])
            cover = _covered(_hits(xs.v[i], ys.v[j], lo, hi), lo, hi, least, need)
            new = (cover & ~covered[i]).any(axis=1)
            i, j, cover = i[new], j[new], cover[new]
            turn = _rank(i)
            for now in range(int(turn.max(initial=-1)) + 1):
                at = np.flatnonzero(turn == now)
                at = at[(cover[at] & ~covered[i[at]]).any(axis=1)]
                covered[i[at]] |= cover[at]
                later.append(i[at])
                earlier.append(j[at])

    compare(*fit(*_firsts(xs, ys, before, (bound & ~covered).any(axis=1), enough)))
    short = np.flatnonzero((bound & ~covered).any(axis=1))
    for some in np.array_split(short, max(1, len(short) >> 8)):
        x, p = _telling(count[some], bound[some] & ~covered[some], xs.lo[some], xs.hi[some], least, need)
        once = np.unique(x * len(head) + which[some[x], p], return_index=True)[1]
        x, p = x[once], p[once]
        size = count[some[x], p]
        cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), 1 << 20))
        parts = np.searchsorted(x, np.unique(x[cuts]))  # of whole xs
        for a, e in itertools.pairwise([*parts.tolist(), len(x)]):
            k = size[a:e]
            at = np.repeat(begin[some[x[a:e]], p[a:e]] - np.cumsum(k) + k, k) + np.arange(k.sum())
            pair, times = np.unique(np.repeat(some[x[a:e]], k) * step + owner[at], return_counts=True)
            i, j = pair // step, pair % step
            order = np.lexsort((j, -times, i))
            i, j = fit(i[order], j[order])
            turn, to = _rank(i), 4
            while len(i):  # those that share most first
                now = turn < to
                compare(i[now], j[now])
                now = ~now & (bound[i] & ~covered[i]).any(axis=1)
                i, j, turn, to = i[now], j[now], turn[now], 4 * to
    return np.concatenate(later), np.concatenate(earlier)


def _telling(count: np.ndarray, todo: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the rarest ``least - need + 1`` shingles of every window that may cover a place ``todo``; ``count``: how many have a shingle."""
    m, width = count.shape
    sums = lambda v: np.hstack([np.zeros((m, 1), np.int16), np.cumsum(v, axis=1, dtype=np.int16)])
    have, new = sums(count > 0), sums(todo)
    live = (have[:, least:] - have[:, :-least] >= need) & (new[:, least:] > new[:, :-least]) & _between(lo, hi - least + 1, width - least + 1)
    row, at = np.nonzero(live)
    most = np.full((m, width + least - 1), -1, count.dtype)  # by window, with none before and after
    for k in range(0, len(row), 8192):
        i, j = row[k : k + 8192], at[k : k + 8192]
        most[i, j + least - 1] = np.partition(count[i[:, None], j[:, None] + np.arange(least)], least - need, axis=1)[:, least - need]
    for k in _steps(least):
        most = np.maximum(most[:, :-k], most[:, k:])
    return np.nonzero((count > 0) & (count <= most))


def _rank(x: np.ndarray) -> np.ndarray:
    """How many equal values stand before each value; equal ones stand together."""
    head = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
    return np.arange(len(x)) - np.repeat(head, np.diff(np.append(head, len(x))))


def _hits(x: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Per row, which values of x between ``lo`` and ``hi`` occur in y there."""
    inside, row = _between(lo, hi, x.shape[1]), np.arange(len(x), dtype=np.uint64)[:, None] << np.uint64(32)
    low = np.uint64(0xFFFFFFFF)
    have = np.append(np.sort((y & low | row)[inside]), np.uint64(1 << 63))
    out = np.zeros(x.shape, bool)
    x = (x & low | row)[inside]
    out[inside] = have[np.searchsorted(have, x)] == x
    return out


def _firsts(xs: _Classes, ys: _Classes, before: np.ndarray, wanted: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """For the ``wanted`` xs the y of their group that agrees best in each part, ties to the first, if it agrees on ``enough`` bytes. An x before ``before`` stands among the ys there."""
    later, earlier = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    head = np.flatnonzero(np.r_[True, ys.group[1:] != ys.group[:-1]])
    size = np.diff(np.append(head, len(ys.group)))
    among = before < len(ys.group)
    number = np.full(len(ys.group), -1)
    number[before[among & wanted]] = np.flatnonzero(among & wanted)
    some = np.add.reduceat(number >= 0, head) > 0
    x, y = _agreeing(ys.word, head[some], size[some], enough)
    later.append(number[x][number[x] >= 0])
    earlier.append(y[number[x] >= 0])
    old = np.flatnonzero(~among & wanted)  # all of one group, the last
    a = int(head[-1])
    for x in np.array_split(old, max(1, len(old) * int(size[-1]) >> 18)):
        for part in range(xs.word.shape[1]):
            agree = _agreement(xs.word[x, part][:, None], ys.word[a:, part])
            best = agree.argmax(axis=1) if len(x) else x
            ok = agree[np.arange(len(x)), best] >= enough
            later.append(x[ok])
            earlier.append(a + best[ok])
    x, y = np.unique(np.stack([np.concatenate(later), np.concatenate(earlier)]), axis=1)
    return x, y


def _partners(least: int, need: int, enough: int):
    """What ``_near`` does in a task, over classes in order of (key, f, block), latest first."""
    width = 2 * least - 1

    def run(batches):
        held, rows, last = [], 0, None
        for b in batches:
            held.append(b)
            rows += b.num_rows
            while rows > CHUNK:
                t = pa.Table.from_batches(held)
                to = whole(t.slice(0, CHUNK + 1))
                last, out = chunk(t.slice(0, to), last)
                yield out
                held, rows = t.slice(to).to_batches(), rows - to
        if rows:
            yield chunk(pa.Table.from_batches(held), last)[1]

    def whole(t):
        """Where to cut: before a group that would go on, unless it is larger than a chunk."""
        name = [t.column(k).to_numpy() for k in ("key", "f", "block")]
        other = np.flatnonzero(np.logical_or.reduce([v != v[-1] for v in name]))
        return int(other[-1]) + 1 if len(other) and t.column("classes")[-1].as_py() <= CHUNK else CHUNK

    def chunk(t, last):
        """``last``: (key, f, block) of the group that may go on, its own classes and what of them is covered."""
        t = t.take(pa.array(np.arange(t.num_rows)[::-1]))
        name = [t.column(k).to_numpy() for k in ("key", "f", "block")]
        new = np.r_[True, np.logical_or.reduce([v[1:] != v[:-1] for v in name])]
        start = np.flatnonzero(new)
        size, group = np.diff(np.append(start, t.num_rows)), np.cumsum(new) - 1
        n, c, left, right, own, many = (t.column(k).to_numpy().astype(np.int64) for k in ("n", "c", "l", "r", "own", "classes"))
        word = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(t.num_rows, 3)
        near, far = _reach(left, c, right, least)
        lo, hi, v = near - c + least - 1, far - c + least - 1, np.zeros((t.num_rows, width), np.uint64)
        large = many > FEW
        v[_between(lo, hi, width) & large[:, None]] = np.frombuffer(b"".join(x for x in t.column("reach").to_pylist() if x), "<u4")
        v |= group.astype(np.uint64)[:, None] << np.uint64(32)
        all_ = _Classes(group, n, c, left, right, word, v, lo, hi)
        pairs = []
        few = ~large[start]
        x, y = _all_agreeing(word, start[few], size[few], enough)
        pairs.append((all_.take(x), all_.take(y)))
        ys = all_.take(large)
        xs, before = all_.take(large & (own > 0)), np.flatnonzero(own[large] > 0)
        covered, end = np.zeros((len(before), width), bool), tuple(k[0] for k in name)
        if last and last[0] == tuple(k[-1] for k in name) and len(last[1].n):
            more, done = last[1], last[2]
            more.group[:] = group[-1]
            more.v = more.v & np.uint64(0xFFFFFFFF) | np.uint64(group[-1] << 32)
            xs, before, covered = more.join(xs), np.append(np.full(len(more.n), len(ys.n)), before), np.concatenate([done, covered])
        x, y = _choices(xs, ys, before, covered, least, need, enough)
        pairs.append((xs.take(x), ys.take(y)))
        on = xs.group == 0
        return (end, xs.take(on), covered[on]), emit([p[0] for p in pairs], [p[1] for p in pairs])

    def emit(x, y):
        x, y = x[0].join(x[1]), y[0].join(y[1])
        el, er = np.minimum(x.c - x.l, y.c - y.l), np.minimum(x.r - x.c, y.r - y.c)
        diagonal = x.c - y.c
        ok = (el + er + 1 >= least) & ((x.n != y.n) | (diagonal >= least))
        cols = [x.n, y.n, diagonal, x.c - el, x.c + er, y.c - el, y.c + er]
        return pa.RecordBatch.from_arrays([pa.array(v[ok] if k < 2 else v[ok].astype(np.int32)) for k, v in enumerate(cols)], names=["n", "m", "diagonal", "xs", "xe", "ys", "ye"])

    return run


def _best(classes: DataFrame, least: int, enough: int) -> DataFrame:
    """(n, m, diagonal, xs, xe, ys, ye) for classes of one min-hash whose sketches agree: each with its best earlier one in each part, whose whole window is compared."""
    parts = F.posexplode(F.array(*[F.substring("sketch", 8 * k + 1, 8) for k in range(3)])).alias("part", "word")
    work = classes.select("key", "f", "n", "c", "l", "r", parts)

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 1 << 15:
                continue
            last = int(heads(held)[-1])  # the last group may go on
            yield from pairs(held.slice(0, last))
            held = held.slice(last).combine_chunks()
        if held is not None:
            yield from pairs(held)

    def heads(t):
        g = [t.column(k).to_numpy() for k in ("key", "f", "part")]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in g])
        return np.flatnonzero(new)

    def pairs(t):
        if not t.num_rows:
            return
        start = heads(t)
        size = np.diff(np.append(start, t.num_rows))
        sketch = np.frombuffer(b"".join(t.column("word").to_pylist()), np.uint64).reshape(t.num_rows, 1)
        x, y = _agreeing(sketch, start, size, enough)
        n, c, left, right = (t.column(k).to_numpy().astype(np.int64) for k in ("n", "c", "l", "r"))
        el, er = np.minimum(c[x] - left[x], c[y] - left[y]), np.minimum(right[x] - c[x], right[y] - c[y])
        diagonal = c[x] - c[y]
        ok = (el + er + 1 >= least) & ((n[x] != n[y]) | (diagonal >= least))
        cols = [n[x], n[y], diagonal, c[x] - el, c[x] + er, c[y] - el, c[y] + er]
        yield pa.RecordBatch.from_arrays([pa.array(v[ok] if k < 2 else v[ok].astype(np.int32)) for k, v in enumerate(cols)], names=["n", "m", "diagonal", "xs", "xe", "ys", "ye"])

    order = ["key", "f", "part"]
    return work.repartition(*order).sortWithinPartitions(*order, "n", "c").mapInArrow(run, "n long, m long, diagonal int, xs int, xe int, ys int, ye int")


def _near(classes: DataFrame, least: int, enough: int, similarity: float) -> DataFrame:
    """(n, m, diagonal, xs, xe, ys, ye) for classes of one min-hash whose sketches agree: each with earlier ones, so many that the others repeat nothing more of what lies around its centre.

    Of FEW classes all that agree are passed on. Of more, the best of each part are, and they bring the shingles around their centres, which tell the partners that another one would add something to. They come latest
    first: a task holds its share of the classes of a min-hash, BLOCK on average, and sees all of that min-hash go by, CHUNK at once.
    """
    blocks = F.when(F.col("classes") > FEW, F.ceil(F.col("classes") / BLOCK)).otherwise(1).cast("int")
    work = classes.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")).withColumn("own", F.pmod(F.xxhash64("n", "c"), blocks) == F.col("block"))
    need = math.ceil(2 * similarity / (1 + similarity) * least - 1e-9)
    order = ["key", "f", "block"]
    more = work.repartition(*order).sortWithinPartitions(*order, F.desc("n"), F.desc("c")).mapInArrow(_partners(least, need, enough), "n long, m long, diagonal int, xs int, xe int, ys int, ye int")
    return _best(classes.where(F.col("classes") > FEW), least, enough).unionByName(more)


def candidates(docs: DataFrame, least: int, hashes: int, enough: int, similarity: float = SIMILARITY) -> DataFrame:
    """(id, n, xs, xe, m, ys, ye): passage [xs, xe] of document n may repeat passage [ys, ye] of the earlier document m (shingle numbers).

    Every run of ``least`` shingles that has come before lies in some [xs, xe].
    """
    # repeats within a batch are dealt out by place, not by min-hash; the others of a min-hash are one per batch and class at most
    dealt = F.when(F.col("again"), F.xxhash64("n", "c")).otherwise(F.col("key"))
    group, same = W.partitionBy("again", "dealt", "f"), W.partitionBy("again", "dealt", "f", "name").orderBy("n", "c")
    met = _windows(docs, least, hashes).withColumn("dealt", dealt).repartition("again", "dealt", "f").withColumn("o", F.when(F.col("again"), F.struct(F.col("on").alias("n"), F.col("oc").alias("c"))).otherwise(F.first(F.struct("n", "c")).over(same)))
    met = met.withColumn("first", ~F.col("again") & (F.col("o.n") == F.col("n")) & (F.col("o.c") == F.col("c")))
    met = met.withColumn("classes", F.sum(F.col("first").cast("int")).over(group).cast("int"))
    met = stored(met.where("first and classes > 1 or not first and f = 0").select("key", "f", "n", "c", "l", "r", "first", "classes", F.col("o.n").alias("m"), (F.col("c") - F.col("o.c")).alias("diagonal")))
    _release(docs.sparkSession)
    apart = (F.col("n") != F.col("m")) | (F.col("diagonal") >= least)
    near, far = F.greatest("l", F.col("c") - (least - 1)), F.least("r", F.col("c") + (least - 1))
    copies = met.where(~F.col("first") & apart).select("n", "m", "diagonal", near.alias("xs"), far.alias("xe"))
    # a member that overlaps its first occurrence is taken apart into runs, as the first ones are
    units = met.where(F.col("first") | ~apart).select("n", "key", "f", "c", "l", "r", F.when(F.col("first"), F.col("classes")).otherwise(1).alias("classes"))
    unfolded = stored(_unfold(docs, units, least))
    w = W.partitionBy("name").orderBy("n", "at")
    runs = unfolded.where("f is null").select(F.col("key").alias("name"), "n", F.col("c").alias("at")).withColumn("o", F.first(F.struct("n", "at")).over(w)).withColumn("diagonal", F.col("at") - F.col("o.at")).withColumn("m", F.col("o.n"))
    runs = runs.where(apart).groupBy("n", "m", "diagonal").agg(F.min("at").alias("xs"), (F.max("at") + (least - 1)).alias("xe"))
    verbatim = copies.unionByName(runs).withColumns({"ys": F.col("xs") - F.col("diagonal"), "ye": F.col("xe") - F.col("diagonal")})
    same = verbatim.unionByName(_near(unfolded.where("f is not null"), least, enough, similarity))
    found = same.groupBy("n", "m", F.floor(F.col("diagonal") / DRIFT).alias("band")).agg(F.min("xs").alias("xs"), F.max("xe").alias("xe"), F.min("ys").alias("ys"), F.max("ye").alias("ye"))
    return stored(found.select("n", "m", "xs", "xe", "ys", "ye").withColumn("id", F.xxhash64("n", "m", "xs", "xe", "ys", "ye")))


def matched(x: np.ndarray, y: np.ndarray, least: int, similarity: float) -> list[tuple[int, int]]:
    """Maximal ranges [start, end) of ``x`` covered by windows of ``least`` shingles of which so many occur in ``y`` that two sets of this size reach the similarity."""
    rank = np.unique(np.concatenate([x, y]), return_inverse=True)[1].astype(np.uint32)
    _, start, end = matched_all([rank[: len(x)]], [rank[len(x) :]], least, similarity)
    return list(zip(start.tolist(), end.tolist(), strict=True))


def matched_all(xs: list[np.ndarray], ys: list[np.ndarray], least: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, start, end) of the ranges that ``matched`` defines, for many pairs of arrays of 32-bit shingles side by side."""
    sizes = np.array([len(x) for x in xs], np.int64)
    total, ends = int(sizes.sum()), np.cumsum(sizes)
    none = np.zeros(0, np.int64)
    if total < least:
        return none, none, none
    tell = lambda parts: (np.repeat(np.arange(len(parts), dtype=np.uint64), [len(v) for v in parts]) << np.uint64(32)) | np.concatenate(parts)
    x, y = tell(xs), np.append(np.sort(tell(ys)), np.uint64(1 << 63))
    found = y[np.searchsorted(y, x)] == x
    need = np.ceil(2 * similarity / (1 + similarity) * least - 1e-9)
    hits = np.concatenate([[0], np.cumsum(found)])
    end = np.repeat(ends, sizes)
    ok = np.flatnonzero((hits[least:] - hits[:-least] >= need) & (np.arange(least, total + 1) <= end[: total - least + 1]))
    if not len(ok):
        return none, none, none
    change = np.zeros(total + 1, np.int32)
    change[ok] += 1
    np.subtract.at(change, ok + least, 1)
    gone = np.cumsum(change[:-1]) > 0
    edge = np.zeros(total + 1, bool)  # arrays lie side by side: a range ends with its own
    edge[0] = edge[ends] = True
    a = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
    b = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
    at = np.flatnonzero(found)  # a range begins and ends with a shingle of y
    pair = np.searchsorted(ends, a, side="right")
    base = (ends - sizes)[pair]
    return pair, at[np.searchsorted(at, a)] - base, at[np.searchsorted(at, b) - 1] + 1 - base


def _passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(id, n, m, xs, side, part): the shingles of both passages of every candidate, by 32 of their bits, in one pass over the texts."""
    side = lambda k, number, s, e: F.struct(F.col(number).alias("doc"), F.struct("id", "n", "m", "xs", F.lit(k).alias("side"), F.col(s).alias("s"), F.col(e).alias("e")).alias("q"))
    sides = found.select(F.explode(F.array(side(0, "n", "xs", "xe"), side(1, "m", "ys", "ye"))).alias("v")).select("v.*")
    # a document that starts a popular passage is wanted often: its list is dealt out over several rows
    busy = sides.groupBy("doc").count().where(F.col("count") > LIST).select("doc", F.ceil(F.col("count") / LIST).alias("salts"))
    salted = sides.join(busy, "doc", "left").withColumn("salt", F.coalesce(F.pmod("q.id", "salts"), F.lit(0)))
    listed = salted.groupBy(F.col("doc").alias("n"), "salt").agg(F.collect_list("q").alias("want"))
    names = ["id", "n", "m", "xs", "side"]

    def emit(rows, parts):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)), pa.array(parts, pa.binary())], names=[*names, "part"])

    def run(batches):
        for b in batches:
            rows, parts = [], []
            for t, want in zip((x.as_py() for x in b.column(0)), (x.as_py() for x in b.column(1)), strict=True):
                s = shingles(t).astype("<u4")
                for q in want:
                    rows.append(q)
                    parts.append(s[q["s"] : q["e"] + 1].tobytes())
                    if len(rows) >= 512:
                        yield emit(rows, parts)
                        rows, parts = [], []
            yield emit(rows, parts)

    return docs.join(listed, "n").select("text", "want").mapInArrow(run, "id long, n long, m long, xs int, side int, part binary")


def _verified(parts: DataFrame, least: int, similarity: float) -> DataFrame:
    """(n, m, s, e): verified word ranges [s, e) of document n. The two sides of a candidate meet as neighbours in a sorted partition."""

    def run(batches):
        left, keys, xs, ys, size = None, [], [], [], 0
        for b in batches:
            for *key, side, part in zip(*(b.column(k).to_pylist() for k in range(5)), (v.as_py() for v in b.column(5)), strict=True):
                if side == 0:
                    left = (key, part)
                elif left and left[0] == key:
                    keys.append(key)
                    xs.append(np.frombuffer(left[1], "<u4"))
                    ys.append(np.frombuffer(part, "<u4"))
                    size += len(xs[-1]) + len(ys[-1])
                    if size > PIECE:
                        yield emit(keys, xs, ys)
                        keys, xs, ys, size = [], [], [], 0
        if keys:
            yield emit(keys, xs, ys)

    def emit(keys, xs, ys):
        pair, start, end = matched_all(xs, ys, least, similarity)
        _, n, m, at = (np.array(v, np.int64)[pair] for v in zip(*keys, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(n), pa.array(m), pa.array((at + start).astype(np.int32)), pa.array((at + end + WORDS - 1).astype(np.int32))], names=["n", "m", "s", "e"])

    return parts.repartition("id").sortWithinPartitions("id", "n", "m", "xs", "side").mapInArrow(run, "n long, m long, s int, e int")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, hashes: int = HASHES, enough: int = ENOUGH) -> DataFrame:
    """Per document: (doc_id, n_words, n_dup_words, n_spans, spans, sources).

    ``spans`` are the maximal runs (start, end) of words that near-duplicate passages of earlier documents, or of the same one
    further up, cover; ``sources`` the ids of such documents: the first one with a wording, and of different wordings so many that no other one covers more. A passage
    has ``least_words`` words at least and shares so many of its five-word shingles that sets of its size reach ``similarity``. Verbatim repeats
    are all found, whatever variants of them there are; near repeats if some function has one min-hash in both and their sketches agree. Null and shorter texts have no spans. Rows with the same id stand in the order of their texts; rows without
    an id come first; an empty table gives an empty result; other columns are ignored.
    """
    least = least_words - WORDS + 1
    if least < 1 or not 1 <= hashes <= len(_SEEDS) or not 1 <= enough <= SKETCH:
        raise ValueError("passages need five words; hashes and enough lie within the functions there are")
    rows, bits = _numbered(docs, id_col, text_col)
    found = candidates(rows, least, hashes, enough, similarity)
    _release(docs.sparkSession)
    hit = stored(_verified(_passages(rows, found), least, similarity))
    _release(docs.sparkSession)
    end = F.max("e").over(W.partitionBy("n").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1))
    runs = hit.select("n", "s", "e").distinct().withColumn("new", (F.col("s") > F.coalesce(end, F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(W.partitionBy("n").orderBy("s", "e").rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("n", "run").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    spans = runs.groupBy("n").agg(F.sum(F.col("end") - F.col("start")).alias("dup"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    names = rows.select(F.col("n").alias("m"), F.col("id").alias("source"))
    sources = hit.select("n", "m").distinct().join(names, "m").groupBy("n").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    words = F.size(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).cast("long")
    out = rows.select("n", "id", words.alias("n_words")).join(spans.join(sources, "n", "left"), "n", "left")
    return out.select(F.col("id").alias("doc_id"), "n_words", F.coalesce("dup", F.lit(0)).cast("long").alias("n_dup_words"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.coalesce("sources", F.array().cast("array<long>")).alias("sources"))


def op10_compact_windows(spark, sf_dir):
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
