import hashlib
import random

import numpy as np
import pytest

from cairngrid.llm import suffix_dedup as sd


def brute(rows, length):
    """rows: (id, text) in order."""
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df, length=100):
    return sorted((tuple(r)[:5] for r in sd.suffix_dedup(df, length=length).collect()), key=str)


def pool(seed):
    rnd = random.Random(seed)
    lines = ["".join(rnd.choice("abcdefgh é\n") for _ in range(rnd.randint(20, 300))) for _ in range(12)]
    docs = []
    for _ in range(60):
        docs.append("".join(rnd.choice([rnd.choice(lines), "".join(rnd.choice("xyz ") for _ in range(rnd.randint(1, 90)))]) for _ in range(rnd.randint(0, 8))))
    return docs + ["a" * 700, "ab" * 300, "a" * 99, "a" * 100, "", docs[3], docs[3] + "!"]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = list(enumerate(pool(seed)))
    df = spark.createDataFrame([(i, t, "q", 5) for i, t in docs], "doc_id long, text string, name string, len int").repartition(5)
    assert rows_of(df) == sorted(brute(docs, 100), key=str)


def test_pieces_cut_long_documents(spark, monkeypatch):
    docs = list(enumerate(pool(3)))
    docs.append((len(docs), "".join(t for _, t in docs) * 2))
    monkeypatch.setattr(sd, "PIECE", 256)
    lo = []
    for raw, ends, number, offset, first in sd._pieces([n for n, _ in docs], [t for _, t in docs], 100):
        sd._TABLES.clear()
        lo.append(len(sd.units(raw, ends, 100)[0]))
        assert len(raw) <= 256 + 99 and len(number) == len(offset) == len(first)
    sd._TABLES.clear()
    assert sum(lo) > 0


def test_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute(sorted((r.doc_id, r.text) for r in df.collect()), 100)
    assert rows_of(df) == sorted(want, key=str) and any(r[2] for r in want)


def test_defined_cases(spark):
    t = "some text that is long enough to be found again " * 4
    rows = [(5, t), (5, t), (-3, t + "x"), (None, "y" + t), (7, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [(None, "y" + t), (-3, t + "x"), (5, t), (5, t), (7, ""), (7, "")]
    assert rows_of(df) == sorted(brute(order, 100), key=str)
    assert rows_of(df.limit(0)) == []


@pytest.mark.parametrize("v", [3, 7, 13, 31, 57, 20])
def test_every_difference_is_covered(v):
    d = sd.difference_cover(v)
    assert {(a - b) % v for a in d for b in d} == set(range(v))
    assert v == 20 or len(d) * (len(d) - 1) + 1 == v


def test_any_two_windows_share_a_sampled_shift():
    length, v = 100, sd.cover_modulus(100)
    d = set(sd.difference_cover(v))
    for i in range(v):
        for j in range(v):
            assert any((i + s) % v in d and (j + s) % v in d for s in range(v))
    part, at = sd._sampled(np.array([99, 100, 400]), np.array([0, 5, 1 << 20]), length)
    want = [(k, b) for k, (n, s) in enumerate([(99, 0), (100, 5), (400, 1 << 20)]) if n >= length for b in range(n - (length - v + 1) + 1) if (b + s) % v in d]
    assert list(zip(part.tolist(), at.tolist(), strict=True)) == want


def test_packed_numbers_come_back():
    for x in ([], [0], [3, 4, 70_000], [5, 6, 65_000], [0, 1 << 31]):
        assert sd._unpacked(sd._packed(np.array(x, np.int64))).tolist() == x


def test_only_repeated_tuples_are_marked(spark):
    """Many buckets and pieces: the marks are those of a plain count, but for collisions of the bits that are sent."""
    rnd = random.Random(4)
    line = "".join(rnd.choice("abcdef ") for _ in range(70))
    docs = [(k, "".join(rnd.choice("ghijkl ") for _ in range(rnd.randint(0, 150))) + (line if k % 3 == 0 else "") + "".join(rnd.choice("mnop ") for _ in range(120))) for k in range(90)]
    df = spark.createDataFrame(docs, "n long, text string").repartition(9)
    v, width = sd.cover_modulus(100), 100 - sd.cover_modulus(100) + 1
    d, seen = set(sd.difference_cover(v)), {}
    for n, t in docs:
        for p in range(len(t) - width + 1) if len(t) >= 100 else ():
            if p % v in d:
                seen.setdefault(t[p : p + width], []).append((n, p))
    want = {x for at in seen.values() if len(at) > 1 for x in at}
    got = {(r.n, int(p)) for r in sd.candidate_marks(df, 10, 100).collect() for m in r.marks for p in sd._unpacked(m)}
    assert want and got == want
