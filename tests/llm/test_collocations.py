import random
import re
from collections import Counter, defaultdict

import pytest

from cairngrid.llm import collocations

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, longest, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang, tuple(w[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inner = defaultdict(int)
    for (lang, w), a in cand.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    inner[lang, w[i:j]] = max(inner[lang, w[i:j]], a)
    out = defaultdict(list)
    for (lang, w), a in cand.items():
        if inner[lang, w] >= a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    return sorted((lang, r, p.decode(), -a, left, right, total, -s) for lang, v in out.items() for r, (s, a, p, left, right, total) in enumerate(sorted(v)[:top], 1))


def run(spark, rows, **more):
    df = spark.createDataFrame([(t, g, 1) for t, g in rows], "text string, lang string, phrase long")
    return sorted(tuple(r) for r in collocations.collocations(df, **more).drop("cut").collect())


@pytest.mark.parametrize(("bits", "part"), [(1 << 20, 1 << 20), (64, 300)])
def test_against_brute_force(spark, monkeypatch, bits, part):
    """Also with a bitmap in which everything seems frequent, and in shares of a few hundred bytes."""
    monkeypatch.setattr(collocations, "PART", part)
    r = random.Random(bits)
    words = ["the", "of", "Cat", "sat", "mat", "dog", "äöü", "Été", "x", "y", "z"]
    idioms = ["kick the bucket now then", "red tape", "once upon a time"]
    text = lambda: "".join(r.choice([*words, *words, *idioms, "rare" + str(r.random())]) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "! ", "\x0b"]) for _ in range(r.randint(0, 60)))
    rows = [(text(), r.choice(["en", "en", "de", None, ""])) for _ in range(150)]
    rows += [("same piece here and there. ", "en")] * 40 + [(None, "en"), ("", None), ("...", "de"), ("the the the the the the the", "en")]
    for least, top in ((5, 1000), (12, 7)):
        assert run(spark, rows, least=least, top=top, bits=bits) == brute(rows, least, 5, top)


def test_empty_and_rare(spark):
    assert run(spark, []) == [] and run(spark, [("a b", "en")] * 99) == [] and len(run(spark, [("a b", "en")] * 100)) == 1


def test_long_piece_and_shorter_phrases(spark):
    rows = [("alpha beta gamma " * 50_000, "en"), ("alpha beta", None)]
    for longest in (2, 3):
        assert run(spark, rows, max_words=longest) == brute(rows, 100, longest, 2000)


def test_exact_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", "a b", ["a", "b"], 4_000_000_000_000, 9_000_000_000_000_001)], "lang string, phrase string, words array<string>, a long, n long")
    counts = spark.createDataFrame([("en", "a", 4_000_000_000_007), ("en", "b", 5_000_000_000_003)], "lang string, phrase string, n long")
    got = collocations._lowest_cuts(found, counts, 5).first()
    assert got.score == 1000 * 4_000_000_000_000 * 9_000_000_000_000_001 // (4_000_000_000_007 * 5_000_000_000_003) and got.k == 1
