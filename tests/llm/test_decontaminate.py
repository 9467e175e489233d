import re

import pytest
from pyspark.sql import functions as F

from cairngrid.llm import decontaminate as dc

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))


def brute(docs, items, window=10):
    win = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            win.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for size in {len(x) for x in win}:
            for k in range(len(w) - size + 1):
                got = win.get(tuple(w[k : k + size]))
                if got is not None:
                    hit.update(range(k, k + size))
                    ids.update(x for x in got if x is not None)
        out.append((d, len(w), len(hit), sorted(map(str, ids)), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **k):
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, pos int, term string")
    it = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, n int")
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in dc.decontaminate(df, it, **k).collect()], key=str)


ITEM = "The quick, brown fox jumps over the lazy dog while the cat sleeps near THE old red barn."
DOCS = [
    (1, "So " + ITEM.upper() + " End."),
    (2, "quick brown fox jumps over the lazy dog while the"),
    (3, "quick brown fox jumps over the lazy dog while a cat"),
    (4, None),
    (5, ""),
    (6, " ... "),
    (7, ITEM + " x " + ITEM),
    (7, ITEM + " x " + ITEM),
    (8, "the the the the the the the the the the the the"),
    (None, "Né à là tiny item"),
    (9, "word " * 3000 + ITEM + " word" * 3000),
]
ITEMS = [(10, ITEM), (11, "tiny item"), (2, "the " * 11), (12, None), (13, "--"), (14, "never seen in any of these documents at all my friend"), (10, ITEM), (15, "né à là"), (None, "red barn")]


@pytest.mark.parametrize("block", [200_000, 7])
def test_against_brute_force(spark, block):
    assert run(spark, DOCS, ITEMS, block_windows=block) == brute(DOCS, ITEMS)


def test_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs, items)
    got = dc.decontaminate(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got.collect()], key=str) == want
    assert any(r[4] for r in want)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, DOCS[:2], []) == brute(DOCS[:2], [])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta x x gamma"), (2, "alpha x x x x x x x x gamma"), (3, "gamma alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha gamma")], "item_id long, text string")
    win = dc.item_windows(items, "item_id", "text", 10)
    anchored = dc.rarest_terms(win, dc.term_counts(docs, win, "doc_id", "text"))
    index = dc.build_index(docs, anchored, "doc_id", "text")
    near = dc.proximity_matches(index, anchored, slop=3).join(index.where("head").select("row", "doc_id"), "row")
    assert sorted((r.doc_id, r.first_pos, r.second_pos) for r in near.collect()) == [(1, 0, 4), (3, 1, 0)]
    assert dc.phrase_matches(index, anchored).count() == 0


def test_no_python_in_the_plan(spark):
    sf = "/root/testdata/sf0.001"
    plan = dc.op3_inverted_index(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_near(docs, items, slop, window=10):
    """Items of which the two rarest occurring words of some window stand near their places."""
    texts = [words(t) for _, t in docs]
    n = {}
    for w in texts:
        for x in w:
            n[x] = n.get(x, 0) + 1
    out = [set() for _ in docs]
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            best = sorted((n[x], p, x) for p, x in enumerate(w[k : k + window]) if x in n)[:2]
            for d, text in enumerate(texts):
                at = [[q - p for q, x in enumerate(text) if x == y] for _, p, y in best]
                if len(best) == 2 and any(abs(a - b) <= slop and a + best[0][1] != b + best[1][1] for a in at[0] for b in at[1]):
                    out[d].add(i)
    return out


@pytest.mark.parametrize("block", [200_000, 7])
def test_near_items_against_brute_force(spark, block):
    docs = [*DOCS[:9], (20, ITEM.replace("lazy", "unheard")), (21, "fox far from any jumps over here " * 3), (22, "item then tiny")]
    items = [(10, ITEM), (11, "tiny item"), (12, None), (14, "never seen in any of these documents at all my friend"), (16, "one whole new unheard-of passage: over the lazy")]
    want = brute_near(docs, items, dc.SLOP)
    exact = brute(docs, items)
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: set(r.near_ids) for r in dc.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), block_windows=block).collect()}
    assert got == {k: {str(i) for i in w} for k, w in enumerate(want)}
    assert "10" in got[9] and sum(r[4] for r in exact) < sum(map(bool, got.values()))
