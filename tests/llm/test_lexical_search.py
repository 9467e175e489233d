import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from cairngrid.llm import arrow_text, lexical_search

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS, ITEMS = "doc_id long, text string, terms string", "item_id long, text string, rank long"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, k):
    tf = [(i, Counter(words(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in tf]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for _, c in tf for w in c)
    out = []
    for item, text in items:
        found = []
        for (i, c), n in zip(tf, sizes, strict=True):
            m = 75 + (25 * n * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in words(text) if c[w])
            if s > 0:
                found.append((s, i))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r, i, s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, k=20, **more):
    index = lexical_search.build_index(spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS))
    got = lexical_search.search(index, spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS), k=k, **more).collect()
    return sorted([tuple(r) for r in got], key=repr)


def test_against_brute_force_with_ties_small_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD", 400)
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["Straße", "ÉTÉ", "x1"]
    text = lambda n: " ,.".join(r.choices(vocabulary, k=r.randint(0, n)))
    docs = [(i, text(40)) for i in r.sample(range(-500, 500), 120)]
    docs += [(i + 1000, docs[0][1]) for i in range(30)] + [(2000, None), (2001, ""), (2002, "...")]
    items = [(i, text(12)) for i in range(12)] + [(50, "w1 w1 W1 unseen"), (50, "w2"), (None, "w3"), (60, None), (61, "unseen"), (62, docs[0][1])]
    for k in (1, 7, 20):
        assert run(spark, docs, items, k, block_terms=40) == brute(docs, items, k)


def test_missing_and_equal_ids_and_empty_tables(spark):
    docs = [(None, "a b"), (3, "a b"), (3, "a b"), (None, "a b"), (1, "b c"), (9, "d")]
    assert run(spark, docs, [(1, "a"), (2, "d b")], 3) == brute(docs, [(1, "a"), (2, "d b")], 3)
    assert run(spark, [], [(1, "a")]) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], [(1, "a")]) == []


def test_long_document_is_one_shard(spark):
    docs = [(1, "needle " + "straw " * 300_000), (2, "needle"), (3, "straw")]
    assert run(spark, docs, [(7, "needle straw")]) == brute(docs, [(7, "needle straw")], 20)


def test_best_is_tie_safe():
    r = np.random.default_rng(1)
    for _ in range(200):
        s = r.integers(-1, 6, r.integers(0, 40))
        k = int(r.integers(1, 12))
        want = sorted((p for p in range(len(s)) if s[p] > 0), key=lambda p: (-s[p], p))[:k]
        assert sorted(lexical_search.best(s, k).tolist()) == sorted(want)


def test_parts_keep_all_rows_in_order():
    r = random.Random(3)
    rows = ["x" * r.randint(0, 30) if r.random() > 0.1 else None for _ in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[a : a + n], pa.string())], names=["t"]) for a, n in ((0, 100), (100, 1), (101, 199))]
    batches = [batches[0].slice(0, 40), batches[0].slice(40), *batches[1:]]
    for size in (1, 17, 50, 10_000):
        got = list(arrow_text.parts(batches, 0, size))
        assert [x for b in got for x in b.column(0).to_pylist()] == rows
        assert all(b.num_rows == 1 or sum(len(x or "") for x in b.column(0).to_pylist()) <= size for b in got)


def test_a_shard_is_a_row_group(spark, monkeypatch):
    """Parquet's writer and reader hold a row group at once: shards of megabytes must not share one."""
    monkeypatch.setattr(lexical_search, "SHARD", 400)
    index = lexical_search.build_index(spark.createDataFrame([(i, "some words " * 20, "x") for i in range(30)], DOCS).coalesce(1))
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.shards.inputFiles()]
    rows = [m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)]
    assert len(rows) == index.shards.count() > 10 and set(rows) == {1}
