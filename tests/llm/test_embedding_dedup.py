import numpy as np
import pytest

from cairngrid.llm import embedding_dedup as ed


def brute(rows, threshold):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, root = [0] * len(ok), list(range(len(ok)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for p, (_, x) in enumerate(ok):
        for q, (_, y) in enumerate(ok):
            if p != q and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                n[p] += 1
                root[max(find(p), find(q))] = min(find(p), find(q))
    low = {}
    for p, (i, _) in enumerate(ok):
        low[find(p)] = min(low.get(find(p), i), i)
    out = [(i, n[p], low[find(p)]) for p, (i, _) in enumerate(ok)]
    return sorted(out + [(i, 0, i) for i, v in rows if i is None or not any(v is w for _, w in [(0, v)]) or not any(i == j for j, _ in ok)], key=str)


def run(spark, rows, **k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted([(r.id, r.n_links, r.component_id) for r in ed.embedding_dedup(df, **k).collect()], key=str)


@pytest.mark.parametrize("tile", [7, 4096])
def test_against_brute_force(spark, tile):
    rnd = np.random.default_rng(1)
    rows, at = [], 0
    for _ in range(12):
        c = rnd.normal(size=16)
        for _ in range(8):
            rows.append((at, (c + rnd.normal(size=16) * rnd.choice([0, 0.1, 0.35, 0.6])).astype(np.float32).tolist()))
            at += 1
    assert run(spark, rows, tile_rows=tile) == brute(rows, 0.9)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, [2.0, 4.0, 6.0]), (3, v), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 1.0]), (8, [1.0, float("nan"), 1.0]), (9, [float("inf"), 1.0, 1.0]), (10, [1.0, 2.0]), (11, [-1.0, -2.0, -3.0])]
    got = {i: (n, c) for i, n, c in run(spark, rows)}
    assert got[1] == got[2] == got[3] == (2, 1)
    assert all(got[i] == (0, i) for i in range(4, 12))


def test_empty(spark):
    assert run(spark, []) == []


def test_bound_prunes_nothing_that_links():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(60, 32)) * np.linspace(2, 0.1, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = ed.linked(x, x, 0.6)
    p, q = np.nonzero(x @ x.T >= 0.6 - ed.SLACK)
    assert sorted(zip(i, j, strict=True)) == sorted(zip(p, q, strict=True))


def test_linked_vectors_share_a_cell():
    rnd = np.random.default_rng(4)
    for axes in (1, 2, 4):
        y = rnd.uniform(-1, 1, (300, axes))
        own, near = ed.cells_of(y, 0.3)
        for i in range(300):
            for j in range(i):
                if ((y[i] - y[j]) ** 2).sum() <= 0.09:
                    assert own[i] == own[j] or own[i] in near[j] or own[j] in near[i]


@pytest.mark.parametrize("threshold", [0.5, 0.999])
def test_other_thresholds_and_hot_vectors(spark, monkeypatch, threshold):
    from cairngrid.llm import common

    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(6, 8))
    rows = [(k, (base[k % 6] + rnd.normal(size=8) * (0.02 if k % 2 else 0.4)).astype(np.float32).tolist()) for k in range(80)] + [(100 + k, [1.0] * 8) for k in range(60)]
    want = brute(rows, threshold)
    assert run(spark, rows, threshold=threshold, tile_rows=9) == want
    monkeypatch.setattr(common.join_named, "__defaults__", (10,))
    assert run(spark, rows, threshold=threshold) == want


def test_different_vectors_of_one_id(spark):
    """Rows that share an id are vectors of their own: one's links are not the other's."""
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.0, 0.0, 1.0]), (3, [0.0, 0.0, 1.0]), (3, [0.0, 1.0, 0.1])]
    assert run(spark, rows) == brute(rows, 0.9)
    assert sorted(n for i, n, _ in run(spark, rows) if i == 1) == [1, 1]
