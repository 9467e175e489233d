import random

import numpy as np
import pyarrow as pa
import pytest

from cairngrid.llm import substring_dedup as sd


def words(t):
    return (t or "").encode().lower().split()


def tree(v, least):
    """Brute force: every interval whose neighbours on both sides are smaller, at least ``least`` wide."""
    out, n = [], len(v)
    for c in range(n):
        left = c
        while left > 0 and v[left - 1] > v[c]:
            left -= 1
        right = c
        while right < n - 1 and v[right + 1] >= v[c]:
            right += 1
        if right - left + 1 >= least:
            out.append((left, c, right))
    return sorted(out)


@pytest.mark.parametrize("least", [1, 3, 10])
def test_compact_windows_are_the_wide_nodes(least):
    rnd = np.random.default_rng(4)
    v = rnd.integers(0, 60, 200).astype(np.uint64)
    got = sorted(zip(*(x.tolist() for x in sd.compact_windows(v, np.array([0]), np.array([200]), least)), strict=True))
    assert got == tree(v.tolist(), least)
    cut = sd.compact_windows(v, np.array([0, 90]), np.array([90, 200]), least)
    want = tree(v[:90].tolist(), least) + [(a + 90, b + 90, c + 90) for a, b, c in tree(v[90:].tolist(), least)]
    assert sorted(zip(*(x.tolist() for x in cut), strict=True)) == sorted(want)


def brute(docs, least_words=50):
    """Words covered by passages whose shingles an earlier passage of the same length repeats verbatim."""
    seen, out = set(), {}
    for i, t in docs:
        w, gone = words(t), set()
        for s in range(len(w) - least_words + 1):
            k = tuple(w[s : s + least_words])
            if k in seen:
                gone.update(range(s, s + least_words))
            seen.add(k)
        out[i] = gone
    return out


def run(spark, rows, **k):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, n int").repartition(3)
    return {r.doc_id: r for r in sd.substring_dedup(df, **k).collect()}


def fresh(rnd, n):
    return " ".join("w%d" % rnd.randrange(10**6) for _ in range(n))


@pytest.mark.parametrize("wanted", [500, 3])
def test_verbatim_passages_and_near_ones(spark, monkeypatch, wanted):
    monkeypatch.setattr(sd, "LIST", wanted)
    rnd = random.Random(7)
    passages = [fresh(rnd, n) for n in (55, 60, 120, 400)]
    docs = []
    for i in range(40):
        docs.append((i, " ".join([fresh(rnd, rnd.randint(0, 90)), rnd.choice(passages), fresh(rnd, rnd.randint(0, 90)), rnd.choice([fresh(rnd, 30), rnd.choice(passages)])])))
    docs.append((40, docs[0][1]))
    near = passages[2].split()
    near[60] = "changed"
    docs.append((41, fresh(rnd, 40) + " " + " ".join(near)))
    got, want = run(spark, docs), brute(docs)
    for i, _ in docs[:41]:
        covered = {k for s in got[i].spans for k in range(s.start, s.end)}
        assert want[i] <= covered
        assert len(covered - want[i]) <= 5 * max(1, got[i].n_spans), i  # a changed shingle between two passages
    assert got[41].n_dup_words >= 110 and got[40].n_dup_words == len(words(docs[40][1]))
    assert all(not r.sources or max(r.sources) <= r.doc_id for r in got.values())


def test_clean_documents_stay(spark):
    rnd = random.Random(8)
    got = run(spark, [(i, fresh(rnd, rnd.randint(0, 300))) for i in range(40)])
    assert all(r.n_dup_words == 0 and list(r.spans) == [] for r in got.values())


def test_long_documents_are_cut(spark, monkeypatch):
    rnd = random.Random(9)
    text = fresh(rnd, 1500)
    assert len(sd.shingles(text)) == 1496
    monkeypatch.setattr(sd, "PIECE", 300)
    got = run(spark, [(1, text), (2, fresh(rnd, 20) + " " + text)])
    assert got[2].n_dup_words >= 1500


def test_defined_cases(spark):
    rnd = random.Random(10)
    t = fresh(rnd, 80)
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (7, None), (8, ""), (9, "a b")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_dup_words) for r in sd.substring_dedup(df).collect())
    assert got == [(0, 80, 0), (5, 80, 80), (5, 80, 80), (7, 0, 0), (8, 0, 0), (9, 2, 0)]
    assert sd.substring_dedup(df.limit(0)).count() == 0


def test_verbatim_repeats_among_variants(spark):
    rnd = random.Random(11)
    template, variants = fresh(rnd, 60).split(), []
    for v in range(10):
        w = list(template)
        for k in (12, 30, 47):
            w[k] = f"v{v}k{k}"
        variants.append(" ".join(w))
    docs = [(i, " ".join([fresh(rnd, rnd.randint(5, 60)), variants[i % 10], fresh(rnd, rnd.randint(5, 60))])) for i in range(200)]
    got, want = run(spark, docs), brute(docs)
    lost = [i for i, _ in docs if not want[i] <= {k for s in got[i].spans for k in range(s.start, s.end)}]
    assert sum(map(bool, want.values())) == 190 and lost == []


@pytest.mark.parametrize("least", [1, 2, 7, 46])
def test_run_names_tell_runs_apart(least):
    s = np.random.default_rng(5).integers(0, 2, 300).astype(np.uint64)
    names = sd.run_names(s, least).tolist()
    runs = [tuple(s[k : k + least].tolist()) for k in range(len(s) - least + 1)]
    assert len(names) == len(runs) and len(set(zip(names, runs))) == len(set(names)) == len(set(runs))


def jaccard_edit(rnd, words, share):
    """``words`` with words replaced until about ``share`` of the union of shingles is common."""
    w, a = list(words), {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    places = list(range(len(w)))
    rnd.shuffle(places)
    for k in places:
        old, w[k] = w[k], "e%d" % rnd.randrange(10**6)
        b = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        if len(a & b) / len(a | b) < share:
            w[k] = old
    return w


@pytest.mark.parametrize("share", [0.8, 0.85, 0.9, 0.95])
def test_recall_of_near_passages(spark, share):
    """Planted near copies of similarity ``share`` among variants of the same passages: at least 0.9 of the words that any earlier variant's verification would mark are marked."""
    rnd = random.Random(int(100 * share))
    passages = [fresh(rnd, rnd.randint(50, 110)).split() for _ in range(25)]
    docs = [(i, " ".join([fresh(rnd, rnd.randint(5, 60)), *jaccard_edit(rnd, passages[i % 25], share), fresh(rnd, rnd.randint(5, 60))])) for i in range(150)]
    docs += [(1000 + k, " ".join([fresh(rnd, 20), *p])) for k, p in enumerate(passages)]
    got = run(spark, docs)
    least, total, marked = sd.LEAST_WORDS - sd.WORDS + 1, 0, 0
    shingled = [(i, sd.shingles(t)) for i, t in docs]
    for k, (i, x) in enumerate(shingled):
        want = {w for j, y in shingled[:k] if (i - j) % 25 == 0 or i >= 1000 for s, e in sd.matched(x, y, least, sd.SIMILARITY) for w in range(s, e + sd.WORDS - 1)}
        total += len(want)
        marked += len(want & {w for s in got[i].spans for w in range(s.start, s.end)})
    assert total > 1000 and marked >= 0.9 * total, (share, marked / total)
    print("recall", share, round(marked / total, 4))


def test_a_common_line_links_nothing_and_hot_tiles_lose_nothing(spark, monkeypatch):
    """Hundreds of variants under one min-hash, in bands and tiles of a few."""
    rnd = random.Random(12)
    line, template = fresh(rnd, 14), fresh(rnd, 70).split()
    docs = [(i, " ".join([fresh(rnd, 60), line, fresh(rnd, 60)])) for i in range(120)]
    docs += [(1000 + i, " ".join([fresh(rnd, 20), *jaccard_edit(rnd, template, 0.9), fresh(rnd, 20)])) for i in range(120)]
    whole = run(spark, docs)
    monkeypatch.setattr(sd, "TILE", 8)
    monkeypatch.setattr(sd, "MANY", 4)
    tiled = run(spark, docs)
    assert all(whole[i].n_dup_words == tiled[i].n_dup_words == 0 for i in range(120))
    assert sum(whole[1000 + i].n_dup_words > 45 for i in range(120)) >= 110 and sum(tiled[1000 + i].n_dup_words > 45 for i in range(120)) >= 110


def test_sketches_are_minima_over_the_parts():
    rnd = np.random.default_rng(9)
    s = rnd.integers(0, 1 << 63, 300).astype(np.uint64)
    left, c, right = np.array([0, 10, 50, 200]), np.array([0, 40, 90, 299]), np.array([60, 41, 299, 299])
    got = sd.sketches(s, left, c, right, 46).reshape(4, 3, sd.SKETCH)
    for g in range(sd.SKETCH):
        v = (sd._mix(s ^ sd._SEEDS[g] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)
        for k in range(4):
            spans = [(max(left[k], c[k] - 45), c[k]), (max(left[k], c[k] - 22), min(right[k], c[k] + 22)), (c[k], min(right[k], c[k] + 45))]
            assert got[k, :, g].tolist() == [int(v[a : b + 1].min()) & 255 for a, b in spans]


def test_agreement_counts_equal_bytes():
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(0, 3, (50, 8)).astype(np.uint8), rnd.integers(0, 3, (50, 8)).astype(np.uint8)
    assert sd._agreement(a.view(np.uint64)[:, 0], b.view(np.uint64)[:, 0]).tolist() == (a == b).sum(axis=1).tolist()


def test_best_partners_against_brute_force():
    rnd = np.random.default_rng(8)
    sketch = rnd.integers(0, 4, (120, 24)).astype(np.uint8)
    size = np.array([1, 2, 32, 40, 45])
    start = np.cumsum(size) - size
    x, y = sd._agreeing(sketch.view(np.uint64), start, size, 4)
    got, parts = set(zip(x.tolist(), y.tolist(), strict=True)), sketch.reshape(120, 3, 8)
    want = set()
    for s, k in zip(start.tolist(), size.tolist(), strict=True):
        for i in range(s, s + k):
            same = [(parts[i] == parts[j]).sum(axis=1) for j in range(s, i)]
            if k <= sd.MANY:
                want |= {(i, s + j) for j, v in enumerate(same) if (v >= 4).any()}
            else:
                for p in range(3):
                    if same and max(v[p] for v in same) >= 4:
                        want.add((i, s + max(range(len(same)), key=lambda j: (same[j][p], -j))))
    assert got == want


@pytest.mark.parametrize("tile", [512, 8])
def test_partners_do_not_depend_on_how_many_classes_there_are(monkeypatch, tile):
    """More classes of a min-hash that come later, and the size from which they are looked up, change no earlier pair."""
    monkeypatch.setattr(sd, "TILE", tile)
    sketch = np.random.default_rng(6).integers(0, 3, (700, 24)).astype(np.uint8).view(np.uint64)
    pairs = lambda k: set(zip(*(v.tolist() for v in sd._agreeing(sketch, np.array([0]), np.array([k]), 3)), strict=True))
    few, many, most = pairs(30), pairs(45), pairs(700)
    assert few and few == {p for p in many if p[0] < 30} == {p for p in most if p[0] < 30}
    parts = sketch.view(np.uint8).reshape(700, 3, 8)
    want = set()
    for i in range(1, 700):
        same = (parts[:i] == parts[i]).sum(axis=2)
        want |= {(i, int(j)) for p, j in enumerate(same.argmax(axis=0)) if same[j, p] >= 3}
    assert most == want


def test_many_pairs_are_matched_as_single_ones():
    rnd = np.random.default_rng(2)
    xs = [rnd.integers(0, 25, n).astype("<u4") for n in (0, 5, 30, 41, 8, 60)]
    ys = [rnd.integers(0, 25, n).astype("<u4") for n in (9, 30, 25, 0, 30, 33)]
    want = []
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        hit, cover = [v in set(y.tolist()) for v in x.tolist()], set()
        for s in range(len(x) - 4):
            if sum(hit[s : s + 5]) >= 4:  # 8 / 9 of 5 would be 5, 2 / 3 x 5 is 4
                cover |= set(range(s, s + 5))
        at = 0
        while at < len(x):
            end = at
            while end in cover:
                end += 1
            if end > at:
                own = [i for i in range(at, end) if hit[i]]
                want.append((k, own[0], own[-1] + 1))
            at = end + 1
    assert want and sorted(zip(*(v.tolist() for v in sd.matched_all(xs, ys, 5, 0.5)), strict=True)) == want


@pytest.mark.parametrize("few, chunk, blocks", [(2, 2048, 1), (2, 16, 1), (2, 16, 2), (100, 2048, 1)])
def test_no_agreeing_class_is_left_out(monkeypatch, few, chunk, blocks):
    """The partners passed on cover all that any earlier class that agrees covers; the best one of each part does not."""
    monkeypatch.setattr(sd, "FEW", few)
    monkeypatch.setattr(sd, "CHUNK", chunk)
    rnd, least, enough, similarity, rows = np.random.default_rng(7), 5, 3, 0.6, []
    for key, size in enumerate((2, 3, 9, 30, 70)):
        template = rnd.integers(0, 1 << 30, 9).astype(np.uint32)
        for _ in range(size):
            v, (left, right) = template.copy(), rnd.integers(0, 5, 2)
            if rnd.random() < 0.7:
                left, right = 4, 4
            edits = rnd.choice([0, 1, 2, 3, 5, 6, 7, 8], 3, replace=False)
            v[edits] = rnd.integers(0, 6, 3)
            n = len(rows)
            rows.append({"key": key, "f": 0, "n": n, "c": 50, "l": 50 - int(left), "r": 50 + int(right), "classes": size, "sketch": rnd.integers(0, 3, 24).astype(np.uint8).tobytes(), "reach": v[4 - left : 5 + right].tobytes() if size > few else None, "v": v[4 - left : 5 + right]})
    table = [r | {"block": b, "own": r["n"] % k == b} for r in rows for k in [blocks if r["classes"] > few else 1] for b in range(k)]
    table.sort(key=lambda r: (r["key"], r["block"], -r["n"]))
    names = ["key", "f", "n", "c", "l", "r", "classes", "sketch", "reach", "block", "own"]
    batches = pa.table({k: [r[k] for r in table] for k in names}).to_batches(7)
    got = {(a, b) for out in sd._partners(least, 4, enough)(iter(batches)) for a, b in zip(out.column("n").to_pylist(), out.column("m").to_pylist(), strict=True)}

    def cover(x, y):
        el, er = min(50 - x["l"], 50 - y["l"]), min(x["r"] - 50, y["r"] - 50)
        part = lambda q: q["v"][50 - q["l"] - el : 50 - q["l"] + er + 1]
        return {s + 50 - el for a, e in sd.matched(part(x), part(y), least, similarity) for s in range(a, e)} if el + er + 1 >= least else set()

    words = [np.frombuffer(r["sketch"], np.uint8).reshape(3, 8) for r in rows]
    agree = {(x["n"], y["n"]) for x in rows for y in rows if x["key"] == y["key"] and x["n"] > y["n"] and ((words[x["n"]] == words[y["n"]]).sum(axis=1) >= enough).any()}
    start = np.array([0, 2, 5, 14, 44])
    best = set(zip(*(v.tolist() for v in sd._agreeing(np.stack(words).reshape(len(rows), 24).view(np.uint64), start, np.array([2, 3, 9, 30, 70]), enough)), strict=True))
    union = lambda pairs: {r["n"]: set().union(*[cover(r, rows[m]) for n, m in pairs if n == r["n"]]) for r in rows}
    assert got <= agree and best < agree
    assert union(got) == union(agree) != union(best)
