"""Joined lines and shortest paths over many tasks, held against walks in one place."""

import heapq
import math
import random

import pytest

from cairngrid.operators import chains, trails


def walk(lines, tolerance=1.0):
    """Greedy growth in line order, at the end first and then at the start: {smallest line: points}."""
    spot = lambda p: (math.floor(p[0] / tolerance + 0.5), math.floor(p[1] / tolerance + 0.5))
    degree, used, out = {}, set(), {}
    for ln in lines.values():
        for p in (ln[0], ln[-1]):
            degree[spot(p)] = degree.get(spot(p), 0) + 1
    for i in sorted(lines):
        if i in used:
            continue
        used.add(i)
        cur = list(lines[i])
        for at_end in (True, False):
            while True:
                tip = spot(cur[-1] if at_end else cur[0])
                j = next((j for j in sorted(lines) if j not in used and tip in (spot(lines[j][0]), spot(lines[j][-1]))), None) if degree[tip] == 2 else None
                if j is None:
                    break
                used.add(j)
                new = lines[j] if spot(lines[j][0]) == tip else lines[j][::-1]
                cur = cur + new[1:] if at_end else new[::-1][:-1] + cur
                if spot(cur[0]) == spot(cur[-1]) and len(cur) > 2:
                    break
        out[i] = cur
    return out


def joined(spark, files):
    rows = [(f, i, s, float(x), float(y)) for f, lines in files.items() for i, ln in lines.items() for s, (x, y) in enumerate(ln)]
    got = {}
    for r in trails.join_lines(spark.createDataFrame(rows, "file string, line_id int, seq int, x double, y double"), "file").orderBy("file", "joined", "seq").collect():
        got.setdefault((r.file, r.joined), []).append((r.x, r.y))
        assert len(got[r.file, r.joined]) - 1 == r.seq
    return got


def test_join_lines_equals_the_walk(spark):
    r, files = random.Random(2), {}
    for f in range(6):
        spots = [(r.randint(0, 9) * 100, r.randint(0, 9) * 100) for _ in range(14)]
        jitter = lambda p: (p[0] + r.uniform(-0.3, 0.3), p[1] + r.uniform(-0.3, 0.3))
        files[str(f)] = {i: [jitter(r.choice(spots)), *[(r.uniform(0, 900), r.uniform(0, 900)) for _ in range(r.randint(0, 3))], jitter(r.choice(spots))] for i in r.sample(range(100), 12)}
    ring = list(range(40))
    r.shuffle(ring)
    files["loop"] = {i: [(k * 10, 0), (k * 10 + 10, 0)][:: r.choice((1, -1))] if k < 39 else [(390, 0), (0, 0)] for k, i in enumerate(ring)}
    files["path"] = {i: [(k * 10, 5), (k * 10 + 4, 9), (k * 10 + 10, 5)][:: r.choice((1, -1))] for k, i in enumerate(ring)}
    want = {(f, i): p for f, lines in files.items() for i, p in walk(lines).items()}
    assert joined(spark, files) == want


def test_chain_order_of_long_chains_and_cycles(spark):
    r = random.Random(4)
    names = r.sample(range(100_000), 3000)
    straight, round_ = names[:2000], names[2000:]
    rows = [(n, straight[k - 1] if k else None, 2) for k, n in enumerate(straight)] + [(n, round_[k - 1], 3) for k, n in enumerate(round_)]
    got = {x.node: (x.head, x.far) for x in chains.chain_order(spark.createDataFrame(rows, "node int, prev int, step int")).collect()}
    at = round_.index(min(round_))
    want = {n: (straight[0], 2 * k) for k, n in enumerate(straight)} | {n: (min(round_), 3 * ((k - at) % len(round_))) for k, n in enumerate(round_)}
    assert got == want


def cheapest(mult, cols, starts, size):
    best, heap = {}, [(0.0, s) for s in starts if mult.get(s) is not None and mult[s] < math.inf]
    for d, s in heap:
        best[s] = d
    heapq.heapify(heap)
    while heap:
        d, i = heapq.heappop(heap)
        if d > best[i]:
            continue
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                k = i + a * cols + b
                if (a or b) and 0 <= i % cols + b < cols and mult.get(k) is not None and 0 <= mult[k] < math.inf:
                    v = d + size * (math.sqrt(2) if a and b else 1.0) * (mult[i] + mult[k]) / 2
                    if v < best.get(k, math.inf):
                        best[k] = v
                        heapq.heappush(heap, (v, k))
    return {k: best.get(k, math.inf) for k in mult}


@pytest.mark.parametrize("tile", [5, 128])
def test_cost_distance_over_tiles_equals_the_queue(spark, tile):
    """A maze whose way back and forth crosses tiles many times, missing cells, several starts and grids."""
    r, cols = random.Random(8), 19
    grids = {}
    for g in range(2):
        n = cols * 13
        mult = {i: r.choice([0.5, 1.0, 2.0, 3.25, None, math.inf, -1.0] if r.random() < 0.3 else [1.0, 1.5]) for i in range(n)}
        for y in range(2, n // cols, 4):
            for x in range(cols):
                if x != (0 if y % 8 == 2 else cols - 1):
                    mult[y * cols + x] = None
        for i in r.sample(range(n), 9):
            mult.pop(i)
        grids[g] = (mult, r.sample(sorted(mult), 2))
    cells = spark.createDataFrame([(g, i, m) for g, (mult, _) in grids.items() for i, m in mult.items()], "grid_id int, cell_id long, mult double")
    start = spark.createDataFrame([(g, s) for g, (_, starts) in grids.items() for s in starts], "grid_id int, cell_id long")
    got = {(x.grid_id, x.cell_id): x.cost for x in trails.cost_distance(cells, start, cols, 10.0, tile=tile).collect()}
    assert got == {(g, i): c for g, (mult, starts) in grids.items() for i, c in cheapest(mult, cols, starts, 10.0).items()}


def test_start_outside_the_grid(spark):
    cells = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0)], "grid_id int, cell_id long, mult double")
    with pytest.raises(Exception, match="outside the grid"):
        trails.cost_distance(cells, spark.createDataFrame([(1, 2)], "grid_id int, cell_id long"), 2, 1.0)
