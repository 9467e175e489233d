"""Corridor outlines and areas in bands, held against distances and areas worked out otherwise."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairngrid.operators import outlines

#: Area of a regular 720-sided polygon of circumradius 1.
UNIT = 0.5 * 720 * math.sin(2 * math.pi / 720)


def corridors(spark, lines, half_width, tolerance=outlines.ARC_TOLERANCE):
    rows = [(k, s, float(x), float(y)) for k, ln in lines.items() for s, (x, y) in enumerate(ln)]
    got = {}
    for r in outlines.corridor_outlines(spark.createDataFrame(rows, "line_id int, seq int, x double, y double"), half_width, tolerance=tolerance).orderBy("line_id", "ring").collect():
        got.setdefault(r.line_id, []).append((r.hole, r.area_m2, [(p.x, p.y) for p in r.points]))
    return got


def inside(rings, x, y):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            n += (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay)
    return n % 2 == 1


def distance(line, x, y):
    best = math.inf
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy or 1)))
        best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


def test_straight_line_and_switchback(spark):
    got = corridors(spark, {1: [(0, 0), (100, 0)], 2: [(0, 0), (500, 0), (0, 30)]}, 10.0)
    (hole, area, ring), full = got[1][0], 100 * 20 + math.pi * 100
    assert len(got[1]) == 1 and not hole and full - 15.71 < area <= full and ring[0] == ring[-1]
    assert len(corridors(spark, {2: [(0, 0), (500, 0), (0, 30)]}, 50.0)[2]) == 1


def test_loop_has_a_hole(spark):
    square = [(0, 0), (400, 0), (400, 400), (0, 400), (0, 0)]
    rings = corridors(spark, {1: square}, 20.0, 0.001)[1]
    assert [r[0] for r in rings] == [False, True] and rings[1][1] == pytest.approx(-(360**2), abs=0.1)
    assert rings[0][1] == pytest.approx(400**2 + 4 * 400 * 20 + math.pi * 400, abs=1)


def test_outlines_equal_distances_on_a_lattice(spark):
    """Random lines, lines walked back and forth, straight bends, repeated points, crossings."""
    r, lines = random.Random(7), {}
    for k in range(14):
        lines[k] = [(r.uniform(0, 900), r.uniform(0, 900)) for _ in range(r.randint(2, 9))]
    lines[20] = [(0, 0), (300, 0), (600, 0), (600, 0), (300, 0), (0, 0)]
    lines[21] = [(0, 0), (500, 0), (200, 0), (800, 0)]
    lines[22] = [(100, 100), (500, 500), (100, 500), (500, 100), (100, 100)]
    lines[23] = [(i * 15.0, 200 + 60 * math.sin(i / 3)) for i in range(60)]
    lines[24] = [(5, 5), (5, 5)]
    got, half = corridors(spark, lines, 40.0), 40.0
    assert sorted(got) == [k for k in sorted(lines) if k != 24]
    for k, rings in got.items():
        assert not rings[0][0] and all(h for h, _, _ in rings[1:]) and rings[0][1] > 0
        for _ in range(250):
            x, y = r.uniform(-60, 960), r.uniform(-60, 960)
            d = distance(lines[k], x, y)
            if d < half - 0.26 or d > half + 0.01:
                assert inside([ring for _, _, ring in rings], x, y) == (d < half), (k, x, y, d)


def rect(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def areas(spark, polygons, bands, **more):
    rows = [(k, n, s, float(x), float(y)) for k, rings in polygons.items() for n, ring in enumerate(rings) for s, (x, y) in enumerate(ring)]
    out = outlines.areas_in_bands(spark.createDataFrame(rows, "geom_id string, ring int, seq int, x double, y double"), bands, **more)
    return sorted([(int(r.name[2:]), r.geom_id, r.area_m2, r.nearness, [[(p.x, p.y) for p in ring] for ring in r.rings]) for r in out.collect()])


def test_disc_and_merged_bands(spark):
    big = {"a": [rect(-2000, -2000, 2000, 2000)]}
    assert [x[2] for x in areas(spark, big, [(0, 500)])] == [pytest.approx(UNIT * 500**2, abs=0.1)]
    assert [x[2] for x in areas(spark, big, [(500, 1000), (0, 500)])] == [pytest.approx(UNIT * 1000**2, abs=0.1)]


def test_disc_and_ring_with_a_hole(spark):
    got = areas(spark, {"a": [rect(-2000, -2000, 2000, 2000)]}, [(600, 900), (0, 300)])
    assert [(x[0], x[2], len(x[4])) for x in got] == [(1, pytest.approx(UNIT * 300**2, abs=0.1), 1), (2, pytest.approx(UNIT * (900**2 - 600**2), abs=0.1), 2)]
    assert got[0][3] == 0 and got[1][3] == pytest.approx(600, abs=0.01)


def test_half_disc_with_a_lake_order_and_crumbs(spark):
    got = areas(spark, {"h": [rect(0, -2000, 2000, 2000), rect(200, -100, 400, 100)]}, [(0, 1000)])
    assert len(got) == 1 and len(got[0][4]) == 2 and got[0][2] == pytest.approx(UNIT * 1000**2 / 2 - 40_000, abs=0.2)
    got = areas(spark, {"far": [rect(600, -100, 800, 100)], "near": [rect(-300, -100, -100, 100)]}, [(0, 1000)])
    assert [x[1] for x in got] == ["near", "far"] and [x[3] for x in got] == [100, 600]
    d = 1000 / math.sqrt(2) - 10
    assert areas(spark, {"s": [rect(d, d, d + 800, d + 800)], "out": [rect(3000, 3000, 4000, 4000)]}, [(0, 1000)]) == []
    assert len(areas(spark, {"s": [rect(500, 500, 1500, 1500)]}, [(0, 1000)])) == 1
    with pytest.raises(ValueError, match="wider"):
        areas(spark, {"s": [rect(0, 0, 1, 1)]}, [(5, 5)])


def test_areas_equal_a_lattice(spark):
    """Star-shaped polygons around many centres, with holes and rings in holes, either way round."""
    r, polygons = random.Random(3), {}
    for k in range(8):
        cx, cy = r.uniform(-900, 900), r.uniform(-900, 900)
        star = lambda lo, hi, n, cx=cx, cy=cy: [(cx + q * math.cos(a), cy + q * math.sin(a)) for a, q in ((2 * math.pi * i / n, r.uniform(lo, hi)) for i in range(n))]
        rings = [star(500, 800, 17), star(250, 400, 9), star(60, 150, 5)][: r.randint(1, 3)]
        polygons[str(k)] = [ring[:: r.choice((1, -1))] for ring in rings]
    bands = [(0, 250), (400, 800), (700, 1000)]
    got = areas(spark, polygons, bands, crumb_m2=0.0)
    x, y = np.meshgrid(np.arange(-1000, 1000, 8) + 4, np.arange(-1000, 1000, 8) + 4)
    radius = np.hypot(x, y)
    region = (radius < 250) | ((radius > 400) & (radius < 1000))

    def crossings(rings):
        n = np.zeros(x.shape, int)
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
                if ay != by:
                    n += ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
        return n % 2 == 1

    for k, rings in polygons.items():
        want = crossings(rings) & region
        mine = np.zeros(x.shape, int)
        for g in got:
            if g[1] == k:
                mine += crossings([q[:-1] for q in g[4]])
        assert mine.max() <= 1 and (mine != want).sum() <= 4, k
        assert sum(g[2] for g in got if g[1] == k) == pytest.approx(want.sum() * 64.0, rel=0.02, abs=2000)


def test_in_rings(spark):
    rings = spark.createDataFrame([("a", [(0.0, 0.0), (500.0, 0.0), (500.0, 500.0), (0.0, 0.0)])], "k string, points array<struct<x:double,y:double>>")
    points = spark.range(0, 36).select("id", (F.col("id") % 6 * 100.0 + 3).alias("x"), (F.floor(F.col("id") / 6) * 100.0 + 1).alias("y"))
    got = {r.id for r in outlines.in_rings(points, rings, "k", "id", "x", "y").collect()}
    assert got == {r.id for r in points.collect() if r.x < 500 and r.y < r.x}


def test_in_rings_joins_edges_by_their_key(spark):
    """Edges meet points by key and strip, never by the strip alone, which would bring the edges of all keys to one task; a null key counts as one."""
    ring = lambda a: [(a, 0.0), (a + 500.0, 0.0), (a + 500.0, 500.0), (a, 500.0), (a, 0.0)]
    rings = spark.createDataFrame([("a", ring(0.0)), ("b", ring(250.0)), (None, ring(-7000.0))], "k string, points array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 10.0, 10.0), (2, 300.0, 499.0), (3, 600.0, 250.0), (4, -6800.0, 130.0), (5, 900.0, 10.0)], "id int, x double, y double")
    out = outlines.in_rings(points, rings, "k", "id", "x", "y")
    assert {tuple(r) for r in out.collect()} == {("a", 1), ("a", 2), ("b", 2), ("b", 3), (None, 4)}
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in line and "y0#" in line]
    assert joins and all("<=>" in line for line in joins)


def test_polygons_are_linked_once_without_a_row_or_object_per_point(spark, monkeypatch):
    """A ring around the origin has some 1500 points; numbering the parts by ranges reads what is numbered twice."""
    r, polygons, seen = random.Random(11), {}, []
    for k in range(40):
        x, y = r.uniform(-900, 900), r.uniform(-900, 900)
        polygons[f"{k:02}"] = [rect(x - 300, y - 300, x + 300, y + 300)]
    inner = outlines.running_before
    monkeypatch.setattr(outlines, "running_before", lambda df, *a: seen.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or inner(df, *a))
    got = areas(spark, polygons, [(0, 400), (600, 1000)], crumb_m2=0.0)
    columns, plan = seen[0]
    assert "rings" not in columns and "MapIn" not in plan and "InPandas" not in plan
    monkeypatch.setattr(outlines, "HANDED_ON", 1)  # one polygon at a time
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # polygons go on in the next batch
    try:
        assert areas(spark, polygons, [(0, 400), (600, 1000)], crumb_m2=0.0) == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [g[0] for g in got] == list(range(1, len(got) + 1)) and [g[3] for g in got] == sorted(g[3] for g in got)
