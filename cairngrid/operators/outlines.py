"""Outlines as rings: corridors around lines, and polygons cut to distance bands.

Both are arrangements worked out as rows. Boundary elements that may cross meet in squares of the plane and are cut where they cross; a cut
element stays if its middle lies outside every other shape (a union) or inside the other shape (an intersection); what stays runs with the
inside on its left, so every end is one other's start, and one line's or polygon's elements are linked to rings.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngrid.functions.geometry import segment_distance
from cairngrid.operators.surface import checkpointed, running_before, stored
from cairngrid.operators.trails import legs

#: Largest gap between a rounded end or bend and the true circle, in metres.
ARC_TOLERANCE = 0.25
#: Legs of one line get half widths that differ by so much, so that no two outlines run along each other (a trail walked back and forth).
STEP = 1e-6
CRUMB_M2 = 5000.0
#: Circles are polygons of so many sides.
SIDES = 720
#: The circles' corners are turned by this angle, so that none lies on a line through the origin along an axis.
TURN = 1.7e-8
POINT = "struct<x:double,y:double>"
#: Points of finished rings that a task hands on at once.
HANDED_ON = 200_000
#: Points meet the spans of keys in boxes as high as a strip and so many times as wide.
WIDE = 16


def _cells(x0: Column, y0: Column, x1: Column, y1: Column, side: float, reach: float | None = None) -> dict[str, Column]:
    """First and last square of a box, kept within ``reach`` of the origin."""
    to = lambda v: F.floor((v if reach is None else F.greatest(F.lit(-reach), F.least(F.lit(reach), v))) / side)
    return {"gx0": to(F.least(x0, x1)), "gx1": to(F.greatest(x0, x1)), "gy0": to(F.least(y0, y1)), "gy1": to(F.greatest(y0, y1))}


def _spread(df: DataFrame) -> DataFrame:
    return df.withColumn("gx", F.explode(F.sequence("gx0", "gx1"))).withColumn("gy", F.explode(F.sequence("gy0", "gy1")))


def _along_squares(df: DataFrame, side: float, reach: float) -> DataFrame:
    """Segments (x0, y0, x1, y1) in the squares that they cross within ``reach`` of the origin, column by column."""
    kept = lambda v: F.greatest(F.lit(-reach), F.least(F.lit(reach), v))
    box = _cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), side, reach)
    df = df.withColumn("gx", F.explode(F.sequence(box["gx0"], box["gx1"])))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    flat = F.abs(dx) < 1e-9
    y = lambda x: F.when(flat, F.col("y0")).otherwise(F.col("y0") + (x - F.col("x0")) * dy / dx)
    ya = F.when(flat, F.col("y0")).otherwise(y(F.greatest(F.least("x0", "x1"), F.col("gx") * side)))
    yb = F.when(flat, F.col("y1")).otherwise(y(F.least(F.greatest("x0", "x1"), (F.col("gx") + 1) * side)))
    low, high = F.floor(kept(F.least(ya, yb) - 1e-6) / side), F.floor(kept(F.greatest(ya, yb) + 1e-6) / side)
    return df.withColumn("gy", F.explode(F.sequence(low, high)))


def _walk_rings(starts: list, ends: list) -> list[list[int]]:
    """Rings of one shape, as the numbers of their elements in order: an element's end is the start of exactly one other."""
    at = {s: k for k, s in enumerate(starts)}
    left, rings = dict.fromkeys(range(len(starts))), []
    while left:
        k, ring = next(iter(left)), []
        while k in left:
            del left[k]
            ring.append(k)
            if ends[k] not in at:
                raise ValueError("an outline does not close")
            k = at[ends[k]]
        rings.append(ring)
    return rings


def _area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _closed(ring: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in [*ring, ring[0]]]


def _elements(lines: DataFrame, half_width: float, key: str) -> tuple[DataFrame, DataFrame]:
    """(legs with their half width h, the four elements around each: right side, end cap, left side, start cap, counter-clockwise)."""
    e = legs(lines, key).withColumn("len", F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)).where("len > 1e-6")
    e = e.withColumns({"h": half_width - STEP * (F.col("leg") % 1000 + 1), "nx": (F.col("y1") - F.col("y0")) / F.col("len"), "ny": (F.col("x0") - F.col("x1")) / F.col("len")})
    x = lambda end, way: F.col(f"x{end}") + way * F.col("nx") * F.col("h")
    y = lambda end, way: F.col(f"y{end}") + way * F.col("ny") * F.col("h")

    def element(k: int, a: int, b: int, way_a: int, way_b: int, cap: bool) -> Column:
        parts = {"e": F.lit(k), "cap": F.lit(cap), "ax": x(a, way_a), "ay": y(a, way_a), "bx": x(b, way_b), "by": y(b, way_b), "cx": F.col(f"x{a}"), "cy": F.col(f"y{a}"), "ux": way_a * F.col("nx"), "uy": way_a * F.col("ny")}
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    four = F.array(element(0, 0, 1, 1, 1, False), element(1, 1, 1, 1, -1, True), element(2, 1, 0, -1, -1, False), element(3, 0, 0, -1, 1, True))
    return e, e.select(key, "leg", "h", F.explode(four).alias("q")).select(key, "leg", "h", "q.*")


def _crossings(p: DataFrame) -> Column:
    """Points in which elements 1 and 2 of a row may cross, before it is asked whether they reach that far."""
    c = lambda n, k: F.col(f"{n}{k}")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    none = F.array().cast(f"array<{POINT}>")

    def sides() -> Column:
        dx1, dy1, dx2, dy2 = c("bx", 1) - c("ax", 1), c("by", 1) - c("ay", 1), c("bx", 2) - c("ax", 2), c("by", 2) - c("ay", 2)
        d = dx1 * dy2 - dy1 * dx2
        t = F.try_divide((c("ax", 2) - c("ax", 1)) * dy2 - (c("ay", 2) - c("ay", 1)) * dx2, d)
        return F.when(t.isNull(), none).otherwise(F.array(point(c("ax", 1) + t * dx1, c("ay", 1) + t * dy1)))

    def side_cap(s: int, k: int) -> Column:
        dx, dy, ox, oy = c("bx", s) - c("ax", s), c("by", s) - c("ay", s), c("ax", s) - c("cx", k), c("ay", s) - c("cy", k)
        a, b, q = dx * dx + dy * dy, ox * dx + oy * dy, ox * ox + oy * oy - c("h", k) * c("h", k)
        root = b * b - a * q
        t = [(-b + way * F.sqrt(F.greatest(root, F.lit(0.0)))) / a for way in (-1, 1)]
        return F.when(root > 0, F.array(*[point(c("ax", s) + v * dx, c("ay", s) + v * dy) for v in t])).otherwise(none)

    dx, dy = c("cx", 2) - c("cx", 1), c("cy", 2) - c("cy", 1)
    d2 = dx * dx + dy * dy
    m = F.try_divide(d2 + c("h", 1) * c("h", 1) - c("h", 2) * c("h", 2), 2 * d2)
    w = F.try_divide(c("h", 1) * c("h", 1), d2) - m * m
    caps = F.when(w > 0, F.array(*[point(c("cx", 1) + m * dx - way * F.sqrt(w) * dy, c("cy", 1) + m * dy + way * F.sqrt(w) * dx) for way in (-1, 1)])).otherwise(none)
    return F.when(~c("cap", 1) & ~c("cap", 2), sides()).when(~c("cap", 1), side_cap(1, 2)).when(~c("cap", 2), side_cap(2, 1)).otherwise(caps)


def _along(p: Column, k: int | str = "") -> Column:
    """Where on its element a point lies: 0 at the start, 1 at the end."""
    c = lambda n: F.col(f"{n}{k}")
    dx, dy = c("bx") - c("ax"), c("by") - c("ay")
    wx, wy = p["x"] - c("cx"), p["y"] - c("cy")
    turned = F.atan2(c("ux") * wy - c("uy") * wx, c("ux") * wx + c("uy") * wy) / math.pi
    return F.when(c("cap"), turned).otherwise(((p["x"] - c("ax")) * dx + (p["y"] - c("ay")) * dy) / (dx * dx + dy * dy))


def _place(t: Column) -> Column:
    """The point of the row's element at ``t``."""
    a = t * math.pi
    x, y = F.col("cx") + F.col("h") * (F.cos(a) * F.col("ux") - F.sin(a) * F.col("uy")), F.col("cy") + F.col("h") * (F.sin(a) * F.col("ux") + F.cos(a) * F.col("uy"))
    return F.struct(F.when(F.col("cap"), x).otherwise(F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), F.when(F.col("cap"), y).otherwise(F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))


def corridor_outlines(lines: DataFrame, half_width: float, key: str = "line_id", tolerance: float = ARC_TOLERANCE) -> DataFrame:
    """(key, ring, hole, area_m2, points): every point within ``half_width`` of a line (key, seq, x, y), with round ends and bends.

    Ring 0 is the outer one, the others are holes where a line loops back on itself; rings are closed, outer ones counter-clockwise. Rounded
    parts lie inside the true circle by ``tolerance`` at most. The corridor is the union of its legs' capsules. A line without length has no outline.
    """
    e, elements = _elements(lines, half_width, key)
    side = max(4 * half_width, 200.0)
    box = lambda a, b, c, r: (F.when(F.col("cap"), F.col(c) - r).otherwise(F.least(a, b)), F.when(F.col("cap"), F.col(c) + r).otherwise(F.greatest(a, b)))
    (x0, x1), (y0, y1) = box("ax", "bx", "cx", F.col("h")), box("ay", "by", "cy", F.col("h"))
    placed = checkpointed(elements.withColumns(_cells(x0, y0, x1, y1, side)))
    names = ["leg", "h", "e", "cap", "ax", "ay", "bx", "by", "cx", "cy", "ux", "uy", "gx0", "gy0"]
    one = lambda k: _spread(placed).select(key, "gx", "gy", *[F.col(n).alias(f"{n}{k}") for n in names])
    # a pair that shares several squares counts in the first of them
    first = (F.col("gx") == F.greatest("gx01", "gx02")) & (F.col("gy") == F.greatest("gy01", "gy02"))
    pairs = one(1).join(one(2), [key, "gx", "gy"]).where((F.col("leg1") < F.col("leg2")) & first)
    met = pairs.select("*", F.posexplode(_crossings(pairs)).alias("k", "p")).withColumns({"t1": _along(F.col("p"), 1), "t2": _along(F.col("p"), 2)}).where("t1 between 0 and 1 and t2 between 0 and 1")
    node = F.concat_ws(".", "leg1", "e1", "leg2", "e2", "k").alias("node")
    both = F.array(*[F.struct(F.col(f"leg{k}").alias("leg"), F.col(f"e{k}").alias("e"), F.col(f"t{k}").alias("t")) for k in (1, 2)])
    cuts = met.select(key, node, F.explode(both).alias("c")).select(key, "node", "c.*").groupBy(key, "leg", "e").agg(F.array_sort(F.collect_list(F.struct("t", "node"))).alias("cuts"))
    corner = lambda k: F.concat_ws(".", "leg", k.cast("string"))
    ends = [F.array(F.struct(F.lit(v).alias("t"), corner((F.col("e") + int(v)) % 4).alias("node"))) for v in (0.0, 1.0)]
    some = F.coalesce("cuts", F.array().cast("array<struct<t:double,node:string>>"))
    runs = F.arrays_zip(F.concat(ends[0], some).alias("a"), F.concat(some, ends[1]).alias("b"))
    parts = placed.join(cuts, [key, "leg", "e"], "left").select(key, *names[:-2], F.posexplode(runs).alias("i", "r"))
    parts = parts.withColumns({"t0": F.col("r.a.t"), "n0": F.col("r.a.node"), "t1": F.col("r.b.t"), "n1": F.col("r.b.node")}).drop("r")
    parts = checkpointed(parts.withColumn("m", _place((F.col("t0") + F.col("t1")) / 2)))
    around = _spread(e.withColumns(_cells(F.least("x0", "x1") - half_width, F.least("y0", "y1") - half_width, F.greatest("x0", "x1") + half_width, F.greatest("y0", "y1") + half_width, side)))
    around = around.select(key, "gx", "gy", F.col("leg").alias("other"), F.col("h").alias("reach"), F.col("x0").alias("px"), F.col("y0").alias("py"), F.col("x1").alias("qx"), F.col("y1").alias("qy"))
    spots = parts.select(key, "leg", "e", "i", "m", F.floor(F.col("m.x") / side).alias("gx"), F.floor(F.col("m.y") / side).alias("gy"))
    near = segment_distance(F.col("m.x"), F.col("m.y"), F.col("px"), F.col("py"), F.col("qx"), F.col("qy"))
    covered = spots.join(around, [key, "gx", "gy"]).where((F.col("other") != F.col("leg")) & (near < F.col("reach"))).select(key, "leg", "e", "i").distinct()
    turn = 2 * F.acos(F.greatest(F.lit(0.0), 1 - tolerance / F.col("h")))
    n = F.when(F.col("cap"), F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0")) * math.pi / turn))).otherwise(1).cast("int")
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda k: _place(F.col("t0") + (F.col("t1") - F.col("t0")) * k / n))
    kept = parts.join(covered, [key, "leg", "e", "i"], "left_anti").select(F.col(key), "n0", "n1", points.alias("points"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf["points"].tolist()
        walked = (np.array([(p["x"], p["y"]) for k in ring for p in points[k]]) for ring in _walk_rings(pdf["n0"].tolist(), pdf["n1"].tolist()))
        rings = sorted(((_area(r), r) for r in walked), key=lambda x: -abs(x[0]))
        rings = [x for k, x in enumerate(rings) if not k or (x[0] > 0) != (rings[0][0] > 0)]
        return pd.DataFrame([(pdf[key].iloc[0], k, k > 0, a, _closed(r)) for k, (a, r) in enumerate(rings)], columns=[key, "ring", "hole", "area_m2", "points"])

    return kept.groupBy(key).applyInPandas(link, f"{key} {dict(lines.dtypes)[key]}, ring int, hole boolean, area_m2 double, points array<{POINT}>")


def in_rings(points: DataFrame, rings: DataFrame, key: str, point_id: str, x: str, y: str, side: float = 200.0) -> DataFrame:
    """(key, point_id) of the points inside a key's rings (key, points), even-odd.

    Edges lie in strips of ``side`` metres along y. A point meets the keys whose edges in its strip reach from its left to its right, one short row per key and
    strip, and then these edges alone: no task holds the edges of all keys in a strip.
    """
    p, q = F.col("e.p"), F.col("e.q")
    edges = rings.select(key, F.explode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("p"), F.slice("points", 2, F.size("points") - 1).alias("q"))).alias("e"))
    edges = edges.select(F.col(key).alias("key_"), p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1")).where("y0 <> y1")
    strips = checkpointed(edges.withColumn("strip", F.explode(F.sequence(F.floor(F.least("y0", "y1") / side), F.floor(F.greatest("y0", "y1") / side)))))
    px, py = F.col("px_"), F.col("py_")
    within = lambda v: F.greatest(F.least("y0", "y1"), F.least(F.greatest("y0", "y1"), v))
    at = lambda v: F.col("x0") + (within(v) - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    ends = [at(F.col("strip") * side), at((F.col("strip") + 1) * side)]
    spans = strips.groupBy("key_", "strip").agg((F.min(F.least(*ends)) - 1e-3).alias("from_"), (F.max(F.greatest(*ends)) + 1e-3).alias("to_"))
    wide = lambda v: F.floor(v / (side * WIDE))
    spans = spans.withColumn("wide", F.explode(F.sequence(wide(F.col("from_")), wide(F.col("to_")))))
    spots = points.select(F.col(point_id), F.col(x).alias("px_"), F.col(y).alias("py_"), F.floor(F.col(y) / side).alias("strip"), wide(F.col(x)).alias("wide"))
    close = spots.join(spans, ["strip", "wide"]).where(px.between(F.col("from_"), F.col("to_"))).select(F.col("key_").alias(key), point_id, "px_", "py_", F.col("strip").alias("strip_"))
    crossed = ((F.col("y0") > py) != (F.col("y1") > py)) & (px < F.col("x0") + (py - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    met = close.join(strips, F.col(key).eqNullSafe(F.col("key_")) & (F.col("strip") == F.col("strip_")) & crossed)
    return met.groupBy(key, point_id).agg(F.count("*").alias("n")).where("n % 2 = 1").select(key, point_id)


def _corner(radius: Column, k: Column) -> Column:
    a = k * (2 * math.pi / SIDES) + TURN
    return F.struct((radius * F.cos(a)).alias("x"), (radius * F.sin(a)).alias("y"))


def _in_circle(p: Column, radius: float) -> Column:
    """Whether a point lies inside the polygon that stands for a circle: the distance along the normal of the side it faces."""
    step = 2 * math.pi / SIDES
    a = F.pmod(F.atan2(p["y"], p["x"]) - TURN, F.lit(step)) - step / 2
    return F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]) * F.cos(a) < radius * math.cos(step / 2)


def areas_in_bands(polygons: DataFrame, bands: list[tuple[float, float]], key: str = "geom_id", crumb_m2: float = CRUMB_M2) -> DataFrame:
    """(name, key, part, area_m2, nearness, rings): the parts of polygons inside rings around the origin, A-1, A-2, ... nearest first.

    ``polygons`` has (key, ring, seq, x, y) in local metres; rings of one polygon do not cross, and what lies in an even number of them is outside. Touching
    bands count as one. Circles are polygons of 720 sides. A part's rings are closed, the outer one (counter-clockwise) first; parts smaller than ``crumb_m2`` are left out.
    ``nearness`` is 0 where a part holds the origin, else the distance of its nearest edge. Each polygon's cuts are found in squares of the plane; its pieces are
    linked to rings by polygon, where an arc is its start and its range of corners, and no point of a circle is a row or a Python object.
    """
    merged: list[list[float]] = []
    for a, b in sorted((float(a), float(b)) for a, b in bands if b > a):  # as many as bands were asked for
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    if not merged:
        raise ValueError("a band must be wider than nothing")
    spark, reach = polygons.sparkSession, merged[-1][1]
    circles = [(c, r, w) for c, (r, w) in enumerate((r, w) for a, b in merged for r, w in ((b, 1), (a, -1)) if r > 0)]
    side = reach / 32

    w = W.partitionBy(key, "ring").orderBy("seq")
    v = polygons.select(key, "ring", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    v = v.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)}).where("px is null or px <> x or py <> y").drop("px", "py")
    whole = W.partitionBy(key, "ring").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    v = v.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(whole), "fx": F.first("x").over(whole), "fy": F.first("y").over(whole)})
    v = v.where(~((F.col("i") == F.col("n") - 1) & (F.col("i") > 0) & (F.col("x") == F.col("fx")) & (F.col("y") == F.col("fy"))))
    last = F.lead("x").over(w).isNull()
    v = v.withColumns({"x1": F.coalesce(F.lead("x").over(w), "fx"), "y1": F.coalesce(F.lead("y").over(w), "fy"), "j": F.when(last, 0).otherwise(F.col("i") + 1)})
    edges = v.select(key, "ring", "i", "j", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")
    box = v.groupBy(key).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    gap = lambda lo, hi: F.greatest(F.lit(0.0), lo, -hi)
    close = box.where(F.sqrt(gap(F.col("a"), F.col("b")) ** 2 + gap(F.col("c"), F.col("d")) ** 2) <= reach).select(key)
    edges = checkpointed(edges.join(close, key))

    strip = lambda c: F.floor(c / side)
    strips = edges.withColumn("strip", F.explode(F.sequence(strip(F.least("y0", "y1")), strip(F.greatest("y0", "y1"))))).select(key, "strip", F.col("ring").alias("other"), *[F.col(c).alias(f"{c}_") for c in ("x0", "y0", "x1", "y1")])
    crossed = ((F.col("y0_") > F.col("ty")) != (F.col("y1_") > F.col("ty"))) & (F.col("tx") < F.col("x0_") + (F.col("ty") - F.col("y0_")) * (F.col("x1_") - F.col("x0_")) / (F.col("y1_") - F.col("y0_")))
    # a ring inside an odd number of others bounds a hole and runs clockwise
    rings = edges.groupBy(key, "ring").agg(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")).alias("twice"), F.min_by(F.struct("x0", "y0"), "i").alias("p"))
    tests = rings.select(key, "ring", F.col("p.x0").alias("tx"), F.col("p.y0").alias("ty"), strip(F.col("p.y0")).alias("strip"))
    depth = tests.join(strips, [key, "strip"]).where((F.col("other") != F.col("ring")) & crossed).groupBy(key, "ring").agg(F.count("*").alias("depth"))
    turned = rings.join(depth, [key, "ring"], "left").select(key, "ring", ((F.col("twice") > 0) == (F.coalesce("depth", F.lit(0)) % 2 == 1)).alias("turn"))
    swap = lambda a, b: F.when(F.col("turn"), F.col(b)).otherwise(F.col(a))
    edges = edges.join(turned, [key, "ring"]).select(key, "ring", F.col("i").alias("edge"), *[swap(a, b).alias(n) for n, a, b in (("i", "i", "j"), ("j", "j", "i"), ("x0", "x0", "x1"), ("y0", "y0", "y1"), ("x1", "x1", "x0"), ("y1", "y1", "y0"))])
    edges = checkpointed(edges)

    table = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).alias("circle"), F.lit(r).alias("radius"), F.lit(w).alias("way")) for c, r, w in circles])))
    sides = table.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(SIDES - 1)))).withColumns({"a": _corner(F.col("radius"), F.col("k")), "b": _corner(F.col("radius"), F.col("k") + 1)})
    sides = _spread(sides.withColumns(_cells(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"), side))).select("circle", "k", "a", "b", "gx", "gy")
    met = _along_squares(edges, side, reach + side).join(F.broadcast(sides), ["gx", "gy"])
    dx, dy, ex, ey = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    d = dx * ey - dy * ex
    met = met.withColumns({"t": F.try_divide((F.col("a.x") - F.col("x0")) * ey - (F.col("a.y") - F.col("y0")) * ex, d), "u": F.try_divide((F.col("a.x") - F.col("x0")) * dy - (F.col("a.y") - F.col("y0")) * dx, d)})
    met = met.where("t > 0 and t < 1 and u >= 0 and u < 1").select(key, "ring", "edge", "t", "circle", (F.col("k") + F.col("u")).alias("s"), F.concat_ws(".", F.lit("x"), "circle", "k", "ring", "edge").alias("node"))
    met = checkpointed(met.dropDuplicates([key, "node"]))  # a pair may share several squares

    cuts = met.groupBy(key, "ring", "edge").agg(F.array_sort(F.collect_list(F.struct("t", "node"))).alias("cuts"))
    corner = lambda c: F.concat_ws(".", F.lit("v"), "ring", c)
    some = F.coalesce("cuts", F.array().cast("array<struct<t:double,node:string>>"))
    runs = F.arrays_zip(F.concat(F.array(F.struct(F.lit(0.0).alias("t"), corner("i").alias("node"))), some).alias("a"), F.concat(some, F.array(F.struct(F.lit(1.0).alias("t"), corner("j").alias("node")))).alias("b"))
    at = lambda t: F.struct((F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"))
    parts = edges.join(cuts, [key, "ring", "edge"], "left").withColumn("r", F.explode(runs)).withColumn("m", at((F.col("r.a.t") + F.col("r.b.t")) / 2))
    inside = F.lit(False)
    for a, b in merged:
        inside = inside | (_in_circle(F.col("m"), b) & (~_in_circle(F.col("m"), a) if a > 0 else F.lit(True)))
    parts = parts.where(inside).select(key, F.col("r.a.node").alias("n0"), F.col("r.b.node").alias("n1"), at(F.col("r.a.t")).alias("p"), F.lit(-1).alias("circle"), F.lit(0).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"))

    # the circles between their cuts, and whole circles that are not cut
    c = W.partitionBy(key, "circle").orderBy("s")
    every = W.partitionBy(key, "circle").orderBy("s").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    arcs = met.select(key, "circle", F.col("s").alias("s0"), F.col("node").alias("m0"), F.coalesce(F.lead("s").over(c), F.first("s").over(every) + SIDES).alias("s1"), F.coalesce(F.lead("node").over(c), F.first("node").over(every)).alias("m1"))
    full = edges.select(key).distinct().withColumn("circle", F.explode(F.array(*[F.lit(c) for c, _, _ in circles]))).join(met.select(key, "circle").distinct(), [key, "circle"], "left_anti")
    name = F.concat_ws(".", F.lit("w"), "circle")
    arcs = arcs.unionByName(full.select(key, "circle", F.lit(0.0).alias("s0"), name.alias("m0"), F.lit(float(SIDES)).alias("s1"), name.alias("m1"))).join(F.broadcast(table), "circle")
    on = lambda s: F.struct(*[(_corner(F.col("radius"), F.floor(s))[n] + (s - F.floor(s)) * (_corner(F.col("radius"), F.floor(s) + 1)[n] - _corner(F.col("radius"), F.floor(s))[n])).alias(n) for n in ("x", "y")])
    arcs = checkpointed(arcs.withColumn("id", F.monotonically_increasing_id()).withColumn("m", on((F.col("s0") + F.col("s1")) / 2)))
    tests = arcs.select(key, "id", F.col("m.x").alias("tx"), F.col("m.y").alias("ty"), strip(F.col("m.y")).alias("strip"))
    within = tests.join(strips, [key, "strip"]).where(crossed).groupBy(key, "id").agg(F.count("*").alias("n")).where("n % 2 = 1").select(key, "id")
    outer = F.col("way") == 1
    either = lambda a, b: F.when(outer, a).otherwise(b)
    arcs = arcs.join(within, [key, "id"]).select(key, either(F.col("m0"), F.col("m1")).alias("n0"), either(F.col("m1"), F.col("m0")).alias("n1"), either(on(F.col("s0")), on(F.col("s1"))).alias("p"), "circle", (F.floor("s0") + 1).alias("low"), (F.ceil("s1") - 1).alias("high"))

    def ring_of(elements: list[tuple]) -> np.ndarray:
        """Each element's start and, on a circle, the corners from ``low`` to ``high``, backwards on an inner circle."""
        runs = []
        for _, _, _, x, y, circle, low, high in elements:
            runs.append([[x, y]])
            if high >= low:
                _, radius, way = circles[circle]
                a = np.arange(low, high + 1)[::way] * (2 * math.pi / SIDES) + TURN
                runs.append(radius * np.column_stack([np.cos(a), np.sin(a)]))
        return np.concatenate(runs)

    def holds(ring: np.ndarray, x: float, y: float) -> bool:
        a, b = ring, np.roll(ring, -1, 0)
        some = (a[:, 1] > y) != (b[:, 1] > y)
        a, b = a[some], b[some]
        return bool((x < a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])).sum() % 2)

    def nearest(ring: np.ndarray) -> float:
        d = np.roll(ring, -1, 0) - ring
        t = np.clip(-(ring * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
        return float(np.sqrt(((ring + t[:, None] * d) ** 2).sum(1)).min())

    def parts_of(elements: list[tuple]) -> list[tuple]:
        """(part, area, nearness, rings) of one polygon."""
        found = [(_area(r), r) for r in (ring_of([elements[k] for k in order]) for order in _walk_rings([e[1] for e in elements], [e[2] for e in elements]))]
        outers = sorted(([a, [r]] for a, r in found if a > 0), key=lambda o: (o[0], o[1][0].tolist()))
        for a, r in found:
            if a < 0:  # a hole belongs to the smallest ring around it
                middle = (r[0] + r[1]) / 2
                home = next((o for o in outers if _area(o[1][0]) >= -a and holds(o[1][0], *middle)), None)
                if home:
                    home[0] += a
                    home[1].append(r)
        covers = lambda rs: holds(rs[0], 0.0, 0.0) and not any(holds(r, 0.0, 0.0) for r in rs[1:])
        return [(k, a, 0.0 if covers(rs) else min(map(nearest, rs)), rs) for k, (a, rs) in enumerate(outers)]

    def handed_on(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
        keys, part, area, near, rings = zip(*rows, strict=True)
        closed = [np.concatenate([r, r[:1]]) for rs in rings for r in rs]
        x, y = np.ascontiguousarray(np.concatenate(closed).T)
        ends = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
        points = pa.ListArray.from_arrays(ends(map(len, closed)), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"]))
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(part, pa.int32()), pa.array(area, pa.float64()), pa.array(near, pa.float64()), pa.ListArray.from_arrays(ends(map(len, rings)), points)], names=[key, "part", "area_m2", "nearness", "rings"])

    def link(batches):
        """The rows of a polygon's elements stand together; what is made of them is handed on in bounded batches."""
        kind, rows, n = [], [], 0

        def elements():
            for b in batches:
                kind[:] = [b.schema.field(0).type]
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        for k, own in groupby(elements(), key=lambda e: e[0]):
            made = parts_of(list(own))
            rows += [(k, *p) for p in made]
            n += sum(len(r) for p in made for r in p[-1])
            if n >= HANDED_ON:
                yield handed_on(kind[0], rows)
                rows, n = [], 0
        if rows:
            yield handed_on(kind[0], rows)

    elements = parts.unionByName(arcs).select(key, "n0", "n1", "p.x", "p.y", "circle", "low", "high")
    made = elements.repartition(key).sortWithinPartitions(key, "n0").mapInArrow(link, f"{key} {dict(polygons.dtypes)[key]}, part int, area_m2 double, nearness double, rings array<array<{POINT}>>")
    made = stored(made.where(F.col("area_m2") >= crumb_m2))
    # ranges are sampled and sorted without the rings
    places = running_before(made.select(key, "part", "nearness").withColumn("one", F.lit(1)), [], [F.col("nearness"), F.col(key), F.col("part")], "one", "before")
    out = made.join(places.select(key, "part", "before"), [key, "part"])
    return out.select(F.concat(F.lit("A-"), (F.col("before") + 1).cast("string")).alias("name"), key, "part", "area_m2", "nearness", "rings")
