"""Planar raster and vector geometry as Column expressions; everything stays inside code generation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Regular raster: x east, y north, row 0 in the south, cell id = row * cols + col."""

    origin_x: float
    origin_y: float
    cell_size: float
    cols: int
    rows: int
    crs: str = "local"

    def __post_init__(self):
        finite = all(abs(v) != float("inf") and v == v for v in (self.origin_x, self.origin_y, self.cell_size))
        if not finite or self.cell_size <= 0 or int(self.cols) != self.cols or int(self.rows) != self.rows or self.cols < 1 or self.rows < 1:
            raise ValueError("a grid needs a finite origin, a positive cell size and at least one column and row")

    @property
    def cell_count(self) -> int:
        return self.cols * self.rows

    @property
    def cell_area(self) -> float:
        return self.cell_size * self.cell_size

    @property
    def domain_area(self) -> float:
        return self.cell_count * self.cell_area

    def cells(self, spark: SparkSession) -> DataFrame:
        """(cell_id, cx, cy) of every cell, generated in parallel."""
        return self.with_centres(spark.range(self.cell_count).withColumnRenamed("id", "cell_id"))

    def with_centres(self, df: DataFrame, cell: str = "cell_id") -> DataFrame:
        col = F.col(cell) % self.cols
        row = F.floor(F.col(cell) / self.cols)
        return df.withColumns({"cx": self.origin_x + (col + 0.5) * self.cell_size, "cy": self.origin_y + (row + 0.5) * self.cell_size})

    def index_at(self, x: Column, y: Column) -> Column:
        """Cell id of a point, -1 outside; the west and south edges belong to a cell, the east and north edges do not."""
        col, row = F.floor((x - self.origin_x) / self.cell_size), F.floor((y - self.origin_y) / self.cell_size)
        inside = (col >= 0) & (col < self.cols) & (row >= 0) & (row < self.rows)
        return F.when(inside, row * self.cols + col).otherwise(F.lit(-1)).cast("long")


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def segment_distance(px: Column, py: Column, ax, ay, bx, by) -> Column:
    """Distance of a point to a segment; a segment of no length is a point."""
    ax, ay, bx, by = (F.lit(float(v)) if not isinstance(v, Column) else v for v in (ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - ax) * dx + (py - ay) * dy, size))), F.lit(0.0))
    return distance(px, py, ax + t * dx, ay + t * dy)


def polyline_distance(px: Column, py: Column, line: list[tuple[float, float]]) -> Column:
    """Distance to a polyline that the driver knows: the least over its segments, without any join."""
    if not line:
        raise ValueError("a polyline needs a vertex")
    if len(line) == 1:
        return distance(px, py, F.lit(float(line[0][0])), F.lit(float(line[0][1])))
    parts = [segment_distance(px, py, *a, *b) for a, b in zip(line, line[1:], strict=False)]
    return parts[0] if len(parts) == 1 else F.least(*parts)


def in_polygon(px: Column, py: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd test against a polygon that the driver knows."""
    hits = []
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if ay == by:
            continue
        crosses = ((F.lit(float(ay)) > py) != (F.lit(float(by)) > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
        hits.append(crosses.cast("int"))
    return reduce(lambda a, b: a + b, hits) % 2 == 1 if hits else F.lit(False)


def _vertex(points: Column, i: Column) -> Column:
    return F.get(points, i)


def polyline_length(points: Column) -> Column:
    """Length of an array<struct<x,y>>."""
    legs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), lambda i: F.coalesce(distance(_vertex(points, i)["x"], _vertex(points, i)["y"], _vertex(points, i - 1)["x"], _vertex(points, i - 1)["y"]), F.lit(0.0)))
    return F.aggregate(legs, F.lit(0.0), lambda a, b: a + b)


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array<struct<x,y>>; the first vertex need not be repeated."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: p["x"] * _vertex(points, (i + 1) % n)["y"] - _vertex(points, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)) / 2


def polygon_edges(polygons: DataFrame, key: str = "geom_id", points: str = "points") -> DataFrame:
    """(key, i, n, ax, ay, bx, by) of every edge."""
    at = polygons.select(key, F.col(points).alias("q"), F.size(points).alias("n"), F.posexplode(points).alias("i", "a"))
    b = F.get("q", (F.col("i") + 1) % F.col("n"))
    return at.select(key, "i", "n", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))


def _side(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_cross(a: str, b: str) -> Column:
    """Proper crossing of two edges given as prefixed columns (ax, ay, bx, by); touching is none."""
    c = lambda p, n: F.col(f"{p}.{n}")
    o1 = _side(c(a, "ax"), c(a, "ay"), c(a, "bx"), c(a, "by"), c(b, "ax"), c(b, "ay"))
    o2 = _side(c(a, "ax"), c(a, "ay"), c(a, "bx"), c(a, "by"), c(b, "bx"), c(b, "by"))
    o3 = _side(c(b, "ax"), c(b, "ay"), c(b, "bx"), c(b, "by"), c(a, "ax"), c(a, "ay"))
    o4 = _side(c(b, "ax"), c(b, "ay"), c(b, "bx"), c(b, "by"), c(a, "bx"), c(a, "by"))
    return (o1 * o2 < 0) & (o3 * o4 < 0)


def validate_polygons(polygons: DataFrame, key: str = "geom_id", points: str = "points") -> DataFrame:
    """(key, problem): too few vertices, non-finite vertices, no area, or the first self-crossing; valid outlines have no row.

    Edges are compared within their polygon only: an equi-join on the key with an ordering predicate.
    """
    finite = F.forall(points, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    simple = polygons.select(key, F.when(F.size(points) < 3, "fewer than 3 vertices").when(~finite, "non-finite vertex").when(polygon_area(F.col(points)) == 0, "zero area").alias("problem"))
    good = polygons.join(simple.where("problem is null").select(key), key)
    e = polygon_edges(good, key, points)
    pairs = e.alias("s").join(e.alias("t"), (F.col(f"s.{key}") == F.col(f"t.{key}")) & (F.col("s.i") + 1 < F.col("t.i")) & ~((F.col("s.i") == 0) & (F.col("t.i") == F.col("s.n") - 1)))
    crossing = pairs.where(segments_cross("s", "t")).groupBy(F.col(f"s.{key}").alias(key)).agg(F.min(F.struct(F.col("s.i").alias("i"), F.col("t.i").alias("j"))).alias("x"))
    return simple.where("problem is not null").unionByName(crossing.select(key, F.concat(F.lit("edges "), F.col("x.i"), F.lit(" and "), F.col("x.j"), F.lit(" intersect")).alias("problem")))


def self_overlap_area(polygons: DataFrame, key: str = "geom_id", points: str = "points", step: float = 20.0) -> DataFrame:
    """(key, lost_m2): area that even-odd filling loses against non-zero winding, sampled on a lattice."""
    e = polygon_edges(polygons, key, points)
    box = e.groupBy(key).agg(F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1"))
    steps = lambda a, b: F.sequence(F.lit(0), F.greatest(F.ceil((F.col(b) - F.col(a)) / step) - 1, F.lit(0)).cast("int"))
    lattice = box.select(key, "x0", "y0", "y1", F.explode(steps("x0", "x1")).alias("i"), "x1").select(key, (F.col("x0") + (F.col("i") + 0.5) * step).alias("px"), "y0", F.explode(steps("y0", "y1")).alias("j")).select(key, "px", (F.col("y0") + (F.col("j") + 0.5) * step).alias("py"))
    joined = lattice.join(e, key)
    left = _side(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col("px"), F.col("py"))
    up, down = (F.col("ay") <= F.col("py")) & (F.col("by") > F.col("py")) & (left > 0), (F.col("ay") > F.col("py")) & (F.col("by") <= F.col("py")) & (left < 0)
    w = joined.groupBy(key, "px", "py").agg(F.sum(F.when(up, 1).when(down, -1).otherwise(0)).alias("w"))
    lost = w.groupBy(key).agg(F.sum(F.when((F.col("w") != 0) & (F.col("w") % 2 == 0), step * step).otherwise(0.0)).alias("lost_m2"))
    return polygons.select(key).join(lost, key, "left").select(key, F.coalesce("lost_m2", F.lit(0.0)).alias("lost_m2"))


def rasterize_legs(legs: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """(keys, cell_id, length): legs (ax, ay, bx, by) cut into pieces of a quarter cell at most, counted in the cell of each piece's middle."""
    size = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    n = F.greatest(F.lit(1), F.ceil(size / (grid.cell_size / 4))).cast("int")
    piece = legs.select(*keys, "ax", "ay", "bx", "by", size.alias("leg"), n.alias("n")).where("leg > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = (F.col("k") + 0.5) / F.col("n")
    at = piece.select(*keys, (F.col("leg") / F.col("n")).alias("part"), grid.index_at(F.col("ax") + (F.col("bx") - F.col("ax")) * t, F.col("ay") + (F.col("by") - F.col("ay")) * t).alias("cell_id"))
    return at.where("cell_id >= 0").groupBy(*keys, "cell_id").agg(F.sum("part").alias("length"))


def line_legs(spark: SparkSession, line: list[tuple[float, float]], **keys) -> DataFrame:
    """The legs of a polyline that the driver knows."""
    rows = [(*keys.values(), i, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for i, (a, b) in enumerate(zip(line, line[1:], strict=False))]
    kinds = ", ".join(f"{k} string" for k in keys)
    return spark.createDataFrame(rows, f"{kinds}{', ' if keys else ''}leg_no int, ax double, ay double, bx double, by double")


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of a closed array<struct<x,y>>: positive where it runs counter-clockwise."""
    terms = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2


def label_point(ring: Column) -> Column:
    """Where to put a closed ring's title, as struct<x,y>: the middle of the widest run (the first of equal ones) across its middle row; its first vertex if no edge crosses that row."""
    ys = F.transform(ring, lambda p: p["y"])
    row = (F.array_min(ys) + F.array_max(ys)) / 2
    sides = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda p, q: F.when((p["y"] > row) != (q["y"] > row), p["x"] + (row - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"])))
    xs = F.array_sort(F.array_compact(sides))
    pairs = F.filter(xs, lambda x, i: i % 2 == 0)
    runs = F.transform(pairs, lambda x, i: F.struct((F.get(xs, 2 * i + 1) - x).alias("width"), (-i).alias("order"), ((x + F.get(xs, 2 * i + 1)) / 2).alias("x")))
    best = F.array_max(F.filter(runs, lambda r: r["width"].isNotNull()))
    first = F.get(ring, F.lit(0))
    return F.when(best.isNull(), F.struct(first["x"].alias("x"), first["y"].alias("y"))).otherwise(F.struct(best["x"].alias("x"), row.alias("y")))


def nice_distance(m: Column) -> Column:
    """The largest of 1, 2 and 5 times a power of ten that is not above ``m``."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(m)))
    return F.when(5 * p <= m, 5 * p).when(2 * p <= m, 2 * p).otherwise(p)


def feature_kind(geometry: Column, title: Column, cls: Column) -> Column:
    """ring, wedge, trail, area or sector of a map feature; null for points and what has no geometry."""
    t = F.coalesce(title, F.lit(""))
    return F.when(geometry == "LineString", "ring").when(geometry == "Polygon", F.when(F.coalesce(cls != "Assignment", F.lit(True)), "wedge").when(t.startswith("T-"), "trail").when(t.startswith("A-"), "area").otherwise("sector"))
