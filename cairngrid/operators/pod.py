"""Probability of detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngrid.functions.geometry import Grid, in_polygon, polyline_distance, rasterize_legs

SEARCH_OBJECTS = ("responsive", "unresponsive", "clue")

# The invented sweep widths of the built-in exercise (resource, vegetation, slope, metres for a responsive subject).
EXERCISE_SWEEP_WIDTHS = [
    ("GROUND", "open", "any", 60.0),
    ("GROUND", "light", "any", 40.0),
    ("GROUND", "moderate", "any", 20.0),
    ("GROUND", "dense", "any", 10.0),
    ("DOG_TRAIL", "open", "any", 100.0),
    ("DOG_TRAIL", "light", "any", 80.0),
    ("DOG_TRAIL", "moderate", "any", 60.0),
    ("DOG_TRAIL", "dense", "any", 40.0),
    ("AIR", "open", "any", 200.0),
    ("AIR", "light", "any", 100.0),
    ("AIR", "moderate", "any", 40.0),
    ("AIR", "dense", "any", 10.0),
]


def exponential_pod(coverage: Column) -> Column:
    return 1 - F.exp(-coverage)


def planned_pod(cells: DataFrame, outline: list[tuple[float, float]], sweep_width: float, spacing: float) -> DataFrame:
    """(cell_id, coverage, pod, in_assignment): the same coverage in every cell whose centre is inside the outline."""
    if sweep_width <= 0 or spacing <= 0:
        raise ValueError("sweep width and spacing must be positive")
    inside = in_polygon(F.col("cx"), F.col("cy"), outline)
    coverage = F.when(inside, F.lit(sweep_width / spacing)).otherwise(0.0)
    return cells.select("cell_id", coverage.alias("coverage"), inside.alias("in_assignment")).withColumn("pod", exponential_pod(F.col("coverage")))


def achieved_pod(cells: DataFrame, legs: DataFrame, grid: Grid, outline: list[tuple[float, float]], sweep_width: float, clip_buffer: float = 0.0) -> DataFrame:
    """(cell_id, coverage, pod, in_assignment) from walked legs; cells off the assignment count within ``clip_buffer`` of its outline."""
    length = rasterize_legs(legs, grid, [])
    inside = in_polygon(F.col("cx"), F.col("cy"), outline)
    near = inside | (polyline_distance(F.col("cx"), F.col("cy"), outline + outline[:1]) <= clip_buffer)
    j = cells.withColumns({"in_assignment": inside, "near_": near}).join(length, "cell_id", "left")
    coverage = F.when(F.col("near_"), F.coalesce(F.col("length") * sweep_width / grid.cell_area, F.lit(0.0))).otherwise(0.0)
    return j.select("cell_id", coverage.alias("coverage"), "in_assignment").withColumn("pod", exponential_pod(F.col("coverage")))


def summarise(pod: DataFrame) -> DataFrame:
    """(cells, mean_coverage, mean_pod) over the assignment's cells; 0 without any."""
    return pod.where("in_assignment").agg(F.count("*").alias("cells"), F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("mean_coverage"), F.coalesce(F.avg("pod"), F.lit(0.0)).alias("mean_pod"))


def combine_pod_surfaces(pods: DataFrame, by: list[str], dependence: float = 0.0) -> DataFrame:
    """The cumulative detection per cell over several surfaces."""
    from cairngrid.operators.updates import cumulative_pod

    return cumulative_pod(pods, by, dependence)


def sweep_table(spark: SparkSession, rows=EXERCISE_SWEEP_WIDTHS) -> DataFrame:
    """(seq, resource, vegetation, slope, responsive, unresponsive, clue): half and a quarter of the responsive width."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, resource string, vegetation string, slope string, responsive double")
    return df.withColumns({"unresponsive": F.col("responsive") / 2, "clue": F.col("responsive") / 4})


def lookup_sweep_width(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``wanted`` (key, resource, vegetation, slope) with the widths of the exact slope, else of "any", else nulls; of equal rows the first."""
    t = table.select("seq", "resource", "vegetation", F.col("slope").alias("slope_"), *SEARCH_OBJECTS)
    j = wanted.join(F.broadcast(t), ["resource", "vegetation"], "left").where((F.col("slope_") == F.col("slope")) | (F.col("slope_") == "any") | F.col("slope_").isNull())
    best = j.groupBy(key).agg(F.min(F.struct((F.col("slope_") != F.col("slope")).cast("int").alias("off"), "seq", *SEARCH_OBJECTS)).alias("b"))
    return wanted.join(best, key, "left").select(*wanted.columns, *[F.col(f"b.{c}").alias(c) for c in SEARCH_OBJECTS])


def pod_class(pod: Column, medium: float = 0.5, high: float = 0.75) -> Column:
    if not 0 < medium < high < 1:
        raise ValueError("0 < medium < high < 1 must hold")
    return F.when(pod >= high, "HIGH").when(pod >= medium, "MEDIUM").when(pod.isNotNull(), "LOW")


def planned_segment_pod(segments: DataFrame, key: str, spacing: str = "spacing") -> DataFrame:
    """(key, object, coverage, pod, class) for each search object of segments that carry widths; no width gives nulls."""
    each = F.array(*[F.struct(F.lit(o).alias("object"), F.col(o).alias("width")) for o in SEARCH_OBJECTS])
    rows = segments.select(key, spacing, F.explode(each).alias("o")).select(key, "o.object", (F.col("o.width") / F.col(spacing)).alias("coverage"))
    return rows.withColumn("pod", exponential_pod(F.col("coverage"))).withColumn("class", pod_class(F.col("pod")))


def segment_plans(segments: DataFrame, defaults: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Plans per segment: an override's values where given, else the single row of defaults; no spacing or a spacing of 0 or less is left out."""
    d = defaults.select(*[F.col(c).alias(f"d_{c}") for c in defaults.columns])
    j = segments.crossJoin(F.broadcast(d)).join(overrides, key, "left")
    return j.select(key, *[F.coalesce(c, f"d_{c}").alias(c) for c in defaults.columns]).where("spacing > 0")


def track_legs(points: DataFrame, key: str = "track_id") -> DataFrame:
    """(key, ax, ay, bx, by) between consecutive points of each track, by seq."""
    w = W.partitionBy(key).orderBy("seq")
    rows = points.withColumns({"ax": F.lag("x").over(w), "ay": F.lag("y").over(w)})
    return rows.where("ax is not null").select(key, "ax", "ay", F.col("x").alias("bx"), F.col("y").alias("by"))
