"""Prior surfaces."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngrid.functions.geometry import distance, polyline_distance
from cairngrid.operators.surface import normalize


def _check_outside(outside: float) -> None:
    if not 0 <= outside < 1:
        raise ValueError("the probability outside must be in [0, 1)")


def _scaled(cells: DataFrame, weight: Column, outside: float, by: list[str]) -> DataFrame:
    """Weights per cell brought to a sum of 1 - outside."""
    m = cells.withColumns({"mass": weight, "outside_mass": F.lit(0.0)})
    s = normalize(m, by)
    return s.select(*by, "cell_id", (F.col("p") * (1 - outside)).alias("p"), F.lit(float(outside)).alias("outside"))


def uniform_prior(cells: DataFrame, outside: float, mask: Column | None = None, by: list[str] = ()) -> DataFrame:
    """Equal probability on every unmasked cell; all cells masked is an error."""
    _check_outside(outside)
    return _scaled(cells, F.coalesce(mask, F.lit(False)).cast("double") if mask is not None else F.lit(1.0), outside, list(by))


def validate_ring_table(breaks: DataFrame) -> DataFrame:
    """(table_id, seq, problem) of ring tables given as (table_id, seq, distance_m, cumulative, tail_m)."""
    w = W.partitionBy("table_id").orderBy("seq")
    last = F.lead("seq").over(w).isNull()
    rows = breaks.withColumns({"d0": F.lag("distance_m", 1, 0.0).over(w), "c0": F.lag("cumulative", 1, 0.0).over(w), "last": last})
    checks = F.array_compact(
        F.array(
            F.when(~(F.col("distance_m") > F.col("d0")), "distance does not increase"),
            F.when((F.col("cumulative") < F.col("c0")) | (F.col("cumulative") > 1), "cumulative probability decreases or exceeds 1"),
            F.when(F.col("last") & (F.col("cumulative") < 1 - 1e-10) & F.col("tail_m").isNull(), "no tail distance"),
            F.when(F.col("last") & (F.col("tail_m") <= F.col("distance_m")), "tail inside last ring"),
        )
    )
    return rows.select("table_id", "seq", F.explode(checks).alias("problem"))


def rings_from_table(breaks: DataFrame) -> DataFrame:
    """(table_id, inner, outer, prob) annuli of ring tables, with the tail ring where there is one."""
    w = W.partitionBy("table_id").orderBy("seq")
    rows = breaks.withColumns({"inner": F.lag("distance_m", 1, 0.0).over(w), "c0": F.lag("cumulative", 1, 0.0).over(w), "last": F.lead("seq").over(w).isNull()})
    rings = rows.select("table_id", "inner", F.col("distance_m").alias("outer"), (F.col("cumulative") - F.col("c0")).alias("prob"))
    tail = rows.where(F.col("last") & (F.col("cumulative") < 1 - 1e-10) & F.col("tail_m").isNotNull()).select("table_id", F.col("distance_m").alias("inner"), F.col("tail_m").alias("outer"), (1 - F.col("cumulative")).alias("prob"))
    return rings.unionByName(tail)


def gaussian_offsets(sigma: float, cell_size: float) -> list[tuple[float, float, float]]:
    """(dx, dy, weight) of a position uncertainty: one point up to a quarter cell, else a lattice of 0.75 sigma within 3 sigma."""
    if not sigma > cell_size / 4:
        return [(0.0, 0.0, 1.0)]
    step, out = 0.75 * sigma, []
    for i in range(-4, 5):
        for j in range(-4, 5):
            r2 = ((i * 0.75) ** 2) + ((j * 0.75) ** 2)
            if r2 <= 9:
                out.append((i * step, j * step, math.exp(-r2 / 2)))
    total = sum(w for *_, w in out)
    return [(x, y, w / total) for x, y, w in out]


def distance_ring_prior(spark: SparkSession, cells: DataFrame, point: tuple[float, float], rings: list[tuple[float, float, float]], cell_size: float, sigma: float = 0.0, mask: Column | None = None) -> DataFrame:
    """(cell_id, p, outside) from annuli (inner, outer, prob) around an uncertain point.

    Each offset of the point counts its rings' cells; a ring's probability spreads over its analytic area, at most all
    of it over its unmasked cells, and what falls off the grid or on no valid cell goes outside. The offsets, 49 at most, are an array
    inside each cell's row: the counts per (offset, ring) are a partial aggregate of at most 49 x rings rows, their shares come back as one
    broadcast row, and no cell is shuffled: a small table of many cells is dealt out by the caller.
    """
    area, k = cell_size * cell_size, len(rings)
    offsets = gaussian_offsets(sigma, cell_size)

    def slot(n: int, x: float, y: float) -> Column:
        """offset * rings + ring of a cell, null beyond the last ring."""
        d = distance(F.col("cx"), F.col("cy"), F.lit(float(point[0] + x)), F.lit(float(point[1] + y)))
        out = F.lit(None).cast("int")
        for r in range(k - 1, -1, -1):
            out = F.when(d < rings[r][1], F.lit(n * k + r)).otherwise(out)
        return out

    valid = F.coalesce(mask, F.lit(False)) if mask is not None else F.lit(True)
    placed = cells.select("cell_id", valid.alias("valid"), F.array(*[slot(n, x, y) for n, (x, y, _) in enumerate(offsets)]).alias("slots"))
    table = spark.createDataFrame([(n * k + r, float(w), float(p), math.pi * (o * o - i * i)) for n, (_, _, w) in enumerate(offsets) for r, (i, o, p) in enumerate(rings)], "slot int, w double, prob double, annulus double")
    each = placed.select("valid", F.explode("slots").alias("slot")).where("slot is not null")
    count = each.groupBy("slot").agg(F.sum(F.col("valid").cast("long")).alias("nv"), F.sum((~F.col("valid")).cast("long")).alias("nm")).join(F.broadcast(table), "slot")
    usable = F.greatest(F.col("annulus") - F.col("nm") * area, F.col("nv") * area)
    share = count.where("nv > 0").select("slot", "nv", (F.col("w") * F.col("prob") * F.least(1 / F.col("nv"), area / usable)).alias("share"))
    one = share.agg(F.map_from_entries(F.collect_list(F.struct("slot", "share"))).alias("shares"), F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum(F.col("share") * F.col("nv")), F.lit(0.0))).alias("outside"))
    one = one.select(F.transform(F.sequence(F.lit(0), F.lit(len(offsets) * k - 1)), lambda s: F.coalesce(F.col("shares")[s], F.lit(0.0))).alias("shares"), "outside")
    p = F.lit(0.0)
    for n in range(len(offsets)):
        p = p + F.coalesce(F.get("shares", F.get("slots", F.lit(n))), F.lit(0.0))
    return placed.crossJoin(F.broadcast(one)).select("cell_id", F.when(F.col("valid"), p).otherwise(0.0).alias("p"), "outside")


def route_corridor(cells: DataFrame, route: list[tuple[float, float]], decay: float, buffer: float, outside: float, mask: Column | None = None, by: list[str] = ()) -> DataFrame:
    """Weight exp(-d / decay) within ``buffer`` (inclusive) of a route, brought to 1 - outside."""
    _check_outside(outside)
    if len(route) < 2 or decay <= 0 or buffer <= 0:
        raise ValueError("a corridor needs two vertices and positive decay and buffer")
    near = cells.withColumn("d_", polyline_distance(F.col("cx"), F.col("cy"), route))
    ok = (F.col("d_") <= buffer) & (F.coalesce(mask, F.lit(False)) if mask is not None else F.lit(True))
    return _scaled(near, F.when(ok, F.exp(-F.col("d_") / decay)).otherwise(0.0), outside, list(by))


def mixture(components: list[tuple[str, float, DataFrame]]) -> DataFrame:
    """(cell_id, p, outside, contributions map<component, p>) of weighted surfaces (id, weight, surface).

    All components must have the same cells, each once; a cell that one of them lacks raises an error.
    """
    ids, weights = [i for i, *_ in components], [w for _, w, _ in components]
    if len(set(ids)) != len(ids) or any(not w >= 0 for w in weights) or abs(sum(weights) - 1) > 1e-10:
        raise ValueError("components need unique ids and nonnegative weights that sum to 1")
    rows = None
    for i, w, s in components:
        r = s.select(F.lit(i).alias("component"), "cell_id", (F.col("p") * w).alias("p"), (F.col("outside") * w).alias("outside"))
        rows = r if rows is None else rows.unionByName(r)
    both = rows.groupBy("cell_id").agg(F.sum("p").alias("p"), F.sum("outside").alias("outside"), F.array_sort(F.collect_list(F.struct("component", "p"))).alias("c"))
    whole = F.size("c") == len(components)
    return both.select("cell_id", F.when(whole, F.col("p")).otherwise(F.raise_error(F.lit("components must be surfaces of the same grid")).cast("double")).alias("p"), "outside", F.map_from_entries("c").alias("contributions"))


def route_weighted_prior(corridor: DataFrame, background: DataFrame, confidence: float) -> DataFrame:
    if not 0 <= confidence <= 0.9:
        raise ValueError("the corridor's confidence must be in [0, 0.9]")
    return mixture([("corridor", confidence, corridor), ("background", 1 - confidence, background)]).drop("contributions")


def reachable_prior(cells: DataFrame, cost: Column, most: float, outside: float, by: list[str] = ()) -> DataFrame:
    """Uniform over the cells whose cost is at most ``most``."""
    return uniform_prior(cells, outside, cost <= most, by)
