"""Bayesian updates of surfaces (cell_id, p, outside)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairngrid.functions.geometry import distance
from cairngrid.operators.surface import _with_sums, checkpointed, normalize, running_before

EXTREME_SPREAD = 100.0


def apply_likelihood(prior: DataFrame, field: DataFrame, lr_outside: float | Column = 1.0, by: list[str] = ()) -> DataFrame:
    """(by, cell_id, p, outside, z): posterior in proportion to prior times likelihood ratio ``lr`` of ``field``."""
    by = list(by)
    out = lr_outside if isinstance(lr_outside, Column) else F.lit(float(lr_outside))
    j = prior.join(field.select(*by, "cell_id", "lr"), [*by, "cell_id"], "left")
    return normalize(j.withColumns({"mass": F.col("p") * F.col("lr"), "outside_mass": F.col("outside") * out}), by)


def chain_updates(prior: DataFrame, fields: list[tuple[DataFrame, float]], by: list[str] = ()) -> DataFrame:
    """(by, cell_id, p, outside, z1 ... zn): the posterior after several likelihood fields (cell_id, lr) with their ratio outside, and every step's z.

    Updates multiply, so masses are carried along without being normalised in between: all sums come from one aggregate, and a session of n
    updates reads the prior twice (once for the sums), not 2 ** n times. Cells that a field lacks keep their mass.
    """
    by = list(by)
    j, out = prior.withColumns({"m0": F.col("p"), "o0": F.col("outside")}), F.col("outside")
    for k, (field, lr_outside) in enumerate(fields, 1):
        out = out * float(lr_outside)
        j = j.join(field.select(*by, "cell_id", F.col("lr").alias(f"lr{k}")), [*by, "cell_id"], "left")
        j = j.withColumns({f"m{k}": F.col(f"m{k - 1}") * F.coalesce(f"lr{k}", F.lit(1.0)), f"o{k}": out})
    n = len(fields)
    sums = _with_sums(j, by, **{f"s{k}": F.sum(f"m{k}") + F.max(f"o{k}") for k in range(n + 1)})
    bad = ~((F.col(f"s{n}") > 0) & (F.col(f"s{n}") < float("inf")))
    total = F.when(bad, F.raise_error(F.lit("masses must be finite and nonnegative with a positive sum")).cast("double")).otherwise(F.col(f"s{n}"))
    return sums.select(*by, "cell_id", (F.col(f"m{n}") / total).alias("p"), (F.col(f"o{n}") / total).alias("outside"), *[(F.col(f"s{k}") / F.col(f"s{k - 1}")).alias(f"z{k}") for k in range(1, n + 1)])


def summarize_likelihood(field: DataFrame, lr_outside: float) -> DataFrame:
    """(min_lr, max_lr, spread, extreme) over cells and outside; a smallest ratio of 0 has an infinite spread."""
    s = field.agg(F.least(F.min("lr"), F.lit(float(lr_outside))).alias("min_lr"), F.greatest(F.max("lr"), F.lit(float(lr_outside))).alias("max_lr"))
    spread = F.when(F.col("min_lr") > 0, F.try_divide("max_lr", "min_lr")).otherwise(F.lit(float("inf")))
    return s.withColumn("spread", spread).withColumn("extreme", F.col("spread") > EXTREME_SPREAD)


def combined_credibility(reliability: float, relevance: float) -> float:
    if not (0 <= reliability <= 1 and 0 <= relevance <= 1):
        raise ValueError("reliability and relevance must be in [0, 1]")
    return reliability * relevance


def kernel_likelihood(kernel: DataFrame, q: float | Column) -> DataFrame:
    """Kernel mass ``f`` per cell to likelihood ratios: lr = 1 - q + q * n * f with n cells; outside 1 - q."""
    q = q if isinstance(q, Column) else F.lit(float(q))
    n = kernel.agg(F.count("*").alias("n_"))
    return kernel.crossJoin(F.broadcast(n)).withColumn("lr", 1 - q + q * F.col("n_") * F.col("f")).withColumn("lr_outside", 1 - q).drop("n_")


def gaussian_kernel(cells: DataFrame, x: float, y: float, sigma: float, cell_area: float) -> DataFrame:
    """(cell_id, f): normal density times cell area at the centres; scaled down only if its sum exceeds 1."""
    d = distance(F.col("cx"), F.col("cy"), F.lit(float(x)), F.lit(float(y)))
    k = cells.select("cell_id", (cell_area / (2 * math.pi * sigma * sigma) * F.exp(-(d * d) / (2 * sigma * sigma))).alias("f"))
    return k.crossJoin(F.broadcast(k.agg(F.greatest(F.lit(1.0), F.sum("f")).alias("s")))).select("cell_id", (F.col("f") / F.col("s")).alias("f"))


def wedge_kernel(cells: DataFrame, x: float, y: float, bearing: float, half_angle: float, reach: float, cell_area: float) -> DataFrame:
    """(cell_id, f): equal mass on the cells inside a wedge (bearing clockwise from north), at most all of it."""
    dx, dy = F.col("cx") - x, F.col("cy") - y
    d = F.sqrt(dx * dx + dy * dy)
    at = F.degrees(F.atan2(dx, dy))
    diff = F.abs((((at - bearing) % 360) + 540) % 360 - 180)
    inside = cells.withColumn("in_", (d > 0) & (d <= reach) & (diff <= half_angle))
    n = inside.agg(F.sum(F.col("in_").cast("long")).alias("n_"))
    area = math.radians(2 * half_angle) / 2 * reach * reach
    share = F.when(F.col("in_"), F.least(F.lit(1.0), F.col("n_") * cell_area / area) / F.col("n_")).otherwise(0.0)
    return inside.crossJoin(F.broadcast(n)).select("cell_id", share.alias("f"))


def no_find_update(prior: DataFrame, pod: DataFrame, by: list[str] = (), allow_certain: bool = False) -> DataFrame:
    """Posterior after an unsuccessful search: mass times 1 - pod; cells without a row of ``pod`` were not searched."""
    by = list(by)
    j = prior.join(pod.select(*by, "cell_id", "pod"), [*by, "cell_id"], "left").withColumn("pod", F.coalesce("pod", F.lit(0.0)))
    ok = F.col("pod").between(0, 1) & (F.lit(allow_certain) | (F.col("pod") < 1))
    keep = F.when(ok, 1 - F.col("pod")).otherwise(F.raise_error(F.lit("detection must be in [0, 1), or 1 if allowed")).cast("double"))
    return normalize(j.withColumns({"mass": F.col("p") * keep, "outside_mass": F.col("outside")}), by)


def probability_of_success(prior: DataFrame, pod: DataFrame, by: list[str] = ()) -> DataFrame:
    j = prior.join(pod.select(*by, "cell_id", "pod"), [*by, "cell_id"])
    agg = F.sum(F.col("p") * F.col("pod")).alias("pos")
    return j.groupBy(*by).agg(agg) if by else j.agg(agg)


def cumulative_pod(pods: DataFrame, by: list[str], dependence: float, pod: str = "pod") -> DataFrame:
    """(by, pod): 1 - prod(1 - pod), moved by ``dependence`` towards the best single search."""
    both = pods.groupBy(*by).agg((1 - F.product(1 - F.col(pod))).alias("ind"), F.max(pod).alias("best"))
    return both.select(*by, (F.col("ind") - dependence * (F.col("ind") - F.col("best"))).alias("pod"))


def _rationale(text: str) -> None:
    if len(text.strip()) < 10:
        raise ValueError("a rationale of at least 10 characters is needed")


def apply_manual_adjustment(prior: DataFrame, factors: DataFrame, rationale: str, outside_factor: float = 1.0, by: list[str] = ()) -> DataFrame:
    _rationale(rationale)
    return apply_likelihood(prior, factors.select(*by, "cell_id", F.col("factor").alias("lr")), outside_factor, by)


def set_outside_probability(surface: DataFrame, outside: float, rationale: str) -> DataFrame:
    _rationale(rationale)
    if not 0 <= outside < 1:
        raise ValueError("the probability outside must be in [0, 1)")
    return surface.select("cell_id", (F.col("p") * (1 - outside) / (1 - F.col("outside"))).alias("p"), F.lit(float(outside)).alias("outside"))


def transfer_summary(prior: DataFrame, posterior: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moved) and (zone, prior, posterior, change): half the absolute change, outside included; zones (cell_id, zone)."""
    j = prior.select("cell_id", F.col("p").alias("a"), F.col("outside").alias("oa")).join(posterior.select("cell_id", F.col("p").alias("b"), F.col("outside").alias("ob")), "cell_id")
    moved = j.agg(((F.sum(F.abs(F.col("b") - F.col("a"))) + F.max(F.abs(F.col("ob") - F.col("oa")))) / 2).alias("moved"))
    names = zones.select("zone").distinct()
    z = j.join(zones, "cell_id").groupBy("zone").agg(F.sum("a").alias("prior"), F.sum("b").alias("posterior"))
    z = names.join(z, "zone", "left").select("zone", F.coalesce("prior", F.lit(0.0)).alias("prior"), F.coalesce("posterior", F.lit(0.0)).alias("posterior"))
    return moved, z.withColumn("change", F.col("posterior") - F.col("prior"))


def sensitivity(prior: DataFrame, kernel: DataFrame, reliability: float, relevance: float, spread: float = 0.2) -> DataFrame:
    """(variant, cell_id, p, outside, z) for credibility low, central and high: both factors shifted by ``spread`` and clamped."""
    clamp = lambda v: min(1.0, max(0.0, v))
    spark = prior.sparkSession
    variants = spark.createDataFrame([(n, clamp(reliability + s) * clamp(relevance + s)) for n, s in (("low", -spread), ("central", 0.0), ("high", spread))], "variant string, q double")
    field = kernel_likelihood(kernel, 0.0).select("cell_id", "f").crossJoin(F.broadcast(variants)).crossJoin(F.broadcast(kernel.agg(F.count("*").alias("n_"))))
    field = field.select("variant", "cell_id", "q", (1 - F.col("q") + F.col("q") * F.col("n_") * F.col("f")).alias("lr"))
    j = prior.join(field, "cell_id")
    return normalize(j.withColumns({"mass": F.col("p") * F.col("lr"), "outside_mass": F.col("outside") * (1 - F.col("q"))}), ["variant"])


def highest_density(surface: DataFrame, level: float | Column, by: list[str]) -> DataFrame:
    """The smallest set of most probable cells of each surface that reaches ``level``; empty where a surface never does.

    A level may be a column of the keys. Ties go to the smaller cell id. Cells are summed in ranges, so neither many surfaces nor one large one meet in one task.
    """
    by, level = list(by), level if isinstance(level, Column) else F.lit(float(level))
    surface = checkpointed(surface)
    totals = surface.groupBy(*by).agg(F.sum("p").alias("total_"))
    enough = totals.where(F.col("total_") >= level).select(*by)
    rows = surface.join(enough, by) if by else surface.crossJoin(F.broadcast(enough.select(F.lit(True).alias("ok_")))).drop("ok_")
    return running_before(rows, by, [F.desc("p"), F.asc("cell_id")], "p", "before").where(F.col("before") < level)
