"""Probability surfaces: cells (keys..., cell_id, p) with the mass outside the grid as a column of every row.

All operators work on many surfaces at once, told apart by the key columns ``by``; a surface is a
thin set of rows, so the sums behind a normalisation are partial aggregates and one join on the keys.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOLERANCE = 1e-10


def _with_sums(df: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """``df`` with aggregates per key; without keys the single row of sums is broadcast."""
    if by:
        return df.join(df.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()]), by)
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in sums.items()])))


def normalize(masses: DataFrame, by: list[str] = (), mass: str = "mass", outside: str = "outside_mass") -> DataFrame:
    """(by, cell_id, p, outside, z): divide by z, the mass of all cells plus the mass outside.

    Negative or non-finite masses, and a z that is not positive and finite, raise an error.
    """
    by = list(by)
    bad = F.isnan(mass) | F.col(mass).isNull() | (F.col(mass) < 0) | (F.abs(mass) == float("inf")) | F.isnan(outside) | F.col(outside).isNull() | (F.col(outside) < 0) | (F.abs(outside) == float("inf"))
    s = _with_sums(masses, by, z_=F.sum(mass) + F.max(outside), bad_=F.max(bad.cast("int")))
    z = F.when((F.col("bad_") == 1) | ~((F.col("z_") > 0) & (F.col("z_") < float("inf"))), F.raise_error(F.lit("masses must be finite and nonnegative with a positive sum")).cast("double")).otherwise(F.col("z_"))
    return s.withColumn("z", z).select(*by, "cell_id", (F.col(mass) / F.col("z")).alias("p"), (F.col(outside) / F.col("z")).alias("outside"), "z")


def check_invariants(surface: DataFrame, by: list[str] = (), cell_count: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per surface: what breaks its invariants (n_cells, n_bad, total, problems array)."""
    bad = F.col("p").isNull() | F.isnan("p") | (F.col("p") < 0) | (F.abs("p") == float("inf"))
    agg = [F.count("*").alias("n_cells"), F.sum(bad.cast("long")).alias("n_bad"), F.max("outside").alias("outside"), (F.sum("p") + F.max("outside")).alias("total")]
    s = surface.groupBy(*by).agg(*agg) if by else surface.agg(*agg)
    problems = F.array_compact(
        F.array(
            F.when(F.col("n_cells") != cell_count, "cell count") if cell_count is not None else F.lit(None).cast("string"),
            F.when(F.col("n_bad") > 0, "negative or non-finite cell"),
            F.when(~F.col("outside").between(0, 1), "outside not in [0, 1]"),
            F.when(F.abs(F.col("total") - 1) > tolerance, "sum is not 1"),
        )
    )
    return s.withColumn("problems", problems)


def densities(surface: DataFrame, cell_area: float) -> DataFrame:
    return surface.withColumn("density", F.col("p") / cell_area)


def in_domain_probability(surface: DataFrame, by: list[str] = ()) -> DataFrame:
    agg = F.sum("p").alias("in_domain")
    return surface.groupBy(*by).agg(agg) if by else surface.agg(agg)


def _shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names (``spark.checkpoint.dir``); a temporary one only in local sessions without it."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="cairngrid-checkpoint-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` evaluated once, in the shared checkpoint folder."""
    _shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` evaluated once, as Parquet below the shared checkpoint folder: columns can be read alone."""
    path = f"{_shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def running_before(df: DataFrame, by: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before each one in the given order, per key.

    Rows are dealt out in ranges of keys and order, summed within their range, and the ranges' totals (one row each) are carried on: a
    single surface does not meet in one task.
    """
    ranges = checkpointed(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("range_", F.spark_partition_id()))
    totals = ranges.groupBy(*by, "range_").agg(F.sum(value).alias("sum_"))
    carried = F.sum("sum_").over(W.partitionBy(*by).orderBy("range_").rowsBetween(W.unboundedPreceding, -1))
    base = totals.select(*by, "range_", F.coalesce(carried, F.lit(0)).alias("base_"))
    inside = F.sum(value).over(W.partitionBy(*by, "range_").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    # without keys there is one row per range; with many surfaces Spark chooses by size
    return ranges.withColumn("in_", F.coalesce(inside, F.lit(0))).join(base if by else F.broadcast(base), [*by, "range_"]).withColumn(name, F.col("base_") + F.col("in_")).drop("range_", "in_", "base_")
