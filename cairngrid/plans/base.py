"""Registration of catalogue queries and the raster that the part table stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngrid.functions.geometry import Grid

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
DIGITS = 9

#: A 50-column raster of 100 m cells; rows follow the table's size.
COLS, CELL = 50, 100.0

CELLS = f"""cells AS (
  SELECT p_partkey AS cell_id, (p_partkey % {COLS} + 0.5e0) * 100e0 AS cx, (p_partkey // {COLS} + 0.5e0) * 100e0 AS cy,
         p_size, p_retailprice, p_brand, p_size > 5 AS ok
  FROM part)"""


def query(sql: str | None = None):
    """Register a query function under its name, with its DuckDB SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def grid(rows: int = 1) -> Grid:
    return Grid(0.0, 0.0, CELL, COLS, rows)


def cells(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("cell_id"), "p_size", "p_retailprice", "p_brand", (F.col("p_size") > 5).alias("ok"))
    return grid().with_centres(p)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def literal(spark: SparkSession, ddl: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def points(spark: SparkSession, d: str) -> DataFrame:
    """Events as tracks: user as track, time as t, position from value and id."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("seq0"), (F.col("value") * 10).alias("x"), (F.col("event_id") % 100).cast("double").alias("y"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
