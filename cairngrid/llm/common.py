"""Helpers that several corpus operators share: checkpoints, table access, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids that a filter may broadcast; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of one key that a join may bring to one task; a key with more of them is broadcast.
HOT_ROWS = 10_000
#: Links of one task, about, where a graph has few of them, and up to how many links it has few.
PART_LINKS = 50_000
FEW_LINKS = 1_000_000
BATCH = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent (local tests) a temporary folder is set as the checkpoint folder.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="cairngrid-checkpoint-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Evaluate ``df`` once and keep it in the shared checkpoint folder, so lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, group: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back: columns can be read alone.

    ``group``: rows of a Parquet row group, for rows of megabytes: writer and reader hold a row group at once, and by themselves look at its size only every 100 rows.
    """
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.options(**{"parquet.block.row.count.limit": group} if group else {}).parquet(path)
    return df.sparkSession.read.parquet(path)


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with as many underscores after it as it takes that no column name begins with it."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(wanted.lower()) for c in taken):
        wanted += "_"
    return wanted


def append(df: DataFrame, inputs: list[str], outputs: str, make: Callable[[list[list]], list[pa.Array]]) -> DataFrame:
    """``df`` with further columns, made in Python from batches of the columns ``inputs``.

    ``outputs`` is their DDL; a column of ``df`` with one of these names (upper or lower case) is read where it is an
    input, and replaced in the result. No join is needed to bring results to their rows.
    """
    new = T.StructType.fromDDL(outputs)
    made = {n.lower() for n in new.names}
    lower = [c.lower() for c in df.columns]
    keep = [k for k, c in enumerate(lower) if c not in made]
    at = [lower.index(c.lower()) for c in inputs]
    names = [*(df.columns[k] for k in keep), *new.names]

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, BATCH):
                part = b.slice(start, BATCH)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *make([part.column(i).to_pylist() for i in at])], names=names)

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[k] for k in keep), *new.fields]))


def plain_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is all rows of the Parquet files of one path and nothing else."""
    files = docs.inputFiles()
    if not files or "_metadata" in (c.lower() for c in docs.columns):
        return False
    first = files[0].removeprefix("file://")  # as a path is given to the reader
    try:
        return any(docs.sameSemantics(docs.sparkSession.read.parquet(r)) for r in [*[first] * (len(files) == 1), first.rsplit("/", 1)[0]])
    except (PySparkException, Py4JJavaError):  # the folder is no single table
        return False


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a row number of its own for every row, the same whenever it is read, and that column's name.

    Rows of plain Parquet files are numbered by file and place in the file, without a copy; anything else is numbered and stored.
    """
    name = free_name(docs.columns, "row_number")
    if not plain_scan(docs):
        return stored(docs.withColumn(name, F.monotonically_increasing_id())), name
    file = f"{name}_file"
    placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(name))
    paths = sorted(r[0] for r in placed.select(file).distinct().collect())  # one per file
    numbers = docs.sparkSession.createDataFrame([(p, k) for k, p in enumerate(paths)], f"{file} string, {name}_base long")
    number = F.shiftleft(f"{name}_base", 40).bitwiseOR(F.col(name))
    return placed.join(F.broadcast(numbers), file).select(*docs.columns, number.alias(name)), name


def without_rows(rows: DataFrame, number: str, gone: DataFrame) -> DataFrame:
    """The rows whose number is not in the one-column frame ``gone``, without their numbers."""
    gone = cut(gone.toDF(number).distinct())
    small = gone.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if small else gone, number, "left_anti").drop(number)


def join_named(rows: DataFrame, named: DataFrame, key: str, size: str, hot: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with ``named`` (one row per ``key``; column ``size`` says how many rows have it).

    Keys of more than ``hot`` rows are few, rows / hot at most: they are broadcast, so their rows stay where they are; the others are
    joined by a shuffle. ``named`` should be cut. Past BROADCAST_IDS hot keys all go by the shuffle, where skewed partitions are split.
    """
    large = named.where(F.col(size) > hot)
    n = large.limit(BROADCAST_IDS + 1).count()
    if not 0 < n <= BROADCAST_IDS:
        return rows.join(named, key)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti")
    return rows.join(F.broadcast(large), key).unionByName(rest.join(named.where(F.col(size) <= hot), key))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest reachable id for every id that occurs in ``edges`` (undirected, long columns ``a`` and ``b``).

    Alternating star contraction: the large step hangs every larger neighbour under the smallest id
    around, the small step does the same with the smaller ones, until nothing moves. Each step is
    grouped minima and an equi-join on ids, so no component meets in one task; the edges between
    steps are checkpointed. A graph of few links takes few tasks a step, not as many as there are shuffle partitions: there are dozens of
    stages, and the driver keeps a record of every task. Null ids and self-links are ignored; repeated links count once.
    Returns (id, component_id).
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        # each row: u with a neighbour v; the small step keeps only v < u
        rows = e.select(F.col("u").alias("n"), F.col("v").alias("w"))
        if not small:
            rows = rows.unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("w")))
        low = few(rows.groupBy("n").agg(F.min("w").alias("m")).withColumn("m", F.least("n", "m")))
        out = few(rows.join(low, "n"))
        if small:
            out = out.select(F.explode(F.array(F.struct(F.col("n").alias("u"), F.col("m").alias("v")), F.struct(F.col("w").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        else:
            out = out.where("w > n").select(F.col("w").alias("u"), F.col("m").alias("v"))
        return few(out.where("u <> v").distinct())

    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok")).where("ok and u <> v").select("u", "v").distinct()
    e = cut(e)
    n = e.count()
    few = (lambda df: df.coalesce(1 + n // PART_LINKS)) if n <= FEW_LINKS else (lambda df: df)
    e, mark = few(e), None
    while True:
        e = cut(star(star(e, False), True))
        # a forest of stars is reached when a further step would not change the set of edges
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    low = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))
    return low.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
