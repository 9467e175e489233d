"""From raw documents to token files, with operators of ``cairngrid.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads
again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngrid.llm import decontaminate, langid, mixing, simhash, token_output
from cairngrid.llm.common import free_name, numbered, shared_dir, table, without_rows


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of which no language can be told: a null text, or one without a letter."""
    model, prefix = langid.train(docs.where(~langid.held_out())), free_name(docs.columns, "pred_")
    return langid.with_language(docs, model, prefix=prefix).where(F.col(f"{prefix}lang") != langid.UNKNOWN).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies one row stays: that of the smallest id (rows without one come last), then of the smallest text hash.

    Rows are told apart by a number of their own, so rows that share an id, or have none, are judged each by its text.
    """
    rows, number = numbered(docs)
    found = simhash.simhash_dedup(rows, id_col=number)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col(number).alias("id"))
    groups = found.join(rows.select(F.col(number).alias("id"), order.alias("place")), "id")
    best = groups.groupBy("component_id").agg(F.min("place")["id"].alias("id"))
    return without_rows(rows, number, found.select("id").join(best.select("id"), "id", "left_anti"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go, each judged by its own text."""
    rows, number = numbered(docs)
    found = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=number, slop=None)
    return without_rows(rows, number, found.where("contaminated").select("doc_id"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their fitted rate says."""
    prefix = free_name(docs.columns, "mix_")
    out = mixing.mix(docs, mixing.labelled(table(spark, sf_dir, "labels")), mixing.TARGETS, prefix=prefix)
    copies = F.col(f"{prefix}copies").cast("int")
    return out.where(copies > 0).withColumn(f"{prefix}n", F.explode(F.sequence(F.lit(1), copies))).select(docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; returns each stored document's place, length and checksum."""
    return token_output.token_output(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_domains),
    ("token-ID / binary output", write_tokens),
]

#: Fitted models and an external tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
