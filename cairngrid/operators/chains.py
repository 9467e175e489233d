"""Order along chains: rows that name the row before them, ranked by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngrid.operators.surface import checkpointed


def _doubled(links: DataFrame) -> DataFrame:
    """(node, top, far, open, low) after as many rounds as it takes: ``top`` is the chain's first node and ``far`` the way from there, or,
    where ``open``, the node lies on a cycle and ``low`` is its smallest node.

    Every round doubles how far a node sees, so a chain of n nodes takes log2(n) joins.
    """
    first = F.col("prev").isNull()
    cur = checkpointed(links.select("node", F.coalesce("prev", "node").alias("top"), F.when(first, 0).otherwise(F.col("step")).cast("long").alias("far"), (~first).alias("open"), F.least("node", "prev").alias("low")))
    seen = None
    while True:
        now = cur.agg(F.count_if("open"), F.sum(F.when(F.col("open"), F.xxhash64("low").cast("decimal(38,0)")))).first()
        if not now[0] or now == seen:  # nothing is open, or a round has changed no cycle's smallest node
            return cur
        seen = now
        onward = cur.select(F.col("node").alias("top"), F.col("top").alias("top_"), F.col("far").alias("far_"), F.col("open").alias("open_"), F.col("low").alias("low_"))
        moved = cur.where("open").join(onward, "top").select("node", F.col("top_").alias("top"), (F.col("far") + F.col("far_")).alias("far"), F.col("open_").alias("open"), F.least("low", "low_").alias("low"))
        cur = checkpointed(cur.where("not open").unionByName(moved))


def chain_order(links: DataFrame) -> DataFrame:
    """(node, head, far): each node's chain, named by its first node, and the sum of ``step`` from there to the node.

    ``links`` has (node, prev, step): the node before, null at a chain's start, and the way from it. A node comes before one other at most. A cycle starts
    at its smallest node. No chain meets in one task.
    """
    got = _doubled(links)
    straight = got.where("not open").select("node", F.col("top").alias("head"), "far")
    round_ = got.where("open").select("node", "low")
    if round_.isEmpty():
        return straight
    cut = links.join(round_, "node").select("node", F.when(F.col("node") != F.col("low"), F.col("prev")).alias("prev"), "step")
    return straight.unionByName(_doubled(cut).select("node", F.col("top").alias("head"), "far"))
