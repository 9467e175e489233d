"""Embedding near-duplicates by PCA-ordered tiled comparison.

All unit vectors are rotated onto the principal axes of the whole table, largest variance first. Tiles of
vectors are compared pairwise; inside a pair of tiles the products of the leading dimensions are added
up first, what the remaining dimensions can add is bounded by the product of the two suffix norms
(Cauchy-Schwarz), and rows, columns and in the end the whole tile are given up as soon as the cosine
cannot reach the threshold. A coarse grid over the leading axes, whose cells are at least as wide as the
largest distance of two linked unit vectors, leaves out pairs of tiles that lie too far apart: a vector stays in its own cell
and visits the earlier neighbour cells that it can reach, whose visitors share tiles whatever cell they come from.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngrid.llm.common import BROADCAST_IDS, connected_components, cut, join_named

THRESHOLD = 0.9
TILE_ROWS = 4096
BLOCK_ROWS = 512
GRID_AXES = 4
SLACK = 1e-9


def _matrix(column) -> np.ndarray:
    """A list column of equally long vectors as a matrix of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(axis=1, keepdims=True)  # keeps squares of huge and tiny components finite
    y = x / scale
    norm = np.sqrt((y * y).sum(axis=1, keepdims=True))
    return y / norm, x


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension d, the eigenvectors (columns, largest first) of the mean outer product of all unit vectors.

    Each task adds up its own d x d matrix; d squared rows per dimension reach the driver, however many vectors there are.
    """

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            col = b.column(0)
            size = pa.compute.list_value_length(col).to_numpy(zero_copy_only=False)
            for d in np.unique(size):
                u, _ = _unit(_matrix(col.filter(pa.array(size == d))))
                sums[int(d)] = sums.get(int(d), 0) + u.T @ u
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d), pa.int32()), pa.array(np.arange(d * d), pa.int32()), pa.array(m.ravel())], names=["d", "at", "value"])

    got: dict[int, np.ndarray] = {}
    for r in vectors.select("vec").mapInArrow(moments, "d int, at int, value double").groupBy("d", "at").agg(F.sum("value").alias("value")).toLocalIterator():
        got.setdefault(r.d, np.zeros(r.d * r.d))[r.at] = r.value
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy() for d, m in got.items()}


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` (rotated unit vectors) whose cosine may reach ``threshold``, by leading dimensions first."""
    d = a.shape[1]
    stops, k = [], max(4, d // 8)
    while k < d:
        stops.append(k)
        k *= 2
    stops.append(d)
    least, rows, cols = threshold - SLACK, np.arange(len(a)), np.arange(len(b))
    tail = lambda m, k: np.sqrt(np.maximum(0, (m[:, k:] ** 2).sum(axis=1)))
    part, at = np.zeros((len(a), len(b))), 0
    for k in stops:
        part += a[rows, at:k] @ b[cols, at:k].T
        at = k
        alive = part + np.outer(tail(a[rows], k), tail(b[cols], k)) >= least if k < d else part >= least
        if k == d or alive.sum() < 0.02 * alive.size:
            i, j = np.nonzero(alive)
            if k < d and len(i):  # few are left: finish these alone
                rest = np.concatenate([np.einsum("ij,ij->i", a[rows[i[s : s + 65536]], k:], b[cols[j[s : s + 65536]], k:]) for s in range(0, len(i), 65536)])
                ok = part[i, j] + rest >= least
                i, j = i[ok], j[ok]
            return rows[i], cols[j]
        r, c = alive.any(axis=1), alive.any(axis=0)
        part, rows, cols = part[np.ix_(r, c)], rows[r], cols[c]
    return rows[:0], cols[:0]


def cells_of(y: np.ndarray, width: float) -> tuple[np.ndarray, list[list[int]]]:
    """Per row of leading coordinates its grid cell, and the earlier ones (lexicographically) of the neighbour cells within ``width`` of it.

    Two vectors at most ``width`` apart share a cell, or the one in the later cell visits the other's. Cells are named by a 64-bit hash; names that
    collide only cost comparisons.
    """
    c = np.floor(y / width).astype(np.int64)
    low = y / width - c
    back = low**2, (1 - low) ** 2
    factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)[: c.shape[1]]
    name = lambda k: (k.astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64).view(np.int64)
    near: list[list[int]] = [[] for _ in range(len(y))]
    for step in itertools.product((-1, 0, 1), repeat=c.shape[1]):
        if step >= (0,) * c.shape[1]:
            continue
        far = sum((back[0] if s < 0 else back[1])[:, k] for k, s in enumerate(step) if s)
        at = np.nonzero(far <= 1 + 1e-9)[0]
        for k, v in zip(at.tolist(), name(c[at] + np.array(step)).tolist(), strict=True):
            near[k].append(v)
    return name(c), near


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of ``i`` and ``j``; a label is the smallest index of its class."""
    while len(i):
        hi, lo = np.maximum(label[i], label[j]), np.minimum(label[i], label[j])
        differ = hi != lo
        if not differ.any():
            break
        i, j = i[differ], j[differ]
        parent = np.arange(len(label))
        np.minimum.at(parent, hi[differ], lo[differ])
        while (nxt := parent[parent]).tolist() != parent.tolist():
            parent = nxt
        label = parent[label]
    return label


def _compare(axes: dict[int, np.ndarray], threshold: float, group: pa.Table) -> pa.Table:
    """Links between the two tiles of a group: per vector their number, counted by copies, and one root per local class."""
    x, side = _matrix(group.column("vec")), group.column("side").to_numpy()
    if group.column("kind")[0].as_py() == "x" and len(np.unique(side)) < 2:  # no visitor, or no one at home, in this pair of tiles
        return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    ids, copies = group.column("no").to_numpy(), group.column("copies").to_numpy()
    u, _ = _unit(x)
    y = u @ axes[x.shape[1]]
    order = np.lexsort((ids, side))
    y, u, ids, copies, side = y[order], u[order], ids[order], copies[order], side[order]
    same = side[-1] == 0
    right = np.arange(len(ids)) if same else np.nonzero(side == 1)[0]
    count, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for at in range(0, int((side == 0).sum()), BLOCK_ROWS):
        left = np.arange(at, min(at + BLOCK_ROWS, int((side == 0).sum())))
        cols = right[right > at] if same else right
        i, j = linked(y[left], y[cols], threshold)
        i, j = left[i], cols[j]
        if same:
            i, j = i[i < j], j[i < j]
        keep = np.concatenate([np.einsum("ij,ij->i", u[i[s : s + 65536]], u[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)]) >= threshold
        i, j = i[keep], j[keep]
        count += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
        label = _merge(label, i, j)
    hit = np.nonzero(count)[0]
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return pa.table({"id": ids[hit], "n": count[hit], "root": least[label[hit]]})


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Link count and class of every vector: (id, n_links, component_id, kept).

    Equal vectors meet as one class with a number of copies before anything is compared; each pair of tiles
    returns counts and one root per class, so a hot group of near copies never emits its pairs.
    Vectors that are null, empty, zero or hold a null or non-finite component, and rows without an id, link with
    nothing: n_links 0 and their own id as component. Vectors of different lengths do not link. Repeated rows
    count as vectors of their own; ties on the threshold link. An empty table gives an empty result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    all_rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = all_rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # classes have a number of their own: different vectors may share an id
    classes = cut(rows.where("fine").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("no", F.monotonically_increasing_id()))
    axes = principal_axes(classes)
    width = math.sqrt(2 - 2 * threshold) + 1e-6

    def place(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index("vec"))
            size = pa.compute.list_value_length(col).to_numpy(zero_copy_only=False)
            cell, visits = np.zeros(len(size), np.int64), [[] for _ in size]
            for d in np.unique(size):
                at = np.nonzero(size == d)[0]
                u, _ = _unit(_matrix(col.take(pa.array(at))))
                y = u @ axes[int(d)][:, :GRID_AXES]
                own, near = cells_of(y, width)
                cell[at] = own
                for k, v in zip(at, near, strict=True):
                    visits[k] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size.astype(np.int32)), pa.array(cell), pa.array(visits, pa.list_(pa.int64()))], names=[*b.schema.names, "d", "cell", "visits"])

    placed = cut(classes.select("vec", "no", "copies").mapInArrow(place, "vec array<double>, no long, copies long, d int, cell long, visits array<long>"))
    chunks = lambda n: F.ceil(F.col(n) / tile_rows).cast("int")
    guests = placed.select("d", F.explode("visits").alias("cell"))
    tiles = placed.groupBy("d", "cell").agg(F.count("*").alias("home")).join(guests.groupBy("d", "cell").agg(F.count("*").alias("guest")), ["d", "cell"], "left")
    tiles = cut(tiles.select("d", "cell", chunks("home").alias("homes"), F.coalesce(chunks("guest"), F.lit(0)).alias("guests")))
    few = tiles.count() <= BROADCAST_IDS
    at_home = lambda rows: rows.join(F.broadcast(tiles) if few else tiles, ["d", "cell"])
    among = lambda n: F.pmod(F.xxhash64("no"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = at_home(placed.drop("visits")).withColumn("tile", among("homes"))
    one, two = F.least("tile", "other"), F.greatest("tile", "other")
    within = home.withColumn("other", each("homes")).select("d", "cell", F.lit("w").alias("kind"), one.alias("i"), two.alias("j"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "no", "copies", "vec")
    hosts = home.where("guests > 0").withColumn("other", each("guests")).select("d", "cell", F.lit("x").alias("kind"), F.col("tile").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "no", "copies", "vec")
    visiting = at_home(placed.drop("cell").withColumn("cell", F.explode("visits"))).withColumn("tile", among("guests")).withColumn("other", each("homes"))
    visiting = visiting.select("d", "cell", F.lit("x").alias("kind"), F.col("other").alias("i"), F.col("tile").alias("j"), F.lit(1).alias("side"), "no", "copies", "vec")
    work = within.unionByName(hosts).unionByName(visiting)
    found = cut(work.groupBy("d", "cell", "kind", "i", "j").applyInArrow(lambda t: _compare(axes, threshold, t), "id long, n long, root long"))
    roots = connected_components(found, "id", "root").select(F.col("id").alias("no"), F.col("component_id").alias("root"))
    counts = found.groupBy(F.col("id").alias("no")).agg(F.sum("n").alias("n"))
    rooted = cut(classes.join(counts, "no", "left").join(roots, "no", "left").select("vec", "rep", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "no").alias("root")))
    named = cut(rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("vec", "copies", "n_links", "component_id"))
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = join_named(rows.where("fine"), named, "vec", "copies").select("id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("id") == F.col("component_id"))


def op2_pca_tiles(spark, sf_dir):
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
