"""Append-only surface versions: records (surface_id, incident_id, parent_id, iteration, seq, ...) and cells by surface."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
import struct
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

RECORD = "surface_id string, incident_id string, parent_id string, iteration int, created_at long, kind string, z double, outside double, values_hash string, input_hash string, rationale string, created_by string"


def history(records: DataFrame, by: str = "incident_id") -> DataFrame:
    """Records with ``has_sibling``: another record of the incident has the same parent (null parents never match)."""
    n = records.where("parent_id is not null").groupBy("parent_id").agg((F.count("*") > 1).alias("has_sibling"))
    return records.join(n, "parent_id", "left").withColumn("has_sibling", F.coalesce("has_sibling", F.lit(False)))


def divergent(records: DataFrame) -> DataFrame:
    """Records with ``divergent``: an earlier one already had the same parent."""
    first = records.where("parent_id is not null").groupBy("parent_id").agg(F.min("surface_id").alias("first_"))
    return records.join(first, "parent_id", "left").withColumn("divergent", F.coalesce(F.col("surface_id") != F.col("first_"), F.lit(False))).drop("first_")


def heads(records: DataFrame) -> DataFrame:
    """Records that are nobody's parent."""
    parents = records.select(F.col("parent_id").alias("surface_id")).where("surface_id is not null").distinct()
    return records.join(parents, "surface_id", "left_anti")


def lineage_problems(records: DataFrame) -> DataFrame:
    """(surface_id, problem): a prior with a parent or an iteration, a child off its parent's incident or iteration, a lost parent."""
    p = records.select(F.col("surface_id").alias("parent_id"), F.col("incident_id").alias("p_incident"), F.col("iteration").alias("p_iteration"), F.lit(True).alias("found"))
    j = records.join(p, "parent_id", "left")
    checks = F.array_compact(
        F.array(
            F.when(F.col("parent_id").isNull() & (F.col("iteration") != 0), "prior with an iteration"),
            F.when(F.col("parent_id").isNotNull() & F.col("found").isNull(), "parent not found"),
            F.when(F.col("p_incident") != F.col("incident_id"), "parent of another incident"),
            F.when(F.col("iteration") != F.col("p_iteration") + 1, "iteration does not follow parent"),
        )
    )
    return j.select("surface_id", F.explode(checks).alias("problem"))


def canonical_json(value) -> str:
    """JSON with sorted keys, numbers as whole where they are, and non-finite numbers wrapped."""

    def norm(v):
        if isinstance(v, dict):
            return {k: norm(x) for k, x in sorted(v.items()) if x is not ...}
        if isinstance(v, (list, tuple, np.ndarray)):
            return [norm(x) for x in v]
        if isinstance(v, float):
            if not math.isfinite(v):
                return {"$nonFinite": "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"}
            if v.is_integer() and abs(v) < 1e21:
                return int(v)
        return v

    return json.dumps(norm(value), separators=(",", ":"), ensure_ascii=False)


def hash_value(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def hash_values(values: np.ndarray, outside: float) -> str:
    """Hash of the exact bits of a surface: little-endian doubles, the outside mass last."""
    return hashlib.sha256(np.append(np.asarray(values, "<f8"), np.float64(outside)).astype("<f8").tobytes()).hexdigest()


def encode_surface(values: np.ndarray, outside: float) -> bytes:
    return gzip.compress(np.append(np.asarray(values, "<f8"), outside).astype("<f8").tobytes(), 6, mtime=0)


def decode_surface(blob: bytes, cells: int) -> tuple[np.ndarray, float]:
    raw = gzip.decompress(blob)
    if len(raw) != 8 * (cells + 1):
        raise ValueError(f"a surface of {cells} cells takes {8 * (cells + 1)} bytes, not {len(raw)}")
    v = np.frombuffer(raw, "<f8")
    return v[:-1], float(v[-1])


def values_to_base64(values: np.ndarray, outside: float) -> str:
    return base64.b64encode(np.append(np.asarray(values, "<f8"), outside).astype("<f8").tobytes()).decode()


def values_from_base64(text: str) -> tuple[np.ndarray, float]:
    raw = base64.b64decode(text)
    if len(raw) % 8 or len(raw) < 16:
        raise ValueError("a surface needs whole doubles, two at least")
    v = np.frombuffer(raw, "<f8")
    return v[:-1], float(v[-1])


def surface_digests(surfaces: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, values_hash, outside, n): ``hash_values`` of each surface's masses in the order of cells.

    A hash of exact bits reads one surface in order, so that surface is one task's, streamed in Arrow batches from a sort that
    spills; surfaces of different keys are hashed side by side, and nothing is collected.
    """
    by = list(by)
    rows = surfaces.select(*by, F.col("cell_id").cast("long").alias("cell_id"), F.col("p").cast("double").alias("p"), F.col("outside").cast("double").alias("outside"))
    dealt = (rows.repartition(*by) if by else rows.repartition(1)).sortWithinPartitions(*by, "cell_id")
    schema = T.StructType([*(rows.schema[c] for c in by), *T.StructType.fromDDL("values_hash string, outside double, n long").fields])

    def run(batches):
        key, h, outside, n, out = None, None, None, 0, []

        def end():
            h.update(struct.pack("<d", outside))
            out.append((*key, h.hexdigest(), outside, n))

        for b in batches:
            keys = list(zip(*[b.column(k).to_pylist() for k in range(len(by))], strict=True)) if by else [()] * b.num_rows
            p, outer = b.column(len(by) + 1).to_numpy(zero_copy_only=False).astype("<f8"), b.column(len(by) + 2)
            at = 0
            while at < b.num_rows:
                to = next((k for k in range(at + 1, b.num_rows) if keys[k] != keys[at]), b.num_rows) if by and keys[-1] != keys[at] else b.num_rows
                if keys[at] != key:
                    if h:
                        end()
                    key, h, n = keys[at], hashlib.sha256(), 0
                outside, n = outer[at].as_py(), n + to - at
                h.update(p[at:to].tobytes())
                at = to
        if h:
            end()
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=to_arrow_schema(schema))

    return dealt.mapInArrow(run, schema)


class SurfaceStore:
    """Append-only store in a folder that any number of writers share: Parquet tables ``records``, ``cells`` and ``locks``.

    Each commit writes folders of its own, named by its id, cells first and the record last, so writers never touch each other's files and a commit without
    a record is invisible. Order and divergence are told from the records when they are read, not decided when they are written: two commits on one
    head both stand, and the later one is divergent. A surface's cells are one folder, so reading one reads no other.
    """

    def __init__(self, spark: SparkSession, path: str, mode: str = "training"):
        if mode == "operational_disabled":
            raise ValueError("operational mode is disabled")
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        names = T.StructType.fromDDL(schema).names
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").select(*names)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    @property
    def records(self) -> DataFrame:
        """All records, with ``seq``, their place in the incident (a parent comes before its children), and ``divergent``: another child of the parent came before."""
        rows = self._read("records", RECORD)
        seq = F.row_number().over(W.partitionBy("incident_id").orderBy("iteration", "created_at", "surface_id")) - 1
        child = F.row_number().over(W.partitionBy("parent_id").orderBy("created_at", "surface_id"))
        return rows.withColumns({"seq": seq.cast("long"), "divergent": F.col("parent_id").isNotNull() & (child > 1)})

    @property
    def cells(self) -> DataFrame:
        return self._read("cells", "surface_id string, cell_id long, p double")

    def commit(self, surface: DataFrame, incident_id: str, kind: str, created_by: str, z: float = 1.0, parent_id: str | None = None, rationale: str | None = None, inputs: dict | None = None, expected_hash: str | None = None, cell_count: int | None = None) -> dict:
        """The record of the new surface, with ``divergent`` as known now; a surface whose values do not hash as expected, or has another number of cells, is refused."""
        from cairngrid.operators.surface import check_invariants

        if not created_by or not (z > 0 and math.isfinite(z)):
            raise ValueError("a commit needs its author and a positive finite z")
        if (kind == "prior") != (parent_id is None):
            raise ValueError("a prior has no parent, everything else has one")
        if kind != "prior" and not (rationale or "").strip():
            raise ValueError("an update needs a rationale")
        problems = check_invariants(surface, cell_count=cell_count).first()["problems"]
        if problems:
            raise ValueError("; ".join(problems))
        known = self._read("records", RECORD)
        parent = known.where(F.col("surface_id") == parent_id).first() if parent_id else None
        if parent_id and (parent is None or parent["incident_id"] != incident_id):
            raise ValueError("the parent is not a surface of this incident")
        digest = surface_digests(surface).first()
        if expected_hash and digest["values_hash"] != expected_hash:
            raise ValueError("the values do not match their hash")
        row = {
            "surface_id": f"srf_{digest['values_hash'][:8]}_{uuid.uuid4().hex[:12]}", "incident_id": incident_id, "parent_id": parent_id, "iteration": parent["iteration"] + 1 if parent else 0, "created_at": time.time_ns() // 1000, "kind": kind, "z": float(z), "outside": digest["outside"],
            "values_hash": digest["values_hash"], "input_hash": hash_value({"inputs": inputs, "parentHash": parent["values_hash"] if parent else "", "kind": kind}), "rationale": rationale, "created_by": created_by,
        }
        name = row["surface_id"]
        surface.select("cell_id", "p").write.parquet(f"{self.path}/cells/surface_id={name}")
        self.spark.createDataFrame([tuple(row.values())], RECORD).coalesce(1).write.parquet(f"{self.path}/records/commit={name}")
        return row | {"divergent": bool(parent_id) and self.records.where(F.col("surface_id") == name).first()["divergent"]}

    def get(self, surface_id: str) -> DataFrame:
        """(cell_id, p, outside); a surface whose values do not hash as recorded raises an error."""
        rec = self._read("records", RECORD).where(F.col("surface_id") == surface_id).first()
        if rec is None:
            raise KeyError(surface_id)
        out = self.cells.where(F.col("surface_id") == surface_id).select("cell_id", "p", F.lit(rec["outside"]).alias("outside"))
        if surface_digests(out).first()["values_hash"] != rec["values_hash"]:
            raise ValueError("stored values do not match their hash")
        return out

    def damaged(self) -> DataFrame:
        """(surface_id, problem) of all stored surfaces whose values are missing or do not hash as recorded, checked side by side."""
        recorded = self._read("records", RECORD).select("surface_id", F.col("values_hash").alias("recorded"), F.col("outside").alias("outside"))
        found = surface_digests(self.cells.join(recorded.select("surface_id", "outside"), "surface_id"), ["surface_id"]).select("surface_id", "values_hash")
        problem = F.when(F.col("values_hash").isNull(), "no values").when(F.col("values_hash") != F.col("recorded"), "values do not match their hash")
        return recorded.join(found, "surface_id", "left").withColumn("problem", problem).where("problem is not null").select("surface_id", "problem")

    def rollback(self, incident_id: str, target_id: str, head_id: str, created_by: str, rationale: str) -> dict:
        """A copy of an earlier surface as child of a head."""
        return self.commit(self.get(target_id), incident_id, "rollback", created_by, 1.0, head_id, rationale, {"target": target_id})

    def lock(self, surface_id: str, at: str) -> str:
        """The time of the first lock; locking again changes nothing."""
        locks = self._read("locks", "surface_id string, locked_at string, event string").where(F.col("surface_id") == surface_id)
        first = locks.agg(F.min("locked_at")).first()[0]
        if first is None:
            self.spark.createDataFrame([(surface_id, at, uuid.uuid4().hex)], "surface_id string, locked_at string, event string").coalesce(1).write.parquet(f"{self.path}/locks/lock={uuid.uuid4().hex}")
        return first or at

    def history(self, incident_id: str) -> DataFrame:
        return history(self.records.where(F.col("incident_id") == incident_id)).orderBy("seq")

    def heads(self, incident_id: str) -> DataFrame:
        return heads(self.records.where(F.col("incident_id") == incident_id))


def domain_problems(records: DataFrame) -> DataFrame:
    """(surface_id, problem) of records (surface_id, parent_id, incident_id, domain_id, domain_incident_id): a domain of another incident, or not the parent's."""
    p = records.select(F.col("surface_id").alias("parent_id"), F.col("domain_id").alias("p_domain"))
    j = records.join(p, "parent_id", "left")
    checks = F.array_compact(F.array(F.when(F.col("domain_incident_id") != F.col("incident_id"), "domain of another incident"), F.when(F.col("domain_id") != F.col("p_domain"), "domain differs from parent's")))
    return j.select("surface_id", F.explode(checks).alias("problem"))


def changed_after_commit(old: DataFrame, new: DataFrame, key: str = "surface_id", mutable: str = "locked_at") -> DataFrame:
    """(key, problem): rows of an append-only table that went, or changed in anything but ``mutable``, which may only be filled in once."""
    cols = [c for c in old.columns if c not in (key, mutable)]
    j = old.select(key, F.struct(*cols).alias("a"), F.col(mutable).alias("am")).join(new.select(key, F.struct(*cols).alias("b"), F.col(mutable).alias("bm"), F.lit(True).alias("there")), key, "left")
    problem = F.when(F.col("there").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "changed").when(F.col("am").isNotNull() & ~F.col("am").eqNullSafe(F.col("bm")), "lock changed")
    return j.withColumn("problem", problem).where("problem is not null").select(key, "problem")
