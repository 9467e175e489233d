"""Cutoffs, leakage and the measures of a surface against a find location."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairngrid.operators.surface import checkpointed, running_before

#: Keys that tell an outcome; a prefix match.
OUTCOME_KEY = r"(?i)^(found|find|outcome|recovered|located_at)"
_OUTCOME, _DECODER = re.compile(OUTCOME_KEY, re.ASCII), json.JSONDecoder(strict=False)


def filter_available(items: DataFrame, cutoff: str | Column, column: str = "available_at") -> DataFrame:
    """Rows available at the cutoff, which itself counts; a time that cannot be read raises an error."""
    at = F.to_timestamp(F.lit(cutoff)) if isinstance(cutoff, str) else cutoff
    known = F.coalesce(F.col(column).cast("timestamp"), F.raise_error(F.lit("an item has no readable time")).cast("timestamp"))
    return items.where(known <= at)


def late_items(items: DataFrame, cutoff: str | Column, column: str = "available_at") -> DataFrame:
    """Rows after the cutoff; unreadable times pass, as they do in the leakage check."""
    at = F.to_timestamp(F.lit(cutoff)) if isinstance(cutoff, str) else cutoff
    return items.where(F.col(column).cast("timestamp") > at)


def json_outcomes(text: str) -> list[str]:
    """Paths of all object keys that tell an outcome, at any depth, as ``$.key`` and ``[i]``; none if the text is no JSON."""
    try:
        value, _ = _DECODER.raw_decode(text.lstrip())
    except RecursionError:
        raise ValueError("a payload is nested too deeply to be searched") from None
    except ValueError:
        return []
    out, todo = [], [("$", value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            out += [f"{path}.{k}" for k in v if _OUTCOME.match(k)]
            todo += [(f"{path}.{k}", x) for k, x in v.items() if isinstance(x, (dict, list))]
        else:
            todo += [(f"{path}[{i}]", x) for i, x in enumerate(v) if isinstance(x, (dict, list))]
    return [p.encode("utf-8", "replace").decode() for p in out]


def outcome_keys(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, path) of object keys anywhere in a JSON payload that tell an outcome; payloads that are no JSON have none.

    Objects and arrays are walked to any depth. Spark's parser, which also reads single quotes, writes the payload anew before.
    """
    text = F.col(payload).cast("string")
    inner = F.when(text.rlike(r"^\s*[\[{]"), F.coalesce(F.get_json_object(text, "$"), text))

    def run(batches):
        for b in batches:
            found = [json_outcomes(t) for t in b.column(1).to_pylist()]
            at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([p for x in found for p in x], pa.string())], names=[key, "path"])

    rows = df.select(key, inner.alias("v")).where("v is not null")
    return rows.mapInArrow(run, T.StructType([df.select(key).schema[0], T.StructField("path", T.StringType())]))


def case_metrics(surface: DataFrame, finds: DataFrame, cell_area_m2: float, floor: float = 1e-9, tops=(0.10, 0.25, 0.50)) -> DataFrame:
    """Per find (find_id, cell_id; cell -1 is outside the grid): p, density_km2, rank, capture, top masses, log_score, outside.

    rank is (higher + (ties - 1) / 2) / n and capture (higher + ties) / n, from counts of equal probabilities, not of cells
    one by one; the top masses hold max(1, round half up) cells.
    """
    surface = checkpointed(surface)
    dist = surface.groupBy("p").agg(F.count("*").alias("ties"))
    levels = running_before(dist, [], [F.desc("p")], "ties", "higher")
    n = surface.agg(F.count("*").alias("n"), F.max("outside").alias("outside_p"))
    top = levels.crossJoin(F.broadcast(n)).agg(*[F.sum(F.col("p") * F.greatest(F.lit(0), F.least("ties", F.greatest(F.lit(1), F.floor(F.col("n") * f + 0.5)) - F.col("higher")))).alias(f"top{round(f * 100)}") for f in tops])
    j = finds.join(surface.select("cell_id", "p"), "cell_id", "left").join(levels, "p", "left").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(top))
    inside = F.col("cell_id") >= 0
    p = F.when(inside, F.col("p")).otherwise(F.col("outside_p"))
    return j.select(
        "find_id",
        p.alias("p"),
        F.when(inside, F.col("p") / cell_area_m2 * 1e6).alias("density_km2"),
        F.when(inside, (F.col("higher") + (F.col("ties") - 1) / 2) / F.col("n")).alias("rank"),
        F.when(inside, (F.col("higher") + F.col("ties")) / F.col("n")).alias("capture"),
        *[f"top{round(f * 100)}" for f in tops],
        F.ln(F.greatest(p, F.lit(floor))).alias("log_score"),
        (~inside).alias("outside"),
    )


@dataclass
class EvaluationRun:
    """open -> locked -> revealed; the outcome is only asked for once locked and by a role that may see it."""

    candidate_id: str
    baseline_ids: list[str]
    cutoff: dt.datetime
    status: str = "open"
    locked_at: dt.datetime | None = None
    revealed_at: dt.datetime | None = None
    metrics: dict = field(default_factory=dict)
    allowed: tuple[str, ...] = ("administrator", "evaluator", "instructor")

    def lock(self, now: Callable[[], dt.datetime]) -> None:
        if self.status != "open":
            raise ValueError(f"a run that is {self.status} cannot be locked")
        self.status, self.locked_at = "locked", now()

    def reveal(self, outcome: Callable[[], object], role: str, now: Callable[[], dt.datetime]) -> object:
        if self.status == "open":
            raise ValueError("lock the run first")
        if role not in self.allowed:
            raise PermissionError(f"{role} may not see outcomes")
        got = outcome()
        self.status, self.revealed_at = "revealed", self.revealed_at or now()
        return got

#: Allowed changes of an evaluation run's status.
TRANSITIONS = {("open", "open"), ("open", "locked"), ("locked", "locked"), ("locked", "revealed"), ("revealed", "revealed")}


def transition_problems(changes: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, problem) of changes (old_status, new_status, old_metrics, new_metrics): a forbidden step, or metrics written twice."""
    ok = F.concat_ws(">", "old_status", "new_status").isin([f"{a}>{b}" for a, b in sorted(TRANSITIONS)])
    problem = F.when(~ok, F.concat(F.lit("from "), F.col("old_status"), F.lit(" to "), F.col("new_status"))).when(F.col("old_metrics").isNotNull() & ~F.col("old_metrics").eqNullSafe(F.col("new_metrics")), "metrics changed")
    return changes.withColumn("problem", problem).where("problem is not null").select(key, "problem")


def evaluation_package(tables: dict[str, DataFrame], incidents: DataFrame, cutoff: Column) -> DataFrame:
    """(kind, incident_id, item_id, available_at) of all inputs available at their incident's ``cutoff``: one filtered union.

    Each table has incident_id, item_id and available_at; the cutoff is a column of ``incidents``.
    """
    out = None
    for kind, df in sorted(tables.items()):
        one = df.select(F.lit(kind).alias("kind"), "incident_id", "item_id", "available_at")
        out = one if out is None else out.unionByName(one)
    limits = incidents.select("incident_id", cutoff.alias("cutoff_"))
    return out.join(limits, "incident_id").where(F.col("available_at") <= F.col("cutoff_")).drop("cutoff_")
