"""Evaluation runs as append-only events, resolved to states, refusals and audit rows.

An event is (event_id, at, run_id, kind, user_id, role) with, by kind: ``incident_id`` and ``information_cutoff`` (create), ``surface_id`` and ``baselines``
(lock), nothing (reveal), ``metrics`` (metrics). Writers only append; what an event did follows from the events before it, so writers
need no lock among themselves and every refused step is a row and no exception. A run is open, then locked, then revealed, and gets metrics once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngrid.operators.security import PRIVILEGED

EVALUATORS = ("evaluator", "administrator", "instructor")
EVENTS = "event_id long, at timestamp, run_id long, kind string, user_id long, role string, incident_id long, information_cutoff timestamp, surface_id long, baselines array<long>, metrics string"
ACTIONS = {"create": "insert", "lock": "lock", "reveal": "restricted_read", "metrics": "update"}


def judged_events(events: DataFrame, members: DataFrame, surfaces: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """``events`` with ``pos`` (their order within the run), ``incident`` of the run and ``problem``, null where the event took effect.

    ``members`` has (incident_id, user_id), ``surfaces`` (surface_id, incident_id), ``training`` the incidents (incident_id) in training mode, all if it is left out.
    Privileged roles see every incident, others those that they are members of; evaluators, administrators and instructors may create, lock and record, instructors
    reveal training incidents only. Revealing again is allowed; it is a restricted read each time. Events of a run are ordered by time, then by id; one shuffle by run orders them all.
    """
    run = W.partitionBy("run_id")
    e = events.withColumn("pos", F.row_number().over(run.orderBy("at", "event_id")))
    # most events have no incident or surface of their own: these go by their ids, since all nulls of a join's key meet in one task
    keyed = lambda c: F.struct(F.col(c).cast("long").alias("k"), F.when(F.col(c).isNull(), F.col("event_id")).alias("none"))
    known = lambda c, name: F.struct(F.col(c).cast("long").alias("k"), F.lit(None).cast("long").alias("none")).alias(name)
    allowed = members.where("incident_id is not null").select(known("incident_id", "mi_"), F.col("user_id").alias("mu_")).distinct()
    belongs = lambda df, incident, name: df.withColumn("by_", keyed(incident)).join(allowed.withColumn(name, F.lit(True)), (F.col("by_") == F.col("mi_")) & (F.col("user_id") == F.col("mu_")), "left").drop("by_", "mi_", "mu_").withColumn(name, F.coalesce(name, F.lit(False)) | F.col("role").isin(*PRIVILEGED))
    may = F.coalesce(F.col("role").isin(*EVALUATORS), F.lit(False))
    kind = lambda k: F.col("kind") == k
    first = lambda ok: F.min(F.when(ok, F.col("pos"))).over(run)
    after = lambda c: F.coalesce(F.col("pos") > F.col(c), F.lit(False))
    e = belongs(e, "incident_id", "own_").withColumn("created_", first(kind("create") & may & F.col("own_") & F.col("incident_id").isNotNull()))
    e = e.withColumn("incident", F.max(F.when(F.col("pos") == F.col("created_"), F.col("incident_id"))).over(run))
    e = belongs(e, "incident", "seen_").withColumn("visible_", F.col("seen_") & after("created_"))
    place = surfaces.select(F.col("surface_id").alias("s_"), F.col("incident_id").alias("si_")).distinct()
    named = place.where("s_ is not null").select(known("s_", "sk_"), "si_")
    e = e.withColumn("by_", keyed("surface_id")).join(named, F.col("by_") == F.col("sk_"), "left").withColumn("fits_", F.coalesce(F.col("si_") == F.col("incident"), F.lit(False))).drop("sk_", "si_", "by_")
    wanted = e.where(kind("lock")).select("event_id", "incident", F.explode("baselines").alias("b_"))
    lost = wanted.join(place, (F.col("b_") == F.col("s_")) & (F.col("incident") == F.col("si_")), "left_anti").select("event_id").distinct().withColumn("lost_", F.lit(True))
    e = e.join(lost, "event_id", "left").withColumn("lost_", F.coalesce("lost_", F.lit(False)))
    if training is not None:
        trained = training.where("incident_id is not null").select(known("incident_id", "t_")).distinct().withColumn("training_", F.lit(True))
        e = e.withColumn("by_", keyed("incident")).join(trained, F.col("by_") == F.col("t_"), "left").drop("t_", "by_")
    else:
        e = e.withColumn("training_", F.lit(True))
    opens = F.col("role").isin(*PRIVILEGED) | ((F.col("role") == "instructor") & F.coalesce("training_", F.lit(False)))
    e = e.withColumn("locked_", first(kind("lock") & F.col("visible_") & may & F.col("fits_") & ~F.col("lost_")))
    e = e.withColumn("revealed_", first(kind("reveal") & F.col("visible_") & F.coalesce(opens, F.lit(False)) & after("locked_")))
    e = e.withColumn("recorded_", first(kind("metrics") & F.col("visible_") & may & after("revealed_")))
    lock = F.when(~F.col("visible_"), "evaluation run not found").when(~may, "role may not lock evaluation runs").when(after("locked_"), "run is already locked").when(~F.col("fits_"), "surface does not belong to this incident").when(F.col("lost_"), "every baseline must be a surface of this incident")
    reveal = F.when(~F.col("visible_"), "evaluation run not found").when(~F.coalesce(opens, F.lit(False)), "role may not reveal outcomes").when(~after("locked_"), "outcome cannot be revealed before the run is locked")
    metrics = F.when(~F.col("visible_") | ~may, "not permitted").when(~after("revealed_"), "metrics follow the reveal").when(F.col("pos") != F.col("recorded_"), "metrics are recorded once")
    create = F.when(~may | ~F.col("own_"), "not permitted").when(F.col("incident_id").isNull(), "a run needs its incident").when(F.col("pos") != F.col("created_"), "run exists already")
    problem = F.when(kind("create"), create).when(kind("lock"), lock).when(kind("reveal"), reveal).when(kind("metrics"), metrics).otherwise("unknown kind of event")
    return e.select(*events.columns, "pos", "incident", problem.alias("problem"))


def run_states(judged: DataFrame) -> DataFrame:
    """(run_id, incident_id, information_cutoff, status, surface_id, baselines, locked_by, locked_at, revealed_by, revealed_at, metrics) of every run that was created."""
    done = judged.where("problem is null")
    at = lambda k, c: F.min_by(F.when(F.col("kind") == k, F.struct(F.col(c).alias("v"))), F.when(F.col("kind") == k, F.col("pos")))["v"]
    rows = done.groupBy("run_id").agg(
        F.max("incident").alias("incident_id"), at("create", "information_cutoff").alias("information_cutoff"), F.max((F.col("kind") == "lock").cast("int")).alias("l"), F.max((F.col("kind") == "reveal").cast("int")).alias("r"),
        at("lock", "surface_id").alias("surface_id"), at("lock", "baselines").alias("baselines"), at("lock", "user_id").alias("locked_by"), at("lock", "at").alias("locked_at"), at("reveal", "user_id").alias("revealed_by"), at("reveal", "at").alias("revealed_at"), at("metrics", "metrics").alias("metrics"),
    )
    return rows.withColumn("status", F.when(F.col("r") == 1, "revealed").when(F.col("l") == 1, "locked").otherwise("open")).drop("l", "r")


def audit_trail(judged: DataFrame) -> DataFrame:
    """(event_id, at, user_id, action, entity, run_id, incident_id): one row for everything that took effect, reads of outcomes included."""
    action: Column = F.coalesce(*[F.when(F.col("kind") == k, a) for k, a in ACTIONS.items()])
    entity = F.when(F.col("kind") == "reveal", "found_locations").otherwise("evaluation_runs")
    return judged.where("problem is null").select("event_id", "at", "user_id", action.alias("action"), entity.alias("entity"), "run_id", F.col("incident").alias("incident_id"))


def locked_surfaces(judged: DataFrame) -> DataFrame:
    """(surface_id, locked_at): every surface that a lock named as candidate or baseline, with its first lock."""
    locks = judged.where("problem is null and kind = 'lock'")
    named = locks.select("at", F.explode(F.array_union(F.array("surface_id"), F.coalesce("baselines", F.array().cast("array<long>")))).alias("surface_id"))
    return named.groupBy("surface_id").agg(F.min("at").alias("locked_at"))


def run_metrics(states: DataFrame, metrics: DataFrame) -> DataFrame:
    """(run_id, surface_id, candidate, ...metrics) of revealed runs: ``metrics`` (surface_id and figures, as ``case_metrics`` gives them) for the candidate and its baselines."""
    ready = states.where("status = 'revealed'")
    named = ready.select("run_id", "surface_id", F.lit(True).alias("candidate")).unionByName(ready.select("run_id", F.explode("baselines").alias("surface_id"), F.lit(False).alias("candidate")))
    return named.join(metrics, "surface_id")
