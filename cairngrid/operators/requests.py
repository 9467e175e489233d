"""Requests as JSON texts: what keeps a body from being accepted, one row per problem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
SURFACE_TYPES = ("prior", "clue_update", "search_update", "manual_adjustment")
COMMIT = (
    "searchDomainId string, parentSurfaceId string, surfaceType string, valuesBase64 string, normalizationConstant double, modelVersion struct<component:string,version:string>, rationale string, "
    "evidence struct<evidenceType:string,evidenceId:string,method:string,previewHash:string>, adjustment struct<method:string>"
)
CREATE_RUN = "incidentId string, informationCutoff string"
LOCK_RUN = "surfaceId string, baselineSurfaceIds array<string>, modelVersions map<string,string>"
#: Baselines that one run may name.
BASELINES = 10
INSTANT = r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"
ROLLBACK = "headSurfaceId string, targetSurfaceId string, rationale string"


def _text(c: Column, least: int = 1) -> Column:
    return F.coalesce(F.length(c) >= least, F.lit(False))


def _guid(c: Column) -> Column:
    return F.coalesce(c.rlike(GUID), F.lit(False))


def _reported(df: DataFrame, key: str, body: str, ddl: str, checks) -> DataFrame:
    b = df.select(key, F.from_json(F.col(body).cast("string"), ddl, {"mode": "PERMISSIVE"}).alias("b"), F.col(body).cast("string").rlike(r"^\s*\{").alias("object_"))
    found = F.when(~F.coalesce("object_", F.lit(False)), F.array(F.lit("body"))).otherwise(F.array_compact(F.array(*[F.when(bad, path) for path, bad in checks(lambda n: F.col(f"b.{n}"))])))
    return b.select(key, F.explode(F.array_sort(F.array_distinct(found))).alias("path"))


def commit_problems(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, path) of what is wrong with bodies that commit a surface; a good body has no row, a text that is no object has ``body``.

    A prior has no parent and every update has one; updates need a rationale, clue and search updates their evidence, manual
    adjustments a method and a rationale of ten characters.
    """

    def checks(c):
        kind, why = c("surfaceType"), F.trim(F.coalesce(c("rationale"), F.lit("")))
        known = F.coalesce(kind.isin(*SURFACE_TYPES), F.lit(False))
        evidence = _text(c("evidence.evidenceType")) & _guid(c("evidence.evidenceId")) & _text(c("evidence.method")) & _text(c("evidence.previewHash"), 8)
        return [
            ("searchDomainId", ~_guid(c("searchDomainId"))),
            ("parentSurfaceId", c("parentSurfaceId").isNotNull() & ~_guid(c("parentSurfaceId"))),
            ("parentSurfaceId", known & ((kind == "prior") != c("parentSurfaceId").isNull())),
            ("surfaceType", ~known),
            ("valuesBase64", ~_text(c("valuesBase64"), 16)),
            ("normalizationConstant", ~F.coalesce((c("normalizationConstant") > 0) & (c("normalizationConstant") < float("inf")), F.lit(False))),
            ("modelVersion", ~(_text(c("modelVersion.component")) & _text(c("modelVersion.version")))),
            ("rationale", F.length(F.coalesce(c("rationale"), F.lit(""))) > 4000),
            ("rationale", known & (kind != "prior") & (F.length(why) == 0)),
            ("evidence", c("evidence").isNotNull() & ~evidence),
            ("evidence", kind.isin("clue_update", "search_update") & c("evidence").isNull()),
            ("adjustment", (kind == "manual_adjustment") & (~_text(c("adjustment.method")) | (F.length(why) < 10))),
        ]

    return _reported(df, key, body, COMMIT, checks)


def rollback_problems(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, path) of what is wrong with bodies that roll a head back to an earlier surface."""
    return _reported(df, key, body, ROLLBACK, lambda c: [("headSurfaceId", ~_guid(c("headSurfaceId"))), ("targetSurfaceId", ~_guid(c("targetSurfaceId"))), ("rationale", ~_text(F.trim(c("rationale")), 10))])


def create_run_problems(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, path) of what is wrong with bodies that create an evaluation run: its incident, and a cutoff as a date and time with an offset that exists."""

    def checks(c):
        at = c("informationCutoff")
        real = F.coalesce(at.rlike(INSTANT) & F.try_to_timestamp(F.substring(at, 1, 10), F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))
        return [("incidentId", ~_guid(c("incidentId"))), ("informationCutoff", ~real)]

    return _reported(df, key, body, CREATE_RUN, checks)


def lock_run_problems(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, path) of what is wrong with bodies that lock a run: its surface, up to ten baselines, and named model versions; both may be left out."""

    def checks(c):
        baselines, models = c("baselineSurfaceIds"), c("modelVersions")
        bad = F.coalesce((F.size(baselines) > BASELINES) | F.exists(baselines, lambda b: ~_guid(b)), F.lit(False))
        return [("surfaceId", ~_guid(c("surfaceId"))), ("baselineSurfaceIds", bad), ("modelVersions", F.coalesce(F.exists(F.map_values(models), lambda v: v.isNull()), F.lit(False)))]

    return _reported(df, key, body, LOCK_RUN, checks)
