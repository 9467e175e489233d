"""Row filters by role, membership and cutoff, audit rows and idempotent requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PRIVILEGED = ("administrator", "evaluator")
#: Roles that may write to incidents they are members of.
WRITERS = ("administrator", "analyst", "evaluator", "instructor")
#: Columns no client reads.
HIDDEN = ("restricted_payload_ciphertext",)


def current_role(users: DataFrame, roles: DataFrame, user_id) -> str | None:
    """Role of an active user if the role is enabled."""
    row = users.where((F.col("user_id") == user_id) & F.col("active")).join(roles.where("enabled"), "role").select("role").first()
    return row[0] if row else None


def active_roles(users: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, role) of all active users whose role is enabled; the table of roles is a handful of rows."""
    enabled = roles.where("enabled").select("role")
    few = enabled.limit(1001).count() <= 1000
    return users.where("active").join(F.broadcast(enabled) if few else enabled, "role").select("user_id", "role")


def readable_incidents(incidents: DataFrame, members: DataFrame, user_id, role: str | None) -> DataFrame:
    if role is None:
        return incidents.where(F.lit(False))
    if role in PRIVILEGED:
        return incidents
    return incidents.join(members.where(F.col("user_id") == user_id).select("incident_id"), "incident_id", "left_semi")


def writable_incidents(incidents: DataFrame, members: DataFrame, user_id, role: str | None) -> DataFrame:
    if role not in WRITERS:
        return incidents.where(F.lit(False))
    return incidents if role == "administrator" else incidents.join(members.where(F.col("user_id") == user_id).select("incident_id"), "incident_id", "left_semi")


def can_see_input(role: str | None, available_at: Column, cutoff: Column) -> Column:
    """Inputs after an incident's cutoff are for privileged roles only."""
    if role is None:
        return F.lit(False)
    return F.lit(True) if role in PRIVILEGED else available_at <= cutoff


def secured_inputs(inputs: DataFrame, incidents: DataFrame, members: DataFrame, user_id, role: str | None) -> DataFrame:
    """The rows of an input table that a user may see, without hidden columns; ``incidents`` has incident_id and cutoff."""
    visible = readable_incidents(incidents, members, user_id, role).select("incident_id", F.col("cutoff").alias("cutoff_"))
    rows = inputs.join(visible, "incident_id").where(can_see_input(role, F.col("available_at"), F.col("cutoff_")))
    return rows.drop("cutoff_", *[c for c in HIDDEN if c in inputs.columns])


def incident_detail(incidents: DataFrame, inputs: dict[str, tuple[DataFrame, bool]], members: DataFrame, user_id, role: str | None, full_timeline: bool = False) -> DataFrame:
    """(incident_id, kind, item_id, available_at, details) of the incidents a user may read: one package of all input tables.

    ``inputs`` maps a kind to (rows with incident_id, item_id and, if timed, available_at; whether it is timed). Timed inputs are cut at the
    incident's cutoff unless a privileged role asks for the full timeline; for other roles the cut stays, and a timed input without a time is not shown. ``details`` are the rest of the row as JSON,
    without hidden columns, so no outcome field is reachable. One filtered union of equi-joins on the incident.
    """
    visible = readable_incidents(incidents, members, user_id, role).select("incident_id", F.col("cutoff").alias("cutoff_"))
    out = None
    for kind, (df, timed) in sorted(inputs.items()):
        rest = [c for c in df.columns if c not in ("incident_id", "item_id", "available_at", *HIDDEN)]
        at = F.col("available_at").cast("timestamp") if timed else F.lit(None).cast("timestamp")
        one = df.select(F.lit(timed).alias("timed_"), "incident_id", F.lit(kind).alias("kind"), F.col("item_id").cast("string").alias("item_id"), at.alias("available_at"), (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("details"))
        out = one if out is None else out.unionByName(one)
    rows = out.join(visible, "incident_id")
    if not full_timeline or role not in PRIVILEGED:
        rows = rows.where(~F.col("timed_") | (F.col("available_at") <= F.col("cutoff_")))
    return rows.drop("cutoff_", "timed_")


def listed_by(df: DataFrame, keys: list[str], value: str, order: list[str], separator: str = ",") -> DataFrame:
    """(keys, n, listed): the values of a key joined in the given order; nulls are left out."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).cast("string").alias("v_"))))).alias("all_"))
    return rows.select(*keys, F.size("all_").cast("long").alias("n"), F.array_join(F.transform("all_", lambda r: r["v_"]), separator).alias("listed"))


def with_member(array: Column, value: Column) -> Column:
    """The array with ``value`` at its end, unless it is in it already; a null array counts as empty."""
    known = F.coalesce(array, F.array().cast("array<string>"))
    return F.when(F.array_contains(known, value), known).otherwise(F.array_append(known, value))


def missing_baselines(runs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(run_id, surface_id): baselines (array of ids) that are no surface of the run's incident."""
    each = runs.select("run_id", "incident_id", F.explode("baselines").alias("surface_id"))
    return each.join(surfaces.select("surface_id", "incident_id"), ["surface_id", "incident_id"], "left_anti").select("run_id", "surface_id")


def first_responses(requests: DataFrame, keys: list[str], order: list[str], request: str) -> DataFrame:
    """Requests with ``outcome``: the first of a key is new, an equal later one is replayed, a different one a conflict."""
    w = W.partitionBy(*keys).orderBy(*order)
    first = requests.withColumns({"n_": F.row_number().over(w), "r_": F.first(request).over(w)})
    outcome = F.when(F.col("n_") == 1, "new").when(F.col("r_").eqNullSafe(F.col(request)), "replayed").otherwise("conflict")
    return first.withColumn("outcome", outcome).drop("n_", "r_")


def audit_rows(changed: DataFrame, table: str, key: str, action: str, user_id) -> DataFrame:
    """An audit event per changed row; details hold the row without hidden columns."""
    shown = [c for c in changed.columns if c not in HIDDEN]
    return changed.select(F.lit(table).alias("entity"), F.col(key).cast("string").alias("entity_id"), F.lit(action).alias("action"), F.lit(str(user_id)).alias("user_id"), F.to_json(F.struct(*shown)).alias("details"))


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    return df.withColumn("n_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")


def seal_location(text: Column, incident_id: Column, key: Column) -> Column:
    """AES-GCM with the incident as additional data."""
    return F.base64(F.aes_encrypt(text, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), incident_id))


def open_location(sealed: Column, incident_id: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(sealed), key, F.lit("GCM"), F.lit("DEFAULT"), incident_id).cast("string")


def _url64(c: Column) -> Column:
    return F.rtrim(F.translate(F.base64(c), "+/\r\n", "-_"), F.lit("="))


def _from_url64(c: Column) -> Column:
    return F.unbase64(F.rpad(F.translate(c, "-_", "+/"), F.ceil(F.length(c) / 4).cast("int") * 4, "="))


def _ring(keys: dict[str, bytes]) -> Column:
    """Keys by their id; a session has a handful of them."""
    if not keys or any(not i or ":" in i or len(k) != 32 for i, k in keys.items()):
        raise ValueError("a key ring needs keys of 32 bytes, each with an id")
    return F.create_map(*[x for i, k in keys.items() for x in (F.lit(i), F.lit(bytearray(k)))])


def seal_token(text: Column, incident_id: Column, keys: dict[str, bytes], nonce: Column | None = None) -> Column:
    """``v1:key id:nonce:tag:ciphertext`` of a text under the first key of the ring, AES-GCM with the incident as additional data; ``nonce`` (12 bytes) is random if left out."""
    first = next(iter(keys))
    key, aad = F.try_element_at(_ring(keys), F.lit(first)), incident_id.cast("string").cast("binary")
    extra = (nonce, aad) if nonce is not None else (F.lit(bytearray()), aad)
    sealed = F.aes_encrypt(text.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), *extra)
    n = F.octet_length(sealed)
    part = lambda at, size: _url64(F.substring(sealed, at, size))
    return F.concat_ws(":", F.lit("v1"), F.lit(first), part(F.lit(1), F.lit(12)), part(n - 15, F.lit(16)), part(F.lit(13), n - 28))


def open_token(token: Column, incident_id: Column, keys: dict[str, bytes]) -> Column:
    """struct<text, problem>: what a token holds, by the key of the ring that it names; a token of another form, key or incident, or one that was changed, has a problem and no text."""
    p = F.split(token, ":")
    form = F.coalesce((F.size(p) == 5) & (F.get(p, F.lit(0)) == "v1") & ~F.exists(F.slice(p, 2, 3), lambda x: x == ""), F.lit(False))
    key = F.try_element_at(_ring(keys), F.get(p, F.lit(1)))
    whole = F.concat(_from_url64(F.get(p, F.lit(2))), _from_url64(F.get(p, F.lit(4))), _from_url64(F.get(p, F.lit(3))))
    text = F.when(form & key.isNotNull(), F.try_aes_decrypt(whole, key, F.lit("GCM"), F.lit("DEFAULT"), incident_id.cast("string").cast("binary")).cast("string"))
    problem = F.when(~form, "unrecognised outcome ciphertext").when(key.isNull(), F.concat(F.lit("outcome key "), F.get(p, F.lit(1)), F.lit(" is not configured"))).when(text.isNull(), "outcome ciphertext does not open")
    return F.struct(text.alias("text"), problem.alias("problem"))
