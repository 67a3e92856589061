"""Registering memories: one parse of their JSON attributes, fanned out into the governance tables.

Ordinary writes always enter at the lowest tier, unreviewed, in quarantine, private to their author. Only trusted callers
(migrations, tests) may carry a tier, a verification, an owner, visibility and access entries in the attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.functions import scoring as S
from loamstone.functions import text as X

#: Allowed values (fixed values).
TIERS = ["M0", "M1", "M2", "M3"]
VERIFICATIONS = ["unreviewed", "verified", "rejected", "conflicted"]
REVIEWS = ["quarantine", "active", "needs_review", "retired"]
VISIBILITIES = ["private", "team", "restricted", "agent"]
PERMISSIONS = ["read", "write", "admin"]
VERSION = "governance-v2"


def _meta(key: str) -> Column:
    return F.coalesce(F.get_json_object("meta", f"$.{key}"), F.lit(""))


def _first(*keys: str, size: int) -> Column:
    """The first of these attributes that isn't blank, trimmed and cut."""
    return F.substring(F.trim(F.coalesce(*[F.nullif(_meta(k), F.lit("")) for k in keys], F.lit(""))), 1, size)


def _one_of(value: Column, allowed: list[str], default: str | Column) -> Column:
    return F.when(value.isin(allowed), value).otherwise(F.lit(default) if isinstance(default, str) else default)


def _objects(key: str) -> Column:
    """The objects of an attribute that is one or a list of them, as JSON strings."""
    raw = F.trim(_meta(key))
    many = F.from_json(raw, "array<string>")
    found = F.when(F.substring(raw, 1, 1) == "[", F.coalesce(many, F.array().cast("array<string>"))).when(F.substring(raw, 1, 1) == "{", F.array(raw)).otherwise(F.array().cast("array<string>"))
    return F.filter(found, lambda x: F.substring(F.trim(F.coalesce(x, F.lit(""))), 1, 1) == "{")


def _of(json: Column, *keys: str, size: int) -> Column:
    return F.substring(F.trim(F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{k}"), F.lit("")) for k in keys], F.lit(""))), 1, size)


def evidence_of(rows: DataFrame) -> DataFrame:
    """memory_id, evidence_type, locator, excerpt, observed_at of the evidence with a locator; one row a locator."""
    df = rows.select(F.col("id").alias("memory_id"), F.explode(_objects("evidence")).alias("e"))
    kind = _of(F.col("e"), "type", size=80)
    df = df.select("memory_id", F.when(kind == "", "source").otherwise(kind).alias("evidence_type"), _of(F.col("e"), "locator", "url", "source_ref", size=1000).alias("locator"), _of(F.col("e"), "excerpt", "statement", size=2000).alias("excerpt"), _of(F.col("e"), "observed_at", size=80).alias("observed_at"))
    return df.filter("locator <> ''").dropDuplicates(["memory_id", "evidence_type", "locator"])


def sidecars(rows: DataFrame, principal: tuple[str, str], now: int, trusted: bool = False) -> DataFrame:
    """The governance row of each memory (id, kind, mode_id, meta)."""
    kind, who = principal[0].strip().lower()[:40], principal[1].strip()[:160]
    own = lambda key, size, default: F.when(_first(key, size=size) == "", F.lit(default)).otherwise(_first(key, size=size)) if trusted else F.lit(default)
    verification = _one_of(F.lower(_first("verification_status", size=40)), VERIFICATIONS, F.when(X.truthy(_meta("verified")), "verified").otherwise("unreviewed")) if trusted else F.lit("unreviewed")
    review = F.lower(_first("review_status", size=40))
    review = _one_of(F.when(review == "", F.when(verification == "verified", "active").otherwise("quarantine")).otherwise(review), REVIEWS, "quarantine") if trusted else F.lit("quarantine")
    confidence = F.expr("try_cast(get_json_object(meta, '$.confidence') AS double)")
    source_id = _first("source_id", size=300)
    proofs = evidence_of(rows).filter("trim(excerpt) <> '' AND trim(observed_at) <> ''").groupBy("memory_id").agg(F.count("*").cast("int").alias("evidence_count"))
    active = F.expr("coalesce(try_cast(get_json_object(meta, '$.activation_count') AS int), 0)") if trusted else F.lit(0)
    status, version, sensitivity = _first("status", size=40), _first("classification_version", size=80), _first("sensitivity", size=40)
    out = rows.select(
        F.col("id").alias("memory_id"), S.memory_form(F.col("kind"), _meta("memory_form")).alias("memory_form"), S.lifecycle_stage(F.col("kind"), _meta("lifecycle_stage")).alias("lifecycle_stage"), F.when(status == "", "active").otherwise(status).alias("status"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.coalesce(confidence, F.lit(0.0)) == 0, 0.7).otherwise(confidence))).alias("confidence"), F.when(sensitivity == "", "internal").otherwise(sensitivity).alias("sensitivity"),
        source_id.alias("source_id"), _first("source", "source_type", size=120).alias("source"), F.when(_first("scope", "project", size=200) == "", F.substring(F.coalesce("mode_id", F.lit("")), 1, 200)).otherwise(_first("scope", "project", size=200)).alias("scope"),
        _first("observed_at", "happened_at", size=80).alias("observed_at"), _first("valid_from", size=40).alias("valid_from"), _first("valid_to", size=40).alias("valid_to"), _first("review_after", size=40).alias("review_after"), F.when(version == "", "cognitive-v2").otherwise(version).alias("classification_version"),
        (_one_of(F.upper(_first("memory_tier", size=2)), TIERS, "M0") if trusted else F.lit("M0")).alias("memory_tier"), verification.alias("verification_status"), review.alias("review_status"), F.lower(own("owner_type", 40, kind)).alias("owner_type"), own("owner_id", 160, who).alias("owner_id"),
        (_one_of(F.lower(_first("visibility", size=40)), VISIBILITIES, "private") if trusted else F.lit("private")).alias("visibility"), (_first("parent_memory_id", size=160) if trusted else F.lit("")).alias("parent_memory_id"), (_first("supersedes_memory_id", size=160) if trusted else F.lit("")).alias("supersedes_memory_id"),
        F.when(_first("root_source_id", size=300) != "", _first("root_source_id", size=300)).when(source_id != "", source_id).otherwise(F.col("id")).alias("root_source_id"), F.greatest(F.lit(0), active).alias("activation_count"), F.lit(0).alias("adopted_count"), F.lit(0).alias("confirmed_count"), F.lit(0).alias("seen_count"),
        F.when(verification == "verified", F.lit(now)).otherwise(F.lit(0)).cast("long").alias("last_verified_ts"), F.lit(VERSION).alias("governance_version"), F.lit(now).cast("long").alias("updated_ts"))
    return out.join(proofs, "memory_id", "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))


def access_of(rows: DataFrame, sides: DataFrame, trusted: bool = False) -> DataFrame:
    """memory_id, principal_type, principal_id, permission, expires_at: the owner as admin, and what a trusted caller grants."""
    own = sides.select("memory_id", F.col("owner_type").alias("principal_type"), F.col("owner_id").alias("principal_id"), F.lit("admin").alias("permission"), F.lit(None).cast("long").alias("expires_at"))
    if not trusted:
        return own
    e = rows.select(F.col("id").alias("memory_id"), F.explode(_objects("acl")).alias("e"))
    kind, permission = F.lower(_of(F.col("e"), "type", "principal_type", size=40)), F.lower(_of(F.col("e"), "permission", size=40))
    more = e.select("memory_id", F.when(kind == "", "user").otherwise(kind).alias("principal_type"), _of(F.col("e"), "id", "principal_id", size=160).alias("principal_id"), F.when(permission == "", "read").otherwise(permission).alias("permission"), F.expr("try_cast(get_json_object(e, '$.expires_at') AS long)").alias("expires_at"))
    return own.unionByName(more.filter((F.col("principal_id") != "") & F.col("permission").isin(PERMISSIONS))).dropDuplicates(["memory_id", "principal_type", "principal_id", "permission"])


def facets_of(rows: DataFrame) -> DataFrame:
    """memory_id, facet_type, facet_value (lower case): domains, entities, tags and project."""
    lists = {"domain": ("domains", "domain"), "entity": ("entities",), "tag": ("tags",), "project": ("project", "scope")}
    raw = lambda keys: F.coalesce(*[F.nullif(F.nullif(_meta(k), F.lit("")), F.lit("[]")) for k in keys], F.lit(""))
    tagged = lambda kind: lambda v: F.struct(F.lit(kind).alias("facet_type"), F.lower(v).alias("facet_value"))
    pairs = F.flatten(F.array(*[F.transform(X.listed_json(raw(keys)), tagged(kind)) for kind, keys in lists.items()]))
    return rows.select(F.col("id").alias("memory_id"), F.explode(pairs).alias("f")).select("memory_id", "f.*").distinct()


def lineage_of(rows: DataFrame, sides: DataFrame) -> DataFrame:
    """child, parent and relation_type of memories that name a parent or what they supersede."""
    named = sides.join(rows.select(F.col("id").alias("memory_id"), _first("parent_relation", size=40).alias("relation")), "memory_id")
    parent = named.filter("parent_memory_id <> ''").select(F.col("memory_id").alias("child"), F.col("parent_memory_id").alias("parent"), F.when(F.col("relation") == "", "derived_from").otherwise(F.col("relation")).alias("relation_type"))
    return parent.union(named.filter("supersedes_memory_id <> ''").select("memory_id", "supersedes_memory_id", F.lit("supersedes")))


def conflicts_of(rows: DataFrame, now: int) -> DataFrame:
    """Open conflicts with the memories that a memory says it contradicts; the id is that of the unordered pair."""
    reason = _first("conflict_reason", size=1000)
    df = rows.select("id", F.explode(X.listed_json(_meta("conflicts_with"))).alias("other"), F.when(reason == "", "source statements disagree").otherwise(reason).alias("reason")).filter("other <> id")
    return df.select(F.concat(F.lit("conf-"), S.conflict_id(F.col("other"), F.col("id"))).alias("conflict_id"), F.col("other").alias("left_memory_id"), F.col("id").alias("right_memory_id"), "reason", F.lit("open").alias("status"), F.lit(now).cast("long").alias("created_ts")).dropDuplicates(["conflict_id"])


def registered(rows: DataFrame, principal: tuple[str, str], now: int, trusted: bool = False) -> dict[str, DataFrame]:
    """All governance tables' new rows by table name."""
    sides = sidecars(rows, principal, now, trusted)
    return {"memory_cognitive": sides, "memory_evidence": evidence_of(rows), "memory_acl": access_of(rows, sides, trusted), "memory_facets": facets_of(rows), "memory_lineage": lineage_of(rows, sides), "memory_conflicts": conflicts_of(rows, now)}
