"""Access, evidence-gated promotion, conflicts, planned filters and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstone.functions import scoring as S

OWNER = "u0"


def allowed(memories: DataFrame, cognitive: DataFrame, acl: DataFrame, principal: tuple[str, str], roles: list[str], now: int, default_owner: str = OWNER) -> DataFrame:
    """Ids of live memories that a principal may read: without a sidecar the default owner, own private, own team, or by an entry."""
    kind, who = principal
    rows = memories.filter("invalid_at IS NULL").select("id")
    side = cognitive.select(F.col("memory_id").alias("id"), F.coalesce("visibility", F.lit("private")).alias("visibility"), "owner_type", "owner_id")
    both = rows.join(side.withColumn("known", F.lit(True)), "id", "left")
    own = F.col("known").isNull() & F.lit(who == default_owner)
    own = own | ((F.col("visibility") == "private") & (F.col("owner_type") == kind) & (F.col("owner_id") == who)) | ((F.col("visibility") == "team") & (F.col("owner_id") == who))
    named = (F.col("principal_type") == kind) & (F.col("principal_id") == who)
    if roles:
        named = named | ((F.col("principal_type") == "role") & F.col("principal_id").isin(roles))
    entry = acl.filter(named & F.col("permission").isin("read", "write", "admin") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    return both.filter(F.coalesce(own, F.lit(False))).select("id").union(rows.join(entry.select(F.col("memory_id").alias("id")), "id", "left_semi")).distinct()


def complete(evidence: DataFrame) -> DataFrame:
    """Evidence with locator, excerpt and time of observation."""
    full = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return evidence.filter(full("locator") & full("excerpt") & full("observed_at"))


def activation_counts(activations: DataFrame) -> DataFrame:
    """memory_id, adoptions, confirmations, and their distinct dates and non-blank sessions."""
    df = activations.filter(F.col("activation_kind").isin("adopted", "confirmed"))
    session = F.when(F.trim("session_id") != "", F.col("session_id"))
    return df.groupBy("memory_id").agg(
        F.count("*").alias("activations"), F.count_if(F.col("activation_kind") == "adopted").alias("adopted"), F.count_if(F.col("activation_kind") == "confirmed").alias("confirmed"),
        F.countDistinct("occurred_date").alias("dates"), F.countDistinct(session).alias("sessions"))


def open_conflicts(conflicts: DataFrame) -> DataFrame:
    """memory_id of either side of open conflicts."""
    return conflicts.filter("status = 'open'").select(F.explode(F.array("left_memory_id", "right_memory_id")).alias("memory_id")).distinct()


def promotion(cognitive: DataFrame, evidence: DataFrame, activations: DataFrame, conflicts: DataFrame) -> DataFrame:
    """memory_id, reasons and promoted for the step from the second tier to the third: promoted if no reason speaks against it."""
    counts = activation_counts(activations)
    proof = complete(evidence).groupBy("memory_id").agg(F.count("*").alias("evidence"))
    held = open_conflicts(conflicts).withColumn("held", F.lit(True))
    df = cognitive.filter("memory_tier = 'M2'").join(counts, "memory_id", "left").join(proof, "memory_id", "left").join(held, "memory_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    reasons = F.array_compact(F.array(
        F.when(F.col("verification_status") != "verified", "not_verified"), F.when(F.col("review_status") != "active", "not_active"), F.when(z("activations") < 3, "few_activations"),
        F.when((z("dates") < 2) & (z("sessions") < 2), "one_occasion"), F.when(z("evidence") < 2, "little_evidence"), F.when(F.coalesce("held", F.lit(False)), "open_conflict")))
    return df.select("memory_id", z("activations").alias("activations"), F.concat_ws(",", reasons).alias("reasons"), (F.size(reasons) == 0).alias("promoted"))


def dream_effect(events: DataFrame, on_date: str) -> DataFrame:
    """memory_id and the decayed, capped change in accessibility on a date; later events don't count."""
    age = F.date_diff(F.lit(on_date).cast("date"), F.col("occurred_date"))
    df = events.filter(age >= 0)
    return df.groupBy("memory_id").agg(F.least(F.lit(S.DREAM_CAP), F.sum(S.decayed(S.dream_delta(F.col("phase_count")), age.cast("double")))).alias("dream"))


def planned_reason(depth: str = "Q2", books: bool = False, hypotheses: bool = False) -> Column:
    """Why a candidate with its sidecar is left out of planned recall, or null. Books are for the deepest plan, or where wanted."""
    out = F.when(F.coalesce("status", F.lit("active")) != "active", "inactive")
    out = out.when(F.coalesce(F.col("verification_status") == "rejected", F.lit(False)) | F.coalesce(F.col("review_status") == "retired", F.lit(False)), "governance_rejected_or_retired")
    if not hypotheses:
        out = out.when(F.col("memory_form") == "hypothesis", "hypothesis_excluded")
    if not books and depth != "Q3":
        out = out.when(F.lower(F.coalesce("kind", F.lit(""))).isin("knowledge_book", "book") | F.coalesce(F.col("source") == "books", F.lit(False)), "book_excluded")
    return out.when(F.coalesce("lifecycle_stage", F.lit("consolidated")) == "deep", "deep_memory_excluded") if depth == "Q1" else out


def planned(candidates: DataFrame, facets: DataFrame, conflicts: DataFrame, dream: DataFrame, domains: list[str], names: list[str], forms: list[str] = (), project: str = "", depth: str = "Q2", books: bool = False, hypotheses: bool = False) -> DataFrame:
    """Candidates (id, rrf_score and sidecar columns) with their hits, the filter reason and the planned score, rounded to four places."""
    lower = lambda xs: sorted({x.strip().lower() for x in xs if x.strip()})
    hit = lambda kind, values: (F.col("facet_type") == kind) & F.col("facet_value").isin(values)
    domains, names, project = lower(domains), lower(names), lower([project])
    seen = facets.filter(hit("domain", domains) | hit("entity", names) | hit("project", project)).select("memory_id", "facet_type", "facet_value").distinct()
    values = lambda kind: F.sort_array(F.collect_list(F.when(F.col("facet_type") == kind, F.col("facet_value"))))
    hits = seen.groupBy(F.col("memory_id").alias("id")).agg(values("domain").alias("domain_hits"), values("entity").alias("entity_hits"), F.count_if(F.col("facet_type") == "project").alias("project_hits"))
    held = open_conflicts(conflicts).select(F.col("memory_id").alias("id"), F.lit(True).alias("conflicted"))
    for c in ("status", "verification_status", "review_status", "lifecycle_stage", "memory_tier", "source", "source_id", "confidence", "root_source_id"):
        if c not in candidates.columns:
            candidates = candidates.withColumn(c, F.lit(None).cast("double" if c == "confidence" else "string"))
    df = candidates.join(hits, "id", "left").join(held, "id", "left").join(dream.withColumnRenamed("memory_id", "id"), "id", "left")
    none = F.array().cast("array<string>")
    df = df.withColumns({"domain_hits": F.coalesce("domain_hits", none), "entity_hits": F.coalesce("entity_hits", none), "conflicted": F.coalesce("conflicted", F.lit(False)), "dream_boost": F.coalesce("dream", F.lit(0.0)),
        "memory_form": F.coalesce("memory_form", S.memory_form(F.col("kind"), F.lit(None).cast("string"))), "lifecycle_stage": F.coalesce("lifecycle_stage", F.lit("consolidated")), "memory_tier": F.coalesce("memory_tier", F.lit("M0")),
        "verification_status": F.coalesce("verification_status", F.lit("unreviewed")), "review_status": F.coalesce("review_status", F.lit("quarantine"))}).drop("dream")
    form_hit = F.col("memory_form").isin([f for f in lower(forms) if f in S.FORMS])
    m = S.planned_multiplier(F.size("domain_hits"), F.size("entity_hits"), form_hit, F.col("confidence"), F.coalesce(F.col("project_hits") > 0, F.lit(False)), F.col("dream_boost"), F.col("conflicted"))
    tagged = lambda tag, c: F.transform(c, lambda x: F.concat(F.lit(tag), x))
    via = F.filter(F.split("via", r"\+"), lambda x: x != "") if "via" in candidates.columns else none
    why = F.concat(F.coalesce(via, none), tagged("领域:", F.col("domain_hits")), tagged("实体:", F.col("entity_hits")), F.when(form_hit, F.array(F.concat(F.lit("记忆类型:"), "memory_form"))).otherwise(none), F.when(F.col("dream_boost") > 0, F.array(F.lit("梦境可达性"))).otherwise(none))
    return df.withColumns({"filter_reason": planned_reason(depth, books, hypotheses), "why_recalled": why, "score": F.round(F.col("rrf_score") * m, 4), "confidence": F.round(F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.7).otherwise(F.col("confidence")), 3)})


PACKED = "query string, id string, position int, snippet string, tokens int, stop string"


def packed(candidates: DataFrame, items: int, chars: int, tokens: int, floor: float = 0.02) -> DataFrame:
    """Greedy choice of each query's candidates (query, id, score, rrf_score, sim, snippet, coverage array) under budgets.

    Best score first, the fused score, the similarity and the id among equal ones; snippets are cut to the characters and
    tokens left, a character is a token; after the first choice a candidate that covers nothing new needs a fused score of
    ``floor``. ``stop`` says why a candidate isn't chosen. Each query's list is bounded by its channels' caps.
    """
    import pandas as pd

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, used, covered, chosen = [], 0, set(), 0
        for r in pdf.sort_values(["score", "rrf_score", "sim", "id"], ascending=[False, False, False, True]).itertuples():
            if chosen >= items:
                stop = "item_budget_dropped"
            elif used >= chars:
                stop = "char_budget_dropped"
            elif used >= tokens:
                stop = "token_budget_dropped"
            elif not r.snippet:
                stop = "budget_dropped"
            elif chosen and not set(r.coverage) - covered and r.rrf_score < floor:
                stop = "coverage_duplicate"
            else:
                text = r.snippet[: min(chars - used, tokens - used)]
                used, chosen, covered = used + len(text), chosen + 1, covered | set(r.coverage)
                rows.append((r.query, r.id, chosen, text, len(text), ""))
                continue
            rows.append((r.query, r.id, None, None, 0, stop))
        return pd.DataFrame(rows, columns=["query", "id", "position", "snippet", "tokens", "stop"]).astype({"position": "Int32"})

    return candidates.groupBy("query").applyInPandas(choose, PACKED)


def seeded_sample(rows: DataFrame, seed: str, most: int = 512, take: int = 8) -> DataFrame:
    """A repeatable sample of (id, memory_tier, memory_form): the first of each (tier, form) by id, ordered by a hash of seed and id."""
    groups = rows.select("memory_tier", "memory_form").distinct().count()
    each = -(-most // max(1, groups))
    w = Window.partitionBy("memory_tier", "memory_form").orderBy("id")
    pool = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= each)
    order = lambda *parts: F.sha2(F.concat_ws("|", *parts), 256)
    cut = pool.orderBy(order(F.lit(seed), F.lit("pool"), F.col("id"))).limit(most)
    return cut.orderBy(order(F.lit(seed), F.col("id"))).limit(take).select("id", "memory_tier", "memory_form")


def backlog(memories: DataFrame, cognitive: DataFrame, limit: int = 100) -> DataFrame:
    """Sidecar rows for the oldest memories without one."""
    new = memories.join(cognitive, F.col("id") == F.col("memory_id"), "left_anti").orderBy("created_ts", "id").limit(limit)
    none = F.lit(None).cast("string")
    return new.select(F.col("id").alias("memory_id"), S.memory_form(F.col("kind"), none).alias("memory_form"), S.lifecycle_stage(F.col("kind"), none).alias("lifecycle_stage"))


# transitions

TIER_FIELDS = ["source", "source_id", "observed_at", "valid_from", "valid_to"]


def promotion_reasons(cognitive: DataFrame, evidence: DataFrame, activations: DataFrame, conflicts: DataFrame, parents: DataFrame, to_tier: str) -> DataFrame:
    """memory_id and the reasons that speak against its promotion to a tier; it may be promoted if there are none.

    ``parents`` are (memory_id, parent_id) of the memories that it sums up.
    """
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    proof = complete(evidence).groupBy("memory_id").agg(F.count("*").alias("proofs"))
    held = open_conflicts(conflicts).withColumn("held", F.lit(True))
    df = cognitive.join(proof, "memory_id", "left").join(held, "memory_id", "left")
    reasons = [F.when(F.coalesce("held", F.lit(False)), "open_conflict")]
    if to_tier == "M1":
        reasons += [F.when(F.trim(F.coalesce(f, F.lit(""))) == "", f"{f}_required") for f in TIER_FIELDS]
        reasons.append(F.when(z("proofs") < 1, "complete_evidence_required"))
    elif to_tier == "M2":
        side = cognitive.select(F.col("memory_id").alias("parent_id"), F.col("memory_tier").alias("pt"), F.col("verification_status").alias("pv"))
        kin = parents.distinct().join(side, "parent_id").groupBy("memory_id").agg(F.count("*").alias("kin"), F.count_if(~F.col("pt").isin("M1", "M2", "M3")).alias("low"), F.count_if(F.col("pv") != "verified").alias("unsure"))
        df = df.join(kin, "memory_id", "left")
        reasons += [F.when((F.col("memory_tier") != "M1") | (F.col("verification_status") != "verified"), "current_memory_must_be_verified_M1"), F.when((z("kin") < 2) | (z("low") > 0), "two_verified_M1_parents_required"), F.when(z("unsure") > 0, "parent_verification_required")]
    elif to_tier == "M3":
        df = df.join(activation_counts(activations).select("memory_id", "activations", "dates", "sessions"), "memory_id", "left")
        alone = (z("activations") < 3) | ((z("dates") < 2) & (z("sessions") < 2))
        reasons += [F.when(F.col("memory_tier") != "M2", "current_memory_must_be_M2"), F.when(alone, "independent_adoption_required"), F.when(z("proofs") < 2, "two_evidence_items_required")]
    else:
        raise ValueError("a memory is promoted to M1, M2 or M3")
    return df.select("memory_id", F.array_compact(F.array(*reasons)).alias("reasons"))


def nightly(gated: DataFrame, cognitive: DataFrame, limit: int = 100) -> DataFrame:
    """memory_id of what ``promotion`` lets pass, the most adopted first, then those verified longest ago; ``limit`` at most."""
    return gated.filter("promoted").select("memory_id").join(cognitive.select("memory_id", "activation_count", "last_verified_ts"), "memory_id").orderBy(F.desc("activation_count"), F.asc("last_verified_ts"), "memory_id").limit(limit).select("memory_id")


def dream_reasons(mentions: DataFrame, allowed_ids: DataFrame, cognitive: DataFrame) -> DataFrame:
    """``mentions`` (memory_id, ...) with ``reason``: why a mention in a dream isn't accepted, or null."""
    side = cognitive.select("memory_id", "memory_tier", "verification_status", "review_status", "status", F.lit(True).alias("known"))
    df = mentions.join(allowed_ids.select(F.col("id").alias("memory_id"), F.lit(True).alias("readable")).distinct(), "memory_id", "left").join(side, "memory_id", "left")
    reason = (
        F.when(F.col("readable").isNull(), "acl_denied").when(F.col("known").isNull(), "governance_row_missing").when(~F.coalesce("memory_tier", F.lit("M0")).isin("M1", "M2", "M3"), "stable_tier_required")
        .when(F.coalesce("verification_status", F.lit("unreviewed")) != "verified", "verified_memory_required").when((F.coalesce("review_status", F.lit("quarantine")) != "active") | (F.coalesce("status", F.lit("active")) != "active"), "active_memory_required"))
    return df.select(*mentions.columns, reason.alias("reason"))


def dream_seeds(memories: DataFrame, cognitive: DataFrame, readable: DataFrame, seed: str, limit: int = 4, chars: int = 2800, each: int = 700) -> DataFrame:
    """A repeatable sample of readable memories for a dream: verified stable ones, or the lowest tier where there are none.

    In order of a hash of seed and id; texts are cut to ``each`` characters and to what is left of ``chars``.
    """
    fit = lambda tiers, verification, review: cognitive.filter(F.col("memory_tier").isin(tiers) & (F.col("verification_status") == verification) & (F.col("review_status") == review) & (F.col("status") == "active") & (F.col("memory_form") != "hypothesis"))
    pools = [("verified_stable", ["M1", "M2", "M3"], fit(["M1", "M2", "M3"], "verified", "active")), ("legacy_unverified_dream_only", ["M0"], fit(["M0"], "unreviewed", "quarantine"))]
    for name, tiers, rows in pools:
        pool = seeded_pool(rows.withColumnRenamed("memory_id", "id"), seed, tiers).select("id", "memory_tier", "memory_form").join(readable.select("id").distinct(), "id", "left_semi")
        if name == pools[-1][0] or not pool.isEmpty():
            break
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col("id")), 256)
    df = pool.join(memories.select("id", "content"), "id").withColumn("text", F.substring(F.trim("content"), 1, each)).filter("text <> ''")
    # a text that comes after the limit, or after the characters are used up, can't be chosen
    w = Window.orderBy("by")
    df = df.withColumn("by", order).orderBy("by").limit(limit).withColumn("before", F.coalesce(F.sum(F.char_length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return df.filter(F.col("before") < chars).select("id", "memory_tier", "memory_form", F.expr(f"substring(text, 1, CAST({chars} - before AS INT))").alias("snippet"), F.lit(name).alias("pool"), F.lit(name == "verified_stable").alias("reinforced"), F.row_number().over(w).alias("position"))


def seeded_pool(rows: DataFrame, seed: str, tiers: list[str], most: int = 512) -> DataFrame:
    """The first ceil(most / groups) ids of each of the tiers' (tier, form), then ``most`` by a hash of seed and id."""
    each = -(-most // (len(tiers) * (len(S.FORMS) - 1)))
    w = Window.partitionBy("memory_tier", "memory_form").orderBy("id")
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= each).drop("rn").orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.lit("pool"), F.col("id")), 256)).limit(most)


def reviewed(conflicts: DataFrame, conflict: str, resolution: str, winner: str = "", locator: str = "") -> DataFrame:
    """Conflicts after a review. A resolution needs a winner and a locator; a closed conflict is only opened again by a call for more evidence."""
    if resolution not in ("resolved", "dismissed", "needs_more_evidence"):
        raise ValueError("unknown resolution")
    if resolution == "resolved" and not (winner.strip() and locator.strip()):
        raise ValueError("a resolved conflict needs a winner and evidence")
    row = conflicts.filter(F.col("conflict_id") == conflict).first()
    if row is None:
        raise KeyError(conflict)
    if row.status != "open" and resolution != "needs_more_evidence":
        raise RuntimeError("the conflict is closed already")
    new = "open" if resolution == "needs_more_evidence" else resolution
    return conflicts.withColumn("status", F.when(F.col("conflict_id") == conflict, new).otherwise(F.col("status")))


def relabelled(cognitive: DataFrame, conflicts: DataFrame, sides: DataFrame) -> DataFrame:
    """The sidecar after a review of conflicts with these ``sides`` (memory_id): conflicted and to be reviewed while one is open, else verified and active. Other rows stay."""
    held = open_conflicts(conflicts).withColumn("held", F.lit(True))
    df = cognitive.join(sides.select("memory_id", F.lit(True).alias("side")).distinct(), "memory_id", "left").join(held, "memory_id", "left")
    new = lambda c, a, b: F.when(F.col("side") & F.col("held"), a).when(F.col("side"), b).otherwise(F.col(c)).alias(c)
    return df.withColumns({"verification_status": new("verification_status", "conflicted", "verified"), "review_status": new("review_status", "needs_review", "active")}).select(*cognitive.columns)


def superseded(memories: DataFrame, cognitive: DataFrame, conflicts: DataFrame, old: str, new: str, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories, sidecar and conflicts after ``new`` takes ``old``'s place; raises unless new is verified above M0, old is live, and they differ."""
    if old == new:
        raise ValueError("a memory can't supersede itself")
    o = memories.filter(F.col("id") == old).join(cognitive.select(F.col("memory_id").alias("id")), "id").first()
    n = cognitive.filter(F.col("memory_id") == new).first()
    if o is None or n is None:
        raise KeyError(old if o is None else new)
    if o.invalid_at is not None:
        raise RuntimeError("the old memory is inactive already")
    if n.memory_tier == "M0" or n.verification_status != "verified":
        raise RuntimeError("the new memory must be verified at M1 or above")
    hit = F.col("id") == old
    m = memories.withColumns({"invalid_at": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("invalid_at")), "superseded_by": F.when(hit, F.lit(new)).otherwise(F.col("superseded_by"))})
    c = cognitive.withColumns({"review_status": F.when(F.col("memory_id") == old, "retired").otherwise(F.col("review_status")), "supersedes_memory_id": F.when(F.col("memory_id") == new, F.lit(old)).otherwise(F.col("supersedes_memory_id"))})
    part = (F.col("status") == "open") & (F.col("left_memory_id").isin(old, new) | F.col("right_memory_id").isin(old, new))
    return m, c, conflicts.withColumn("status", F.when(part, "resolved").otherwise(F.col("status")))
