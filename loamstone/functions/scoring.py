"""Scoring, classification and scheduling functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
RRF_K = 60
DEFAULT_STABILITY = 14.0

#: Weight of each kind of memory in the activation score (fixed values).
KIND_PRIORITY = {
    "procedural": 1.00, "episodic": 0.90, "self_upgrade": 0.85, "knowledge_case": 0.70, "knowledge_pitfall": 0.65, "knowledge_standard": 0.60,
    "semantic": 0.55, "knowledge_kol": 0.48, "knowledge_book": 0.45, "knowledge_trend": 0.42, "knowledge_history": 0.40, "knowledge_slang": 0.35,
}
DEFAULT_PRIORITY = 0.40
#: Memory forms and lifecycle stages (fixed values).
FORMS = ["episodic", "semantic", "procedural", "preference", "prospective", "social", "evidence", "hypothesis"]
STAGES = ["sensory", "working", "hippocampal", "consolidated", "deep"]
#: Per depth: milliseconds, items, characters, and candidates of the lexical, vector and graph channels (fixed values).
DEPTHS = {"Q0": (0, 0, 0, 0, 0, 0), "Q1": (250, 4, 2400, 24, 24, 0), "Q2": (900, 8, 6400, 48, 48, 40), "Q3": (2500, 16, 16000, 96, 96, 80)}
#: Change in accessibility by the number of dream phases, its half-life in days and its cap (fixed values).
DREAM_DELTA, DREAM_HALF_LIFE, DREAM_CAP = {1: 0.020, 2: 0.028, 3: 0.035}, 30.0, 0.12


def depth(name: str | None) -> str:
    """Q0 to Q3 of a depth or its L alias; Q2 if unknown."""
    n = (name or "").strip().upper().replace("L", "Q")
    return n if n in DEPTHS else "Q2"


def _mapped(col: Column, values: dict, default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def kind_priority(kind: Column) -> Column:
    return _mapped(F.coalesce(kind, F.lit("")), KIND_PRIORITY, DEFAULT_PRIORITY)


def days_between(now: int, then: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(now) - then) / F.lit(float(DAY)))


def stability_or_default(stability: Column) -> Column:
    """Null and zero count as the default."""
    return F.when(F.coalesce(stability, F.lit(0.0)) == 0, F.lit(DEFAULT_STABILITY)).otherwise(stability)


def activation(now: int) -> Column:
    """Activation of a memory row at ``now``: recency, frequency, emotion, novelty, connection, prediction, age, importance, kind."""
    z = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    recency = F.exp(-days_between(now, F.coalesce("last_recall_ts", "created_ts")) / F.greatest(F.lit(1.0), stability_or_default(F.col("stability"))))
    return (
        recency + 0.6 * F.log1p(z("recall_count", 0)) + 0.8 * (2.0 * z("emotional_tag", 0.0)) + 0.5 * z("novelty", 0.5) + 0.7 * z("connection_density", 0.0)
        + 0.6 * z("predictive_value", 0.0) - 0.3 * (days_between(now, F.col("created_ts")) / 365.0) + 0.5 * (z("importance", 2) / 5.0) + kind_priority(F.col("kind"))
    )


def retrievability(now: int) -> Column:
    return F.exp(-days_between(now, F.coalesce("last_recall_ts", "created_ts")) / F.greatest(F.lit(1.0), stability_or_default(F.col("stability"))))


def tier_of(r: Column) -> Column:
    return F.when(r >= 0.85, "foreground").when(r >= 0.55, "active").when(r >= 0.20, "latent").otherwise("deep")


def stability(importance: Column, recall_count: Column, ef: Column, repetitions: Column) -> Column:
    """Days a memory holds; the review part counts only for a card with repetitions."""
    reviewed = F.when((F.coalesce(ef, F.lit(0.0)) != 0) & (F.coalesce(repetitions, F.lit(0)) != 0), (ef - 1.3) * repetitions * 8.0).otherwise(0.0)
    return F.round(importance / 5.0 * 30.0 + F.log1p(recall_count) * 15.0 + 1.0 + reviewed, 2)


def difficulty(importance: Column) -> Column:
    return F.round(1.0 - importance / 5.0, 3)


def sm2(ef: Column, interval: Column, reps: Column, grade: Column) -> Column:
    """SM-2 step as a struct (ef, interval_days, repetitions)."""
    g = F.greatest(F.lit(0), F.least(F.lit(5), grade))
    n = reps + 1
    later = F.greatest(F.lit(1), F.bround(interval * ef).cast("int"))
    raised = F.greatest(F.lit(1.3), ef + (F.lit(0.1) - (5 - g) * (F.lit(0.08) + (5 - g) * F.lit(0.02))))
    passed = F.struct(raised.alias("ef"), F.when(n == 1, 1).when(n == 2, 3).otherwise(later).alias("interval_days"), n.cast("int").alias("repetitions"))
    failed = F.struct(F.greatest(F.lit(1.3), ef - 0.2).alias("ef"), F.lit(1).alias("interval_days"), F.lit(0).alias("repetitions"))
    return F.when(g < 3, failed).otherwise(passed)


def rrf(rank: Column) -> Column:
    return F.lit(1.0) / (F.lit(RRF_K) + rank)


def memory_form(kind: Column, declared: Column) -> Column:
    said, k = F.lower(F.trim(declared)), F.lower(F.coalesce(kind, F.lit("semantic")))
    return (
        F.when(said.isin(FORMS), said).when(k.isin(FORMS), k).when(k.isin("knowledge_book", "book", "knowledge"), "semantic")
        .when(k.isin("decision", "lesson", "workflow", "self_upgrade"), "procedural").when(k.isin("dream", "idea", "inference"), "hypothesis").otherwise("semantic")
    )


def lifecycle_stage(kind: Column, declared: Column) -> Column:
    said = F.lower(F.trim(declared))
    return F.when(said.isin(STAGES), said).when(F.lower(F.coalesce(kind, F.lit(""))).isin("knowledge_book", "book"), "deep").otherwise("consolidated")


def token_count(content: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(content) / 3).cast("int"))


def concept_id(name: Column) -> Column:
    return F.concat(F.lit("c-"), F.substring(F.md5(F.lower(F.trim(name)).cast("binary")), 1, 12))


def conflict_id(left: Column, right: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.least(left, right), F.greatest(left, right)), 256), 1, 16)


def dream_delta(phases: Column) -> Column:
    return _mapped(phases, DREAM_DELTA, 0.0)


def decayed(delta: Column, age_days: Column) -> Column:
    return delta * F.pow(F.lit(0.5), age_days / DREAM_HALF_LIFE)


def hybrid_score(sim: Column, ppr_share: Column, act_share: Column, same_mode: Column, consolidated: Column) -> Column:
    return 0.5 * sim + 0.3 * ppr_share + 0.2 * act_share + F.when(same_mode, 0.08).otherwise(0.0) - F.when(consolidated, 0.05).otherwise(0.0)


def planned_multiplier(domains: Column, entities: Column, form_hit: Column, confidence: Column, project_hit: Column, dream: Column, conflicted: Column) -> Column:
    sure = F.when(F.coalesce(confidence, F.lit(0.0)) == 0, 0.7).otherwise(confidence)
    m = 1 + F.least(F.lit(0.06), 0.03 * domains) + F.least(F.lit(0.06), 0.03 * entities) + F.when(form_hit, 0.03).otherwise(0.0) + 0.04 * (sure - 0.5) + F.when(project_hit, 0.04).otherwise(0.0) + dream
    return m * F.when(conflicted, 0.90).otherwise(1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


def masked(secret: Column) -> Column:
    return F.when(F.coalesce(secret, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("***"), F.right(secret, F.lit(4))))


def backup_copies(importance: Column, age_days: Column) -> Column:
    """Number of pools that a memory is kept in."""
    return F.when((importance >= 4) | (age_days <= 90), 5).when(importance >= 3, 5).when(importance >= 2, 3).otherwise(2)
