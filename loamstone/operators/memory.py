"""Recall, state, review and life-cycle operators over memory tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstone.functions import scoring as S
from loamstone.functions import text as X

PERSONAL = ["episodic", "semantic", "procedural"]


def live(memories: DataFrame) -> DataFrame:
    return memories.filter("invalid_at IS NULL")


def filtered(memories: DataFrame, kind: str | None = None, query: str | None = None, persona: str | None = None, personal: bool = False) -> DataFrame:
    """Live memories of a kind, with the query in their content, of a persona, or of the personal kinds."""
    df = live(memories)
    if kind:
        df = df.filter(F.col("kind") == kind)
    if query:
        df = df.filter(X.like_contains(F.col("content"), query))
    if persona:
        df = df.filter(F.col("persona_id") == persona)
    if personal:
        df = df.filter(F.col("kind").isin(PERSONAL))
    return df


def recall(memories: DataFrame, now: int, k: int = 20, pool: int = 500, static: bool = False, bonus: DataFrame | None = None, **where) -> DataFrame:
    """The ``pool`` latest recalled memories that fit, by activation (plus the ``bonus`` of an ``id``) or by time if ``static``."""
    latest = filtered(memories, **where).orderBy(F.desc("last_recall_ts"), "id").limit(pool)
    df = latest.withColumn("score", S.activation(now))
    if bonus is not None:
        df = df.join(bonus.select("id", "bonus"), "id", "left").withColumn("score", F.col("score") + F.coalesce("bonus", F.lit(0.0))).drop("bonus")
    order = F.desc("last_recall_ts") if static else F.desc("score")
    return df.orderBy(order, "id").limit(k)


def states(memories: DataFrame, now: int) -> DataFrame:
    r = S.retrievability(now)
    return memories.select(
        "id", S.tier_of(r).alias("tier"), F.round(r, 4).alias("retrievability"), F.round(S.activation(now), 4).alias("activation"),
        F.round(S.days_between(now, F.coalesce("last_recall_ts", "created_ts")), 2).alias("days_since_recall"), F.round(F.greatest(F.lit(1.0), S.stability_or_default(F.col("stability"))), 2).alias("stability_days"),
    )


def touched(memories: DataFrame, touches: DataFrame) -> DataFrame:
    """Memories with recalls counted and the latest time of ``touches`` (id, ts)."""
    agg = touches.groupBy("id").agg(F.count("*").alias("n"), F.max("ts").alias("t"))
    out = memories.join(agg, "id", "left")
    return out.withColumn("recall_count", (F.col("recall_count") + F.coalesce("n", F.lit(0))).cast("int")).withColumn("last_recall_ts", F.greatest("last_recall_ts", F.coalesce("t", "last_recall_ts"))).drop("n", "t")


def with_stability(memories: DataFrame, reviews: DataFrame) -> DataFrame:
    """id, stability and difficulty from importance, recalls and reviews."""
    df = memories.join(reviews, memories.id == reviews.memory_id, "left")
    return df.select("id", S.stability(F.col("importance"), F.col("recall_count"), F.col("ef"), F.col("repetitions")).alias("stability"), S.difficulty(F.col("importance")).alias("difficulty"))


def due(memories: DataFrame, reviews: DataFrame, now: int, limit: int = 20) -> DataFrame:
    cards = reviews.filter(F.col("next_review_ts") <= now)
    return live(memories).join(cards, F.col("id") == F.col("memory_id")).select("id", "next_review_ts", "ef", "interval_days", "repetitions").orderBy("next_review_ts", "id").limit(limit)


def review_stats(reviews: DataFrame, now: int) -> DataFrame:
    return reviews.agg(F.count("*").alias("total"), F.count_if(F.col("next_review_ts") <= now).alias("due_now"), F.count_if(F.col("next_review_ts") <= now + 7 * S.DAY).alias("due_in_7d"))


def graded(reviews: DataFrame, now: int) -> DataFrame:
    """Each card after its grade; the next review is ``interval_days`` from now."""
    step = S.sm2(F.col("ef"), F.col("interval_days"), F.col("repetitions"), F.col("grade"))
    return reviews.select("memory_id", step.alias("s")).select("memory_id", "s.*", (F.lit(now) + F.col("s.interval_days").cast("long") * S.DAY).alias("next_review_ts"))


def graded_in_order(reviews: DataFrame, grades: DataFrame) -> DataFrame:
    """Each card after all of its ``grades`` (memory_id, seq, grade), folded in order of seq."""
    lists = grades.groupBy("memory_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "grade"))), lambda x: x.grade).alias("gs"))
    start = F.struct(F.col("ef").cast("double").alias("ef"), F.col("interval_days").cast("int").alias("interval_days"), F.col("repetitions").cast("int").alias("repetitions"))
    return reviews.join(lists, "memory_id").select("memory_id", F.aggregate("gs", start, lambda s, g: S.sm2(s.ef, s.interval_days, s.repetitions, g)).alias("s")).select("memory_id", "s.*")


def enrolled(memories: DataFrame, reviews: DataFrame, now: int, least: int = 4) -> DataFrame:
    """New cards for live memories of importance ``least`` or more that have none."""
    new = live(memories).filter(F.col("importance") >= least).join(reviews, F.col("id") == F.col("memory_id"), "left_anti")
    return new.select(F.col("id").alias("memory_id"), F.lit(2.5).alias("ef"), F.lit(0).alias("interval_days"), F.lit(0).alias("repetitions"), F.lit(now + S.DAY).cast("long").alias("next_review_ts"))


def protected(memories: DataFrame, reviews: DataFrame) -> DataFrame:
    """``memories`` with ``protected``: important, under review, or well connected."""
    cards = reviews.select(F.col("memory_id").alias("id"), F.lit(True).alias("card")).distinct()
    return memories.join(cards, "id", "left").withColumn("protected", (F.col("importance") >= 4) | F.coalesce("card", F.lit(False)) | (F.col("connection_density") >= 0.6)).drop("card")


def forget_plan(memories: DataFrame, reviews: DataFrame, now: int, threshold: float = 0.05, most: int = 50, scan: int = 2000) -> DataFrame:
    """Ids to forget: of the ``scan`` oldest memories, the unprotected ones under the threshold, ``most`` at most."""
    oldest = memories.orderBy("last_recall_ts", "id").limit(scan)
    low = protected(oldest, reviews).filter("NOT protected").withColumn("score", F.round(S.activation(now), 6)).filter(F.col("score") < threshold)
    return low.orderBy("last_recall_ts", "id").limit(most).select("id", "score", "last_recall_ts")


def without(table: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """``table`` without rows whose ``keys`` name an id of ``gone``: one step of a cascading delete."""
    for key in keys:
        table = table.join(gone.select(F.col("id").alias(key)), key, "left_anti")
    return table


def invalidated(memories: DataFrame, gone: DataFrame, now: int) -> DataFrame:
    """``memories`` with ``invalid_at`` set once for the ids of ``gone``."""
    hit = memories.join(gone.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    return hit.withColumn("invalid_at", F.when(F.col("hit") & F.col("invalid_at").isNull(), F.lit(now).cast("long")).otherwise(F.col("invalid_at"))).select(*memories.columns)


def hot(memories: DataFrame, cognitive: DataFrame) -> DataFrame:
    """Live memories whose sidecar is active, not deep and not retired."""
    fit = cognitive.filter("status = 'active' AND lifecycle_stage <> 'deep' AND review_status <> 'retired'")
    return live(memories).join(fit, F.col("id") == F.col("memory_id")).drop("memory_id")


def important(rows: DataFrame, limit: int) -> DataFrame:
    """The most important memories, the latest recalled first among equals."""
    return rows.orderBy(F.desc("importance"), F.desc("last_recall_ts"), "id").limit(limit)


def is_bundle_id(bundle_id: str) -> bool:
    return re.fullmatch("mb-[a-f0-9]{12,64}", bundle_id) is not None


def bundle(episodes: DataFrame, most: int = 1000) -> DataFrame:
    """One text a bundle: its parts in order, ``most`` at most; JSON parts give their ``content``. Ids that aren't bundle ids are left out."""
    parts = episodes.filter(F.col("bundle_id").rlike("^mb-[a-f0-9]{12,64}$"))
    part = F.coalesce(F.when(F.substring(F.trim("content"), 1, 1) == "{", F.get_json_object("content", "$.content")), F.col("content"))
    ranked = parts.withColumn("part", part).withColumn("rn", F.row_number().over(Window.partitionBy("bundle_id").orderBy("chunk_index", "part"))).filter(F.col("rn") <= most)
    return ranked.groupBy("bundle_id").agg(F.count("*").alias("n_parts"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "part"))), lambda x: x.part), "").alias("content"))


def first_of_source(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row a ``source_id`` (the first written); rows without one all stay; sources already stored go."""
    w = Window.partitionBy("source_id").orderBy("created_ts", "id")
    keyed = rows.filter("source_id IS NOT NULL").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    if stored is not None:
        keyed = keyed.join(stored.select("source_id").distinct(), "source_id", "left_anti").select(*rows.columns)
    return keyed.unionByName(rows.filter("source_id IS NULL"))


def change_plan(files: DataFrame, stored: DataFrame) -> DataFrame:
    """What to do with each name: insert, replace, skip, or keep one without a file (name, hash on either side)."""
    a, b = files.select("name", F.col("hash").alias("new")), stored.select("name", F.col("hash").alias("old"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "keep").when(F.col("old") == F.col("new"), "skip").otherwise("replace")
    return a.join(b, "name", "full").select("name", action.alias("action"))
