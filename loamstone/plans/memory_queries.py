"""Registered queries over memories, reviews and life cycle, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamstone.functions import scoring as S
from loamstone.functions import text as X
from loamstone.operators import memory as M
from loamstone.plans.bridge import AS_OF, DAY, view

QUERIES, SQL = {}, {}

PRIORITY_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.KIND_PRIORITY.items()) + f" ELSE {S.DEFAULT_PRIORITY} END"
RECENCY_SQL = f"exp(-greatest(0.0, ({AS_OF} - last_recall_ts) / 86400.0) / greatest(1.0, CASE WHEN coalesce(stability, 0) = 0 THEN 14.0 ELSE stability END))"
ACTIVATION_SQL = f"""({RECENCY_SQL} + 0.6 * ln(1 + recall_count) + 1.6 * emotional_tag + 0.5 * novelty + 0.7 * connection_density + 0.6 * predictive_value
    - 0.3 * greatest(0.0, ({AS_OF} - created_ts) / 86400.0) / 365.0 + 0.5 * importance / 5.0 + CAST({PRIORITY_SQL} AS DOUBLE))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH latest AS (SELECT * FROM memories WHERE invalid_at IS NULL ORDER BY last_recall_ts DESC, id LIMIT 500)
    SELECT id, kind, round({ACTIVATION_SQL}, 6) AS score FROM latest ORDER BY {ACTIVATION_SQL} DESC, id LIMIT 20""")
def recall_activation(spark, d):
    return M.recall(view(spark, d, "memories"), AS_OF).select("id", "kind", F.round("score", 6).alias("score"))


@query("SELECT id, last_recall_ts FROM memories WHERE invalid_at IS NULL AND kind IN ('episodic', 'semantic', 'procedural') AND persona_id = 'en' ORDER BY last_recall_ts DESC, id LIMIT 25")
def recall_static_personal(spark, d):
    return M.recall(view(spark, d, "memories"), AS_OF, k=25, static=True, personal=True, persona="en").select("id", "last_recall_ts")


@query("""SELECT id FROM memories WHERE invalid_at IS NULL AND lower(content) LIKE '%anti%'""")
def like_search(spark, d):
    return M.filtered(view(spark, d, "memories"), query="ANTI").select("id")


@query(f"""SELECT id, CASE WHEN r >= 0.85 THEN 'foreground' WHEN r >= 0.55 THEN 'active' WHEN r >= 0.20 THEN 'latent' ELSE 'deep' END AS tier, round(r, 4) AS retrievability, days_since_recall
    FROM (SELECT id, {RECENCY_SQL} AS r, round(greatest(0.0, ({AS_OF} - last_recall_ts) / 86400.0), 2) AS days_since_recall FROM memories) x""")
def memory_states(spark, d):
    return M.states(view(spark, d, "memories"), AS_OF).select("id", "tier", "retrievability", "days_since_recall")


@query("""SELECT id, round(importance / 5.0 * 30.0 + ln(1 + recall_count) * 15.0 + 1.0 + CASE WHEN coalesce(repetitions, 0) <> 0 THEN (ef - 1.3) * repetitions * 8.0 ELSE 0.0 END, 2) AS stability, round(1.0 - importance / 5.0, 3) AS difficulty
    FROM memories LEFT JOIN review_state ON id = memory_id""")
def update_stability(spark, d):
    return M.with_stability(view(spark, d, "memories"), view(spark, d, "review_state"))


@query(f"""SELECT m.id, r.next_review_ts FROM memories m JOIN review_state r ON m.id = r.memory_id WHERE m.invalid_at IS NULL AND r.next_review_ts <= {AS_OF} ORDER BY r.next_review_ts, m.id LIMIT 20""")
def due_reviews(spark, d):
    return M.due(view(spark, d, "memories"), view(spark, d, "review_state"), AS_OF).select("id", "next_review_ts")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE next_review_ts <= {AS_OF}) AS due_now, count(*) FILTER (WHERE next_review_ts <= {AS_OF + 7 * DAY}) AS due_in_7d FROM review_state")
def review_stats(spark, d):
    return M.review_stats(view(spark, d, "review_state"), AS_OF)


@query("""SELECT memory_id, round(CASE WHEN g < 3 THEN greatest(1.3, ef - 0.2) ELSE greatest(1.3, ef + 0.1 - (5 - g) * (0.08 + (5 - g) * 0.02)) END, 6) AS ef,
        CAST(CASE WHEN g < 3 THEN 1 WHEN repetitions = 0 THEN 1 WHEN repetitions = 1 THEN 3 ELSE greatest(1, round_even(interval_days * ef, 0)) END AS BIGINT) AS interval_days, CASE WHEN g < 3 THEN 0 ELSE repetitions + 1 END AS repetitions
    FROM (SELECT *, greatest(0, least(5, grade)) AS g FROM review_state) x""")
def sm2_grade(spark, d):
    out = M.graded(view(spark, d, "review_state"), AS_OF)
    return out.select("memory_id", F.round("ef", 6).alias("ef"), F.col("interval_days").cast("long").alias("interval_days"), "repetitions")


@query(f"""SELECT id AS memory_id, {AS_OF + DAY} AS next_review_ts FROM memories WHERE invalid_at IS NULL AND importance >= 4 AND NOT EXISTS (SELECT 1 FROM review_state r WHERE r.memory_id = id)""")
def auto_enroll(spark, d):
    return M.enrolled(view(spark, d, "memories"), view(spark, d, "review_state"), AS_OF).select("memory_id", "next_review_ts")


@query(f"""WITH oldest AS (SELECT * FROM memories ORDER BY last_recall_ts, id LIMIT 2000)
    SELECT id, round({ACTIVATION_SQL}, 6) AS score FROM oldest WHERE importance < 4 AND connection_density < 0.6 AND id NOT IN (SELECT memory_id FROM review_state) AND round({ACTIVATION_SQL}, 6) < 1.2 ORDER BY last_recall_ts, id LIMIT 50""")
def forget_plan(spark, d):
    return M.forget_plan(view(spark, d, "memories"), view(spark, d, "review_state"), AS_OF, threshold=1.2).select("id", "score")


@query("""WITH gone AS (SELECT id FROM memories WHERE importance = 1) SELECT memory_id, facet_value FROM memory_facets WHERE memory_id NOT IN (SELECT id FROM gone)""")
def hard_delete_facets(spark, d):
    gone = view(spark, d, "memories").filter("importance = 1").select("id")
    return M.without(view(spark, d, "memory_facets"), gone, "memory_id").select("memory_id", "facet_value")


@query("""WITH gone AS (SELECT id FROM memories WHERE importance = 1) SELECT src, dst, weight FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)""")
def hard_delete_edges(spark, d):
    gone = view(spark, d, "memories").filter("importance = 1").select("id")
    return M.without(view(spark, d, "edges"), gone, "src", "dst").select("src", "dst", "weight")


@query(f"""SELECT id, CASE WHEN invalid_at IS NULL AND importance = 2 THEN {AS_OF} ELSE invalid_at END AS invalid_at FROM memories""")
def invalidate(spark, d):
    m = view(spark, d, "memories")
    return M.invalidated(m, m.filter("importance = 2").select("id"), AS_OF).select("id", "invalid_at")


@query("""SELECT m.id, c.memory_tier FROM memories m JOIN memory_cognitive c ON c.memory_id = m.id WHERE m.invalid_at IS NULL AND c.status = 'active' AND c.lifecycle_stage <> 'deep' AND c.review_status <> 'retired'""")
def hot_memories(spark, d):
    return M.hot(view(spark, d, "memories"), view(spark, d, "memory_cognitive")).select("id", "memory_tier")


@query("""SELECT bundle_id, count(*) AS n_parts, string_agg(part, '' ORDER BY chunk_index, part) AS content FROM (SELECT *, CASE WHEN chunk_index % 3 = 0 THEN 'part ' || CAST(chunk_index AS VARCHAR) ELSE content END AS part FROM episodes) x GROUP BY bundle_id""")
def bundles(spark, d):
    return M.bundle(view(spark, d, "episodes"))


@query("""SELECT id, source_id FROM (SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY created_ts, id) AS rn FROM memories) x WHERE source_id IS NULL OR rn = 1""")
def source_dedup(spark, d):
    return M.first_of_source(view(spark, d, "memories")).select("id", "source_id")


@query("""WITH files AS (SELECT 'f' || CAST(doc_id AS STRING) AS name, md5(text) AS hash FROM {documents} WHERE doc_id % 4 <> 0), stored AS (SELECT 'f' || CAST(doc_id AS STRING) AS name, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE md5(text) END AS hash FROM {documents} WHERE doc_id % 3 <> 0)
    SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.hash IS NULL THEN 'insert' WHEN a.hash IS NULL THEN 'keep' WHEN a.hash = b.hash THEN 'skip' ELSE 'replace' END AS action FROM files a FULL JOIN stored b ON a.name = b.name""")
def file_changes(spark, d):
    docs = view(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), F.md5(F.col("text").cast("binary")).alias("hash"), "doc_id")
    stored = docs.filter("doc_id % 3 <> 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("hash")))
    return M.change_plan(docs.filter("doc_id % 4 <> 0"), stored)


@query("""SELECT m.id, CAST(m.recall_count + coalesce(t.n, 0) AS INT) AS recall_count, greatest(m.last_recall_ts, coalesce(t.ts, m.last_recall_ts)) AS last_recall_ts FROM memories m
    LEFT JOIN (SELECT memory_id, count(*) AS n, CAST(max(epoch(occurred_date)) AS BIGINT) AS ts FROM memory_activations GROUP BY memory_id) t ON t.memory_id = m.id""")
def touch(spark, d):
    touches = view(spark, d, "memory_activations").select(F.col("memory_id").alias("id"), F.unix_seconds(F.col("occurred_date").cast("timestamp")).alias("ts"))
    return M.touched(view(spark, d, "memories"), touches).select("id", "recall_count", "last_recall_ts")


@query("""SELECT id, substring(string_split(trim(content), chr(10))[1], 1, 40) AS title, substring(content, 1, 90) AS snippet, CAST(greatest(1, floor(length(content) / 3)) AS INT) AS tokens FROM memories""")
def text_projection(spark, d):
    m = view(spark, d, "memories")
    return m.select("id", X.title(F.col("content")).alias("title"), X.snippet(F.col("content")).alias("snippet"), S.token_count(F.col("content")).alias("tokens"))


@query(r"""SELECT id FROM notes WHERE regexp_matches(content, '\bsk-[A-Za-z0-9_-]{16,}\b') OR regexp_matches(content, '(?i)\b(?:api[_ -]?key|access[_ -]?token|password|secret)\s*[:=]\s*\S+') OR contains(content, '-----BEGIN RSA PRIVATE KEY-----')""")
def secret_rejects(spark, d):
    return view(spark, d, "notes").filter(X.has_secret(F.col("content"))).select("id")


@query("""SELECT id, CASE WHEN kind IN ('episodic', 'semantic', 'procedural') THEN kind WHEN kind = 'knowledge_book' THEN 'semantic' WHEN kind = 'decision' THEN 'procedural' WHEN kind = 'idea' THEN 'hypothesis' ELSE 'semantic' END AS memory_form,
        CASE WHEN kind = 'knowledge_book' THEN 'deep' ELSE 'consolidated' END AS lifecycle_stage,
        CAST(CASE WHEN importance >= 4 OR greatest(0.0, (1706745600 - created_ts) / 86400.0) <= 90 THEN 5 WHEN importance >= 3 THEN 5 WHEN importance >= 2 THEN 3 ELSE 2 END AS INT) AS copies FROM memories""")
def classification(spark, d):
    none = F.lit(None).cast("string")
    return view(spark, d, "memories").select("id", S.memory_form(F.col("kind"), none).alias("memory_form"), S.lifecycle_stage(F.col("kind"), none).alias("lifecycle_stage"), S.backup_copies(F.col("importance"), S.days_between(AS_OF, F.col("created_ts"))).alias("copies"))
