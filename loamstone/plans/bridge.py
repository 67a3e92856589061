"""Memory tables derived from the given tables, as SQL that Spark and DuckDB read alike.

Every value is a function of keys; ``AS_OF`` stands for now.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = 1706745600
DAY = 86400
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    "memories": f"""
        SELECT 'm-' || CAST(doc_id AS STRING) AS id, doc_id,
            CASE doc_id % 8 WHEN 0 THEN 'episodic' WHEN 1 THEN 'semantic' WHEN 2 THEN 'procedural' WHEN 3 THEN 'knowledge_book' WHEN 4 THEN 'knowledge_case' WHEN 5 THEN 'decision' WHEN 6 THEN 'idea' ELSE 'moc' END AS kind,
            text AS content, source AS mode_id, lang AS persona_id, CAST(doc_id % 6 AS INT) AS importance,
            {AS_OF} - ((doc_id * 37) % 400) * {DAY} AS created_ts, {AS_OF} - least((doc_id * 13) % 90, (doc_id * 37) % 400) * {DAY} AS last_recall_ts,
            CAST(doc_id % 11 AS INT) AS recall_count, CAST(doc_id % 5 AS DOUBLE) / 4 AS emotional_tag, CAST(0.5 AS DOUBLE) AS novelty, CAST(doc_id % 3 AS DOUBLE) / 2 AS predictive_value,
            CAST(doc_id % 10 AS DOUBLE) / 10 AS connection_density, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(doc_id % 40 AS DOUBLE) END AS stability,
            CASE WHEN doc_id % 29 = 0 THEN {AS_OF} - {DAY} ELSE NULL END AS invalid_at, CASE WHEN doc_id % 9 = 0 THEN 'src-' || CAST(doc_id % 50 AS STRING) ELSE NULL END AS source_id,
            CASE WHEN doc_id % 6 = 0 THEN chr(123) || '"consolidated": true' || chr(125) ELSE chr(123) || '"title": "t' || CAST(doc_id % 12 AS STRING) || '"' || chr(125) END AS meta, CAST(greatest(1, floor(length(text) / 3)) AS INT) AS token_count, CAST(NULL AS STRING) AS superseded_by
        FROM {{documents}}""",
    "notes": """
        SELECT 'm-' || CAST(doc_id AS STRING) AS id, 'semantic' AS kind, CAST(NULL AS BIGINT) AS invalid_at, 'About [[Topic ' || CAST(doc_id % 23 AS STRING) || ']] and [[ Area ' || CAST(doc_id % 40 AS STRING) || ' |an alias]] in ' || source || '. ' || CASE doc_id % 5 WHEN 0 THEN '项目进度管理需要我们' WHEN 1 THEN '今天讨论项目' WHEN 2 THEN '样品发货。样品验收' WHEN 3 THEN 'plain alpha_flag words' ELSE '可以' END
            || CASE doc_id % 50 WHEN 7 THEN ' Password: hunter2' WHEN 8 THEN ' sk-abcdefghijklmnop1234' WHEN 9 THEN ' -----BEGIN RSA PRIVATE KEY-----' WHEN 10 THEN ' sk-short, password' ELSE '' END AS content FROM {documents}""",
    "raw_memories": """
        SELECT 'm-' || CAST(doc_id AS STRING) AS id, CASE doc_id % 4 WHEN 0 THEN 'episodic' WHEN 1 THEN 'knowledge_book' WHEN 2 THEN 'decision' ELSE 'dream' END AS kind, 'mode' || CAST(doc_id % 3 AS STRING) AS mode_id,
            chr(123) || '"source_id": "s' || CAST(doc_id % 90 AS STRING) || '", "domains": ["Work", "' || lang || '", "Work"], "entities": "Alpha; ' || source || ',beta", "confidence": ' || CASE WHEN doc_id % 7 = 0 THEN '1.7' ELSE '0.25' END || ', "memory_tier": "M3", "conflicts_with": "m-' || CAST(doc_id % 5 AS STRING) || '", "evidence": ['
            || chr(123) || '"locator": "loc' || CAST(doc_id AS STRING) || '", "excerpt": "' || CASE WHEN doc_id % 2 = 0 THEN 'said' ELSE ' ' END || '", "observed_at": "2024-01-15"' || chr(125) || ']' || chr(125) AS meta FROM {documents}""",
    "typed_edges": """
        SELECT 'te-' || CAST(vec_id AS STRING) AS id, 'm-' || CAST(vec_id % 60 AS STRING) AS src, 'm-' || CAST((vec_id * 7 + 1) % 60 AS STRING) AS dst, CASE vec_id % 3 WHEN 0 THEN 'causes' WHEN 1 THEN 'supports' ELSE 'relates' END AS rel_type, 'because ' || CAST(vec_id AS STRING) AS because, CAST(2.0 AS DOUBLE) AS weight, embedding, CAST(0 AS BIGINT) AS created_ts FROM {embeddings} WHERE vec_id % 5 = 0""",
    "parents": """
        SELECT 'm-' || CAST(doc_id AS STRING) AS memory_id, 'm-' || CAST(doc_id + 4 AS STRING) AS parent_id FROM {documents} UNION ALL SELECT 'm-' || CAST(doc_id AS STRING), 'm-' || CAST(doc_id + 5 + doc_id % 3 AS STRING) FROM {documents} WHERE doc_id % 5 <> 0""",
    "inbox": f"""
        SELECT 'hip-' || CAST(event_id AS STRING) AS episode_id, 'src-' || CAST(user_id AS STRING) AS source_id, CASE event_id % 4 WHEN 0 THEN 'staged' WHEN 1 THEN 'promoted' WHEN 2 THEN 'dismissed' ELSE 'archived' END AS status, {AS_OF} - (event_id * 17) % 5000 AS updated_ts FROM {{events}}""",
    "memories_vec": "SELECT 'm-' || CAST(vec_id AS STRING) AS memory_id, vec_id, embedding AS vec, label FROM {embeddings}",
    "memory_cognitive": """
        SELECT 'm-' || CAST(d.doc_id AS STRING) AS memory_id, 'M' || CAST(d.doc_id % 4 AS STRING) AS memory_tier,
            CASE WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 THEN 'verified' WHEN l.quality = 0 THEN 'conflicted' ELSE 'unreviewed' END AS verification_status,
            CASE d.doc_id % 5 WHEN 0 THEN 'quarantine' WHEN 4 THEN 'retired' ELSE 'active' END AS review_status,
            CASE WHEN d.doc_id % 13 = 0 THEN 'archived' ELSE 'active' END AS status, CASE WHEN d.doc_id % 17 = 0 THEN 'deep' ELSE 'consolidated' END AS lifecycle_stage,
            CASE d.doc_id % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'team' ELSE 'restricted' END AS visibility, 'user' AS owner_type, 'u' || CAST(d.doc_id % 6 AS STRING) AS owner_id,
            CASE WHEN d.doc_id % 19 = 0 THEN NULL ELSE CAST(d.doc_id % 10 AS DOUBLE) / 10 END AS confidence, CASE d.doc_id % 4 WHEN 0 THEN 'hypothesis' WHEN 1 THEN 'episodic' ELSE 'semantic' END AS memory_form, d.source AS root_source_id,
            CASE WHEN d.doc_id % 12 = 0 THEN ' ' WHEN d.doc_id % 12 = 1 THEN 'books' ELSE 'chat' END AS source, 's' || CAST(d.doc_id AS STRING) AS source_id, CASE WHEN d.doc_id % 14 = 0 THEN NULL ELSE '2024-01-15' END AS observed_at, '2024-01-15' AS valid_from, CASE WHEN d.doc_id % 15 = 0 THEN '' ELSE '2025-01-15' END AS valid_to,
            CAST(d.doc_id % 9 AS INT) AS activation_count, CAST(1700000000 + (d.doc_id * 31) % 1000 AS BIGINT) AS last_verified_ts, CAST(NULL AS STRING) AS supersedes_memory_id
        FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id WHERE d.doc_id % 23 <> 0""",
    "memory_facets": """
        SELECT 'm-' || CAST(doc_id AS STRING) AS memory_id, 'domain' AS facet_type, 'd' || CAST(doc_id % 30 AS STRING) AS facet_value FROM {documents}
        UNION ALL SELECT 'm-' || CAST(doc_id AS STRING), 'domain', lang FROM {documents}
        UNION ALL SELECT 'm-' || CAST(doc_id AS STRING), 'entity', source FROM {documents} WHERE doc_id % 2 = 0
        UNION ALL SELECT 'm-' || CAST(doc_id AS STRING), 'project', source FROM {documents} WHERE doc_id % 3 = 0""",
    "memory_evidence": """
        SELECT 'm-' || CAST(doc_id AS STRING) AS memory_id, 'doc' AS evidence_type, 'loc' || CAST(doc_id AS STRING) AS locator, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE source END AS excerpt, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE '2024-01-15' END AS observed_at FROM {documents}
        UNION ALL SELECT 'm-' || CAST(doc_id AS STRING), 'page', 'p' || CAST(doc_id AS STRING), lang, '2024-01-20' FROM {documents} WHERE doc_id % 2 = 1""",
    "memory_conflicts": """
        SELECT 'c' || CAST(doc_id AS STRING) AS conflict_id, 'm-' || CAST(doc_id AS STRING) AS left_memory_id, 'm-' || CAST(doc_id + 1 AS STRING) AS right_memory_id, CASE WHEN doc_id % 2 = 0 THEN 'open' ELSE 'resolved' END AS status
        FROM {documents} WHERE doc_id % 31 = 5 OR doc_id % 31 = 10""",
    "memory_activations": """
        SELECT event_id, 'm-' || CAST(user_id AS STRING) AS memory_id, CASE event_type WHEN 'purchase' THEN 'adopted' WHEN 'signup' THEN 'confirmed' ELSE 'seen' END AS activation_kind,
            CAST(ts AS DATE) AS occurred_date, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 's' || CAST(event_id % 40 AS STRING) END AS session_id FROM {events}""",
    "dream_events": """
        SELECT event_id, 'm-' || CAST(user_id AS STRING) AS memory_id, CAST(ts AS DATE) AS occurred_date, CAST(event_id % 4 AS INT) AS phase_count FROM {events} WHERE event_type = 'click'""",
    "review_state": f"""
        SELECT 'm-' || CAST(doc_id AS STRING) AS memory_id, 1.3 + CAST(doc_id % 13 AS DOUBLE) / 10 AS ef, CAST(doc_id % 17 AS INT) AS interval_days, CAST(doc_id % 5 AS INT) AS repetitions, {AS_OF} + (doc_id % 21 - 10) * {DAY} AS next_review_ts, CAST(doc_id % 7 AS INT) - 1 AS grade FROM {{labels}}""",
    "memory_acl": f"""
        SELECT 'm-' || CAST(c_custkey AS STRING) AS memory_id, CASE WHEN c_custkey % 3 = 0 THEN 'role' ELSE 'user' END AS principal_type, CASE WHEN c_custkey % 3 = 0 THEN 'r' || CAST(c_nationkey % 4 AS STRING) ELSE 'u' || CAST(c_nationkey % 6 AS STRING) END AS principal_id,
            CASE c_custkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'admin' ELSE 'none' END AS permission, CASE WHEN c_custkey % 5 = 0 THEN {AS_OF} - 1 WHEN c_custkey % 5 = 1 THEN {AS_OF} + 1 ELSE NULL END AS expires_at FROM {{customer}}""",
    "edges": """
        SELECT 'm-' || CAST(o_orderkey % 997 AS STRING) AS src, 'm-' || CAST(o_custkey AS STRING) AS dst, max(CAST(o_orderkey % 7 + 1 AS DOUBLE)) AS weight FROM {orders} WHERE o_orderkey % 997 <> o_custkey GROUP BY 1, 2""",
    "retrieval_runs": """
        SELECT event_id AS run_id, user_id, event_type AS source, value AS latency_ms, CAST(ts AS DATE) AS day FROM {events} WHERE event_type IN ('click', 'view')""",
    "episodes": """
        SELECT 'mb-' || substring(md5(CAST(conv_id AS STRING)), 1, 16) AS bundle_id, turn AS chunk_index, role, CASE WHEN turn % 3 = 0 THEN chr(123) || '"content": "part ' || CAST(turn AS STRING) || '"' || chr(125) ELSE text END AS content FROM {conversations}""",
}


def needs(sql: str, found: list[str] | None = None) -> list[str]:
    """Views that ``sql`` names, in the order in which they have to be defined."""
    found = [] if found is None else found
    for v in VIEWS:
        if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", sql) and v not in found:
            needs(VIEWS[v], found)
            found.append(v)
    return found


def full_sql(sql: str) -> str:
    """``sql`` with the definitions of the views that it names; base tables are still in braces."""
    defs = [f"{v} AS ({VIEWS[v]})" for v in needs(sql)]
    if not defs:
        return sql
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if m:
        return f"WITH {m[1] or ''}" + ",\n".join(defs) + ",\n" + sql[m.end() :]
    return "WITH " + ",\n".join(defs) + "\n" + sql


def duck(sql: str) -> str:
    """The statement for DuckDB, where the base tables are views of their own names."""
    return re.sub(r"\{(\w+)\}", r"\1", full_sql(sql))


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    full = full_sql(sql)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", full)) & set(BASE)}
    return spark.sql(full, **tables)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark_sql(spark, sf_dir, f"SELECT * FROM {name}" if name in VIEWS else f"SELECT * FROM {{{name}}}")
