"""Registered queries over access, evidence, promotion, planning, counts and telemetry, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamstone.functions import scoring as S
from loamstone.functions import text as X
from loamstone.operators import concept_deltas as D
from loamstone.operators import fulltext as T
from loamstone.operators import governance as G
from loamstone.operators import graph as N
from loamstone.operators import memory as M
from loamstone.operators import register as Q
from loamstone.operators import retrieval as R
from loamstone.plans.bridge import AS_OF, spark_sql, view
from loamstone.sources.shared import shared_dir

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _all(spark, d, *names):
    return [view(spark, d, n) for n in names]


@query(f"""SELECT m.id FROM memories m LEFT JOIN memory_cognitive c ON c.memory_id = m.id WHERE m.invalid_at IS NULL AND (
        (c.visibility = 'private' AND c.owner_type = 'user' AND c.owner_id = 'u3') OR (c.visibility = 'team' AND c.owner_id = 'u3')
        OR EXISTS (SELECT 1 FROM memory_acl a WHERE a.memory_id = m.id AND ((a.principal_type = 'user' AND a.principal_id = 'u3') OR (a.principal_type = 'role' AND a.principal_id IN ('r1', 'r2'))) AND a.permission IN ('read', 'write', 'admin') AND (a.expires_at IS NULL OR a.expires_at > {AS_OF})))""")
def acl_allowed(spark, d):
    return G.allowed(*_all(spark, d, "memories", "memory_cognitive", "memory_acl"), ("user", "u3"), ["r1", "r2"], AS_OF)


@query(f"""SELECT m.id FROM memories m WHERE m.invalid_at IS NULL AND m.id NOT IN (SELECT memory_id FROM memory_cognitive WHERE visibility IN ('private', 'team') AND owner_id = 'u1')
    AND m.id NOT IN (SELECT memory_id FROM memory_acl WHERE principal_type = 'user' AND principal_id = 'u1' AND permission <> 'none' AND (expires_at IS NULL OR expires_at > {AS_OF}))""")
def acl_denied(spark, d):
    m = view(spark, d, "memories")
    ok = G.allowed(m, *_all(spark, d, "memory_cognitive", "memory_acl"), ("user", "u1"), [], AS_OF)
    return m.filter("invalid_at IS NULL").select("id").join(ok, "id", "left_anti")


@query("""SELECT memory_id, count(*) AS n FROM memory_evidence WHERE trim(coalesce(locator, '')) <> '' AND trim(coalesce(excerpt, '')) <> '' AND trim(coalesce(observed_at, '')) <> '' GROUP BY memory_id""")
def evidence_counts(spark, d):
    return G.complete(view(spark, d, "memory_evidence")).groupBy("memory_id").agg(F.count("*").alias("n"))


@query("""SELECT memory_id, count(*) AS activations, count(*) FILTER (WHERE activation_kind = 'adopted') AS adopted, count(*) FILTER (WHERE activation_kind = 'confirmed') AS confirmed, count(DISTINCT occurred_date) AS dates,
        count(DISTINCT CASE WHEN trim(session_id) <> '' THEN session_id END) AS sessions FROM memory_activations WHERE activation_kind IN ('adopted', 'confirmed') GROUP BY memory_id""")
def activation_counts(spark, d):
    return G.activation_counts(view(spark, d, "memory_activations"))


PROMOTION_SQL = """WITH counts AS (SELECT memory_id, count(*) AS activations, count(DISTINCT occurred_date) AS dates, count(DISTINCT CASE WHEN trim(session_id) <> '' THEN session_id END) AS sessions FROM memory_activations WHERE activation_kind IN ('adopted', 'confirmed') GROUP BY memory_id),
    proof AS (SELECT memory_id, count(*) AS evidence FROM memory_evidence WHERE trim(coalesce(locator, '')) <> '' AND trim(coalesce(excerpt, '')) <> '' AND trim(coalesce(observed_at, '')) <> '' GROUP BY memory_id),
    gated AS (SELECT c.memory_id, coalesce(a.activations, 0) AS activations, coalesce(a.dates, 0) AS dates, coalesce(a.sessions, 0) AS sessions, coalesce(p.evidence, 0) AS evidence, c.verification_status, c.review_status,
        EXISTS (SELECT 1 FROM memory_conflicts x WHERE x.status = 'open' AND (x.left_memory_id = c.memory_id OR x.right_memory_id = c.memory_id)) AS held
        FROM memory_cognitive c LEFT JOIN counts a ON a.memory_id = c.memory_id LEFT JOIN proof p ON p.memory_id = c.memory_id WHERE c.memory_tier = 'M2')
    SELECT memory_id, activations, concat_ws(',', CASE WHEN verification_status <> 'verified' THEN 'not_verified' END, CASE WHEN review_status <> 'active' THEN 'not_active' END, CASE WHEN activations < 3 THEN 'few_activations' END,
        CASE WHEN dates < 2 AND sessions < 2 THEN 'one_occasion' END, CASE WHEN evidence < 2 THEN 'little_evidence' END, CASE WHEN held THEN 'open_conflict' END) AS reasons,
        verification_status = 'verified' AND review_status = 'active' AND activations >= 3 AND (dates >= 2 OR sessions >= 2) AND evidence >= 2 AND NOT held AS promoted FROM gated"""


@query(PROMOTION_SQL)
def promotion_gate(spark, d):
    return G.promotion(*_all(spark, d, "memory_cognitive", "memory_evidence", "memory_activations", "memory_conflicts"))


@query("""WITH sides AS (SELECT DISTINCT unnest([left_memory_id, right_memory_id]) AS memory_id FROM memory_conflicts WHERE conflict_id IN ('c5', 'c10', 'c36', 'c41', 'c67')), held AS (SELECT unnest([left_memory_id, right_memory_id]) AS memory_id FROM memory_conflicts WHERE status = 'open')
    SELECT memory_id, CASE WHEN memory_id NOT IN (SELECT memory_id FROM sides) THEN verification_status WHEN memory_id IN (SELECT memory_id FROM held) THEN 'conflicted' ELSE 'verified' END AS verification_status,
        CASE WHEN memory_id NOT IN (SELECT memory_id FROM sides) THEN review_status WHEN memory_id IN (SELECT memory_id FROM held) THEN 'needs_review' ELSE 'active' END AS review_status FROM memory_cognitive""")
def conflict_relabel(spark, d):
    side, conflicts = _all(spark, d, "memory_cognitive", "memory_conflicts")
    sides = conflicts.filter(F.col("conflict_id").isin("c5", "c10", "c36", "c41", "c67")).select(F.explode(F.array("left_memory_id", "right_memory_id")).alias("memory_id"))
    return G.relabelled(side, conflicts, sides).select("memory_id", "verification_status", "review_status")


@query("""SELECT memory_id, round(least(0.12, sum(CASE phase_count WHEN 1 THEN 0.020 WHEN 2 THEN 0.028 WHEN 3 THEN 0.035 ELSE 0 END * pow(0.5, date_diff('day', occurred_date, DATE '2024-01-25') / 30.0))), 6) AS dream FROM dream_events WHERE occurred_date <= DATE '2024-01-25' GROUP BY memory_id""")
def dream_accessibility(spark, d):
    return G.dream_effect(view(spark, d, "dream_events"), "2024-01-25").select("memory_id", F.round("dream", 6).alias("dream"))


def _reason_sql(depth: str) -> str:
    deep = " WHEN lifecycle_stage = 'deep' THEN 'deep_memory_excluded'" if depth == "Q1" else ""
    book = "" if depth == "Q3" else " WHEN lower(kind) IN ('knowledge_book', 'book') OR source = 'books' THEN 'book_excluded'"
    return f"""SELECT '{depth}' AS depth, coalesce(CASE WHEN coalesce(status, 'active') <> 'active' THEN 'inactive' WHEN verification_status = 'rejected' OR review_status = 'retired' THEN 'governance_rejected_or_retired' WHEN memory_form = 'hypothesis' THEN 'hypothesis_excluded'{book}{deep} END, 'kept') AS filter_reason, count(*) AS n
    FROM memories m JOIN memory_cognitive c ON m.id = c.memory_id GROUP BY 2"""


@query(" UNION ALL ".join(_reason_sql(q) for q in ("Q1", "Q2", "Q3")))
def planned_filters(spark, d):
    m, c = _all(spark, d, "memories", "memory_cognitive")
    both = m.join(c.drop("source_id"), m.id == c.memory_id)
    each = [both.groupBy(F.coalesce(G.planned_reason(q), F.lit("kept")).alias("filter_reason")).agg(F.count("*").alias("n")).select(F.lit(q).alias("depth"), "filter_reason", "n") for q in ("Q1", "Q2", "Q3")]
    return each[0].union(each[1]).union(each[2])


def _planned(spark, d):
    m, c = _all(spark, d, "memories", "memory_cognitive")
    cand = M_candidates(m.drop("source_id"), c)
    return G.planned(cand, *_all(spark, d, "memory_facets", "memory_conflicts"), G.dream_effect(view(spark, d, "dream_events"), "2024-01-25"), ["en", "D3", "d7"], ["src1", "src2"], ["episodic"], "SRC3")


def M_candidates(m, c):
    """Live memories by recency as one channel, with their sidecars."""
    w = Window.orderBy(F.desc("last_recall_ts"), "id")
    top = m.filter("invalid_at IS NULL").orderBy(F.desc("last_recall_ts"), "id").limit(96).withColumn("rank", F.row_number().over(w))
    return top.join(c, F.col("id") == F.col("memory_id")).withColumn("rrf_score", S.rrf(F.col("rank"))).drop("memory_id")


@query("""WITH top AS (SELECT *, row_number() OVER (ORDER BY last_recall_ts DESC, id) AS rank FROM memories WHERE invalid_at IS NULL QUALIFY rank <= 96),
    hits AS (SELECT memory_id, count(*) FILTER (WHERE facet_type = 'domain' AND facet_value IN ('en', 'd3', 'd7')) AS dh, count(*) FILTER (WHERE facet_type = 'entity' AND facet_value IN ('src1', 'src2')) AS eh FROM memory_facets GROUP BY memory_id),
    dream AS (SELECT memory_id, least(0.12, sum(CASE phase_count WHEN 1 THEN 0.020 WHEN 2 THEN 0.028 WHEN 3 THEN 0.035 ELSE 0 END * pow(0.5, date_diff('day', occurred_date, DATE '2024-01-25') / 30.0))) AS dream FROM dream_events WHERE occurred_date <= DATE '2024-01-25' GROUP BY memory_id)
    SELECT t.id, round(1.0 / (60 + t.rank) * (1 + least(0.06, 0.03 * coalesce(h.dh, 0)) + least(0.06, 0.03 * coalesce(h.eh, 0)) + CASE WHEN c.memory_form = 'episodic' THEN 0.03 ELSE 0 END + 0.04 * (CASE WHEN coalesce(c.confidence, 0) = 0 THEN 0.7 ELSE c.confidence END - 0.5)
        + CASE WHEN t.id IN (SELECT memory_id FROM memory_facets WHERE facet_type = 'project' AND facet_value = 'src3') THEN 0.04 ELSE 0 END + coalesce(e.dream, 0)) * CASE WHEN t.id IN (SELECT unnest([left_memory_id, right_memory_id]) FROM memory_conflicts WHERE status = 'open') THEN 0.9 ELSE 1 END, 4) AS score
    FROM top t JOIN memory_cognitive c ON c.memory_id = t.id LEFT JOIN hits h ON h.memory_id = t.id LEFT JOIN dream e ON e.memory_id = t.id""")
def planned_scores(spark, d):
    return _planned(spark, d).select("id", "score")


@query()
def planned_packs(spark, d):
    cand = _planned(spark, d).filter("filter_reason IS NULL")
    facets = view(spark, d, "memory_facets").groupBy(F.col("memory_id").alias("id")).agg(F.sort_array(F.collect_list(F.concat_ws(":", "facet_type", "facet_value"))).alias("coverage"))
    ready = cand.join(facets, "id", "left").select(F.lit("q").alias("query"), "id", "score", "rrf_score", F.lit(0.0).alias("sim"), X.snippet(F.col("content"), 360).alias("snippet"), F.coalesce("coverage", F.array().cast("array<string>")).alias("coverage"))
    return G.packed(ready, *S.DEPTHS["Q2"][1:3], 6400)


@query("""WITH pool AS (SELECT *, row_number() OVER (PARTITION BY memory_tier, memory_form ORDER BY memory_id) AS rn FROM memory_cognitive), n AS (SELECT CAST(ceil(512.0 / greatest(1, count(*))) AS BIGINT) AS each FROM (SELECT DISTINCT memory_tier, memory_form FROM memory_cognitive) g),
    cut AS (SELECT * FROM pool, n WHERE rn <= each ORDER BY sha256('seed|pool|' || memory_id) LIMIT 512) SELECT memory_id AS id, memory_tier, memory_form FROM cut ORDER BY sha256('seed|' || memory_id) LIMIT 8""")
def dream_seeds(spark, d):
    return G.seeded_sample(view(spark, d, "memory_cognitive").withColumnRenamed("memory_id", "id"), "seed")


@query("""SELECT m.id AS memory_id, CASE WHEN kind IN ('episodic', 'semantic', 'procedural') THEN kind WHEN kind = 'decision' THEN 'procedural' WHEN kind = 'idea' THEN 'hypothesis' ELSE 'semantic' END AS memory_form, CASE WHEN kind = 'knowledge_book' THEN 'deep' ELSE 'consolidated' END AS lifecycle_stage
    FROM memories m WHERE NOT EXISTS (SELECT 1 FROM memory_cognitive c WHERE c.memory_id = m.id) ORDER BY m.created_ts, m.id LIMIT 100""")
def cognitive_backfill(spark, d):
    return G.backlog(*_all(spark, d, "memories", "memory_cognitive"))


@query("SELECT memory_tier, verification_status, count(*) AS n FROM memory_cognitive GROUP BY 1, 2")
def tier_counts(spark, d):
    return view(spark, d, "memory_cognitive").groupBy("memory_tier", "verification_status").agg(F.count("*").alias("n"))


@query("SELECT facet_value, count(*) AS n FROM memory_facets WHERE facet_type = 'domain' GROUP BY 1 ORDER BY n DESC, facet_value LIMIT 20")
def domain_top(spark, d):
    return view(spark, d, "memory_facets").filter("facet_type = 'domain'").groupBy("facet_value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "facet_value").limit(20)


@query(f"""SELECT (SELECT count(*) FROM memories) AS memories, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM memories_vec) AS vectors, (SELECT count(*) FROM review_state WHERE next_review_ts <= {AS_OF}) AS due""")
def total_counts(spark, d):
    m, e, v, r = _all(spark, d, "memories", "edges", "memories_vec", "review_state")
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(m, "memories").crossJoin(one(e, "edges")).crossJoin(one(v, "vectors")).crossJoin(one(r.filter(F.col("next_review_ts") <= AS_OF), "due"))


@query("""SELECT CAST(floor(100.0 * count(v.memory_id) / greatest(count(*), 1)) AS BIGINT) AS coverage, count(*) AS memories FROM memories m LEFT JOIN memories_vec v ON v.memory_id = m.id WHERE m.invalid_at IS NULL""")
def vector_coverage(spark, d):
    m, v = _all(spark, d, "memories", "memories_vec")
    both = m.filter("invalid_at IS NULL").join(v.select("memory_id"), F.col("id") == F.col("memory_id"), "left")
    return both.agg(F.floor(100.0 * F.count("memory_id") / F.greatest(F.count("*"), F.lit(1))).alias("coverage"), F.count("*").alias("memories"))


@query("SELECT id FROM memories WHERE invalid_at IS NULL AND id NOT IN (SELECT memory_id FROM memories_vec)")
def vector_backlog(spark, d):
    return R.missing(*_all(spark, d, "memories", "memories_vec")).select("id")


@query("""SELECT memory_id, string_agg(facet_value, ',' ORDER BY facet_value) FILTER (WHERE facet_type = 'domain') AS domains, coalesce(string_agg(facet_value, ',' ORDER BY facet_value) FILTER (WHERE facet_type = 'entity'), '') AS entities FROM memory_facets GROUP BY memory_id""")
def facet_maps(spark, d):
    lists = view(spark, d, "memory_facets").groupBy("memory_id", "facet_type").agg(F.sort_array(F.collect_list("facet_value")).alias("v"))
    maps = lists.groupBy("memory_id").agg(F.map_from_entries(F.collect_list(F.struct("facet_type", "v"))).alias("facets"))
    return maps.select("memory_id", F.concat_ws(",", F.element_at("facets", F.lit("domain"))).alias("domains"), F.concat_ws(",", F.coalesce(F.try_element_at("facets", F.lit("entity")), F.array().cast("array<string>"))).alias("entities"))


@query("SELECT run_id, source FROM retrieval_runs ORDER BY run_id DESC LIMIT 5000")
def run_retention(spark, d):
    w = view(spark, d, "retrieval_runs")
    return w.select("run_id", "source").orderBy(F.desc("run_id")).limit(5000)


@query("SELECT source, day, count(*) AS n, round(avg(latency_ms), 6) AS mean_latency FROM retrieval_runs GROUP BY 1, 2")
def run_stats(spark, d):
    return view(spark, d, "retrieval_runs").groupBy("source", "day").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean_latency"))


# graph and retrieval

CONCEPT_SQL = r"""WITH reps AS (SELECT min(id) AS id, any_value(content) AS content FROM memories WHERE invalid_at IS NULL AND kind <> 'moc' GROUP BY md5(trim(content))),
    toks AS (SELECT id, t.w AS w, t.i AS i FROM (SELECT id, regexp_extract_all(content, '[\p{L}\p{N}_]+') AS ws FROM reps) r, unnest(ws) WITH ORDINALITY AS t(w, i)),
    uniq AS (SELECT id, w, min(i) AS i FROM toks WHERE regexp_matches(w, '^[A-Za-z][A-Za-z0-9_]{2,}$') GROUP BY id, w),
    firsts AS (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY i) AS rn FROM uniq),
    links AS (SELECT id AS memory_id, w AS name, 'c-' || substring(md5(lower(trim(w))), 1, 12) AS concept_id FROM firsts WHERE rn <= 15),
    total AS (SELECT count(*) AS n FROM reps),
    found AS (SELECT concept_id, count(*) AS mention_count, count(DISTINCT memory_id) AS doc_freq, (count(DISTINCT memory_id) > max(n) * 0.05 AND count(DISTINCT memory_id) >= 8) OR count(DISTINCT memory_id) > 200 AS is_hub FROM links, total GROUP BY concept_id),
    told AS (SELECT DISTINCT memory_id, concept_id FROM links WHERE concept_id IN (SELECT concept_id FROM found WHERE NOT is_hub AND doc_freq <= 60)),
    pairs AS (SELECT x.memory_id AS a, y.memory_id AS b, CAST(count(*) AS DOUBLE) AS weight FROM told x JOIN told y ON x.concept_id = y.concept_id AND x.memory_id < y.memory_id GROUP BY 1, 2),
    sides AS (SELECT a AS m, b AS nb, weight FROM pairs WHERE weight >= 2 UNION ALL SELECT b, a, weight FROM pairs WHERE weight >= 2),
    top AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY weight DESC, nb) AS rn FROM sides),
    graph AS (SELECT m AS src, nb AS dst, weight FROM top WHERE rn <= 8 UNION SELECT nb, m, weight FROM top WHERE rn <= 8)
"""


def _indexed(spark, d):
    reps = N.representatives(view(spark, d, "memories"))
    links = N.stored_links(reps)
    return links, N.concepts(links, reps.count())


@query(CONCEPT_SQL + "SELECT concept_id, mention_count, doc_freq, is_hub FROM found")
def concept_index(spark, d):
    return _indexed(spark, d)[1].select("concept_id", "mention_count", "doc_freq", "is_hub")


@query(CONCEPT_SQL + "SELECT concept_id, mention_count FROM found WHERE NOT is_hub ORDER BY mention_count DESC, concept_id LIMIT 50")
def list_concepts(spark, d):
    return _indexed(spark, d)[1].filter("NOT is_hub").select("concept_id", "mention_count").orderBy(F.desc("mention_count"), "concept_id").limit(50)


@query(CONCEPT_SQL + "SELECT x.concept_id AS a, y.concept_id AS b, CAST(count(*) AS DOUBLE) AS weight FROM told x JOIN told y ON x.memory_id = y.memory_id AND x.concept_id < y.concept_id GROUP BY 1, 2")
def concept_edges(spark, d):
    return N.pair_weights(N.telling(*_indexed(spark, d)), "concept_id", "memory_id")


@query(CONCEPT_SQL + "SELECT src, dst, weight FROM graph")
def cooccurrence_edges(spark, d):
    return N.cooccurrence_edges(N.pair_weights(N.telling(*_indexed(spark, d))))


def _advanced(spark, d, *wanted):
    """The logs of the concept graph after three batches of memories; of those of pairs the ``wanted``."""
    rows, logs = view(spark, d, "memories"), None
    for k in range(3):
        batch = rows.filter(F.col("doc_id") % 3 == k).select("id", "kind", "content", "invalid_at")
        logs = D.begun(batch, None, wanted) if logs is None else D.added(logs, D.advance(logs, batch, None, wanted))
    return logs


@query(CONCEPT_SQL + "SELECT concept_id, mention_count, doc_freq, is_hub FROM found")
def concept_index_advanced(spark, d):
    return D.concepts(_advanced(spark, d)).select("concept_id", "mention_count", "doc_freq", "is_hub")


@query(CONCEPT_SQL + "SELECT src, dst, weight FROM graph")
def cooccurrence_edges_advanced(spark, d):
    return N.cooccurrence_edges(D.memory_pairs(_advanced(spark, d, "pair_deltas")))


@query("SELECT id, round(ln(1 + count(*)) / 5.0, 6) AS connection_density FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) x GROUP BY id")
def connection_density(spark, d):
    return N.density(view(spark, d, "edges")).select("id", F.round("connection_density", 6).alias("connection_density"))


@query("SELECT src, dst, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM edges) x WHERE rank <= 12")
def top_neighbours(spark, d):
    return N.top_neighbours(view(spark, d, "edges"), 12).select("src", "dst", "weight", "rank")


def _rank_sql(rounds: int) -> str:
    parts = ["WITH share AS (SELECT e.src, e.dst, e.weight / t.total AS p FROM edges e JOIN (SELECT src, sum(weight) AS total FROM edges GROUP BY src) t ON t.src = e.src)", "start AS (SELECT 'm-1' AS id, 0.75 AS s UNION ALL SELECT 'm-2', 0.25)", "r0 AS (SELECT id, CAST(s AS DOUBLE) AS r FROM start)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT coalesce(m.dst, s.id) AS id, 0.85 * coalesce(m.m, 0) + 0.15 * coalesce(s.s, 0) AS r FROM (SELECT dst, sum(p * r) AS m FROM share JOIN r{i} ON src = id GROUP BY dst) m FULL JOIN start s ON s.id = m.dst)")
    return ", ".join(parts) + f" SELECT id, round(r, 9) AS r FROM r{rounds} WHERE r > 1e-6"


@query(_rank_sql(30))
def personalized_rank(spark, d):
    seeds = spark.createDataFrame([("m-1", 3.0), ("m-2", 1.0)], "id string, weight double")
    return N.ranked(view(spark, d, "edges"), seeds).select("id", F.round("r", 9).alias("r"))


SEEDS_SQL = "SELECT 'nation-' || CAST(c_nationkey AS STRING) AS query, 'm-' || CAST(c_custkey AS STRING) AS id, CAST(1 + c_custkey % 3 AS DOUBLE) AS weight FROM {customer} WHERE c_nationkey < 5"


def _ranks_sql(rounds: int) -> str:
    parts = ["WITH share AS (SELECT e.src, e.dst, e.weight / t.total AS p FROM edges e JOIN (SELECT src, sum(weight) AS total FROM edges GROUP BY src) t ON t.src = e.src)", f"seeds AS ({SEEDS_SQL})", "start AS (SELECT query, id, weight / sum(weight) OVER (PARTITION BY query) AS s FROM seeds)", "r0 AS (SELECT query, id, CAST(s AS DOUBLE) AS r FROM start)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT coalesce(m.query, s.query) AS query, coalesce(m.dst, s.id) AS id, 0.85 * coalesce(m.m, 0) + 0.15 * coalesce(s.s, 0) AS r FROM (SELECT query, dst, sum(p * r) AS m FROM share JOIN r{i} ON src = id GROUP BY query, dst) m FULL JOIN start s ON s.id = m.dst AND s.query = m.query)")
    return ", ".join(parts) + f" SELECT query, id, round(r, 9) AS r FROM r{rounds} WHERE r > 1e-6"


@query(_ranks_sql(30))
def personalized_ranks(spark, d):
    """The personalized ranks of five seed sets (customers by nation) in one iteration."""
    return N.ranked_many(view(spark, d, "edges"), spark_sql(spark, d, SEEDS_SQL)).select("query", "id", F.round("r", 9).alias("r"))


@query("""WITH s AS (SELECT 'm-1' AS id UNION ALL SELECT 'm-7'), h1 AS (SELECT dst AS id, max(weight * 0.7) AS bonus FROM edges JOIN s ON src = s.id GROUP BY dst), h2 AS (SELECT dst AS id, max(weight * 0.49) AS bonus FROM edges JOIN h1 ON src = h1.id GROUP BY dst)
    SELECT id, round(max(bonus), 6) AS bonus FROM (SELECT id, 1.0 AS bonus FROM s UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) x GROUP BY id""")
def spread_activation(spark, d):
    return N.spread(view(spark, d, "edges"), spark.createDataFrame([("m-1",), ("m-7",)], "id string")).select("id", F.round("bonus", 6).alias("bonus"))


@query("""WITH RECURSIVE walk AS (SELECT 'm-1' AS id, 0 AS hops UNION SELECT e.dst, w.hops + 1 FROM walk w JOIN edges e ON e.src = w.id WHERE w.hops < 4) SELECT CAST(min(hops) AS INT) AS hops FROM walk WHERE id = 'm-9' HAVING min(hops) IS NOT NULL""")
def connect_paths(spark, d):
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    return N.shortest(view(spark, d, "edges"), one("m-1"), one("m-9")).select("hops")


def _vector(spark, d, n):
    return list(view(spark, d, "memories_vec").filter(F.col("vec_id") == n).first().vec)


@query("""WITH q AS (SELECT vec AS v FROM memories_vec WHERE vec_id = 3) SELECT memory_id, round(list_dot_product(CAST(vec AS DOUBLE[]), CAST(v AS DOUBLE[])) / sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))), 6) AS sim FROM memories_vec, q ORDER BY list_dot_product(CAST(vec AS DOUBLE[]), CAST(v AS DOUBLE[])) DESC, memory_id LIMIT 20""")
def vector_search(spark, d):
    return R.nearest(view(spark, d, "memories_vec"), _vector(spark, d, 3)).select("memory_id", F.round("sim", 6).alias("sim"))


@query("""WITH q AS (SELECT a.vec AS a, b.vec AS b FROM memories_vec a, memories_vec b WHERE a.vec_id = 3 AND b.vec_id = 8), s AS (SELECT memory_id, least(list_dot_product(CAST(vec AS DOUBLE[]), CAST(a AS DOUBLE[])), list_dot_product(CAST(vec AS DOUBLE[]), CAST(b AS DOUBLE[]))) AS sim FROM memories_vec, q) SELECT memory_id, round(sim, 6) AS sim FROM s WHERE sim >= 0.05 ORDER BY s.sim DESC, memory_id LIMIT 5""")
def semantic_bridge(spark, d):
    return R.bridge(view(spark, d, "memories_vec"), _vector(spark, d, 3), _vector(spark, d, 8), floor=0.05).select("memory_id", F.round("sim", 6).alias("sim"))


QUERY = "nation thonre that with"
VECTOR_SQL = "round(list_dot_product(CAST(vec AS DOUBLE[]), CAST(v AS DOUBLE[])) / sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))), 9)"


def fts_sql(query_text: str, rows: str) -> str:
    """CTEs of the phrases' scores over ``rows`` (id, content); phrases that can't overlap themselves."""
    phrases = ", ".join(f"({i}, '{p.lower()}')" for i, p in enumerate(X.query_terms(query_text)))
    return f"""t AS (SELECT id, lower(coalesce(content, '')) AS c FROM ({rows}) z), stats AS (SELECT count(*) AS n, avg(greatest(length(c) - 2, 0)) AS avgdl FROM t), ph AS (SELECT * FROM (VALUES {phrases}) v(p, f)),
    hit AS (SELECT id, p, greatest(length(c) - 2, 0) AS dl, (length(c) - length(replace(c, f, ''))) / length(f) AS tf FROM t, ph WHERE contains(c, f)), dfs AS (SELECT p, count(*) AS df FROM hit GROUP BY p),
    sc AS (SELECT id, hit.p AS phrase, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS score FROM hit JOIN dfs ON dfs.p = hit.p, stats)"""


LIVE = "SELECT id, content FROM memories WHERE invalid_at IS NULL"
FTS_SQL = "WITH " + fts_sql(QUERY, LIVE)


def _live(spark, d):
    return view(spark, d, "memories").filter("invalid_at IS NULL")


@query(FTS_SQL + " SELECT id, round(sum(score), 6) AS bm25 FROM sc GROUP BY id ORDER BY round(sum(score), 9) DESC, id LIMIT 20")
def full_text(spark, d):
    return T.search(_live(spark, d), X.query_terms(QUERY)).select("id", F.round("bm25", 6).alias("bm25"))


@query(FTS_SQL + " SELECT id, round(sum(score), 6) AS bm25 FROM sc GROUP BY id ORDER BY round(sum(score), 9) DESC, id LIMIT 20")
def full_text_indexed(spark, d):
    rows, path = _live(spark, d), f"{shared_dir(spark)}/loamstone-core/index-{uuid.uuid4().hex}"
    T.write_index(rows, path)
    return T.search(None, X.query_terms(QUERY), index=T.read_index(spark, path)).select("id", F.round("bm25", 6).alias("bm25"))


def bounded_sql(k: int, pool: int) -> str:
    """CTE ``bounded``: the fused ranks of the phrases in ``sc``."""
    each = max(8, -(-max(k, min(900, pool)) // len(X.query_terms(QUERY))))
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY round(score, 9) DESC, id) AS rank FROM sc), bounded AS (SELECT id, sum(1.0 / (60 + rank)) AS fused, sum(score) AS bm25, CAST(min(rank) AS INT) AS best_rank FROM r WHERE rank <= {each} GROUP BY id
    ORDER BY round(sum(1.0 / (60 + rank)), 9) DESC, round(sum(score), 9) DESC, min(rank), id LIMIT {min(k, max(k, min(900, pool)))})"""


@query(FTS_SQL + ", " + bounded_sql(20, 48) + " SELECT id, round(fused, 6) AS fused, best_rank FROM bounded")
def full_text_bounded(spark, d):
    return T.search_bounded(_live(spark, d), X.query_terms(QUERY)).select("id", F.round("fused", 6).alias("fused"), "best_rank")


@query("""SELECT id FROM memories WHERE invalid_at IS NULL AND lower(content) LIKE '%zu%' ORDER BY last_recall_ts DESC, id LIMIT 12""")
def entry_fallback(spark, d):
    """A query too short for a trigram is sought as a substring, the latest recalled first."""
    return T.entries(_live(spark, d), "zu", X.query_terms("zu"), 12).select("id")


@query("""SELECT id, position FROM (SELECT id, CAST(row_number() OVER (ORDER BY round(sum(score), 9) DESC, id) AS INT) AS position FROM (WITH """ + fts_sql("项目进度", "SELECT id, content FROM notes") + """ SELECT * FROM sc) s GROUP BY id) x WHERE position <= 15""")
def han_search(spark, d):
    return T.entries(view(spark, d, "notes"), "项目进度", X.query_terms("项目进度"), 15)


@query(FTS_SQL + f""", q AS (SELECT vec AS v FROM memories_vec WHERE vec_id = 3), lex AS (SELECT id, row_number() OVER (ORDER BY round(sum(score), 9) DESC, id) AS rank FROM sc GROUP BY id QUALIFY rank <= 48),
    vs AS (SELECT memory_id AS id, row_number() OVER (ORDER BY {VECTOR_SQL} DESC, memory_id) AS rank FROM memories_vec, q QUALIFY rank <= 48)
    SELECT id, round(sum(1.0 / (60 + rank)), 6) AS rrf_score, count(*) AS channels FROM (SELECT * FROM lex UNION ALL SELECT * FROM vs) x GROUP BY id""")
def fused_candidates(spark, d):
    lex = T.search(_live(spark, d), X.query_terms(QUERY), 48)
    vec = R.nearest(view(spark, d, "memories_vec"), _vector(spark, d, 3), 48).withColumnRenamed("memory_id", "id")
    out = R.fused(R.channel(lex, "lexical", F.desc(F.round("bm25", 9)), F.col("id")), R.channel(vec, "vector", F.desc(F.round("sim", 9)), F.col("id")))
    return out.select("id", F.round("rrf_score", 6).alias("rrf_score"), F.size("channel_ranks").cast("long").alias("channels"))


# transitions

PROOF_SQL = "proof AS (SELECT memory_id, count(*) AS proofs FROM memory_evidence WHERE trim(coalesce(locator, '')) <> '' AND trim(coalesce(excerpt, '')) <> '' AND trim(coalesce(observed_at, '')) <> '' GROUP BY memory_id), held AS (SELECT unnest([left_memory_id, right_memory_id]) AS memory_id FROM memory_conflicts WHERE status = 'open')"
OPEN_SQL = "CASE WHEN c.memory_id IN (SELECT memory_id FROM held) THEN 'open_conflict' END"


def _reasons(spark, d, tier):
    out = G.promotion_reasons(*_all(spark, d, "memory_cognitive", "memory_evidence", "memory_activations", "memory_conflicts", "parents"), tier)
    return out.select("memory_id", F.concat_ws(",", "reasons").alias("reasons"))


@query(f"WITH {PROOF_SQL} SELECT c.memory_id, concat_ws(',', {OPEN_SQL}, " + ", ".join(f"CASE WHEN trim(coalesce({f}, '')) = '' THEN '{f}_required' END" for f in G.TIER_FIELDS) + ", CASE WHEN coalesce(proofs, 0) < 1 THEN 'complete_evidence_required' END) AS reasons FROM memory_cognitive c LEFT JOIN proof p ON p.memory_id = c.memory_id")
def promotion_to_m1(spark, d):
    return _reasons(spark, d, "M1")


@query(f"""WITH {PROOF_SQL}, kin AS (SELECT memory_id, count(*) AS kin, count(*) FILTER (WHERE memory_tier = 'M0') AS low, count(*) FILTER (WHERE verification_status <> 'verified') AS unsure FROM (SELECT DISTINCT p.memory_id, p.parent_id, s.memory_tier, s.verification_status FROM parents p JOIN memory_cognitive s ON s.memory_id = p.parent_id) x GROUP BY memory_id)
    SELECT c.memory_id, concat_ws(',', {OPEN_SQL}, CASE WHEN c.memory_tier <> 'M1' OR c.verification_status <> 'verified' THEN 'current_memory_must_be_verified_M1' END, CASE WHEN coalesce(kin, 0) < 2 OR coalesce(low, 0) > 0 THEN 'two_verified_M1_parents_required' END, CASE WHEN coalesce(unsure, 0) > 0 THEN 'parent_verification_required' END) AS reasons
    FROM memory_cognitive c LEFT JOIN kin ON kin.memory_id = c.memory_id""")
def promotion_to_m2(spark, d):
    return _reasons(spark, d, "M2")


@query(f"""WITH {PROOF_SQL}, acts AS (SELECT memory_id, count(*) AS n, count(DISTINCT occurred_date) AS dates, count(DISTINCT CASE WHEN trim(session_id) <> '' THEN session_id END) AS sessions FROM memory_activations WHERE activation_kind IN ('adopted', 'confirmed') GROUP BY memory_id)
    SELECT c.memory_id, concat_ws(',', {OPEN_SQL}, CASE WHEN c.memory_tier <> 'M2' THEN 'current_memory_must_be_M2' END, CASE WHEN coalesce(n, 0) < 3 OR (coalesce(dates, 0) < 2 AND coalesce(sessions, 0) < 2) THEN 'independent_adoption_required' END, CASE WHEN coalesce(proofs, 0) < 2 THEN 'two_evidence_items_required' END) AS reasons
    FROM memory_cognitive c LEFT JOIN proof p ON p.memory_id = c.memory_id LEFT JOIN acts a ON a.memory_id = c.memory_id""")
def promotion_to_m3(spark, d):
    return _reasons(spark, d, "M3")


@query(f"SELECT c.memory_id FROM memory_cognitive c JOIN ({PROMOTION_SQL}) g ON g.memory_id = c.memory_id WHERE g.promoted ORDER BY c.activation_count DESC, c.last_verified_ts, c.memory_id LIMIT 3")
def nightly_promotions(spark, d):
    side, *rest = _all(spark, d, "memory_cognitive", "memory_evidence", "memory_activations", "memory_conflicts")
    return G.nightly(G.promotion(side, *rest), side, 3)


def _shifted(sql: str) -> str:
    """With the tiers of the memories after: so those at M2 have two pieces of evidence."""
    return sql.replace("memory_cognitive", "(SELECT * REPLACE ('M' || CAST((CAST(substring(memory_tier, 2) AS INT) + 1) % 4 AS VARCHAR) AS memory_tier) FROM memory_cognitive)")


@query(_shifted(f"SELECT c.memory_id FROM memory_cognitive c JOIN ({PROMOTION_SQL}) g ON g.memory_id = c.memory_id WHERE g.promoted ORDER BY c.activation_count DESC, c.last_verified_ts, c.memory_id LIMIT 50"))
def nightly_promotions_due(spark, d):
    side, *rest = _all(spark, d, "memory_cognitive", "memory_evidence", "memory_activations", "memory_conflicts")
    side = side.withColumn("memory_tier", F.concat(F.lit("M"), ((F.substring("memory_tier", 2, 1).cast("int") + 1) % 4).cast("string")))
    return G.nightly(G.promotion(side, *rest), side, 50)


ALLOWED_SQL = f"""SELECT m.id FROM memories m LEFT JOIN memory_cognitive c ON c.memory_id = m.id WHERE m.invalid_at IS NULL AND (
        (c.visibility = 'private' AND c.owner_type = 'user' AND c.owner_id = 'u3') OR (c.visibility = 'team' AND c.owner_id = 'u3')
        OR EXISTS (SELECT 1 FROM memory_acl a WHERE a.memory_id = m.id AND a.principal_type = 'user' AND a.principal_id = 'u3' AND a.permission IN ('read', 'write', 'admin') AND (a.expires_at IS NULL OR a.expires_at > {AS_OF})))"""


def _readable(spark, d):
    return G.allowed(*_all(spark, d, "memories", "memory_cognitive", "memory_acl"), ("user", "u3"), [], AS_OF)


@query(f"""WITH ok AS ({ALLOWED_SQL}) SELECT e.event_id, CASE WHEN e.memory_id NOT IN (SELECT id FROM ok) THEN 'acl_denied' WHEN c.memory_id IS NULL THEN 'governance_row_missing' WHEN memory_tier = 'M0' THEN 'stable_tier_required' WHEN verification_status <> 'verified' THEN 'verified_memory_required' WHEN review_status <> 'active' OR status <> 'active' THEN 'active_memory_required' ELSE 'accepted' END AS reason
    FROM dream_events e LEFT JOIN memory_cognitive c ON c.memory_id = e.memory_id""")
def dream_mentions(spark, d):
    out = G.dream_reasons(view(spark, d, "dream_events").select("memory_id", "event_id"), _readable(spark, d), view(spark, d, "memory_cognitive"))
    return out.select("event_id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


@query(f"""WITH ok AS ({ALLOWED_SQL}), fit AS (SELECT *, row_number() OVER (PARTITION BY memory_tier, memory_form ORDER BY memory_id) AS rn FROM memory_cognitive WHERE memory_tier IN ('M1', 'M2', 'M3') AND verification_status = 'verified' AND review_status = 'active' AND status = 'active' AND memory_form <> 'hypothesis'),
    pool AS (SELECT memory_id FROM fit WHERE rn <= 25 ORDER BY sha256('night|pool|' || memory_id) LIMIT 512), s AS (SELECT m.id, substring(trim(m.content), 1, 700) AS text, row_number() OVER (ORDER BY sha256('night|' || m.id)) AS rn FROM memories m WHERE m.id IN (SELECT memory_id FROM pool) AND m.id IN (SELECT id FROM ok) AND trim(m.content) <> '' QUALIFY rn <= 8),
    b AS (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT id, substring(text, 1, CAST(1500 - before AS INT)) AS snippet FROM b WHERE before < 1500""")
def dream_seed_texts(spark, d):
    m, c = _all(spark, d, "memories", "memory_cognitive")
    return G.dream_seeds(m, c, _readable(spark, d), "night", 8, 1500).select("id", "snippet")


@query("""SELECT memory_id, memory_form, lifecycle_stage, confidence, memory_tier, review_status, visibility, evidence_count, root_source_id, scope FROM (SELECT id AS memory_id, CASE kind WHEN 'episodic' THEN 'episodic' WHEN 'knowledge_book' THEN 'semantic' WHEN 'decision' THEN 'procedural' ELSE 'hypothesis' END AS memory_form, CASE kind WHEN 'knowledge_book' THEN 'deep' ELSE 'consolidated' END AS lifecycle_stage,
        CASE WHEN CAST(substring(id, 3) AS BIGINT) % 7 = 0 THEN 1.0 ELSE 0.25 END AS confidence, 'M0' AS memory_tier, 'quarantine' AS review_status, 'private' AS visibility, CAST(CASE WHEN CAST(substring(id, 3) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS INT) AS evidence_count, 's' || CAST(CAST(substring(id, 3) AS BIGINT) % 90 AS VARCHAR) AS root_source_id, mode_id AS scope FROM raw_memories) x""")
def registered_sidecars(spark, d):
    return Q.sidecars(view(spark, d, "raw_memories"), ("user", "u1"), AS_OF).select("memory_id", "memory_form", "lifecycle_stage", "confidence", "memory_tier", "review_status", "visibility", "evidence_count", "root_source_id", "scope")


@query("""SELECT DISTINCT 'm-' || CAST(doc_id AS VARCHAR) AS memory_id, f.t AS facet_type, f.v AS facet_value FROM (SELECT doc_id, unnest([{'t': 'domain', 'v': 'work'}, {'t': 'domain', 'v': lower(lang)}, {'t': 'entity', 'v': 'alpha'}, {'t': 'entity', 'v': lower(source)}, {'t': 'entity', 'v': 'beta'}]) AS f FROM {documents}) x""")
def registered_facets(spark, d):
    return Q.facets_of(view(spark, d, "raw_memories"))


@query("""SELECT DISTINCT 'conf-' || substring(sha256(least(id, o) || '|' || greatest(id, o)), 1, 16) AS conflict_id, 'open' AS status FROM (SELECT id, 'm-' || CAST(CAST(substring(id, 3) AS BIGINT) % 5 AS VARCHAR) AS o FROM raw_memories) x WHERE id <> o""")
def registered_conflicts(spark, d):
    return Q.conflicts_of(view(spark, d, "raw_memories"), AS_OF).select("conflict_id", "status")


@query("SELECT episode_id, status FROM inbox WHERE status = 'staged' ORDER BY updated_ts DESC, episode_id LIMIT 30")
def inbox_latest(spark, d):
    return view(spark, d, "inbox").filter("status = 'staged'").orderBy(F.desc("updated_ts"), "episode_id").limit(30).select("episode_id", "status")


@query("SELECT id, importance FROM memories WHERE invalid_at IS NULL AND kind IN ('episodic', 'semantic', 'procedural') ORDER BY importance DESC, last_recall_ts DESC, id LIMIT 8")
def digest_top(spark, d):
    return M.important(_live(spark, d).filter(F.col("kind").isin(M.PERSONAL)), 8).select("id", "importance")
