"""Registered queries over jobs, replicas, relations, themes and events, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loamstone.functions import scoring as S
from loamstone.functions import text as X
from loamstone.operators import governance as G
from loamstone.operators import graph as N
from loamstone.operators import jobs as J
from loamstone.operators import memory as M
from loamstone.operators import recall as C
from loamstone.operators import retrieval as R
from loamstone.operators import segment as W
from loamstone.operators import vector_index as V
from loamstone.plans.bridge import AS_OF, view
from loamstone.plans.governance_queries import ALLOWED_SQL, CONCEPT_SQL, FTS_SQL, QUERY, VECTOR_SQL, _indexed, _readable, _vector, bounded_sql, fts_sql
from loamstone.plans.memory_queries import ACTIVATION_SQL, RECENCY_SQL
from loamstone.sources.shared import shared_dir, stored
from loamstone.streaming import events as E

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


COPIES_SQL = f"CASE WHEN importance >= 4 OR greatest(0.0, ({AS_OF} - created_ts) / 86400.0) <= 90 THEN 5 WHEN importance >= 3 THEN 5 WHEN importance >= 2 THEN 3 ELSE 2 END"


@query(f"""SELECT p.pool, count(*) AS shards, count(DISTINCT id) AS memories, count(*) FILTER (WHERE false) AS pending FROM memories JOIN (SELECT * FROM (VALUES (0, 'gist'), (1, 'webdav'), (2, 'notion'), (3, 'gitee'), (4, 'gitlab')) t(i, pool)) p ON p.i < {COPIES_SQL} GROUP BY p.pool""")
def replica_stats(spark, d):
    return J.shard_stats(J.replicas(view(spark, d, "memories"), "key", AS_OF))


@query("SELECT id AS memory_id, content FROM memories")
def replica_round_trip(spark, d):
    shards = J.replicas(view(spark, d, "memories"), "key", AS_OF)
    damaged = shards.withColumn("payload", F.when(F.col("copy") == 0, F.concat("payload", F.lit("x").cast("binary"))).otherwise(F.col("payload")))
    return J.restored(damaged, "key").select("memory_id", F.get_json_object("record", "$.content").alias("content"))


@query("""WITH v AS (SELECT m.id, m.created_ts, x.vec FROM memories m JOIN memories_vec x ON x.memory_id = m.id WHERE m.invalid_at IS NULL ORDER BY m.created_ts DESC, m.id LIMIT 60),
    sim AS (SELECT a.id AS a, b.id AS b, list_dot_product(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])) AS sim FROM v a JOIN v b ON a.id < b.id),
    pairs AS (SELECT a, b, sim FROM sim WHERE sim > 0.4 AND sim < 0.92 UNION ALL SELECT least(src, dst), greatest(src, dst), 1.0 FROM edges WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)),
    best AS (SELECT a, b, max(sim) AS sim FROM pairs GROUP BY 1, 2)
    SELECT a, b, round(sim, 6) AS sim FROM best WHERE NOT EXISTS (SELECT 1 FROM memory_conflicts c WHERE least(c.left_memory_id, c.right_memory_id) = a AND greatest(c.left_memory_id, c.right_memory_id) = b) ORDER BY best.sim DESC, a, b LIMIT 20""")
def relation_candidates(spark, d):
    v = view(spark, d, "memories").filter("invalid_at IS NULL").join(view(spark, d, "memories_vec"), F.col("id") == F.col("memory_id")).select("id", "created_ts", "vec")
    typed = view(spark, d, "memory_conflicts").select(F.col("left_memory_id").alias("src"), F.col("right_memory_id").alias("dst"))
    return J.relation_candidates(v, view(spark, d, "edges"), typed).select("a", "b", F.round("sim", 6).alias("sim"))


@query()
def distill_clusters(spark, d):
    v = view(spark, d, "memories").filter("invalid_at IS NULL AND kind IN ('episodic', 'procedural')").join(view(spark, d, "memories_vec"), F.col("id") == F.col("memory_id")).select("id", "created_ts", "vec")
    return J.clusters(v, floor=0.2)


@query()
def embedding_backfill(spark, d):
    return J.embedded(R.missing(view(spark, d, "memories"), view(spark, d, "memories_vec")), dim=64)


HAN_SQL = """runs AS (SELECT id, r.run, r.i FROM (SELECT id, regexp_extract_all(content, '[\u4e00-\u9fa5]+') AS rs FROM notes) n, unnest(rs) WITH ORDINALITY AS r(run, i)),
    grams AS (SELECT substring(run, CAST(s AS INT), CAST(l AS INT)) AS word FROM runs, unnest(generate_series(1, 4)) AS u(l), unnest(generate_series(1, length(run) - l + 1)) AS v(s)),
    words AS (SELECT word, count(*) AS c FROM grams GROUP BY word HAVING count(*) >= 2), total AS (SELECT sum(c) AS n FROM words),
    paths AS (SELECT DISTINCT run, CAST(0 AS BIGINT) AS e, CAST(0 AS DOUBLE) AS cost, CAST([] AS VARCHAR[]) AS cut FROM runs
        UNION ALL SELECT run, e + l, cost + ln(n) - ln(coalesce(w.c, 0.5)), list_append(cut, x.next) FROM (SELECT p.*, l, substring(p.run, CAST(p.e + 1 AS INT), CAST(l AS INT)) AS next FROM paths p CROSS JOIN (SELECT unnest(generate_series(1, 4)) AS l) u WHERE p.e + l <= length(p.run)) x CROSS JOIN total LEFT JOIN words w ON w.word = x.next WHERE w.c IS NOT NULL OR l = 1),
    best AS (SELECT run, cut FROM paths WHERE e = length(run) QUALIFY row_number() OVER (PARTITION BY run ORDER BY round(cost, 7), len(cut), list_reverse(list_transform(cut, lambda x: length(x))) DESC) = 1),
    cuts AS (SELECT id, i, w.word, w.k FROM runs JOIN best ON best.run = runs.run, unnest(cut) WITH ORDINALITY AS w(word, k))"""


@query("WITH RECURSIVE " + HAN_SQL + " SELECT id, i, k, word FROM cuts WHERE length(word) >= 2 AND word NOT IN ('" + "', '".join(X.STOP) + "')")
def han_words(spark, d):
    """The words of the likeliest cut of every run of Han characters, with their places."""
    notes = view(spark, d, "notes")
    runs = notes.select("id", F.posexplode(F.regexp_extract_all("content", F.lit(X.HAN + "+"), F.lit(0))).alias("i", "run"))
    cut = W.segmented(runs, W.costs(W.word_counts(notes)), "run", least=1, stop=False)
    words = cut.select("id", (F.col("i") + 1).cast("long").alias("i"), F.posexplode("words").alias("k", "word")).select("id", "i", (F.col("k") + 1).cast("long").alias("k"), "word")
    return words.filter((F.char_length("word") >= 2) & ~F.col("word").isin(X.STOP))


CE_SQL = CONCEPT_SQL + """, named AS (SELECT DISTINCT concept_id, first_value(name) OVER (PARTITION BY concept_id ORDER BY memory_id, rn) AS name FROM (SELECT id AS memory_id, w AS name, rn, 'c-' || substring(md5(lower(trim(w))), 1, 12) AS concept_id FROM firsts WHERE rn <= 15) l),
    ce AS (SELECT x.concept_id AS src, y.concept_id AS dst, CAST(count(*) AS DOUBLE) AS weight FROM told x JOIN told y ON x.memory_id = y.memory_id AND x.concept_id <> y.concept_id GROUP BY 1, 2), deg AS (SELECT src AS concept_id, count(*) AS degree FROM ce GROUP BY src),
    near AS (SELECT src, n.name, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM ce JOIN named n ON n.concept_id = dst)"""


def _graph(spark, d):
    """Concept edges both ways, members and concepts."""
    links, found = _indexed(spark, d)
    found = stored(found, "concepts")
    pairs = N.pair_weights(N.telling(links, found), "concept_id", "memory_id")
    return stored(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(pairs.select("b", "a", "weight")), "concept-edges"), links.select("memory_id", "concept_id"), found


@query(CE_SQL + """, most AS (SELECT * FROM deg ORDER BY degree DESC, concept_id LIMIT 12), chosen AS (SELECT m.concept_id, n.name, degree FROM most m JOIN named n ON n.concept_id = m.concept_id WHERE m.concept_id IN (SELECT concept_id FROM found WHERE NOT is_hub) ORDER BY degree DESC, m.concept_id LIMIT 6)
    SELECT c.name AS concept, degree, (SELECT string_agg(near.name, ',' ORDER BY rank) FROM near WHERE near.src = c.concept_id AND rank <= 5) AS related FROM chosen c""")
def digest_themes(spark, d):
    edges, _, found = _graph(spark, d)
    return N.themes(edges, found).select("concept", "degree", F.concat_ws(",", "related").alias("related"))


@query(CE_SQL + """, chosen AS (SELECT g.concept_id, n.name, degree FROM deg g JOIN named n ON n.concept_id = g.concept_id WHERE degree >= 6 AND g.concept_id IN (SELECT concept_id FROM found WHERE NOT is_hub) ORDER BY degree DESC, g.concept_id LIMIT 50),
    lines AS (SELECT k.concept_id, substring(string_split(m.content, chr(10))[1], 1, 70) AS line, row_number() OVER (PARTITION BY k.concept_id ORDER BY m.importance DESC, m.id) AS rn FROM (SELECT DISTINCT concept_id, memory_id FROM links) k JOIN memories m ON m.id = k.memory_id)
    SELECT c.concept_id, degree, '# 概念地图: ' || c.name || chr(10) || chr(10) || '关联概念: ' || (SELECT string_agg('[[' || near.name || ']]', ' ' ORDER BY rank) FROM near WHERE near.src = c.concept_id AND rank <= 12) || chr(10) || chr(10) || '## 相关记忆' || coalesce((SELECT string_agg(chr(10) || '- ' || line, '' ORDER BY rn) FROM lines WHERE lines.concept_id = c.concept_id AND rn <= 8), '') AS content FROM chosen c""")
def maps_of_content(spark, d):
    edges, members, found = _graph(spark, d)
    return N.concept_maps(edges, members, view(spark, d, "memories"), found).select("concept_id", "degree", "content")


def ppr_sql(name: str, seeds: str, rounds: int = 30) -> str:
    """CTE ``name``: the personalized rank of ``edges`` from a table of ids with equal weights; needs ``share``."""
    parts = [f"{name}_s AS (SELECT id, 1.0 / count(*) OVER () AS s FROM ({seeds}) z)", f"{name}_0 AS (SELECT id, CAST(s AS DOUBLE) AS r FROM {name}_s)"]
    for i in range(rounds):
        parts.append(f"{name}_{i + 1} AS MATERIALIZED (SELECT coalesce(m.dst, s.id) AS id, 0.85 * coalesce(m.m, 0) + 0.15 * coalesce(s.s, 0) AS r FROM (SELECT dst, sum(p * r) AS m FROM share JOIN {name}_{i} ON src = id GROUP BY dst) m FULL JOIN {name}_s s ON s.id = m.dst)")
    return ", ".join([*parts, f"{name} AS (SELECT id, r AS ppr FROM {name}_{rounds} WHERE r > 1e-6)"])


SHARE_SQL = "share AS (SELECT e.src, e.dst, e.weight / t.total AS p FROM edges e JOIN (SELECT src, sum(weight) AS total FROM edges GROUP BY src) t ON t.src = e.src)"
NEAR_SQL = "q AS (SELECT vec AS v FROM memories_vec WHERE vec_id = {n}), {name} AS (SELECT memory_id AS id, {sim} AS sim, row_number() OVER (ORDER BY {sim} DESC, memory_id) AS position FROM memories_vec, q QUALIFY position <= {k})"


def near_sql(name: str, k: int, n: int = 3) -> str:
    return NEAR_SQL.replace("{sim}", VECTOR_SQL).replace("{name}", name).replace("{k}", str(k)).replace("{n}", str(n))


@query(FTS_SQL + f""", {near_sql("near", 32)}, lit AS (SELECT id, row_number() OVER (ORDER BY round(sum(score), 9) DESC, id) AS position FROM sc GROUP BY id QUALIFY position <= 32), {SHARE_SQL},
    entry AS (SELECT id, min(CASE WHEN l = 0 THEN position ELSE 100 + position END) AS spot FROM (SELECT id, 0 AS l, position FROM near WHERE position <= 15 UNION ALL SELECT id, 1, position FROM lit WHERE position <= 15) x GROUP BY id), {ppr_sql("ppr", "SELECT id FROM entry")},
    pool AS (SELECT id FROM entry UNION SELECT id FROM (SELECT id FROM ppr ORDER BY round(ppr, 12) DESC, id LIMIT 400) x), cut AS (SELECT p.id, e.spot, r.ppr FROM pool p LEFT JOIN entry e ON e.id = p.id LEFT JOIN ppr r ON r.id = p.id ORDER BY e.spot NULLS LAST, round(r.ppr, 12) DESC, p.id LIMIT 400),
    c AS (SELECT m.id, substring(string_split(trim(content), chr(10))[1], 1, 40) AS title, coalesce(near.sim, 0) AS sim, near.id IS NOT NULL AS is_near, lit.id IS NOT NULL AS is_lit, cut.spot, cut.ppr, {ACTIVATION_SQL} AS act, {RECENCY_SQL} AS rr, mode_id = 'src3' AS same, contains(meta, '"consolidated": true') AS old
        FROM cut JOIN memories m ON m.id = cut.id LEFT JOIN near ON near.id = m.id LEFT JOIN lit ON lit.id = m.id WHERE m.invalid_at IS NULL),
    s AS (SELECT *, 0.5 * sim + 0.3 * coalesce(ppr, 0) / (SELECT max(ppr) FROM ppr) + 0.2 * act / max(act) OVER () + CASE WHEN same THEN 0.08 ELSE 0 END - CASE WHEN old THEN 0.05 ELSE 0 END AS score FROM c),
    g AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY round(score, 9) DESC, id) AS rn FROM s WHERE (rr >= 0.20 OR is_lit OR sim >= 0.55) AND (rr >= 0.55 OR rr < 0.20 OR is_lit OR sim >= 0.30 OR spot IS NOT NULL))
    SELECT id, round(score, 4) AS score, CASE WHEN concat_ws('+', CASE WHEN is_near THEN '语义' END, CASE WHEN is_lit THEN '字面' END, CASE WHEN spot IS NULL AND ppr IS NOT NULL THEN '关联扩散' END) = '' THEN '关联' ELSE concat_ws('+', CASE WHEN is_near THEN '语义' END, CASE WHEN is_lit THEN '字面' END, CASE WHEN spot IS NULL AND ppr IS NOT NULL THEN '关联扩散' END) END AS via FROM g WHERE rn = 1 ORDER BY round(score, 9) DESC, id LIMIT 8""")
def hybrid_recall(spark, d):
    m, v, e = (view(spark, d, n) for n in ("memories", "memories_vec", "edges"))
    return C.hybrid(m, v, e, AS_OF, QUERY, _vector(spark, d, 3), boost_mode="src3").select("id", "score", "via")


@query(f"""WITH {SHARE_SQL}, nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), {ppr_sql("ra", "SELECT id FROM nodes WHERE id IN ('m-1', 'm-2', 'm-900000')")}, {ppr_sql("rb", "SELECT id FROM nodes WHERE id IN ('m-7', 'm-9')")}
    SELECT ra.id, round(ra.ppr * rb.ppr, 10) AS score FROM ra JOIN rb ON rb.id = ra.id ORDER BY ra.ppr * rb.ppr DESC, ra.id LIMIT 5""")
def connectors(spark, d):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    return C.connectors(view(spark, d, "edges"), ids("m-1", "m-2", "m-900000"), ids("m-7", "m-9")).select("id", F.round("score", 10).alias("score"))


@query("""SELECT id FROM typed_edges WHERE (src IN ('m-0', 'm-5', 'm-10', 'm-15') AND dst IN ('m-1', 'm-36', 'm-11', 'm-46')) OR (dst IN ('m-0', 'm-5', 'm-10', 'm-15') AND src IN ('m-1', 'm-36', 'm-11', 'm-46'))""")
def typed_relations(spark, d):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    return C.typed_between(view(spark, d, "typed_edges"), ids("m-0", "m-5", "m-10", "m-15"), ids("m-1", "m-36", "m-11", "m-46")).select("id")


@query("""WITH q AS (SELECT vec AS v FROM memories_vec WHERE vec_id = 3), s AS (SELECT rel_type, because, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) / sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))) AS sim FROM typed_edges, q) SELECT rel_type, because, round(sim, 3) AS sim FROM s WHERE sim >= 0.05 ORDER BY s.sim DESC LIMIT 5""")
def relation_search(spark, d):
    return C.relations(view(spark, d, "typed_edges"), _vector(spark, d, 3), 5, 0.05)


@query(FTS_SQL + f""", {near_sql("near", 36)}, lit AS (SELECT id, row_number() OVER (ORDER BY round(sum(score), 9) DESC, id) AS position FROM sc GROUP BY id QUALIFY position <= 12), mix AS (SELECT id, min(CASE WHEN l = 0 THEN position ELSE 1000 + position END) AS spot FROM (SELECT id, 0 AS l, position FROM near UNION ALL SELECT id, 1, position FROM lit) x GROUP BY id)
    SELECT b.id, CAST(row_number() OVER (ORDER BY spot) AS INT) AS position FROM mix b JOIN memories m ON m.id = b.id WHERE m.invalid_at IS NULL AND m.kind IN ('episodic', 'semantic', 'procedural') QUALIFY position <= 12""")
def rich_seeds(spark, d):
    return C.rich_seeds(view(spark, d, "memories"), view(spark, d, "memories_vec"), QUERY, _vector(spark, d, 3), personal=True)


HOT = "SELECT m.id, m.content FROM memories m JOIN memory_cognitive c ON c.memory_id = m.id WHERE m.invalid_at IS NULL AND c.status = 'active' AND c.lifecycle_stage <> 'deep' AND c.review_status <> 'retired'"


def _candidates_sql() -> str:
    """CTEs of the candidates of a plan of depth Q2 over hot memories, with their ranks; ``shut`` are the denied."""
    return "WITH " + fts_sql(QUERY, HOT) + f""", {bounded_sql(192, 192)}, lx AS (SELECT id, row_number() OVER (ORDER BY round(fused, 9) DESC, round(bm25, 9) DESC, best_rank, id) AS position FROM bounded), {near_sql("nr", 384)}, ok AS ({ALLOWED_SQL}),
    raw AS (SELECT id FROM lx UNION SELECT id FROM nr), lexical AS (SELECT id, row_number() OVER (ORDER BY position) AS rank FROM lx WHERE id IN (SELECT id FROM ok) QUALIFY rank <= 48), vectorial AS (SELECT id, row_number() OVER (ORDER BY position) AS rank FROM nr WHERE id IN (SELECT id FROM ok) QUALIFY rank <= 48),
    seeds AS (SELECT id, row_number() OVER (ORDER BY min(spot)) AS position FROM (SELECT id, rank AS spot FROM lexical WHERE rank <= 12 UNION ALL SELECT id, 100 + rank FROM vectorial WHERE rank <= 12) x GROUP BY id),
    f0 AS (SELECT id FROM seeds WHERE position <= 16), e1 AS (SELECT dst, weight FROM edges WHERE src IN (SELECT id FROM f0) ORDER BY weight DESC, dst LIMIT 160), h1 AS (SELECT dst AS id, max(weight) AS weight FROM e1 WHERE dst NOT IN (SELECT id FROM f0) AND dst IN (SELECT id FROM ok) GROUP BY dst),
    f1 AS (SELECT id FROM h1 ORDER BY weight DESC, id LIMIT 16), e2 AS (SELECT dst, weight FROM edges WHERE src IN (SELECT id FROM f1) ORDER BY weight DESC, dst LIMIT 160), h2 AS (SELECT dst AS id, max(weight) AS weight FROM e2 WHERE dst NOT IN (SELECT id FROM f0) AND dst NOT IN (SELECT id FROM h1) AND dst IN (SELECT id FROM ok) GROUP BY dst),
    graph AS (SELECT id, row_number() OVER (ORDER BY weight DESC, id) AS rank FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) x QUALIFY rank <= 40),
    cand AS (SELECT m.id, l.rank AS lexical_rank, v.rank AS vector_rank, g.rank AS graph_rank, coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + g.rank), 0) AS rrf_score FROM memories m LEFT JOIN lexical l ON l.id = m.id LEFT JOIN vectorial v ON v.id = m.id LEFT JOIN graph g ON g.id = m.id WHERE m.invalid_at IS NULL AND (l.id IS NOT NULL OR v.id IS NOT NULL OR g.id IS NOT NULL)),
    shut AS (SELECT id FROM raw WHERE id NOT IN (SELECT id FROM ok))"""


def _found(spark, d):
    m, c, v, e = (view(spark, d, n) for n in ("memories", "memory_cognitive", "memories_vec", "edges"))
    return C.rrf_candidates(m, M.hot(m, c.select("memory_id", "status", "lifecycle_stage", "review_status")), v, e, _readable(spark, d), QUERY, _vector(spark, d, 3), "Q2")


@query(_candidates_sql() + " SELECT id, CAST(lexical_rank AS INT) AS lexical_rank, CAST(vector_rank AS INT) AS vector_rank, CAST(graph_rank AS INT) AS graph_rank, round(rrf_score, 9) AS rrf_score, true AS allowed FROM cand UNION ALL SELECT id, NULL, NULL, NULL, 0, false FROM shut")
def rrf_candidates(spark, d):
    found, denied = _found(spark, d)
    none = F.lit(None).cast("int")
    rows = found.select("id", "lexical_rank", "vector_rank", "graph_rank", F.round("rrf_score", 9).alias("rrf_score"), F.lit(True).alias("allowed"))
    return rows.unionByName(denied.select("id", none.alias("lexical_rank"), none.alias("vector_rank"), none.alias("graph_rank"), F.lit(0.0).alias("rrf_score"), F.lit(False).alias("allowed")))


def _plan(spark, d):
    found, denied = _found(spark, d)
    side, facets, conflicts, evidence = (view(spark, d, n) for n in ("memory_cognitive", "memory_facets", "memory_conflicts", "memory_evidence"))
    return C.planned(found, denied, side, facets, conflicts, evidence, G.dream_effect(view(spark, d, "dream_events"), "2024-01-25"), 8, 6400, 1600, "Q2", ["en", "d3"], ["src1"], ["episodic"], "src3")


@query()
def planned_recall(spark, d):
    return _plan(spark, d)[0].select("id", "final_rank", "snippet", "tokens", "score", F.concat_ws(",", "why_recalled").alias("why"), F.concat_ws(",", "locators").alias("locators"))


@query()
def planned_audit(spark, d):
    return _plan(spark, d)[1]


@query("""WITH r AS (SELECT 'q' || CAST(doc_id % 5 AS STRING) AS query, doc_id, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY md5(CAST(doc_id AS STRING))) AS rank FROM {documents}), g AS (SELECT 'q' || CAST(doc_id % 5 AS STRING) AS query, doc_id, 1 + doc_id % 3 AS grade, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY 1 + doc_id % 3 DESC, doc_id) AS rn FROM {documents} WHERE doc_id % 11 = 0),
    hit AS (SELECT r.query, count(*) AS hits, max(1.0 / rank) AS rr, sum(grade / log2(rank + 1)) AS dcg FROM r JOIN g ON g.query = r.query AND g.doc_id = r.doc_id WHERE rank <= 5 GROUP BY r.query), ideal AS (SELECT query, count(*) AS n, sum(CASE WHEN rn <= 5 THEN grade / log2(rn + 1) ELSE 0 END) AS idcg FROM g GROUP BY query)
    SELECT ideal.query, round(coalesce(hits / least(n, 5), 0), 6) AS recall, round(coalesce(rr, 0), 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM ideal LEFT JOIN hit ON hit.query = ideal.query""")
def retrieval_quality(spark, d):
    from pyspark.sql import Window

    docs = view(spark, d, "documents").withColumn("query", F.concat(F.lit("q"), (F.col("doc_id") % 5).cast("string"))).withColumn("id", F.col("doc_id"))
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))))).select("query", "id", "rank")
    relevant = docs.filter("doc_id % 11 = 0").select("query", "id", (1 + F.col("doc_id") % 3).alias("grade"))
    q = R.quality(ranked, relevant)
    return q.select("query", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM {events} GROUP BY 1, 2")
def event_windows(spark, d):
    e = view(spark, d, "events")
    w = e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {events}), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    e = view(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.session_window("t", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


# many vector queries at once

MANY_SQL = "SELECT 'q-' || CAST(vec_id AS VARCHAR) AS query, vec AS v FROM memories_vec WHERE vec_id % 100 = 0"
SIM_SQL = "round(list_dot_product(CAST(vec AS DOUBLE[]), CAST(v AS DOUBLE[])) / sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))), 9)"


def _many(spark, d):
    vectors = view(spark, d, "memories_vec")
    return vectors, vectors.filter("vec_id % 100 = 0").select(F.concat(F.lit("q-"), F.col("vec_id").cast("string")).alias("query"), "vec")


def _lists(spark, d, lists: int = 16):
    path = f"{shared_dir(spark)}/loamstone-core/lists-{uuid.uuid4().hex}"
    vectors, queries = _many(spark, d)
    V.write_lists(vectors.select("memory_id", "vec"), V.fitted_centroids(vectors, lists), path)
    return vectors, queries, path


@query(f"SELECT query, memory_id, round(sim, 6) AS sim, rank FROM (SELECT query, memory_id, {SIM_SQL} AS sim, CAST(row_number() OVER (PARTITION BY query ORDER BY {SIM_SQL} DESC, memory_id) AS INT) AS rank FROM memories_vec, ({MANY_SQL}) q) x WHERE rank <= 10")
def vector_search_many(spark, d):
    """The ten nearest of every hundredth vector, among all, in one pass."""
    vectors, queries = _many(spark, d)
    return V.nearest_many(vectors, queries, 10).select("query", "memory_id", F.round("sim", 6).alias("sim"), "rank")


@query(f"SELECT query, memory_id, round(sim, 6) AS sim, rank FROM (SELECT query, memory_id, {SIM_SQL} AS sim, CAST(row_number() OVER (PARTITION BY query ORDER BY {SIM_SQL} DESC, memory_id) AS INT) AS rank FROM memories_vec, ({MANY_SQL}) q) x WHERE rank <= 10")
def vector_index_whole(spark, d):
    """The same from the index, with all its lists probed: every vector is in it."""
    _, queries, path = _lists(spark, d)
    return V.search_lists(spark, path, queries, 10, 16).select("query", "memory_id", F.round("sim", 6).alias("sim"), "rank")


@query()
def vector_index_recall(spark, d):
    """Recall of the ten nearest with 10 of 16 lists probed."""
    vectors, queries, path = _lists(spark, d)
    return V.recall(V.search_lists(spark, path, queries, 10, 10), V.nearest_many(vectors, queries, 10))


# streams over the events, drained into the shared folder

def _stream(spark, d):
    schema = view(spark, d, "events").schema
    return E.read(spark, d, schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _settled(spark, df, name, mode):
    path = f"{shared_dir(spark)}/loamstone-core/stream-{name}-{uuid.uuid4().hex}"
    return E.settled(df, path, mode)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM {events} GROUP BY 1, 2")
def stream_windows(spark, d):
    out = _settled(spark, E.windowed(_stream(spark, d)), "windows", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT 'm-' || CAST(user_id AS VARCHAR) AS memory_id, count(*) AS seen FROM {events} GROUP BY 1")
def stream_seen(spark, d):
    return _settled(spark, E.seen_counts(_stream(spark, d)), "seen", "complete")


@query("SELECT 'm-' || CAST(user_id AS VARCHAR) AS memory_id, count(*) AS n FROM {events} GROUP BY 1")
def stream_accumulated(spark, d):
    """Counts by micro-batch, delivered twice, summed on read."""
    path = f"{shared_dir(spark)}/loamstone-core/stream-accumulated-{uuid.uuid4().hex}"
    events = _stream(spark, d).withColumn("memory_id", F.concat(F.lit("m-"), F.col("user_id").cast("string")))
    for k in range(2):  # another checkpoint: all batches come again
        E.accumulate(events, f"{path}/counts", f"{path}/checkpoint-{k}").awaitTermination()
    return E.accumulated(spark, f"{path}/counts")


@query("SELECT event_id, event_type FROM {events}")
def stream_deduplicated(spark, d):
    """Every event delivered twice comes out once."""
    twice = _stream(spark, d).withColumn("event_id", F.explode(F.array("event_id", "event_id")))
    return _settled(spark, E.deduplicated(twice, late="400 days"), "deduplicated", "append").select("event_id", "event_type")
