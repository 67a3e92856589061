"""Composed retrieval: hybrid recall, connectors of two queries, access-bounded candidates and planned recall.

A channel is a short list (id, rank); all that is joined with it is bounded by the channel's cap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstone.functions import scoring as S
from loamstone.functions import text as X
from loamstone.operators import fulltext as T
from loamstone.operators import governance as G
from loamstone.operators import graph as N
from loamstone.operators import memory as M
from loamstone.operators import retrieval as R
from loamstone.operators.channels import Channels
from loamstone.sources.shared import stored

ENTRY, POOL = 15, 400
#: Until when in a recall's limit the lexical and the vector channel may run, and the graph channel after them.
FIRST_SHARE, GRAPH_SHARE = 0.4, 0.6
Index = tuple[DataFrame, DataFrame] | None


def _position(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def scope(memories: DataFrame, persona: str | None = None, kind: str | None = None, personal: bool = False) -> DataFrame | None:
    """Ids that a recall is restricted to; None for no restriction. Personal scope counts only where no other is given."""
    if persona or kind:
        rows = memories
        if kind:
            rows = rows.filter(F.col("kind") == kind)
        return (rows.filter(F.col("persona_id") == persona) if persona else rows).select("id")
    mine = M.live(memories).filter(F.col("kind").isin(M.PERSONAL)).select("id") if personal else None
    return None if mine is None or mine.isEmpty() else mine


def entry_union(*lists: DataFrame) -> DataFrame:
    """id and position of lists one after the other, each id where it comes first."""
    rows = None
    for i, df in enumerate(lists):
        part = df.select("id", F.struct(F.lit(i).alias("list"), "position").alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    return _position(rows.groupBy("id").agg(F.min("at").alias("at")), F.col("at"), F.col("id")).select("id", "position")


def hybrid(memories: DataFrame, vectors: DataFrame, edges: DataFrame, now: int, query: str, vector: list[float] | None, k: int = 8, persona: str | None = None, kind: str | None = None, personal: bool = False, boost_mode: str = "", index: Index = None, segment=None) -> DataFrame:
    """The k best memories for a query, one a title: by similarity, by the rank that spreads from the entries, by activation.

    Entries are the first of the vector and the full-text list; the pool is the entries and the POOL best of the personalized
    rank, within the scope; without any, what ``fulltext.entries`` finds. Deep memories need a literal hit or a similarity of
    0.55, latent ones a literal hit, 0.30 or a place among the entries.
    """
    rows, allowed, most = M.live(memories), scope(memories, persona, kind, personal), max(30, 4 * k)
    phrases = X.query_terms(query, segment=segment)
    within = lambda df: df if allowed is None else df.join(allowed, "id", "left_semi")
    near = rows.select("id").limit(0).withColumn("sim", F.lit(0.0))
    if vector is not None:
        some = None if allowed is None else allowed.withColumnRenamed("id", "memory_id")
        near = R.nearest(vectors, vector, most, some).withColumnRenamed("memory_id", "id")
    near = stored(_position(near, F.desc(F.round("sim", 9)), F.col("id")), "near")
    literal = _position(T.search(rows, phrases, most, index), F.desc(F.round("bm25", 9)), F.col("id")).select("id", F.col("position").alias("p"))
    literal = stored(_position(within(literal), F.col("p")).select("id", "position"), "literal")
    entry = stored(entry_union(near.filter(F.col("position") <= ENTRY), literal.filter(F.col("position") <= ENTRY)), "entry")
    ppr = stored(N.ranked(edges, entry.select("id", F.lit(1.0).alias("weight"))).withColumnRenamed("r", "ppr"), "ppr") if not entry.isEmpty() else rows.select("id").limit(0).withColumn("ppr", F.lit(0.0))
    top = ppr.orderBy(F.desc(F.round("ppr", 12)), "id").limit(POOL)
    pool = within(entry.select("id").union(top.select("id")).distinct())
    pool = pool.join(entry, "id", "left").join(ppr, "id", "left").orderBy(F.col("position").asc_nulls_last(), F.desc(F.round("ppr", 12)), "id").limit(POOL)
    pool = stored(pool, "pool")
    if pool.isEmpty():
        pool = within(T.entries(rows, query, phrases, k, index).select("id")).withColumn("position", F.lit(None).cast("int")).withColumn("ppr", F.lit(None).cast("double"))
    peak = ppr.agg(F.max("ppr").alias("peak"))
    df = pool.join(rows, "id").join(near.select("id", "sim"), "id", "left").join(literal.select("id", F.lit(True).alias("literal")), "id", "left").crossJoin(F.broadcast(peak))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    df = df.withColumn("act", S.activation(now)).withColumn("r", S.retrievability(now)).withColumn("tier", S.tier_of(F.col("r"))).withColumn("literal", F.coalesce("literal", F.lit(False)))
    act_peak = F.max("act").over(Window.partitionBy())
    df = df.withColumn("score", S.hybrid_score(
        zero("sim"), F.when(F.col("peak") > 0, zero("ppr") / F.col("peak")).otherwise(0.0), F.when(act_peak != 0, F.col("act") / act_peak).otherwise(0.0),
        F.lit(bool(boost_mode)) & F.coalesce(F.col("mode_id") == boost_mode, F.lit(False)), F.coalesce(F.col("meta").contains('"consolidated": true'), F.lit(False))))
    df = df.filter((F.col("tier") != "deep") | F.col("literal") | (zero("sim") >= 0.55)).filter((F.col("tier") != "latent") | F.col("literal") | (zero("sim") >= 0.30) | F.col("position").isNotNull())
    via = F.concat_ws("+", F.when(F.col("sim").isNotNull(), "语义"), F.when(F.col("literal"), "字面"), F.when(F.col("position").isNull() & F.col("ppr").isNotNull(), "关联扩散"))
    df = df.withColumn("title", X.title(F.trim("content"))).withColumn("via", F.when(via == "", "关联").otherwise(via))
    best = Window.partitionBy("title").orderBy(F.desc(F.round("score", 9)), "id")
    df = df.withColumn("rn", F.row_number().over(best)).filter("rn = 1").orderBy(F.desc(F.round("score", 9)), "id").limit(k)
    source = F.trim(F.coalesce(F.get_json_object("meta", "$.title"), F.get_json_object("meta", "$.author"), F.lit("")))
    return df.select("id", "title", X.snippet(F.trim("content")).alias("snippet"), F.round("score", 4).alias("score"), "token_count", "kind", "importance", source.alias("source"), "via", F.col("tier").alias("memory_state"),
        F.round("r", 4).alias("retrievability"), "recall_count", F.round(F.greatest(F.lit(1.0), S.stability_or_default(F.col("stability"))), 2).alias("stability"), F.col("tier").isin("latent", "deep").alias("reactivated"))


# connectors

def rich_seeds(memories: DataFrame, vectors: DataFrame, query: str, vector: list[float] | None, k: int = 12, personal: bool = False, index: Index = None) -> DataFrame:
    """id and position: the nearest vectors, then the literal entries; live ones, of the personal kinds if so wanted, k at most."""
    rows = M.live(memories)
    near = rows.select("id").limit(0).withColumn("sim", F.lit(0.0)) if vector is None else R.nearest(vectors, vector, k * 3 if personal else k).withColumnRenamed("memory_id", "id")
    both = entry_union(_position(near, F.desc(F.round("sim", 9)), F.col("id")), T.entries(rows, query, X.query_terms(query), k, index))
    fit = rows.filter(F.col("kind").isin(M.PERSONAL)) if personal else rows
    return _position(both.join(fit.select("id"), "id", "left_semi").withColumnRenamed("position", "p"), F.col("p")).filter(F.col("position") <= k).select("id", "position")


def connectors(edges: DataFrame, a: DataFrame, b: DataFrame, most: int = 5) -> DataFrame:
    """id and score of what both seed sets (id) reach: the product of their personalized ranks."""
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    seeds = a.select(F.lit("a").alias("query"), "id").union(b.select(F.lit("b"), "id")).join(nodes, "id", "left_semi").select("query", "id", F.lit(1.0).alias("weight"))
    ranks = stored(N.ranked_many(edges, stored(seeds, "seeds")), "ranks")
    side = lambda q, c: ranks.filter(F.col("query") == q).select("id", F.col("r").alias(c))
    both = side("a", "ra").join(side("b", "rb"), "id")
    return both.select("id", (F.col("ra") * F.col("rb")).alias("score")).orderBy(F.desc("score"), "id").limit(most)


def typed_between(typed: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Typed relations from one seed set to the other, in either direction."""
    a, b = a.select("id").distinct(), b.select("id").distinct()
    one = lambda s, t: typed.join(F.broadcast(s.withColumnRenamed("id", "src")), "src", "left_semi").join(F.broadcast(t.withColumnRenamed("id", "dst")), "dst", "left_semi").select(*typed.columns)
    return one(a, b).union(one(b, a)).distinct()


def relations(typed: DataFrame, vector: list[float], k: int = 5, floor: float = 0.4) -> DataFrame:
    """rel_type, because and sim of the relations whose reasons are nearest to the query."""
    named = typed.filter("embedding IS NOT NULL").withColumn("rid", F.struct("rel_type", "because", "src", "dst"))
    near = R.nearest(named, vector, k, floor=floor, key="rid", vec="embedding")
    return near.select("rid.rel_type", "rid.because", F.round("sim", 3).alias("sim"))


# planned recall

def rrf_candidates(memories: DataFrame, index_rows: DataFrame, vectors: DataFrame, edges: DataFrame, allowed: DataFrame, query: str, vector: list[float] | Callable[[], list[float] | None] | None, depth: str, index: Index = None, channels: Channels | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates that may be read, with their rank in each channel and fused; and the denied ones with their raw ranks.

    Access is decided on the ids that the lexical and vector channels bring up, before any content is taken, and at each
    hop of the graph channel, which starts from the first twelve of both. The lexical and the vector channel run side by side
    (``vector`` may be a function that makes the query's vector within its channel); what a channel doesn't find within the limit
    of ``channels`` counts as nothing found, and ``channels.late`` names it.
    """
    channels = channels or Channels(memories.sparkSession)
    _, _, _, lex_cap, vec_cap, graph_cap = S.DEPTHS[depth]
    most = min(900, 4 * lex_cap)
    nothing = memories.select("id").limit(0).withColumn("position", F.lit(0))

    def literal() -> DataFrame:
        found = T.search_bounded(index_rows, X.query_terms(query), most, most, index)
        return stored(_position(found, F.desc(F.round("fused", 9)), F.desc(F.round("bm25", 9)), F.col("best_rank"), F.col("id")).select("id", "position"), "lexical")

    def similar() -> DataFrame:
        v = vector() if callable(vector) else vector
        if v is None or not vec_cap:
            return nothing.withColumn("sim", F.lit(0.0))
        found = R.nearest(vectors, v, min(384, 8 * vec_cap)).withColumnRenamed("memory_id", "id")
        return stored(_position(found, F.desc(F.round("sim", 9)), F.col("id")), "vector")

    got = channels.run({"lexical": literal, "vector": similar}, FIRST_SHARE)
    lex = nothing if got["lexical"] is None else got["lexical"]
    near = nothing.withColumn("sim", F.lit(0.0)) if got["vector"] is None else got["vector"]
    raw = lex.select("id").union(near.select("id")).distinct()
    ok = stored(raw.join(allowed, "id", "left_semi"), "allowed")
    denied = raw.join(ok, "id", "left_anti").join(lex.select("id", F.col("position").alias("lexical_rank")), "id", "left").join(near.select("id", F.col("position").alias("vector_rank")), "id", "left")
    again = lambda df, cap, c: _position(df.join(ok, "id", "left_semi").select("id", F.col("position").alias("p")), F.col("p")).filter(F.col("position") <= cap).select("id", F.col("position").alias(c))
    lexical, vectorial = stored(again(lex, lex_cap, "lexical_rank"), "lexical"), stored(again(near, vec_cap, "vector_rank"), "vector")
    seeds = entry_union(lexical.filter("lexical_rank <= 12").withColumnRenamed("lexical_rank", "position"), vectorial.filter("vector_rank <= 12").withColumnRenamed("vector_rank", "position"))
    graph = memories.select("id").limit(0).withColumn("graph_rank", F.lit(0))
    if graph_cap:
        walk = channels.run({"graph": lambda: stored(N.bounded_ranks(edges, stored(seeds, "seeds"), allowed, graph_cap).select("id", F.col("rank").alias("graph_rank")), "graph")}, GRAPH_SHARE)["graph"]
        graph = graph if walk is None else walk
    found = lexical.join(vectorial, "id", "full").join(graph, "id", "full").join(near.select("id", "sim"), "id", "left")
    ranks = [F.col(f"{c}_rank") for c in ("lexical", "vector", "graph")]
    score = sum((F.coalesce(S.rrf(r), F.lit(0.0)) for r in ranks), F.lit(0.0))
    via = F.concat_ws("+", *[F.when(r.isNotNull(), c) for c, r in zip(("lexical", "vector", "graph"), ranks, strict=True)])
    return found.withColumn("rrf_score", score).withColumn("sim", F.coalesce("sim", F.lit(0.0))).withColumn("via", via).join(M.live(memories), "id"), denied


AUDIT = ["id", "lexical_rank", "vector_rank", "graph_rank", "rrf_score", "permission_result", "filter_reason", "final_rank"]


def planned(candidates: DataFrame, denied: DataFrame, cognitive: DataFrame, facets: DataFrame, conflicts: DataFrame, evidence: DataFrame, dream: DataFrame, items: int, chars: int, tokens: int, depth: str = "Q2", domains: list[str] = (), entities: list[str] = (), forms: list[str] = (), project: str = "", books: bool = False, hypotheses: bool = False) -> tuple[DataFrame, DataFrame]:
    """The chosen items in order, with their packs of evidence and citations; and the audit of all candidates."""
    candidates = candidates.drop(*[c for c in cognitive.columns if c in candidates.columns])  # a memory's source is its sidecar's here
    scored = G.planned(candidates.join(cognitive.withColumnRenamed("memory_id", "id"), "id", "left"), facets, conflicts, dream, list(domains), list(entities), list(forms), project, depth, books, hypotheses)
    cover = facets.filter(F.col("facet_type").isin("domain", "entity")).groupBy(F.col("memory_id").alias("id")).agg(F.sort_array(F.collect_list(F.concat_ws(":", "facet_type", "facet_value"))).alias("cover"))
    root = F.coalesce(F.when(F.col("root_source_id") != "", F.col("root_source_id")), F.when(F.col("source_id") != "", F.col("source_id")), F.col("id"))
    cover_all = F.concat(F.coalesce("cover", F.array().cast("array<string>")), F.array(F.concat(F.lit("source:"), root), F.concat(F.lit("form:"), "memory_form")))
    ready = stored(scored.join(cover, "id", "left").withColumn("coverage", cover_all).withColumn("snippet", X.snippet(F.trim("content"), 360)), "planned")
    packed = stored(G.packed(ready.filter("filter_reason IS NULL").select(F.lit("q").alias("query"), "id", "score", "rrf_score", "sim", "snippet", "coverage"), items, chars, tokens).select("id", F.col("position").alias("final_rank"), F.col("snippet").alias("cut"), "tokens", "stop"), "packed")
    proof = evidence.groupBy(F.col("memory_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("locator", "evidence_type", "excerpt", "observed_at"))).alias("evidence"))
    held = conflicts.filter("status = 'open'").select(F.explode(F.array("left_memory_id", "right_memory_id")).alias("id"), "conflict_id").groupBy("id").agg(F.sort_array(F.collect_list("conflict_id")).alias("open_conflicts"))
    chosen = packed.filter("stop = ''").join(ready, "id").join(proof, "id", "left").join(held, "id", "left")
    locators = F.filter(F.transform(F.col("evidence"), lambda e: e["locator"]), lambda x: F.coalesce(x, F.lit("")) != "")
    chosen = chosen.select("id", "final_rank", F.col("cut").alias("snippet"), "tokens", "score", "rrf_score", X.title(F.trim("content"), 80).alias("title"), "kind", "via", "memory_form", "lifecycle_stage", "memory_tier", "verification_status", "review_status", "confidence",
        "why_recalled", "dream_boost", "source_id", "root_source_id", "evidence", "open_conflicts", F.coalesce(locators, F.array().cast("array<string>")).alias("locators")).orderBy("final_rank")
    stop = F.when(F.coalesce("stop", F.lit("")) != "", F.col("stop"))
    reason = F.coalesce("filter_reason", stop, F.when(F.col("conflicted"), "conflict_downgraded"), F.lit(""))
    kept = ready.join(packed, "id", "left").select("id", "lexical_rank", "vector_rank", "graph_rank", "rrf_score", F.lit("allowed").alias("permission_result"), reason.alias("filter_reason"), "final_rank")
    shut = denied.select("id", "lexical_rank", "vector_rank", F.lit(None).cast("int").alias("graph_rank"), F.lit(0.0).alias("rrf_score"), F.lit("denied").alias("permission_result"), F.lit("acl_denied").alias("filter_reason"), F.lit(None).cast("int").alias("final_rank"))
    return chosen, kept.unionByName(shut)
