"""Vector search, rank fusion and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstone.functions import scoring as S

#: Candidates above which a caller should ask for an index instead of the exact scan.
INDEX_THRESHOLD = 100_000


def nearest(vectors: DataFrame, query: list[float], k: int = 20, candidates: DataFrame | None = None, floor: float | None = None, key: str = "memory_id", vec: str = "vec") -> DataFrame:
    """The k rows whose vectors have the largest cosine with ``query``; rows of another dimension don't count."""
    df = vectors.filter(F.size(vec) == len(query))
    if candidates is not None:
        df = df.join(candidates.select(key), key, "left_semi")
    norm = sum(x * x for x in query) ** 0.5 or 1.0
    q = F.array(*[F.lit(float(x / norm)) for x in query])
    df = df.select(key, S.dot(F.col(vec), q).alias("sim"))
    if floor is not None:
        df = df.filter(F.col("sim") >= floor)
    return df.orderBy(F.desc("sim"), key).limit(k)


def bridge(vectors: DataFrame, a: list[float], b: list[float], k: int = 5, floor: float = 0.35, key: str = "memory_id", vec: str = "vec") -> DataFrame:
    """The k rows that are nearest to both queries: by the smaller cosine, down to ``floor``."""
    lit = lambda q: F.array(*[F.lit(float(x)) for x in q])
    both = vectors.select(key, F.least(S.dot(F.col(vec), lit(a)), S.dot(F.col(vec), lit(b))).alias("sim"))
    return both.filter(F.col("sim") >= floor).orderBy(F.desc("sim"), key).limit(k)


def channel(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """id, channel, rank (from 1) of a bounded candidate list."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("id", F.lit(name).alias("channel"), "rank")


def fused(*channels: DataFrame) -> DataFrame:
    """id, rrf_score and the rank in each channel, of candidates in any channel."""
    rows = channels[0]
    for c in channels[1:]:
        rows = rows.unionByName(c)
    return rows.groupBy("id").agg(F.sum(S.rrf(F.col("rank"))).alias("rrf_score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "rank")))).alias("channel_ranks"))


def missing(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """Live memories without a vector."""
    return memories.filter("invalid_at IS NULL").join(vectors, F.col("id") == F.col("memory_id"), "left_anti")


def quality(results: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """query, recall, mrr and ndcg of ranked ``results`` (query, id, rank) against ``relevant`` (query, id, grade)."""
    hit = results.filter(F.col("rank") <= k).join(relevant, ["query", "id"]).groupBy("query").agg(
        F.count("*").alias("hits"), F.max(1.0 / F.col("rank")).alias("rr"), F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = relevant.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "id")))
    ideal = best.groupBy("query").agg(F.count("*").alias("n"), F.sum(F.when(F.col("rn") <= k, F.col("grade") / F.log2(F.col("rn") + 1)).otherwise(0.0)).alias("idcg"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(hit, "query", "left").select("query", z(F.col("hits") / F.least(F.col("n"), F.lit(k))).alias("recall"), z(F.col("rr")).alias("mrr"), z(F.col("dcg") / F.col("idcg")).alias("ndcg"))
