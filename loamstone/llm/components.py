"""Connected components of an edge table by large-star and small-star rounds.

Every round is joins and minimum aggregates on vertex ids: no neighbour list is collected, and a vertex with a third of all
edges is pre-aggregated before each shuffle. Rounds end when the edges are stars; edges never grow in number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import discard, materialize, skew_join

MAX_ROUNDS = 100


def _with_min(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with ``m``, the value of ``least`` for u."""
    return skew_join(edges.select("u", "v"), least.withColumnRenamed("c", "u"), ["u"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each vertex's larger neighbours with the smallest vertex around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.col("c")).alias("m"))
    return _with_min(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each vertex and its smaller neighbours with the smallest of them. ``edges`` have u > v."""
    least = edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    full = _with_min(edges, least)
    out = full.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, component_id`` (the smallest id reachable) of every vertex in ``links`` (a, b)."""
    a, b = (F.col(c).cast("long") for c in ("a", "b"))
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        nxt = materialize(_small_star(_large_star(edges)), "edges")
        counts = nxt.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        old = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        discard(edges)
        edges = nxt
        if counts == old:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
