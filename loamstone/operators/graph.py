"""Concept and memory graphs: indexing, co-occurrence, ranking, spreading and paths."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstone.functions import scoring as S
from loamstone.functions import text as X
from loamstone.operators.segment import segmented
from loamstone.sources.shared import stored

HUB_RATIO, HUB_FLOOR, HUB_MOST = 0.05, 8, 200
BUCKET_CAP, MIN_SHARED, NEIGHBOURS = 60, 2, 8
ALPHA, ROUNDS, LEAST = 0.15, 30, 1e-6
#: Queries ranked in one pass, and ranks that are dropped on the way: a million times a million of them make less than LEAST.
BLOCK, PRUNED = 16, 1e-18


def representatives(memories: DataFrame) -> DataFrame:
    """One live memory of each trimmed content (the smallest id), maps of content left out."""
    rows = memories.filter("invalid_at IS NULL AND kind <> 'moc'").withColumn("h", F.md5(F.trim("content").cast("binary")))
    return rows.groupBy("h").agg(F.min("id").alias("id"), F.any_value("content").alias("content")).select("id", "content")


def concept_links(reps: DataFrame, cost: dict[str, float] | None = None) -> DataFrame:
    """memory_id, position, name, concept_id, kind and weight of each concept of each representative.

    With ``cost`` (see ``segment.costs``) Han text is cut into its likeliest words.
    """
    words = None if cost is None else F.col("words")
    reps = reps if cost is None else segmented(reps.select("id", "content"), cost)
    df = reps.select(F.col("id").alias("memory_id"), X.wikilinks(F.coalesce("content", F.lit(""))).alias("links"), F.posexplode(X.entities(F.col("content"), words=words)).alias("position", "name"))
    linked = F.array_contains("links", F.col("name"))
    return df.select("memory_id", "position", "name", S.concept_id(F.col("name")).alias("concept_id"), F.when(linked, "wikilink").otherwise("entity").alias("kind"), F.when(linked, 2.0).otherwise(1.0).alias("weight"))


def stored_links(reps: DataFrame, cost: dict[str, float] | None = None) -> DataFrame:
    """``concept_links`` written once: concepts, members and both kinds of edges are made from them."""
    return stored(concept_links(reps, cost), "links")


def concepts(links: DataFrame, total: int) -> DataFrame:
    """concept_id, name, kind, mention_count, doc_freq and is_hub; ``total`` is the number of representatives.

    Names that differ in case are one concept; its name and kind are those of the first place by memory and position.
    """
    first = F.struct("memory_id", "position")
    df = links.groupBy("concept_id").agg(F.min_by("name", first).alias("name"), F.min_by("kind", first).alias("kind"), F.count("*").alias("mention_count"), F.countDistinct("memory_id").alias("doc_freq"))
    hub = ((F.col("doc_freq") > total * HUB_RATIO) & (F.col("doc_freq") >= HUB_FLOOR)) | (F.col("doc_freq") > HUB_MOST)
    return df.withColumn("is_hub", hub)


def telling(links: DataFrame, found: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """memory_id, concept_id of concepts that are no hubs and have ``cap`` memories at most."""
    fit = found.filter(~F.col("is_hub") & (F.col("doc_freq") <= cap)).select("concept_id")
    return links.select("memory_id", "concept_id").distinct().join(fit, "concept_id", "left_semi")


def pair_weights(told: DataFrame, of: str = "memory_id", by: str = "concept_id") -> DataFrame:
    """a < b and the number of shared ``by``; buckets are bounded by ``telling``."""
    a, b = told.select(by, F.col(of).alias("a")), told.select(by, F.col(of).alias("b"))
    return a.join(b, by).filter("a < b").groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))


def cooccurrence_edges(pairs: DataFrame, least: int = MIN_SHARED, most: int = NEIGHBOURS) -> DataFrame:
    """Both directions of each memory's ``most`` strongest neighbours with ``least`` shared concepts."""
    both = pairs.filter(F.col("weight") >= least)
    both = both.select(F.col("a").alias("m"), F.col("b").alias("nb"), "weight").union(both.select("b", "a", "weight"))
    top = both.withColumn("rn", F.row_number().over(Window.partitionBy("m").orderBy(F.desc("weight"), "nb"))).filter(F.col("rn") <= most)
    return top.select(F.col("m").alias("src"), F.col("nb").alias("dst"), "weight").union(top.select("nb", "m", "weight")).distinct()


def density(edges: DataFrame) -> DataFrame:
    """id and connection_density = ln(1 + ends) / 5."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    return ends.groupBy("id").agg((F.log1p(F.count("*")) / 5.0).alias("connection_density"))


def top_neighbours(edges: DataFrame, most: int, key: str = "src", value: str = "dst") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("weight"), value)
    return edges.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def _shares(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """src, dst and p, an edge's share of its source's weight: of all edges, and of those whose target is a source.

    Mass that reaches a target without edges goes no further, so only the last round needs the edges to such targets.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = stored(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")), "share")
    sources = share.select(F.col("src").alias("dst")).distinct()
    return share, stored(share.join(sources, "dst", "left_semi").select("src", "dst", "p"), "inner-share")


def ranked(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, alpha: float = ALPHA) -> DataFrame:
    """Personalized rank from ``seeds`` (id, weight): mass spreads by edge weight, what reaches a dead end is lost.

    The edges carry their share of their source and stay partitioned by it, in memory or on disk, so a round only moves the
    ranks: a join where both sides lie already, and a sum by target. All rounds but the last move them between sources alone.
    Every fifth round's ranks are written to the shared folder; a lost executor's edges are read again from there.
    """
    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share, inner = _shares(edges)
    held = inner.repartition(n, "src").persist(StorageLevel.MEMORY_AND_DISK)
    total = seeds.agg(F.sum("weight").alias("t"))
    start = stored(seeds.crossJoin(F.broadcast(total)).groupBy("id").agg((F.sum("weight") / F.max("t")).alias("s")), "seeds")  # one row
    rank = start.select("id", F.col("s").alias("r"))
    back = start.select("id", (F.col("s") * alpha).alias("r"))
    for i in range(rounds):
        last = i + 1 == rounds
        over = share if last else held
        moved = over.join(rank, over.src == rank.id).select(F.col("dst").alias("id"), (F.col("p") * F.col("r") * (1 - alpha)).alias("r"))
        rank = moved.unionByName(back).groupBy("id").agg(F.sum("r").alias("r"))
        if i % 5 == 4 or last or i + 2 == rounds:
            rank = stored(rank, "rank")
    held.unpersist()
    return rank.filter(F.col("r") > LEAST)


def ranked_many(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, alpha: float = ALPHA, block: int = BLOCK) -> DataFrame:
    """query, id and r: as ``ranked``, for each query's seeds (query, id, weight).

    A block of queries is ranked in one pass over the edges a round: a node's row has a column for each of them, so a round's
    join, sum and exchange serve all. A row whose ranks are all below PRUNED goes: it could lift no other rank to what counts.
    """
    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [r[0] for r in seeds.select("query").distinct().orderBy("query").collect()]  # the callers' queries
    share, inner = _shares(edges)
    held = inner.repartition(n, "src").persist(StorageLevel.MEMORY_AND_DISK)
    parts = [_ranked_block(share, held, seeds, names[lo : lo + block], rounds, alpha) for lo in range(0, len(names), block)]
    held.unpersist()
    if not parts:
        return seeds.select("query", "id", F.lit(0.0).alias("r")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def _ranked_block(share: DataFrame, held: DataFrame, seeds: DataFrame, names: list, rounds: int, alpha: float) -> DataFrame:
    columns = [f"r{i}" for i in range(len(names))]
    sums = seeds.groupBy("query").agg(F.sum("weight").alias("total"))
    begun = seeds.filter(F.col("query").isin(names)).join(F.broadcast(sums), "query")  # one row a query
    start = begun.groupBy("id").agg(*[F.sum(F.when(F.col("query") == q, F.col("weight") / F.col("total")).otherwise(0.0)).alias(c) for q, c in zip(names, columns, strict=True)])
    rank = start = stored(start, "seeds")
    back = start.select("id", *[(F.col(c) * alpha).alias(c) for c in columns])
    for i in range(rounds):
        last = i + 1 == rounds
        over = share if last else held
        moved = over.join(rank, over.src == rank.id).select(F.col("dst").alias("id"), *[(F.col("p") * F.col(c) * (1 - alpha)).alias(c) for c in columns])
        rank = moved.unionByName(back).groupBy("id").agg(*[F.sum(c).alias(c) for c in columns])
        rank = rank.filter(reduce(lambda a, b: a | b, [F.col(c) > PRUNED for c in columns]))
        if i % 5 == 4 or last or i + 2 == rounds:
            rank = stored(rank, "rank")
    told = rank.select("id", F.explode(F.array(*[F.struct(F.lit(q).alias("query"), F.col(c).alias("r")) for q, c in zip(names, columns, strict=True)])).alias("x"))
    return told.select("x.query", "id", "x.r").filter(F.col("r") > LEAST)


def spread(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.7) -> DataFrame:
    """id and bonus: 1 for seeds; at hop h the edge weight times decay ** h, not multiplied along the path; the largest counts."""
    found = [seeds.select("id", F.lit(1.0).alias("bonus"))]
    front = seeds.select("id").distinct()
    for h in range(1, hops + 1):
        step = edges.join(front, edges.src == front.id).groupBy("dst").agg(F.max(F.when(F.col("weight") == 0, 1.0).otherwise(F.col("weight")) * decay**h).alias("bonus"))
        found.append(step.select(F.col("dst").alias("id"), "bonus"))
        front = step.select(F.col("dst").alias("id"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.groupBy("id").agg(F.max("bonus").alias("bonus"))


def shortest(edges: DataFrame, a: DataFrame, b: DataFrame, hops: int = 4) -> DataFrame:
    """hops, path and connector (its middle) of the first shortest path from a set of ids to another; no row if there is none."""
    front = a.select("id", F.array("id").alias("path"))
    seen = front.select("id")
    for n in range(hops + 1):
        hit = front.join(b.select("id").distinct(), "id", "left_semi").select(F.lit(n).alias("hops"), "path").orderBy("path").limit(1)
        if n == hops or not hit.isEmpty():
            return hit.withColumn("connector", F.get("path", (F.size("path") / 2).cast("int")))
        step = edges.join(front, edges.src == front.id).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        front = stored(step.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti"), "front")
        seen = seen.union(front.select("id"))
    raise AssertionError


def bounded_ranks(edges: DataFrame, seeds: DataFrame, allowed: DataFrame, cap: int, hops: int = 2, most_seeds: int = 16) -> DataFrame:
    """id, weight, rank of memories within ``hops`` of the seeds: the strongest edges first, allowed ids only, ``cap`` at most."""
    front = seeds.orderBy("position").limit(most_seeds).select("id")
    seen, found = front, None
    for _ in range(hops):
        rows = edges.join(F.broadcast(front), edges.src == front.id).select("dst", "weight").orderBy(F.desc("weight"), "dst").limit(4 * cap)
        new = rows.groupBy(F.col("dst").alias("id")).agg(F.max("weight").alias("weight")).join(seen, "id", "left_anti").join(allowed, "id", "left_semi")
        found = new if found is None else found.union(new)
        front = new.orderBy(F.desc("weight"), "id").limit(most_seeds).select("id")
        seen = seen.union(new.select("id"))
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weight"), "id"))).filter(F.col("rank") <= cap)


MAP_DEGREE, MAPS, NOTES = 6, 50, 800


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("concept_id")).agg(F.count("*").alias("degree"))


def _described(top: DataFrame, edges: DataFrame, members: DataFrame, memories: DataFrame, found: DataFrame, neighbours: int, each: int, size: int) -> DataFrame:
    """``top`` (concept_id, name, degree) with ``near``, names of the strongest neighbours, and ``lines``, first lines of the most important members."""
    names = found.select(F.col("concept_id").alias("dst"), F.col("name").alias("near_name"))
    near = top_neighbours(edges.join(F.broadcast(top.select(F.col("concept_id").alias("src"))), "src").select("src", "dst", "weight"), neighbours).join(names, "dst")
    near = near.groupBy(F.col("src").alias("concept_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "near_name"))), lambda x: x.near_name).alias("near"))
    w = Window.partitionBy("concept_id").orderBy(F.desc("importance"), "memory_id")
    line = F.substring(F.coalesce(F.get(F.split("content", "\n"), F.lit(0)), F.lit("")), 1, size)
    told = members.select("memory_id", "concept_id").distinct().join(F.broadcast(top.select("concept_id")), "concept_id").join(memories.select(F.col("id").alias("memory_id"), "importance", line.alias("line")), "memory_id")
    told = told.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= each).groupBy("concept_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: F.concat(F.lit("- "), x.line)).alias("lines"))
    none = F.array().cast("array<string>")
    return top.join(near, "concept_id", "left").join(told, "concept_id", "left").withColumns({"near": F.transform(F.coalesce("near", none), lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), "lines": F.coalesce("lines", none)})


def concept_maps(edges: DataFrame, members: DataFrame, memories: DataFrame, found: DataFrame, least: int = MAP_DEGREE, most: int = MAPS, neighbours: int = 12, each: int = 8) -> DataFrame:
    """concept_id, name, degree and content of the maps of the best connected concepts that are no hubs.

    ``edges`` go both ways, ``members`` are (memory_id, concept_id), ``found`` the concepts.
    """
    top = degrees(edges).filter(F.col("degree") >= least).join(found.filter("NOT is_hub").select("concept_id", "name"), "concept_id").orderBy(F.desc("degree"), "concept_id").limit(most)
    df = _described(top, edges, members, memories, found, neighbours, each, 70)
    text = F.array_join(F.concat(F.array(F.concat(F.lit("# 概念地图: "), "name"), F.lit(""), F.concat(F.lit("关联概念: "), F.array_join("near", " ")), F.lit(""), F.lit("## 相关记忆")), F.col("lines")), "\n")
    return df.select("concept_id", "name", "degree", text.alias("content"))


def concept_notes(edges: DataFrame, members: DataFrame, memories: DataFrame, found: DataFrame, most: int = NOTES) -> DataFrame:
    """name (of a file, each once) and content of notes on the best connected concepts that are no hubs."""
    top = found.filter("NOT is_hub").select("concept_id", "name", "doc_freq").join(degrees(edges), "concept_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("degree"), "concept_id").limit(most)
    df = _described(top, edges, members, memories, found, 15, 10, 80)
    head = [F.lit("---"), F.concat(F.lit("doc_freq: "), F.col("doc_freq").cast("string")), F.concat(F.lit("degree: "), F.col("degree").cast("string")), F.lit("type: concept"), F.lit("---"), F.lit("")]
    text = F.array_join(F.concat(F.array(*head, F.concat(F.lit("# "), "name"), F.lit(""), F.concat(F.lit("关联: "), F.array_join("near", " ")), F.lit(""), F.lit("## 相关记忆")), F.col("lines")), "\n")
    safe = X.safe_name(F.col("name"), 56)
    safe = F.when(safe == "", F.col("concept_id")).otherwise(safe)
    twin = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("degree"), "concept_id")) > 1
    return df.withColumn("file", safe).withColumn("twin", twin).select(F.when(F.col("twin"), F.concat("file", F.lit("_"), F.substring("concept_id", 1, 6))).otherwise(F.col("file")).alias("name"), text.alias("content"))


def themes(edges: DataFrame, found: DataFrame, scan: int = 12, most: int = 6, related: int = 5) -> DataFrame:
    """concept, degree and related names: of the ``scan`` best connected concepts the first ``most`` that are no hubs."""
    top = degrees(edges).orderBy(F.desc("degree"), "concept_id").limit(scan).join(found.filter("NOT is_hub").select("concept_id", "name"), "concept_id").orderBy(F.desc("degree"), "concept_id").limit(most)
    names = found.select(F.col("concept_id").alias("dst"), F.col("name").alias("near_name"))
    near = top_neighbours(edges.join(F.broadcast(top.select(F.col("concept_id").alias("src"))), "src").select("src", "dst", "weight"), related).join(names, "dst")
    near = near.groupBy(F.col("src").alias("concept_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "near_name"))), lambda x: x.near_name).alias("related"))
    return top.join(near, "concept_id", "left").select(F.col("name").alias("concept"), "degree", "related").orderBy(F.desc("degree"), "concept")
