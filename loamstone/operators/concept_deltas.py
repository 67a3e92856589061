"""The concept graph kept up by differences: what a batch of memories changes is added to logs, and reads sum the logs.

The logs are ``concept_reps`` (content hash and representative), ``concept_links`` (the concepts of representatives, with a
sign), ``concept_counts`` (mentions and documents that a batch adds to a concept), ``pair_deltas`` and ``concept_pair_deltas``
(weights that it adds to pairs of memories and of concepts). A concept pairs its memories only while it is telling: no hub,
and in no more than BUCKET_CAP memories. Whether it is depends on its own documents and on the number of all; so a batch
looks at every concept's two numbers, and makes the pairs of which one side at least begins or ceases to count: a member that comes
or goes, or all of a concept that begins or ceases to be telling. A telling concept has few members, so what is
written grows with the batch, not with the graph. A memory with the content of a representative and a smaller id takes its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.operators import graph as N
from loamstone.sources.shared import stored

LINK = ["memory_id", "concept_id", "name", "kind", "position", "weight"]
LOGS = {
    "concept_reps": "h string, id string", "concept_links": "memory_id string, concept_id string, name string, kind string, position int, weight double, sign int", "concept_counts": "concept_id string, mentions long, docs long",
    "pair_deltas": "a string, b string, weight double", "concept_pair_deltas": "a string, b string, weight double",
}
Logs = dict[str, DataFrame]


def links(logs: Logs) -> DataFrame:
    """The links of the representatives of now."""
    return logs["concept_links"].groupBy(*LINK).agg(F.sum("sign").alias("n")).filter("n > 0").drop("n")


def total(logs: Logs) -> int:
    return logs["concept_reps"].select("h").distinct().count()


def _is_telling(docs: Column, n: int) -> Column:
    hub = ((docs > n * N.HUB_RATIO) & (docs >= N.HUB_FLOOR)) | (docs > N.HUB_MOST)
    return (docs > 0) & ~hub & (docs <= N.BUCKET_CAP)


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("a", "b").agg(F.sum("weight").alias("weight")).filter("weight <> 0")


def _memberships(log: DataFrame, change: DataFrame) -> DataFrame:
    """memory_id, concept_id, m0, m1: whether the memory has the concept before and after ``change``; one exchange for both sums."""
    rows = log.withColumn("s0", F.col("sign")).unionByName(change.withColumn("s0", F.lit(0))).repartition("memory_id", "concept_id")
    each = rows.groupBy(*LINK).agg((F.sum("s0") > 0).alias("m0"), (F.sum("sign") > 0).alias("m1"))
    return each.groupBy("memory_id", "concept_id").agg(F.max("m0").alias("m0"), F.max("m1").alias("m1")).filter("m0 OR m1")


def _moved_pairs(told: DataFrame, of: str, by: str) -> DataFrame:
    """What changes in the weights of pairs of ``of`` that share a ``by``; b0 and b1 tell which rows count before and after.

    Only pairs of which one side at least begins or ceases to count are made.
    """
    side = lambda n, rows: rows.select(by, F.col(of).alias(n), F.col("b0").alias(f"{n}0"), F.col("b1").alias(f"{n}1"))
    both = side("x", told.filter("b0 <> b1")).join(side("y", told), by).filter("x < y OR x > y AND y0 = y1")
    weight = (F.col("x1") & F.col("y1")).cast("double") - (F.col("x0") & F.col("y0")).cast("double")
    return _summed(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), weight.alias("weight")).filter("weight <> 0"))


def advance(logs: Logs, new: DataFrame, cost: dict[str, float] | None = None, wanted: tuple[str, ...] = tuple(LOGS)) -> Logs:
    """What ``new`` memories (id, kind, content, invalid_at), none of which was there before, add to each log.

    The logs of pairs, on which no later batch depends, are made if they are among the ``wanted``.
    """
    fresh = new.filter("invalid_at IS NULL AND kind <> 'moc'").withColumn("h", F.md5(F.trim("content").cast("binary"))).groupBy("h").agg(F.min("id").alias("id"), F.any_value("content").alias("content"))
    old = logs["concept_reps"].join(fresh.select("h"), "h", "left_semi").groupBy("h").agg(F.min("id").alias("old"))
    turned = stored(fresh.join(old, "h", "left").filter("old IS NULL OR id < old"), "turned")
    plus = N.concept_links(turned.select("id", "content"), cost).select(*LINK, F.lit(1).alias("sign"))
    replaced = turned.filter("old IS NOT NULL").select(F.col("old").alias("memory_id"))
    minus = links({"concept_links": logs["concept_links"].join(replaced, "memory_id", "left_semi")}).select(*LINK, F.lit(-1).alias("sign"))
    change = stored(plus.unionByName(minus), "links")
    docs = change.select("memory_id", "concept_id", "sign").distinct().groupBy("concept_id").agg(F.sum("sign").alias("docs"))
    counts = stored(change.groupBy("concept_id").agg(F.sum("sign").alias("mentions")).join(docs, "concept_id"), "counts")
    out = {"concept_reps": turned.select("h", "id"), "concept_links": change, "concept_counts": counts.select("concept_id", "mentions", "docs")}
    if not {"pair_deltas", "concept_pair_deltas"} & set(wanted):
        return out
    before, added = total(logs), turned.filter("old IS NULL").count()
    known = logs["concept_counts"].groupBy("concept_id").agg(F.sum("docs").alias("d0"))
    status = known.join(counts.select("concept_id", F.col("docs").alias("d")), "concept_id", "full").select("concept_id", F.coalesce("d0", F.lit(0)).alias("d0"), F.coalesce("d", F.lit(0)).alias("d"))
    status = status.select("concept_id", _is_telling(F.col("d0"), before).alias("t0"), _is_telling(F.col("d0") + F.col("d"), before + added).alias("t1")).filter("t0 OR t1")
    told = _memberships(logs["concept_links"], change).join(status, "concept_id")
    told = stored(told.select("memory_id", "concept_id", (F.col("m0") & F.col("t0")).alias("b0"), (F.col("m1") & F.col("t1")).alias("b1")).filter("b0 OR b1"), "told")
    if "pair_deltas" in wanted:
        out["pair_deltas"] = stored(_moved_pairs(told, "memory_id", "concept_id"), "pairs")
    if "concept_pair_deltas" in wanted:
        out["concept_pair_deltas"] = stored(_moved_pairs(told, "concept_id", "memory_id"), "pairs")
    return out


def begun(rows: DataFrame, cost: dict[str, float] | None = None, wanted: tuple[str, ...] = tuple(LOGS)) -> Logs:
    """The logs of all ``rows`` at once, as a reindex leaves them."""
    empty = {n: rows.sparkSession.createDataFrame([], s) for n, s in LOGS.items()}
    return advance(empty, rows, cost, wanted)


def added(logs: Logs, more: Logs) -> Logs:
    return {n: logs[n].unionByName(more[n].select(*logs[n].columns)) for n in LOGS if n in logs}


def concepts(logs: Logs) -> DataFrame:
    """concept_id, name, kind, mention_count, doc_freq, is_hub, as ``graph.concepts`` tells them."""
    counts = logs["concept_counts"].groupBy("concept_id").agg(F.sum("mentions").alias("mention_count"), F.sum("docs").alias("doc_freq")).filter("doc_freq > 0")
    first = F.struct("memory_id", "position")
    named = links(logs).groupBy("concept_id").agg(F.min_by("name", first).alias("name"), F.min_by("kind", first).alias("kind"))
    n = total(logs)
    hub = ((F.col("doc_freq") > n * N.HUB_RATIO) & (F.col("doc_freq") >= N.HUB_FLOOR)) | (F.col("doc_freq") > N.HUB_MOST)
    return named.join(counts, "concept_id").select("concept_id", "name", "kind", "mention_count", "doc_freq", hub.alias("is_hub"))


def memory_pairs(logs: Logs) -> DataFrame:
    """a < b and the number of telling concepts that both memories have."""
    return _summed(logs["pair_deltas"])


def concept_pairs(logs: Logs) -> DataFrame:
    """a < b and the number of memories that have both concepts."""
    return _summed(logs["concept_pair_deltas"])
