"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Which documents contain ``threshold`` of a benchmark item's k-word shingles? Shingles of a document that no item has can't
matter to containment, so a document is first reduced to the shingles that the benchmark has (a fixed-size bit table over
their hashes, then an exact join). The reduced documents are the domains of the search: they are partitioned by size into
powers of two. Containment c of an item of q shingles in a domain of at most u means Jaccard similarity of
``c q / (u + q - c q)`` or more, from which each (item size class, partition) gets the largest number of rows a band for which
the chance to miss stays under MISS. Where not even single-row bands reach that, an item's rarest shingles make the
candidates: of q shingles of which c must be common, one of any q - c + 1 is, so nothing is lost and a shingle that many
documents have is hardly ever used. Candidates are verified by exact containment.

Words are runs outside ASCII white space and ASCII punctuation, lower case for A-Z. Defined results: null, empty and blank
texts contain nothing, such items are in nothing; an item of fewer than k words is one shingle, its whole sequence, and is
sought in documents as that sequence; rows with the same doc_id (item_id) count as one document (item), rows without an id
are in no pair; empty tables give no pairs; other columns are left out of ``contained`` and kept by ``without_contained``,
which judges each row by itself where ids are null or repeated, and takes items without an id too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstone.llm.common import arrow_map, materialize, skew_join
from loamstone.llm.counters import maybe_member_of, summed_counters, without_members
from loamstone.llm.kernel import LOWER, chained, chunks, distinct, hash_spans, list_array, mixed, text_buffer, to_long, word_spans

HASHES = 128
ROWS = (1, 2, 4)
MISS = 1e-6
BITS = 23

#: Bytes to compare words by: A-Z to lower case, ASCII punctuation to a space.
_FOLD = LOWER.copy()
_FOLD[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32
_SEEDS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _hashed(b: pa.RecordBatch, text: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, buf, offs in chunks(*text_buffer(b.column(text))):
        buf = _FOLD[buf]
        starts, ends, first = word_spans(buf, offs)
        yield lo, hi, hash_spans(buf, starts, ends), first


def item_shingles(items: DataFrame, k: int) -> DataFrame:
    """item_id, width, shingle: the distinct shingles of each item; width is k, or the item's number of words if smaller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, first in _hashed(b):
                n = np.minimum(k, first[1:] - first[:-1])
                sets = [distinct(chained(h[a:c], int(w))) if w else np.zeros(0, np.uint64) for a, c, w in zip(first[:-1], first[1:], n, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("item_id").slice(lo, hi - lo), pa.array(n, pa.int32()), list_array(sets)], names=["item_id", "width", "set"])

    sets = items.select("item_id", "text").transform(arrow_map, run, "item_id long, width int, set array<long>")
    return sets.select("item_id", "width", F.explode("set").alias("h")).distinct()


def reduced_documents(docs: DataFrame, shingles: DataFrame, k: int) -> DataFrame:
    """doc_id, h: the distinct shingles of each document that some item has."""
    widths = sorted(r.width for r in shingles.select("width").distinct().collect())  # k numbers at most
    slots = lambda x: (mixed(x) >> np.uint64(64 - BITS)).astype(np.int64)

    def count(b: pa.RecordBatch, total: np.ndarray) -> None:
        total[slots(np.asarray(b.column("h")).view(np.uint64))] = 1

    table = summed_counters(shingles.select("h"), count, 1 << BITS, lambda c: np.packbits(c > 0, bitorder="little"), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for lo, _, h, first in _hashed(b):
                docs_of, found = [], []
                for w in widths:
                    if len(h) < w:
                        continue
                    s = chained(h, w)
                    at = np.flatnonzero(maybe_member_of(shared.value, slots(s)))
                    doc = np.searchsorted(first, at, side="right") - 1
                    inside = at + w <= first[doc + 1]
                    docs_of.append(doc[inside])
                    found.append(s[at[inside]])
                if docs_of and sum(map(len, docs_of)):
                    pairs = np.unique(np.stack([np.concatenate(docs_of).astype(np.uint64), np.concatenate(found)]), axis=1)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(lo + pairs[0].astype(np.int64))), pa.array(to_long(pairs[1]))], names=["doc_id", "h"])

    maybe = docs.select("doc_id", "text").transform(arrow_map, run, "doc_id long, h long")
    return skew_join(maybe, shingles.select("h").distinct().withColumn("known", F.lit(True)), ["h"]).select("doc_id", "h").distinct()


def _minhash(sets: DataFrame, key: str) -> DataFrame:
    """key, set, n and ``sig`` (HASHES minima)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off = np.asarray(b.column("set").offsets).astype(np.int64)
            flat = np.asarray(b.column("set").values).view(np.uint64)[off[0] : off[-1]]
            at = off[:-1] - off[0]
            sig = np.empty((len(at), HASHES), dtype=np.uint64)
            for i, seed in enumerate(_SEEDS):
                sig[:, i] = np.minimum.reduceat(mixed(flat ^ seed), at) if len(at) else 0
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("set"), b.column("n"), list_array(list(sig))], names=[key, "set", "n", "sig"])

    grouped = sets.groupBy(key).agg(F.collect_list("h").alias("set")).withColumn("n", F.size("set").cast("long"))
    return grouped.transform(arrow_map, run, f"{key} long, set array<long>, n long, sig array<long>")


def band_rows(q: int, u: int, threshold: tuple[int, int]) -> int:
    """Rows a band for items of q or more shingles in domains of at most u; 0 where banding would miss too many."""
    c = max(1, math.ceil(q * threshold[0] / threshold[1]))
    s = min(1.0, c / max(u + q - c, 1))
    fit = [r for r in ROWS if (1 - s**r) ** (HASHES // r) <= MISS]
    return max(fit, default=0)


def contained(docs: DataFrame, items: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """Pairs doc_id, item_id, n_item (the item's shingles), n_common, where n_common / n_item is ``threshold`` or more."""
    docs, items = docs.filter("doc_id IS NOT NULL"), items.filter("item_id IS NOT NULL")
    shingles = materialize(item_shingles(items, k), "decon-items")
    small = materialize(reduced_documents(docs, shingles, k), "decon-docs")
    domains = materialize(_minhash(small, "doc_id"), "decon-domains")
    queries = materialize(_minhash(shingles.select("item_id", "h").distinct(), "item_id"), "decon-queries")
    part = lambda n: F.floor(F.log2(n)).cast("int")
    sizes = [r.p for r in domains.select(part("n").alias("p")).distinct().collect()]  # one a power of two: 64 at most
    classes = [r.p for r in queries.select(part("n").alias("p")).distinct().collect()]
    plan = [(p, c, band_rows(1 << c, (2 << p) - 1, threshold)) for p in sizes for c in classes]
    rows = docs.sparkSession.createDataFrame(plan, "p int, c int, r int")
    bands = lambda sig, r: F.transform(F.sequence(F.lit(0), F.floor(F.lit(HASHES) / r).cast("int") - 1), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice(sig, (i * r + 1).cast("int"), r)).alias("value")))
    used = F.broadcast(rows.filter("r > 0").select("p", "r").distinct())
    left = domains.withColumn("p", part("n")).join(used, "p").select("doc_id", "p", "r", F.explode(bands(F.col("sig"), F.col("r"))).alias("b")).select("doc_id", "p", "r", "b.band", "b.value")
    right = queries.withColumn("c", part("n")).join(F.broadcast(rows.filter("r > 0")), "c").select("item_id", "p", "r", F.explode(bands(F.col("sig"), F.col("r"))).alias("b")).select("item_id", "p", "r", "b.band", "b.value")
    pairs = left.join(right, ["p", "r", "band", "value"]).select("doc_id", "item_id")
    plain = rows.filter("r = 0").select("p", "c")
    if not plain.isEmpty():
        d = domains.withColumn("p", part("n")).join(F.broadcast(plain.select("p").distinct()), "p").select("doc_id", "p", F.explode("set").alias("h"))
        i = queries.withColumn("c", part("n")).join(F.broadcast(plain), "c").select("item_id", "n", "p", F.explode("set").alias("h"))
        often = small.groupBy("h").agg(F.count("*").alias("df"))
        rare = F.row_number().over(Window.partitionBy("item_id", "p").orderBy("df", "h"))
        i = skew_join(i, often, ["h"], "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("at", rare)
        i = i.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold[0] / threshold[1]) + 1).select("item_id", "p", "h")
        pairs = pairs.unionByName(d.join(i, ["p", "h"]).select("doc_id", "item_id"))
    pairs = pairs.distinct()
    with_doc = skew_join(pairs, domains.select("doc_id", F.col("set").alias("doc_set")), ["doc_id"])
    both = skew_join(with_doc, queries.select("item_id", F.col("set").alias("item_set"), F.col("n").alias("n_item")), ["item_id"])
    out = both.select("doc_id", "item_id", "n_item", F.size(F.array_intersect("doc_set", "item_set")).cast("long").alias("n_common"))
    return out.filter(F.col("n_common") * threshold[1] >= F.col("n_item") * threshold[0])


def without_contained(docs: DataFrame, items: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """``docs`` without the documents that contain an item."""
    named = materialize(items.select(F.monotonically_increasing_id().alias("item_id"), "text"), "decon-named")
    if docs.select("doc_id").groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        rows, key = docs, "doc_id"
    else:
        rows, key = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "decon-rows"), "__row"
    found = materialize(contained(rows.select(F.col(key).alias("doc_id"), "text"), named, k, threshold).select(F.col("doc_id").alias(key)).distinct(), "decon-found")
    return without_members(rows, found, key).select(*docs.columns)
