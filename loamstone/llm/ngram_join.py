"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters, and one verification a pair.

A document is the set of its distinct k-word shingles (64-bit hashes). Documents with equal sets form a class; only classes
are joined. Steps:

1. A sketch of shingle frequencies: ``2**SKETCH_BITS`` counters over the shingles' hashes, summed over all documents. Its
   size is fixed, so it may be broadcast. (frequency of the counter on a log scale, hash) is the global order; any global
   order gives the same links, a rare-first one gives few candidates.
2. Each class emits its prefix in that order: the first ``n - ceil(t n) + 1`` shingles. Two sets of similarity t share one
   of them. Prefix entries are joined on the shingle; the length filter and the positional filter are part of the join.
3. The suffix filter compares 1024-bit parity signatures of the whole sets, whose differing bits can't outnumber the
   differing shingles. Each pair that is left is verified once, by exact intersection.
4. Classes linked in this way form components (large-star/small-star rounds over the links, in Spark).

Defined results: null, empty and blank texts have no shingle, are linked with nothing and are their own component; a
document with fewer than k words has its whole sequence as its one shingle; equal rows are equal documents; with repeated
ids each row is returned; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import arrow_map, materialize, scratch, skew_join
from loamstone.llm.components import components
from loamstone.llm.counters import maybe_member, member_bits, summed_counters, without_members
from loamstone.llm.kernel import LOWER, chunks, hash_spans, list_array, mixed, shingle_rows, text_buffer, to_long, word_spans
from loamstone.llm.shared_hashes import listed, shared_hashes, shared_of

SKETCH_BITS = 22
#: Bits of the parity signature, and of the folded one that prefix entries carry.
SIG_BITS, FOLDED_BITS = 1024, 256
#: Bytes of a shingle's hash when a set is sent to be compared.
SET_BYTES = 6


def ceil_share(n: np.ndarray, t: Fraction) -> np.ndarray:
    """ceil(t * n), exactly."""
    return -((-n * t.numerator) // t.denominator)


def document_shingles(b: pa.RecordBatch, k: int, text: str = "text") -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for lo, hi, buf, offs in chunks(*text_buffer(b.column(text))):
        buf = LOWER[buf]
        starts, ends, first = word_spans(buf, offs)
        yield lo, hi, shingle_rows(hash_spans(buf, starts, ends), first, k)


def frequency_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """One byte a counter: 8 * log2 of how many shingles of all documents fall on it (capped at 255, beyond 2**31)."""

    def count(b: pa.RecordBatch, total: np.ndarray) -> None:
        for _, _, rows in document_shingles(b, k):
            if rows:
                total += np.bincount((np.concatenate(rows) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)

    return summed_counters(docs.select("text"), count, 1 << SKETCH_BITS, lambda c: np.minimum(255, np.round(8 * np.log2(np.maximum(c, 1)))).astype(np.uint8))


def signatures(docs: DataFrame, k: int, t: Fraction, sketch: np.ndarray) -> DataFrame:
    """doc_id, n, the class key (k1, k2), the parity signature and the prefix of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    shift = np.uint64(64 - SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, rows in document_shingles(b, k):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *_signed(rows, t, shared.value, shift)], names=["doc_id", "n", "k1", "k2", "sig", "prefix"])

    return docs.select("doc_id", "text").transform(arrow_map, run, "doc_id long, n long, k1 long, k2 long, sig array<long>, prefix array<long>")


def _signed(rows: list[np.ndarray], t: Fraction, sketch: np.ndarray, shift: np.uint64) -> list[pa.Array]:
    n = np.array([len(r) for r in rows], dtype=np.int64)
    off = np.concatenate([[0], np.cumsum(n)])
    h = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    m = mixed(h)
    zero = np.zeros(1, np.uint64)
    run1, run2 = np.concatenate([zero, np.cumsum(m, dtype=np.uint64)]), np.concatenate([zero, np.cumsum(mixed(m), dtype=np.uint64)])
    k1, k2 = run1[off[1:]] - run1[off[:-1]], run2[off[1:]] - run2[off[:-1]]
    rank = sketch[(h >> shift).astype(np.int64)]
    size = np.where(n > 0, n - ceil_share(n, t) + 1, 0)
    prefix = []
    doc = np.repeat(np.arange(len(rows)), n)
    flip = np.bincount(doc * SIG_BITS + (m & np.uint64(SIG_BITS - 1)).astype(np.int64), minlength=SIG_BITS * len(rows))
    sig = np.packbits((flip & 1).astype(np.uint8).reshape(-1, SIG_BITS), axis=1, bitorder="little").view(np.int64)
    for a, b, p in zip(off[:-1].tolist(), off[1:].tolist(), size.tolist(), strict=True):
        own, r = h[a:b], rank[a:b]
        order = np.argsort(r, kind="stable")[:p]  # the hashes ascend already
        prefix.append(own[order])
    return [pa.array(n), pa.array(to_long(k1)), pa.array(to_long(k2)), list_array(list(sig)), list_array(prefix)]


def _least_common(x: Column, y: Column, t: Fraction) -> Column:
    """The least intersection of sets of x and y items with similarity t: ceil(t (x + y) / (1 + t)), in whole numbers."""
    p, pq = t.numerator, t.numerator + t.denominator
    top = (x + y) * p + (pq - 1)
    return F.floor((top - top % pq) / pq)


def _folded() -> list[Column]:
    """Columns s0, s1, ...: the signature folded to FOLDED_BITS; folding parities gives parities."""
    step = FOLDED_BITS // 64
    fold = lambda i: reduce(lambda x, y: x.bitwiseXOR(y), [F.get("sig", F.lit(j)) for j in range(i, SIG_BITS // 64, step)])
    return [fold(i).alias(f"s{i}") for i in range(step)]


def _fits(t: Fraction, folded: bool = False) -> Column:
    """Length and suffix filters of a pair with n_a, n_b, and sig_a, sig_b or the folded signatures."""
    p, q = t.numerator, t.denominator
    words = [(F.col(f"s{i}_a"), F.col(f"s{i}_b")) for i in range(FOLDED_BITS // 64)] if folded else [(F.get("sig_a", F.lit(i)), F.get("sig_b", F.lit(i))) for i in range(SIG_BITS // 64)]
    apart = reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in words])
    return (F.col("n_a") * q >= F.col("n_b") * p) & (F.col("n_b") * q >= F.col("n_a") * p) & (apart <= F.col("n_a") + F.col("n_b") - 2 * _least_common(F.col("n_a"), F.col("n_b"), t))


def _side(df: DataFrame, s: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns])


def shared_entries(reps: DataFrame) -> DataFrame:
    """The prefix entries (tok, id, pos) whose shingle is in two prefixes or more, with ``center``, the smallest id that has it.

    The shingles of a group of near copies agree on their center, so a star has a pair for each copy. Most of a prefix's shingles are in no other: they drop out by a bit table of fixed size before any row is made of them.
    """
    lists = reps.select("doc_id", F.col("prefix").alias("hashes"))
    table = reps.sparkSession.sparkContext.broadcast(shared_hashes([(lists, None)], 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, h = listed(b)
            pos = np.arange(len(row)) - np.searchsorted(row, row)
            keep = shared_of(table.value, h)
            yield pa.RecordBatch.from_arrays([pa.array(to_long(h[keep])), b.column("doc_id").take(pa.array(row[keep])), pa.array(pos[keep].astype(np.int32))], names=["tok", "id", "pos"])

    entries = materialize(lists.transform(arrow_map, run, "tok long, id long, pos int"), "ngram-entries")
    many = entries.groupBy("tok").agg(F.count("*").alias("c"), F.min("id").alias("center")).filter("c > 1").select("tok", "center")
    return skew_join(entries, many, ["tok"])


def _packed(sets: list[np.ndarray], which: np.ndarray) -> pa.Array:
    """The upper SET_BYTES bytes of each hash of the sets, ascending, for each row its set."""
    data = [(s >> np.uint64(64 - 8 * SET_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes() for s in sets]
    return pa.array([data[i] for i in which.tolist()], pa.binary())


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SET_BYTES, 8), np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SET_BYTES)
    return out.view("<u8")[:, 0]


def _sets_of(b: pa.RecordBatch, key: str, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The shingle sets of runs of rows with one document, and each row's run: a document's pairs come one after the other."""
    ids = np.asarray(b.column(key))
    head = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, bool)
    texts = pa.RecordBatch.from_arrays([b.column("text").filter(pa.array(head))], names=["text"])
    return [s for _, _, rows in document_shingles(texts, k) for s in rows], np.cumsum(head) - 1


def verified(pairs: DataFrame, docs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """The pairs (a, b), each there once, whose shingle sets have similarity t or more, with the intersection's size.

    Each document of a pair has its text moved, which is smaller than its set; the set of one goes to the text of the other.
    """
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    likely = docs.sparkSession.sparkContext.broadcast(member_bits(wanted, "doc_id"))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(maybe_member(likely.value, b.column("doc_id"))))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, which = _sets_of(b, "a", k)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), _packed(sets, which)], names=["a", "b", "set_a"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, which = _sets_of(b, "b", k)
            mine = [_unpacked(x) for x in _packed(sets, np.arange(len(sets))).to_pylist()]
            common, total = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
            for i, (w, data) in enumerate(zip(which.tolist(), b.column("set_a").to_pylist(), strict=True)):
                other = _unpacked(data)
                at = np.searchsorted(mine[w], other)
                at[at == len(mine[w])] = 0
                common[i], total[i] = int((mine[w][at] == other).sum()) if len(mine[w]) else 0, len(other) + len(mine[w])
            good = pa.array(common * t.denominator >= (total - common) * t.numerator)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(common)], names=["a", "b", "common"]).filter(good)

    texts = docs.select("doc_id", "text").transform(arrow_map, needed, "doc_id long, text string")
    side = lambda c: texts.select(F.col("doc_id").alias(c), "text")
    sent = skew_join(pairs.select("a", "b"), side("a"), ["a"]).select("a", "b", "text").transform(arrow_map, first, "a long, b long, set_a binary")
    met = skew_join(sent, side("b"), ["b"]).select("a", "b", "set_a", "text").transform(arrow_map, second, "a long, b long, common long")
    return materialize(met.groupBy("a", "b").agg(F.max("common").alias("common")), "ngram-links")


def _named(posts: DataFrame, named: DataFrame) -> DataFrame:
    """``posts`` with ``comp``: the component of id, or id itself."""
    return skew_join(posts, named, ["id"], "left").withColumn("comp", F.coalesce("component_id", "id")).drop("component_id")


def _star_pairs(posts: DataFrame, reps: DataFrame, t: Fraction) -> DataFrame:
    """Of each shingle, its center with one entry (the earliest) of each other component: pairs that pass the filters."""
    heads = posts.groupBy("tok", "center", "comp").agg(F.min(F.struct("pos", "id")).alias("head")).select("center", F.col("head.id").alias("id"))
    pairs = heads.filter("id <> center").select(F.least("center", "id").alias("id_a"), F.greatest("center", "id").alias("id_b")).distinct()
    return _sifted(pairs, reps, t)


def _sifted(pairs: DataFrame, reps: DataFrame, t: Fraction) -> DataFrame:
    """Those of the pairs (id_a, id_b) that pass the length and suffix filters, as (a, b)."""
    info = reps.select(F.col("doc_id").alias("id"), "n", "sig")
    return skew_join(skew_join(pairs, _side(info, "a"), ["id_a"]), _side(info, "b"), ["id_b"]).filter(_fits(t)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def _cross_pairs(posts: DataFrame, reps: DataFrame, t: Fraction, within: bool = False) -> DataFrame:
    """All pairs of entries of one shingle in different components that pass the length, positional and suffix filters."""
    p, q = t.numerator, t.denominator
    open_ = posts if within else skew_join(posts, posts.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("tok"), ["tok"])
    lean = skew_join(open_.select("tok", "id", "pos", "comp"), reps.select(F.col("doc_id").alias("id"), "n", *_folded()), ["id"])
    lean = materialize(lean, "ngram-open")
    a, b = _side(lean, "a"), _side(lean, "b")
    room = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    on = (F.col("tok_a") == F.col("tok_b")) & (F.col("id_a") < F.col("id_b")) & (room * (p + q) >= (F.col("n_a") + F.col("n_b")) * p) & _fits(t, folded=True)
    if not within:
        on = on & (F.col("comp_a") != F.col("comp_b"))
    pairs = a.join(b, on).select("id_a", "id_b").distinct()
    return _sifted(pairs, reps, t)


def all_links(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """Every link (a, b, common) between classes. In a large group of near copies their number grows with its square: for components use ``near_duplicates``."""
    t = Fraction(*threshold)
    _, classes, reps = _classes(docs, k, t)
    posts = shared_entries(reps).withColumn("comp", F.col("id"))
    found = verified(materialize(_cross_pairs(posts, reps, t, within=True).distinct(), "ngram-near"), docs, k, t)
    for side in ("a", "b"):
        found = found.join(classes.select(F.col("class_id").alias(side)), side, "left_semi")
    return found.select("a", "b", "common")


def _classes(docs: DataFrame, k: int, t: Fraction) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all documents, the classes of equal sets, and the signatures of one document of each."""
    signed = materialize(signatures(docs, k, t, frequency_sketch(docs, k)), "ngram-signed")
    filled = signed.filter("n > 0")
    classes = materialize(filled.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("class_id")), "ngram-classes")
    # a copy that passes for a representative does no harm: it is linked with its class
    chosen = docs.sparkSession.sparkContext.broadcast(member_bits(classes.select("class_id"), "class_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(maybe_member(chosen.value, b.column("doc_id"))))

    reps = filled.select("doc_id", "n", "sig", "prefix").transform(arrow_map, run, "doc_id long, n long, sig array<long>, prefix array<long>")
    return signed, classes, materialize(reps, "ngram-reps")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id (smallest doc_id reachable by links).

    Links between classes are first sought along stars: each shared shingle's center with one document of each component
    that has the shingle. Then every pair of entries in components still apart is a candidate. A pair whose ends are
    connected already can't change a component, so it isn't made: a large group of near copies costs a star, not its square.
    """
    t = Fraction(*threshold)
    with scratch(docs.sparkSession):  # the prefixes go as soon as the entries are there
        signed, classes, reps = _classes(docs, k, t)
        posts = materialize(shared_entries(reps), "ngram-posts", outer=True)
        reps = materialize(reps.select("doc_id", "n", "sig"), "ngram-info", outer=True)
        signed = materialize(signed.select("doc_id", "n", "k1", "k2"), "ngram-keys", outer=True)
        classes = materialize(classes, "ngram-classes", outer=True)
    named = tried = found = None
    for step in (_star_pairs, _star_pairs, _cross_pairs):
        pairs = step(posts.withColumn("comp", F.col("id")) if named is None else _named(posts, named), reps, t).distinct()
        if tried is not None:  # each pair is verified once
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "ngram-near")
        more = verified(pairs, docs, k, t)
        if named is None or not more.isEmpty():
            found = more if found is None else found.unionByName(more)
            named = materialize(components(found), "ngram-components")
        tried = pairs if tried is None else tried.unionByName(pairs)
    member = skew_join(signed.select("doc_id", "n", "k1", "k2"), classes, ["n", "k1", "k2"], "left")
    member = member.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"))
    out = skew_join(member, named.withColumnRenamed("id", "class_id"), ["class_id"], "left")
    return out.select("doc_id", "n_shingles", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id; columns as they were.

    Rows with a null doc_id, and different texts under one doc_id, are documents of their own. Of a component the smallest
    doc_id stays (null comes last), and of a repeated id's rows in it one. A blank text is its own component: of its rows
    one per doc_id stays, and every one with a null doc_id.
    """
    ids = docs.select("doc_id").groupBy("doc_id").count()
    if ids.filter("doc_id IS NULL OR count > 1").isEmpty():
        member = materialize(near_duplicates(docs, k, threshold).select("doc_id", "component_id"), "ngram-member")
        gone = member.filter("component_id <> doc_id").select("doc_id").distinct()
        return without_members(docs, gone, "doc_id")
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "ngram-rows")
    member = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), k, threshold)
    member = materialize(member.select(F.col("doc_id").alias("__row"), "n_shingles", "component_id"), "ngram-member")
    named = rows.select("__row", "doc_id").join(member, "__row")
    order = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")).alias("first")
    best = named.filter("n_shingles > 0").groupBy("component_id").agg(order).select("first.__row")
    blank = named.filter("n_shingles = 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("__row").alias("__row")).select("__row")
    loose = named.filter("n_shingles = 0 AND doc_id IS NULL").select("__row")
    return rows.join(best.unionByName(blank).unionByName(loose), "__row", "left_semi").select(*docs.columns)
