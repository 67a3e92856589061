"""Full-text search by trigrams: substring phrases, BM25, bounded fusion, stored postings.

Text and phrases are compared in lower case. The terms of a text are its runs of three characters, so a phrase is found
wherever it is a substring, in any script; a phrase of fewer than three characters has no term and is found nowhere. A
phrase's frequency is the number of places where it begins.

Without an index, a search scans the texts once, with all phrases in one projection; the scan counts texts and terms too. The
stored index has a row for each place of each trigram (term, id, position, and the text's number of terms), sorted by term; written
at once (``write_index``) it has a row for each trigram of a block of some thousand texts, with all its places in the block. A
phrase is covered by the trigrams at its places 0, 3, 6, ... and at its end: where all of them follow each other at these
distances, the phrase begins. So a search reads the rows of a few terms and no text, and scores come from the rows alone. Only
texts that have the phrase's rarest trigram are looked at further. A phrase's weight depends on the exact number of texts
that have it, so all its places are found, however few results are wanted.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from loamstone.functions import scoring as S
from loamstone.functions.text import like_contains
from loamstone.sources.shared import arrow_map, stored

#: Fixed values of the ranking: saturation, length normalization, the least weight of a phrase, buckets of postings.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
BUCKETS = 64
GRAM = 3


def _folded(text: str | Column) -> Column:
    return F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def length(text: str | Column) -> Column:
    """Number of terms of a text."""
    return F.greatest(F.char_length(_folded(text)) - (GRAM - 1), F.lit(0))


def places(text: Column, phrase: str) -> Column:
    """At how many places of the folded text the phrase begins; overlapping ones count."""
    return F.regexp_count(text, F.lit(f"(?={re.escape(phrase)})"))


def _phrases(phrases: list[str]) -> list[str]:
    return [p.lower() for p in phrases]


def hits(rows: DataFrame, phrases: list[str], key: str = "id", text: str = "content") -> DataFrame:
    """key, dl, phrase (its position), tf of each phrase that a row has. Nothing is shuffled."""
    folded = _folded(text)
    found = [F.when(folded.contains(p), F.struct(F.lit(i).alias("phrase"), places(folded, p).alias("tf"))) for i, p in enumerate(_phrases(phrases)) if len(p) >= GRAM]
    if not found:
        return rows.select(key).limit(0).withColumns({"dl": F.lit(0), "phrase": F.lit(0), "tf": F.lit(0)})
    lean = rows.select(key, length(text).alias("dl"), F.array_compact(F.array(*found)).alias("hits"))
    return lean.filter(F.size("hits") > 0).select(key, "dl", F.explode("hits").alias("hit")).select(key, "dl", "hit.phrase", "hit.tf")


def statistics(rows: DataFrame, text: str = "content") -> DataFrame:
    """One row: n texts and their mean number of terms."""
    return rows.agg(F.count("*").alias("n"), F.avg(length(text)).alias("avgdl"))


def scores(found: DataFrame, stats: DataFrame, key: str = "id") -> DataFrame:
    """key, phrase, score (larger is better) of the ``hits``; a phrase that most texts have counts next to nothing."""
    df = found.groupBy("phrase").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return found.join(F.broadcast(df), "phrase").crossJoin(F.broadcast(stats)).select(key, "phrase", score.alias("score"))  # one row, and one a phrase


def search(rows: DataFrame | None, phrases: list[str], k: int = 20, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """id and bm25 of the k best by the sum over phrases. ``index`` is (postings, statistics); with it ``rows`` may be None for all that is indexed."""
    found, stats = _found(rows, phrases, index)
    return scores(found, stats).groupBy("id").agg(F.sum("score").alias("bm25")).orderBy(F.desc(F.round("bm25", 9)), "id").limit(k)


def search_bounded(rows: DataFrame | None, phrases: list[str], k: int = 20, pool: int = 48, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Each phrase ranks its own best alone; the ranks are fused, so that a rare phrase isn't lost among many."""
    pool = max(k, min(900, pool))
    each = max(8, -(-pool // max(1, len(phrases))))
    w = Window.partitionBy("phrase").orderBy(F.desc(F.round("score", 9)), "id")
    found, stats = _found(rows, phrases, index)
    top = scores(found, stats).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= each)
    fused = top.groupBy("id").agg(F.sum(S.rrf(F.col("rank"))).alias("fused"), F.sum(F.greatest(F.lit(0.0), F.col("score"))).alias("bm25"), F.min("rank").alias("best_rank"))
    return fused.orderBy(F.desc(F.round("fused", 9)), F.desc(F.round("bm25", 9)), "best_rank", "id").limit(min(k, pool))


def _found(rows: DataFrame | None, phrases: list[str], index: tuple[DataFrame, DataFrame] | None) -> tuple[DataFrame, DataFrame]:
    """The hits and the statistics, from one scan or by the index."""
    if index is not None:
        table, stats = index
        found = stored(indexed_hits(table, phrases), "hits")
        return found if rows is None else found.join(rows.select("id"), "id"), stats
    if not any(len(p) >= GRAM for p in phrases):
        return hits(rows, phrases), statistics(rows)
    seen = Observation(f"scan-{uuid.uuid4().hex}")
    found = stored(hits(rows.observe(seen, F.count(F.lit(1)).alias("n"), F.avg(length("content")).alias("avgdl")), phrases), "hits")
    return found, rows.sparkSession.createDataFrame([(seen.get["n"], seen.get["avgdl"])], "n long, avgdl double")


# stored postings

#: Rows of the rarest trigrams whose ids are sent to all tasks; beyond that both sides are shuffled.
BROADCAST_ROWS = 1 << 18


def _cover(phrase: str) -> dict[int, str]:
    """Trigrams that together hold all characters of the phrase, by their places in it."""
    return {i: phrase[i : i + GRAM] for i in (*range(0, len(phrase) - GRAM, GRAM), len(phrase) - GRAM)}


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(rows: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """bucket, term, key, dl, position of every trigram of each text, in time linear in its length. Nothing is shuffled."""
    folded = rows.select(key, _folded(text).alias("folded")).filter(F.char_length("folded") >= GRAM)
    chars = folded.select(key, F.split("folded", "").alias("a"))  # once: a place of a string is found from its start, one of an array at once
    n = F.size("a")
    three = F.arrays_zip(F.slice("a", F.lit(1), n - 2).alias("a"), F.slice("a", F.lit(2), n - 2).alias("b"), F.slice("a", F.lit(3), n - 2).alias("c"))
    grams = chars.select(key, (n - (GRAM - 1)).alias("dl"), F.posexplode(three).alias("position", "g")).select(key, "dl", "position", F.concat("g.a", "g.b", "g.c").alias("term"))
    return grams.select(_bucket(F.col("term")).alias("bucket"), "term", key, "dl", "position")


def sorted_postings(rows: DataFrame) -> DataFrame:
    """The postings in the order of the stored index; a frequent term goes over several files."""
    return rows.repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id", "position")


def indexed_hits(table: DataFrame, phrases: list[str], key: str = "id") -> DataFrame:
    """As ``hits``, from postings: of few terms, few buckets and row groups are read."""
    if "places" in table.columns:
        return _packed_hits(table, phrases, key)
    spark = table.sparkSession
    covers = {i: _cover(p) for i, p in enumerate(_phrases(phrases)) if len(p) >= GRAM}
    wanted = spark.createDataFrame([(t, i, shift) for i, c in covers.items() for shift, t in c.items()], "term string, phrase int, shift int")
    terms = sorted({t for c in covers.values() for t in c.values()})
    buckets = [r[0] for r in wanted.select(_bucket(F.col("term"))).distinct().collect()] if terms else []
    got = table.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    number = {r[0]: r[1] for r in got.groupBy("term").count().collect()} if terms else {}  # a row for each term asked for
    rarest = {i: min(c.values(), key=lambda t: number.get(t, 0)) for i, c in covers.items()}
    alone = {i for i, c in covers.items() if len(c) > 1}
    rows = got.join(F.broadcast(wanted), "term").select(key, "dl", "phrase", "term", (F.col("position") - F.col("shift")).alias("start"))
    if alone:
        first = spark.createDataFrame([(i, rarest[i]) for i in alone], "phrase int, term string")
        holding = rows.join(F.broadcast(first), ["phrase", "term"]).select(key, "phrase").distinct()
        few = sum(number.get(rarest[i], 0) for i in alone) <= BROADCAST_ROWS
        single = rows.filter(~F.col("phrase").isin([*alone]))
        rows = single.unionByName(rows.filter(F.col("phrase").isin([*alone])).join(F.broadcast(holding) if few else holding, [key, "phrase"], "left_semi"))
    need = spark.createDataFrame([(i, len(c)) for i, c in covers.items()], "phrase int, need int")
    whole = rows.groupBy(key, "phrase", "start").agg(F.count("*").alias("n"), F.first("dl").alias("dl")).join(F.broadcast(need), "phrase").filter(F.col("n") == F.col("need"))
    return whole.groupBy(key, "phrase").agg(F.first("dl").alias("dl"), F.count("*").cast("int").alias("tf")).select(key, "dl", "phrase", "tf")


# postings in blocks

#: Characters of a block of texts; a longer text is a block of its own. A block's texts (ids and lengths) are a row of bucket BUCKETS.
BLOCK = 1 << 21
_PACKED = "term string, block string, places binary, ids array<string>, sizes array<int>"


def varints(values: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers in seven bits a byte, and where the bytes of each head and the end are."""
    n = 1 + sum((values >= 1 << b).astype(np.int64) for b in (7, 14, 21, 28))
    end = np.cumsum(n)
    start = end - n
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for i in range(5):
        at = np.flatnonzero(n > i)
        out[start[at] + i] = ((values[at] >> (7 * i)) & 127) | np.where(n[at] > i + 1, 128, 0)
    return out, np.append(start[heads], len(out))


def from_varints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    last = np.flatnonzero(b < 128)
    first = np.append(0, last[:-1] + 1)
    return np.add.reduceat((b & 127) << (7 * (np.arange(len(b)) - np.repeat(first, last - first + 1))), first) if len(last) else last


def _packed_block(name: str, ids: list[str], texts: list[str]) -> pa.RecordBatch:
    """A row for each trigram of the texts, with the differences of its places in all of them together; and one for the texts."""
    sizes = np.array([len(t) for t in texts])
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    seen = np.zeros(0x110000, bool)
    seen[chars] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.int32)
    number[alphabet] = np.arange(len(alphabet))
    code, n = number[chars].astype(np.int64), len(alphabet)
    inside = np.ones(len(chars), bool)
    ends = np.cumsum(sizes)
    inside[ends - 1] = inside[ends - 2] = False  # a text has GRAM characters at least
    at = np.flatnonzero(inside)
    gram = (code[at] * n + code[at + 1]) * n + code[at + 2]
    order = np.argsort((gram & 0xFFFF).astype(np.uint16), kind="stable")  # by 16 bits at a time, so places stay in order
    for shift in (16, 32, 48):
        if (n**3 - 1) >> shift:
            order = order[np.argsort(((gram >> shift) & 0xFFFF).astype(np.uint16)[order], kind="stable")]
    gram, at = gram[order], at[order]
    heads = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    step = np.diff(at, prepend=0)
    step[heads] = at[heads]
    data, off = varints(step, heads)
    g = gram[heads]
    letters = np.stack([alphabet[g // (n * n)], alphabet[g // n % n], alphabet[g % n]], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    terms = [letters[i : i + GRAM] for i in range(0, len(letters), GRAM)]
    places = pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(data)])
    k = len(terms)
    columns = [pa.array([*terms, None], pa.string()), pa.array([name] * (k + 1)), pa.concat_arrays([places, pa.nulls(1, pa.binary())]), pa.array([None] * k + [ids], pa.list_(pa.string())), pa.array([None] * k + [sizes.tolist()], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _PACKED.split(", ")])


def packed_postings(rows: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """bucket, term, block, places, ids, sizes: the postings of blocks of texts. Nothing is shuffled; a task's blocks are named by its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and held + len(t) > BLOCK:
                    yield _packed_block(f"{task}-{made}", ids, texts)
                    made, ids, texts, held = made + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t)
        if ids:
            yield _packed_block(f"{task}-{made}", ids, texts)

    folded = rows.select(F.col(key).cast("string").alias("id"), _folded(text).alias("folded")).filter(F.char_length("folded") >= GRAM)
    packed = arrow_map(folded, run, _PACKED)
    return packed.select(F.when(F.col("term").isNull(), BUCKETS).otherwise(_bucket(F.col("term"))).alias("bucket"), *packed.columns)


def _packed_hits(table: DataFrame, phrases: list[str], key: str) -> DataFrame:
    """``hits`` from blocks: a block's places of the terms asked for meet in one task, which counts where they follow each other."""
    spark = table.sparkSession
    wanted = {i: (p, _cover(p)) for i, p in enumerate(_phrases(phrases)) if len(p) >= GRAM}
    terms = sorted({t for _, c in wanted.values() for t in c.values()})
    schema = f"{key} string, dl int, phrase int, tf int"
    if not terms:
        return spark.createDataFrame([], schema)
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()]
    told = table.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).select("block", "term", "places")
    texts = table.filter(F.col("bucket") == BUCKETS).select("block", "ids", "sizes")

    def found(_, of: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if of.num_rows and block.num_rows:
            ids, sizes = block.column("ids")[0].as_py(), np.asarray(block.column("sizes")[0].values)
            first = np.cumsum(sizes) - sizes
            at = {t: np.cumsum(from_varints(p)) for t, p in zip(of.column("term").to_pylist(), of.column("places").to_pylist(), strict=True)}
            for i, (phrase, cover) in wanted.items():
                if not all(t in at for t in cover.values()):
                    continue
                starts = None
                for shift, t in sorted(cover.items(), key=lambda c: len(at[c[1]])):
                    starts = at[t] - shift if starts is None else np.intersect1d(starts, at[t] - shift, assume_unique=True)
                own = np.searchsorted(first, starts, side="right") - 1
                whole = (starts >= 0) & (starts + len(phrase) <= first[own] + sizes[own])  # not over the end of a text
                row, tf = np.unique(own[whole], return_counts=True)
                out += [(ids[r], int(sizes[r]) - (GRAM - 1), i, n) for r, n in zip(row.tolist(), tf.tolist(), strict=True)]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32()]
        return pa.table([pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)], names=[key, "dl", "phrase", "tf"])

    return told.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(found, schema)


def write_index(rows: DataFrame, path: str) -> None:
    """Store postings and statistics of (id, content) below ``path``; a frequent term goes over several files."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("block"), F.lit(max(1, -(-4 * n // BUCKETS))))
    packed = packed_postings(rows).repartition("bucket", part).sortWithinPartitions("bucket", "term", "block")
    packed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    statistics(rows).write.mode("overwrite").parquet(f"{path}/statistics")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(f"{_PACKED}, bucket int").parquet(f"{path}/postings"), spark.read.schema("n long, avgdl double").parquet(f"{path}/statistics")


def entries(rows: DataFrame, query: str, phrases: list[str], k: int = 20, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """id and position: the search's ids, or where it has none the k latest recalled rows that contain the query (as LIKE tells)."""
    found = search(rows, phrases, k, index)
    order = Window.orderBy(F.desc(F.round("bm25", 9)), "id")
    if not query.strip() or not found.isEmpty():
        return found.withColumn("position", F.row_number().over(order)).select("id", "position")
    like = rows.filter(like_contains(F.col("content"), query)).orderBy(F.desc("last_recall_ts"), "id").limit(k)
    return like.withColumn("position", F.row_number().over(Window.orderBy(F.desc("last_recall_ts"), "id"))).select("id", "position")
