"""Runs: stretches of words that repeat with a period, found on a harmonic grid.

A run of period p is a stretch of consecutive words in which words p apart are equal, that no neighbouring word extends and
that has no smaller period; it counts from ``times`` periods and ``least`` words on. In it at least (times - 1) * p places
one after the other equal the place p further on, so one of the places 0, s, 2s, ... with s = (times - 1) * p is among them.
These pairs (period, place) are a grid of harmonic size, n * ln(n) / (times - 1) for n words; pairs whose two words differ
go at once. From each of the others the equal stretch reaches as far to either side as the longest common extension of its two
places: a binary search over prefix hashes, for all pairs of a chunk of texts at the same time. The stretches are then compared
word by word with themselves a period further on, and one that a hash made too long is done again for its period without
hashes. A run is found at many places, and its stretch with all multiples of its period too: of one stretch the smallest
period stays.

Words are runs of bytes outside ASCII white space and are told apart by their bytes. All texts of a chunk are one sequence,
with a word that nothing equals after each text, so that no run goes from one text to the next.

Defined results: a null or blank text has no words and no runs, its collapsed text is empty. Texts of any length are taken
whole, in chunks of some MB (one text at least). Equal and repeated rows give equal results, null ids too. An empty table gives
an empty table. Other columns stay; new columns replace ones of those names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamstone.llm.common import arrow_map
from loamstone.llm.kernel import chunks, list_array, mixed, text_buffer

#: A run has so many words, and so many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Pairs of the grid that are looked at together.
PAIRS = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


class _Prefixes:
    """Hashes of all prefixes of a sequence of numbers, modulo 2^64."""

    def __init__(self, a: np.ndarray):
        self.power = np.ones(len(a) + 1, dtype=np.uint64)
        np.cumprod(np.full(len(a), _BASE), out=self.power[1:])
        self.sums = np.zeros(len(a) + 1, dtype=np.uint64)
        np.cumsum(mixed(a.view(np.uint64) + np.uint64(1)) * self.power[:-1], out=self.sums[1:])

    def equal(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` numbers from ``x`` and from ``y`` (further on) have one hash."""
        return (self.sums[x + n] - self.sums[x]) * self.power[y - x] == self.sums[y + n] - self.sums[y]

    def extension(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The longest common extension of the places from ``x`` and ``y`` on, or before them; never too short."""
        low, high = np.zeros_like(most), most + 1
        while (open_ := np.flatnonzero(high - low > 1)).size:
            n = (low[open_] + high[open_]) >> 1
            at = n if back else 0
            same = self.equal(x[open_] - at, y[open_] - at, n)
            low[open_[same]] = n[same]
            high[open_[~same]] = n[~same]
        return low


def _grid(n: int, longest: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Periods and places, some at a time."""
    periods = np.arange(1, longest // times + 1, dtype=np.int64)
    count = np.maximum(0, -(-(n - periods) // ((times - 1) * periods)))
    done = np.cumsum(count)
    lo = 0
    while lo < len(periods):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, side="right")))
        q = np.repeat(periods[lo:hi], count[lo:hi])
        nth = np.arange(len(q)) - np.repeat(np.cumsum(count[lo:hi]) - count[lo:hi], count[lo:hi])
        yield q, nth * (times - 1) * q
        lo = hi


def _plainly(a: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """All maximal stretches of period ``q``, by comparing each place with the one ``q`` further on."""
    same = np.concatenate([[False], a[:-q] == a[q:], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    return edges[::2], edges[1::2] + q


def find_runs(a: np.ndarray, longest: int, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> np.ndarray:
    """start, end, period of the runs of ``a``, whose runs aren't longer than ``longest``; sorted by start, then period."""
    hashes, found = _Prefixes(a), [np.zeros((0, 3), dtype=np.int64)]
    for q, i in _grid(len(a), longest, times):
        met = np.flatnonzero(a[i] == a[i + q])
        q, i = q[met], i[met]
        end = i + q + hashes.extension(i, i + q, np.minimum(longest, len(a) - i - q), back=False)
        start = i - hashes.extension(i, i + q, np.minimum(longest, i), back=True)
        found.append(np.stack([start, end, q], axis=1)[end - start >= np.maximum(least, times * q)])
    got = np.concatenate(found)
    got = got[np.lexsort((got[:, 2], got[:, 1], got[:, 0]))]
    first = np.ones(len(got), dtype=bool)
    first[1:] = (got[1:, :2] != got[:-1, :2]).any(axis=1)
    got = got[first]
    wrong = got[~_verified(a, got), 2]
    if len(wrong):  # a hash took different words for equal ones
        again = [np.stack([s, e, np.full(len(s), q)], axis=1)[e - s >= max(least, times * q)] for q in np.unique(wrong).tolist() for s, e in [_plainly(a, q)]]
        got = np.concatenate([got[~np.isin(got[:, 2], wrong)], *again])
        got = got[np.lexsort((got[:, 2], got[:, 1], got[:, 0]))]
        first = np.ones(len(got), dtype=bool)
        first[1:] = (got[1:, :2] != got[:-1, :2]).any(axis=1)
        got = got[first]
    return got[np.lexsort((got[:, 2], got[:, 0]))]


def _verified(a: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether the words of each stretch are those a period further on, and the ones at its ends aren't."""
    good = np.ones(len(runs), dtype=bool)
    size = runs[:, 1] - runs[:, 0] - runs[:, 2]
    for lo, hi in _blocks(size):
        start, q, n = runs[lo:hi, 0], runs[lo:hi, 2], size[lo:hi]
        owner = np.repeat(np.arange(lo, hi), n)
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(owner))
        good[owner[a[at] != a[at + np.repeat(q, n)]]] = False
    start, end, q = runs.T
    before, after = start > 0, end < len(a)
    good[before] &= a[start[before] - 1] != a[start[before] - 1 + q[before]]
    good[after] &= a[end[after]] != a[end[after] - q[after]]
    return good


def _blocks(size: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, done = 0, np.cumsum(size)
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, side="right")))
        yield lo, hi
        lo = hi


def _chunk(texts: list[bytes], least: int, times: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Of each text its runs (rows of start, length, period) and the text without repeated periods."""
    words = [t.split() for t in texts]
    number: dict[bytes, int] = {}
    first = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=first[1:])
    a = np.empty(first[-1], dtype=np.int64)
    for w, s in zip(words, first.tolist()):
        a[s : s + len(w)] = [number.setdefault(x, len(number)) for x in w]
    a[first[1:] - 1] = -2 - np.arange(len(words))
    runs = find_runs(a, max(map(len, words), default=0), least, times)
    row = np.searchsorted(first, runs[:, 0], side="right") - 1
    dropped = np.zeros(len(a) + 1, dtype=np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 1], -1)
    kept = np.cumsum(dropped[:-1]) == 0
    lo = np.searchsorted(row, np.arange(len(words) + 1))
    local = np.stack([runs[:, 0] - first[row], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    found = [local[x:y] for x, y in zip(lo[:-1].tolist(), lo[1:].tolist())]
    return found, [b" ".join(compress(w, kept[s : s + len(w)].tolist()) if len(r) else w) for w, r, s in zip(words, found, first.tolist())]


def with_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> DataFrame:
    """``df`` with the runs of ``text`` (start, length, period in words, by start, then period), and the words that stay when of each
    run only the first period does, one space between them."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    names = {runs.lower(), collapsed.lower()}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType([*kept, T.StructField(runs, T.ArrayType(RUN, False)), T.StructField(collapsed, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [b.column(i) for i, n in enumerate(b.schema.names) if n.lower() not in names]
            for lo, hi, buf, offs in chunks(*text_buffer(b.column(text))):
                data = memoryview(buf)
                found, texts = _chunk([data[x:y].tobytes() for x, y in zip(offs[:-1].tolist(), offs[1:].tolist())], least, times)
                off = list_array([f[:, 0] for f in found]).offsets
                flat = np.concatenate(found)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in own), pa.ListArray.from_arrays(off, structs), pa.array(texts, pa.binary()).cast(pa.string())], names=[f.name for f in schema.fields])

    return df.transform(arrow_map, run, schema)


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts (by the hash of doc_id) go on with a period from one of their words on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    held = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("w"), g.alias("g"))
    n = F.size("w").cast("long")
    a = F.col("g") % n
    period = F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8)).cast("long")
    held = held.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, period))
    words = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return held.select("doc_id", F.when(n > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """Of each document the number of its runs, its longest run, and digests of all runs and of the collapsed text."""
    held = with_runs(with_planted(docs))
    order = lambda x, y: F.when(x.length != y.length, F.signum(y.length - x.length)).when(x.start != y.start, F.signum(x.start - y.start)).otherwise(F.signum(x.period - y.period)).cast("int")
    best = F.get(F.array_sort("runs", order), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    held = held.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return held.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
