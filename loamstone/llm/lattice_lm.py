"""Subword lattice language model: the marginal probability of a text over all its segmentations.

The subword inventory is an existing tokenizer's whole vocabulary (never trained here, none of its pieces left out). It brings
a unigram score for each piece, by the vocabulary's own order (a Zipf law of the ranks). These scores weight the lattices
first, and stay the prior of what the training documents tell: two rounds of expectation maximisation over the lattices of all distinct
training words, weighted by their counts. The probability of a word is the sum over all ways to make it of pieces, by a
forward recursion in log space; a word is spelled with one space before it, pieces don't reach over words, so a text's log
probability, its ``score``, is the sum of its words' and of the end's. Over all words and the end the probabilities sum to one
at most (pieces that no word is spelled with keep their share).

``word_score`` is that of a mixture beside it: a word seen in training has its count, by Witten and Bell's estimate; with N
training tokens of V kinds its probability is (count + V * the marginal over pieces) / (N + V).

All passes over lattices are over distinct words, in vectors over thousands of words at a time. Word statistics are one
aggregate by word (pre-aggregated in each task). The most frequent words, ``TOP`` at most, are broadcast with their scores;
what else a document has is joined. So the gathered statistics grow with the corpus, and what is broadcast doesn't.

Base score: add-half unigram over lower-cased words and the end, see ``scored``. Defined results: a null, empty or blank
text is just an end; repeated rows are scored each, and count each in training; words of any length are scored whole;
without training documents all pieces keep their first scores and every base probability is even; an empty table gives an
empty table; other columns are left out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.bpe import byte_alphabet
from loamstone.llm.common import arrow_map, discard, materialize
from loamstone.llm.counters import summed_counters
from loamstone.llm.kernel import LOWER, chunks, hash_spans, text_buffer, to_long, word_spans

#: Words whose counts and scores are broadcast, at most (24 bytes each).
TOP = 1 << 18
#: Distinct words that a task holds before it sends them.
HELD = 400_000
ROUNDS = 2
#: Expected counts are summed as whole numbers of 1 / GRAIN, so the sum doesn't depend on the order of tasks.
GRAIN = 1 << 16
#: Uses a piece that the prior counts, on average.
PRIOR = 0.05
_BATCH_BYTES = 1 << 18


class Inventory:
    """Byte pieces of a byte-level vocabulary file, looked up by value; all of them, and all single bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        alphabet = byte_alphabet()
        ranked = (bytes(alphabet[c] for c in token) for token, _ in sorted(vocab.items(), key=lambda x: x[1]))
        pieces = dict.fromkeys([*(bytes([b]) for b in range(256)), *ranked])
        self.pieces = list(pieces)
        self.size = len(self.pieces)
        at = np.cumsum([0, *map(len, self.pieces)])
        flat = np.frombuffer(b"".join(self.pieces), dtype=np.uint8)
        keys = self.keys(flat, at[:-1], np.diff(at))
        bits = 4 + max(8, self.size.bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_id = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.probes = 1
        for i, k in enumerate(keys):
            s, n = int(k >> self.shift), 1
            while self.slot_id[s] >= 0:
                if self.slot_key[s] == k:
                    raise ValueError("two pieces have one key")
                s, n = (s + 1) & self.mask, n + 1
            self.slot_key[s], self.slot_id[s], self.probes = k, i, max(self.probes, n)
        self.longest = max(map(len, self.pieces))

    @staticmethod
    def keys(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return hash_spans(buf, at, at + size, 11)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each key, or -1."""
        s = (keys >> self.shift).astype(np.int64)
        out = np.where(self.slot_key[s] == keys, self.slot_id[s], -1)
        open_ = np.flatnonzero((out < 0) & (self.slot_id[s] >= 0))
        for _ in range(self.probes - 1):
            if len(open_) == 0:
                break
            s[open_] = (s[open_] + 1) & self.mask
            here = s[open_]
            hit = self.slot_key[here] == keys[open_]
            out[open_[hit]] = self.slot_id[here[hit]]
            open_ = open_[~hit & (self.slot_id[here] >= 0)]
        return out

    def first_scores(self) -> np.ndarray:
        """The vocabulary's own scores: natural logs by rank (a Zipf law), the end of text last."""
        p = 1.0 / (np.arange(self.size + 1) + 10.0)
        return np.log(p / p.sum())


class Lattices:
    """Lattices of some words: every edge is a piece from one position to another."""

    def __init__(self, inv: Inventory, words: list[bytes]):
        spelled = [b" " + w for w in words]
        size = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.n, self.count = size, len(words)
        buf = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        ends = np.cumsum(size)
        self.origin = ends - size + np.arange(len(words))  # nodes: size + 1 a word
        pos = np.arange(len(buf))
        word = np.repeat(np.arange(len(words)), size)
        left = ends[word] - pos
        offset = pos - (ends - size)[word]
        self.deepest = int(size.max(initial=0))
        starts, pieces, steps, offs = [], [], [], []
        for length in range(1, inv.longest + 1):
            at = np.flatnonzero(left >= length)
            if len(at) == 0:
                break
            piece = inv.find(inv.keys(buf, at, np.full(len(at), length)))
            hit = piece >= 0
            at = at[hit]
            starts.append(at + word[at])
            pieces.append(piece[hit])
            steps.append(np.full(len(at), length))
            offs.append(offset[at])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        start, self.piece, step, off = cat(starts), cat(pieces), cat(steps), cat(offs)
        order = np.argsort(off * (inv.longest + 1) + step, kind="stable")  # edges of one offset and length end at different nodes
        self.start, self.piece, self.end, key = start[order], self.piece[order], (start + step)[order], (off * (inv.longest + 1) + step)[order]
        cut = np.flatnonzero(np.diff(key)) + 1
        self.runs = list(zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True)) if len(key) else []

    def forward(self, scores: np.ndarray) -> np.ndarray:
        a = np.full(int(self.n.sum()) + self.count, -np.inf)
        a[self.origin] = 0.0
        s = scores[self.piece]
        for lo, hi in self.runs:
            e = self.end[lo:hi]
            a[e] = np.logaddexp(a[e], a[self.start[lo:hi]] + s[lo:hi])
        return a

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        """Natural log probability of each word."""
        return self.forward(scores)[self.origin + self.n]

    def expected(self, scores: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
        """Expected uses of each piece when the words occur ``weight`` times."""
        a = self.forward(scores)
        b = np.full(len(a), -np.inf)
        b[self.origin + self.n] = 0.0
        s = scores[self.piece]
        for lo, hi in reversed(self.runs):
            st = self.start[lo:hi]
            b[st] = np.logaddexp(b[st], s[lo:hi] + b[self.end[lo:hi]])
        word = np.searchsorted(self.origin, self.start, side="right") - 1
        share = np.exp(a[self.start] + s + b[self.end] - b[self.origin][word])
        return np.bincount(self.piece, weights=share * weight[word], minlength=size)


_inventories: dict[str, Inventory] = {}


def inventory(path: str) -> Inventory:
    if path not in _inventories:
        _inventories[path] = Inventory(path)
    return _inventories[path]


def word_groups(words: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of words of bounded bytes together; a longer word is a run of its own."""
    data = words.to_pylist()
    lo, held = 0, 0
    for i, w in enumerate(data):
        if held and held + len(w) > _BATCH_BYTES:
            yield lo, i, data[lo:i]
            lo, held = i, 0
        held += len(w) + 1
    if lo < len(data):
        yield lo, len(data), data[lo:]


def word_counts(docs: DataFrame) -> DataFrame:
    """h, word, c (in training documents) of every distinct word; ``docs`` have held_out, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, cs, ws = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(to_long(hs)), pa.array(ws.tolist(), pa.binary()), pa.array(cs)], names=["h", "word", "c"])

        for b in batches:
            train = ~np.asarray(b.column("held_out").to_numpy(zero_copy_only=False), dtype=bool)
            for lo, hi, buf, offs in chunks(*text_buffer(b.column("text"))):
                buf = LOWER[buf]
                starts, ends, first = word_spans(buf, offs)
                h = hash_spans(buf, starts, ends)
                weight = np.repeat(train[lo:hi], first[1:] - first[:-1])
                own, where, back = np.unique(h, return_index=True, return_inverse=True)
                c = np.bincount(back, weights=weight, minlength=len(own)).astype(np.int64)
                slot = np.searchsorted(hs, own)
                slot[slot == len(hs)] = 0
                known = hs[slot] == own if len(hs) else np.zeros(len(own), bool)
                cs[slot[known]] += c[known]
                new = np.flatnonzero(~known)
                data = buf.tobytes()
                fresh = np.empty(len(new), object)
                fresh[:] = [data[a:z] for a, z in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]
                hs, cs, ws = np.concatenate([hs, own[new]]), np.concatenate([cs, c[new]]), np.concatenate([ws, fresh])
                order = np.argsort(hs, kind="stable")
                hs, cs, ws = hs[order], cs[order], ws[order]
                if len(hs) > HELD:
                    yield batch()
                    hs, cs, ws = hs[:0], cs[:0], ws[:0]
        yield batch()

    found = docs.select("held_out", "text").transform(arrow_map, run, "h long, word binary, c long")
    return found.groupBy("h", "word").agg(F.sum("c").alias("c"))


def learned_scores(words: DataFrame, path: str, ends: int, rounds: int = ROUNDS) -> np.ndarray:
    """Scores (natural logs) of the pieces and, last, of the end: ``rounds`` of expectation maximisation over ``words`` (word, c)."""
    inv = inventory(path)
    scores = inv.first_scores()
    prior = PRIOR * (inv.size + 1) * np.exp(scores)
    size = -(-inv.size // 64) * 64
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(scores)

        def count(b: pa.RecordBatch, total: np.ndarray, shared=shared) -> None:
            lattice_of, weight = inventory(path), np.asarray(b.column("c"), dtype=np.float64)
            for lo, hi, group in word_groups(b.column("word")):
                total += np.round(GRAIN * Lattices(lattice_of, group).expected(shared.value, weight[lo:hi], len(total))).astype(np.int64)

        used = summed_counters(words.filter("c > 0").select("word", "c"), count, size, lambda c: c)[: inv.size] / GRAIN
        mass = np.append(used, ends) + prior
        scores = np.log(mass / mass.sum())
    return scores


def word_scores(words: DataFrame, path: str, scores: np.ndarray, tokens: int = 0, kinds: int = 0) -> DataFrame:
    """h, c, lp and lw: the log10 probability of each word by its lattice, and that mixed with its count in a corpus of so many tokens and kinds."""
    shared = words.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [Lattices(inventory(path), group).marginals(shared.value) for _, _, group in word_groups(b.column("word"))]
            lp = np.concatenate(parts) if parts else np.zeros(0)
            lw = lp
            if tokens:
                with np.errstate(divide="ignore"):
                    lw = np.logaddexp(np.log(np.asarray(b.column("c"), dtype=np.float64)), lp + math.log(kinds)) - math.log(tokens + kinds)
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("c"), pa.array(lp / math.log(10)), pa.array(lw / math.log(10))], names=["h", "c", "lp", "lw"])

    return words.transform(arrow_map, run, "h long, c long, lp double, lw double")


def frequent(words: DataFrame, most: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, count and both scores of the words with the largest counts, all with a count or none of them, ``most`` at most."""
    steps = words.filter("c > 0").groupBy(F.floor(4 * F.log2("c")).cast("int").alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
    least, n = None, 0
    for r in sorted(steps, key=lambda r: -r.step):
        n += r.n
        if n > most:
            break
        least = r.least
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    got = words.filter(F.col("c") >= least).select("h", "c", "lp", "lw").toArrow().combine_chunks()
    h, c, lp, lw = (got.column(k).to_numpy() for k in ("h", "c", "lp", "lw"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], c[order], lp[order], lw[order]


def scored(docs: DataFrame, path: str, fold: int = 1, folds: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score of each document.

    Documents whose crc32(doc_id as text) mod ``folds`` is ``fold`` are held out (null ids are not). Tokens are words and
    one end; ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))) over them; ``score`` is the lattice model's log10
    probability of the text, ``word_score`` that of its mixture with the counts of words.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    docs = docs.select("doc_id", held.alias("held_out"), "text")
    counts = materialize(word_counts(docs), "lm-counts")
    ends = docs.filter("NOT held_out").count()
    total, kinds = counts.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    train, bottom = total + ends, math.log10(total + ends + 0.5 * (kinds + (ends > 0) + 1))
    scores = learned_scores(counts, path, ends)
    words = materialize(word_scores(counts, path, scores, train, kinds + (ends > 0)), "lm-words")
    discard(counts)
    end_score, end_base = float(scores[-1]) / math.log(10), math.log10(ends + 0.5) - bottom
    end_word = math.log10(ends / train) if ends else end_score  # beside words, the end has its share of the training tokens
    shared = docs.sparkSession.sparkContext.broadcast(frequent(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_h, top_c, top_lp, top_lw = shared.value
        row = TaskContext.get().partitionId() << 40
        top_base = np.log10(top_c + 0.5) - bottom
        for b in batches:
            for lo, hi, buf, offs in chunks(*text_buffer(b.column("text"))):
                buf = LOWER[buf]
                starts, ends_at, first = word_spans(buf, offs)
                h = hash_spans(buf, starts, ends_at)
                n = first[1:] - first[:-1]
                doc = np.repeat(np.arange(hi - lo), n)
                slot = np.searchsorted(top_h, h)
                slot[slot == len(top_h)] = 0
                hit = top_h[slot] == h if len(top_h) else np.zeros(len(h), bool)
                add = lambda x, hit=hit, doc=doc, size=hi - lo: np.bincount(doc[hit], weights=x, minlength=size)
                base, score, mixed = (add(x[slot[hit]]) if hit.any() else np.zeros(hi - lo) for x in (top_base, top_lp, top_lw))
                known = np.bincount(doc[hit], minlength=hi - lo)
                miss = ~hit
                at = np.concatenate([[0], np.cumsum(np.bincount(doc[miss], minlength=hi - lo))]).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(at), pa.array(to_long(h[miss])))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + np.arange(hi - lo)), b.column("doc_id").slice(lo, hi - lo), b.column("held_out").slice(lo, hi - lo), pa.array(n + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.array(mixed), rest,
                ], names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "word_score", "rest"])
                row += hi - lo

    seen = docs.transform(arrow_map, run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, word_score double, rest array<long>")
    seen = materialize(seen, "lm-seen")  # fixes the row numbers too
    rest = seen.select("row", F.explode("rest").alias("h")).join(words, "h")
    sums = rest.groupBy("row").agg(F.count_if(F.col("c") > 0).alias("k"), F.sum(F.log10(F.col("c") + F.lit(0.5)) - F.lit(bottom)).alias("b"), F.sum("lp").alias("s"), F.sum("lw").alias("w"))
    out = seen.drop("rest").join(sums, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"), F.lit(train).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b") + end_base).alias("base_score"), (F.col("score") + zero("s") + end_score).alias("score"), (F.col("word_score") + zero("w") + end_word).alias("word_score"),
    )
