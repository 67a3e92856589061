"""Removal of repeated byte strings by prefix doubling over sampled positions.

A suffix array to depth ``length`` (50 bytes) would rank every byte position by its first 1, 2, 4, ... bytes; that is 16
bytes a position and round. Here a position stands for several: of every ``length``-byte window, the anchor is the position
whose GRAM-byte prefix has the smallest hash (the leftmost of equals). Equal windows have equal anchors at equal offsets, so
nothing is lost. Ranks are hashes; the ranks of the first GRAM bytes come from the bytes themselves.

1. Past the threshold: texts are cut into blocks where a hash of 8 bytes is the smallest within REGION bytes. A block's rank
   is that of all bytes of the windows that start in it. Spark sorts the blocks that two documents may have by rank: in
   all but the smallest document of a rank, the block's windows are repeated for certain and drop out.
2. Growing offset: every window of an anchor holds the GRAM bytes at the anchor and the next ones on its left, or those and
   the next ones on its right (half of what is missing). Each anchor that is left has the ranks of these two extensions.
   Tasks send the distinct ones sorted and packed; a rank that one document has alone is unique and drops out. The others
   set bits of a table of fixed size, and so do those of very many documents.
3. Threshold: positions that aren't unique send the rank with the bytes of their windows, and Spark sorts by rank; in each
   rank, contexts are ranked (equal contexts have all windows equal), and contexts that are still apart are reranked by
   (rank of the first half, rank of the second half) of each window up to ``length``. A hot rank is split: its positions
   send each window by the rank of its ``length`` bytes. A window is repeated if its rank holds a smaller doc_id. Of equal
   contexts of a batch only the smallest doc_id is sent, the others are repeated for certain; of a hot block or window the same
   holds for all batches of a task. So a window that all documents have reaches the one task that decides it once from each task.
4. Runs of repeated windows are gathered by document, and the covered bytes are cut out. Texts without a run aren't moved.

The smallest document that has a window keeps it through step 1: were the window's block repeated, a smaller document would
have all of the block's windows. So step 3 meets every window at its smallest document.

Defined results: a null text is empty; texts shorter than ``length`` keep everything; rows with the same doc_id never
repeat each other; repeated rows get equal results; texts of any length are handled whole; null ids count as smaller than
any other; an empty table gives an empty table; other columns are left out. Blocks and contexts count as equal where two
64-bit hashes of their bytes are; rows without an id, or with one of several rows, are numbered in a copy of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import arrow_map, materialize, scratch, skew_join
from loamstone.llm.counters import maybe_member, member_bits
from loamstone.llm.kernel import chunks, hash_spans, mixed, text_buffer, to_long
from loamstone.llm.shared_hashes import Shared, often_of, shared_hashes, shared_of

LENGTH = 50
GRAM = 20
#: Occurrences from which on a rank is hot.
HOT = 1000
#: Blocks begin more than so many bytes apart, about twice as many on average.
REGION = 64
_CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        n = max(n, _CHUNK + 64)
        for k, base in (("p", _P), ("i", _PINV)):
            x = np.full(n, np.uint64(base & (2**64 - 1)), dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers["p"], _powers["i"]


def _rolling(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``_span_hash`` takes the hash of any run of bytes."""
    p, _ = _power(len(buf) + 1)
    c = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * p[: len(buf)], dtype=np.uint64, out=c[1:])
    return c


def _span_hash(c: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    _, inv = _power(len(c))
    return mixed((c[at + size] - c[at]) * inv[at])


def blocks(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, second: bool = True) -> tuple[np.ndarray, ...]:
    """Row, first and last window start, and two hashes (one, unless ``second``) of each block (of the bytes of all its windows)."""
    size = offs[1:] - offs[:-1]
    if size.max(initial=0) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * (1 + second)
    eight = np.ndarray(shape=(len(buf),), dtype="<u8", buffer=np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(buf)) + REGION * (row + 1)  # rows are set apart, so that a block's start depends on its own text alone
    wide = len(buf) + REGION * (len(size) + 1)
    low = (np.uint64(1) << np.uint64(wide.bit_length())) - np.uint64(1)
    inside = np.arange(len(buf)) + 8 <= offs[1:][row]
    key = np.full(wide, ~np.uint64(0), dtype=np.uint64)
    key[place[inside]] = (mixed(eight[inside]) & ~low) | place[inside].astype(np.uint64)
    m, span = key, 1
    while span * 2 <= 2 * REGION + 1:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = 2 * REGION + 1 - span
    m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
    cut = np.zeros(len(buf), dtype=bool)
    cut[inside] = m[place[inside] - REGION] == key[place[inside]]
    cut[offs[:-1][size > 0]] = True
    start = np.flatnonzero(cut)
    start = start[start + length <= offs[1:][row[start]]]
    of = row[start]
    last = offs[1:][of] - length
    same = np.flatnonzero(of[1:] == of[:-1])
    last[same] = start[same + 1] - 1
    return of, start, last, *(hash_spans(buf, start, last + length, k) for k in ((1, 2) if second else (1,)))


def unsettled(buf: np.ndarray, offs: np.ndarray, length: int, table: Shared) -> np.ndarray:
    """Which window starts are in blocks that one document has alone."""
    _, a, z, h = blocks(buf, offs, length, second=False)
    shared = shared_of(table, h)
    step = np.zeros(len(buf) + 1, dtype=np.int8)
    step[a[shared]] += 1
    step[z[shared] + 1] -= 1
    return np.cumsum(step[:-1], dtype=np.int8) == 0


def anchors(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all (wanted) windows: row, anchor position, first and last window start that the anchor owns, and the anchor's rank (a hash)."""
    none = np.zeros(0, np.int64)
    size = offs[1:] - offs[:-1]
    if len(buf) < length or size.max(initial=0) < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    c = _rolling(buf)
    h = mixed((c[GRAM:] - c[:-GRAM]) * _power(len(c))[1][: len(c) - GRAM])
    bits = np.uint64(max(1, int(len(buf)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    w, span = length - GRAM + 1, 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < w:
        m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
    long_ = np.flatnonzero(size >= length)
    n = size[long_] - length + 1
    first = np.concatenate([[0], np.cumsum(n)])
    start = np.repeat(offs[:-1][long_] - first[:-1], n) + np.arange(first[-1])
    row = np.repeat(long_, n)
    owner = (m[start] & low).astype(np.int64)
    new = np.empty(len(owner), dtype=bool)
    new[0] = True
    new[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
    if wanted is not None:
        new[1:] |= wanted[start[1:]] != wanted[start[:-1]]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(owner)) - 1
    if wanted is not None:
        fit = wanted[start[at]]
        at, last = at[fit], last[fit]
    return row[at], owner[at], start[at], start[last], h[owner[at]]


def extensions(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Row, rank (a hash), first and last window start of each extension of an anchor to one side; and the prefix sums of the hashes."""
    row, at, first, last, _ = anchors(buf, offs, length, wanted)
    c = _rolling(buf)
    reach = (length - GRAM) // 2
    left, right = np.flatnonzero(first <= at - reach), np.flatnonzero(last > at - reach)
    p, q = at[left], at[right]
    rank = np.concatenate([_span_hash(c, p - reach, GRAM + reach), ~_span_hash(c, q, length - reach + 1)])
    side = np.concatenate([left, right])
    return row[side], rank, np.concatenate([first[left], np.maximum(first[right], q - reach + 1)]), np.concatenate([np.minimum(last[left], p - reach), last[right]]), c


_BLOCK = "h long, e long, doc_id long, uid long, base int, last int, data binary"
_CONTEXT = "rank long, doc_id long, uid long, base int, last int, context binary"


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c if k == "binary" else c.astype(np.int64 if k == "long" else np.int32), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


#: Hot blocks or windows that a task remembers before it sends them.
LEADERS = 50_000


class _Leaders:
    """Of hot blocks (or windows) the row of the smallest document that a task has met."""

    def __init__(self):
        self.rows: dict[tuple[int, int], tuple[int, int, int, int, bytes]] = {}

    def meet(self, which: np.ndarray, h: np.ndarray, e: np.ndarray, d: np.ndarray, u: np.ndarray, base: np.ndarray, last: np.ndarray, data: Callable[[int], bytes]) -> tuple[list[int], list[tuple[int, int, int]]]:
        """Rows that are remembered or repeated for certain; and (uid, base, last) of the latter."""
        settled, sure = [], []
        for i in which.tolist():
            key, row = (int(h[i]), int(e[i])), (int(d[i]), int(u[i]), int(base[i]), int(last[i]))
            old = self.rows.get(key)
            if old is not None and old[0] == row[0]:
                continue  # another row of the same document: it is sent as any other
            settled.append(i)
            if old is not None and old[0] < row[0]:
                sure.append(row[1:])
                continue
            if old is not None:
                sure.append(old[1:4])
            self.rows[key] = (*row, data(i))
        return settled, sure

    def sent(self, least: int = 0) -> list[np.ndarray]:
        """Columns of all that is remembered, if there is more than ``least``."""
        if len(self.rows) <= least:
            return []
        h, e = (np.array(x, dtype=np.uint64) for x in zip(*self.rows, strict=True))
        d, u, base, last, data = zip(*self.rows.values(), strict=True)
        self.rows = {}
        return [h, e, *(np.array(x, dtype=np.int64) for x in (d, u, base, last)), list(data)]


def shared_blocks(docs: DataFrame, length: int) -> tuple[Shared, DataFrame]:
    """Bits of the blocks that two documents may have, and a table of these blocks' windows: uid, doc_id, base, last, data.

    Without ``data``, the windows from ``base`` to ``base + last`` are repeated for certain; otherwise the document is the
    smallest that has the block, and ``data`` are its bytes.
    """

    def of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, _, _, h = blocks(buf, offs, length, second=False)
        return row, h

    bits = shared_hashes([(docs, of)], HOT)
    table = docs.sparkSession.sparkContext.broadcast(bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders = _Leaders()

        def of_leaders(least: int) -> Iterator[pa.RecordBatch]:
            if cols := leaders.sent(least):
                yield _batch(_BLOCK, to_long(cols[0]), to_long(cols[1]), *cols[2:])

        for b in batches:
            ids, uids = np.asarray(b.column("doc_id").fill_null(-(1 << 63))), np.asarray(b.column("uid"))
            found, texts = [], []
            for lo, _, buf, offs in chunks(*text_buffer(b.column("text")), _CHUNK):
                row, a, z, h, e = blocks(buf, offs, length)
                keep = np.flatnonzero(shared_of(table.value, h))
                row, a, z, h, e = (v[keep] for v in (row, a, z, h, e))
                found.append((h, e, ids[lo + row], uids[lo + row], a - offs[row], z - a, a, np.full(len(a), len(texts))))
                texts.append(buf)
            if not found:
                continue
            h, e, d, u, base, last, a, text = (np.concatenate(x) for x in zip(*found, strict=True))
            again = _again(h, e, d)
            gone = [u[again], base[again], last[again]]
            cut = lambda i, a=a, last=last, text=text, texts=texts: texts[text[i]][a[i] : a[i] + last[i] + length].tobytes()
            settled, sure = leaders.meet(np.flatnonzero(~again & often_of(table.value, h)), h, e, d, u, base, last, cut)
            if sure:
                gone = [np.concatenate([x, np.array(y, dtype=np.int64)]) for x, y in zip(gone, zip(*sure, strict=True), strict=True)]
            again[settled] = True
            if len(gone[0]):
                who, x, y = _joined(gone[0], gone[1], gone[1] + gone[2])
                yield _batch(_BLOCK, who, who, who, who, x, y - x, [None] * len(who))
            yield from of_leaders(LEADERS)
            for k, buf in enumerate(texts):
                own = np.flatnonzero((text == k) & ~again)
                data = memoryview(buf)
                kept = [data[x : x + n].tobytes() for x, n in zip(a[own].tolist(), (last[own] + length).tolist(), strict=True)]
                yield _batch(_BLOCK, to_long(h[own]), to_long(e[own]), d[own], u[own], base[own], last[own], kept)
        yield from of_leaders(0)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, least = (None, None), 0  # of the row before
        for b in batches:
            h, e, d = (np.asarray(b.column(c)) for c in ("h", "e", "doc_id"))
            if not len(h):
                continue
            head = np.append((h[0], e[0]) != group, (h[1:] != h[:-1]) | (e[1:] != e[:-1]))
            first = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
            low = np.where(first > 0, d[first], d[0] if head[0] else least)
            group, least = (h[-1], e[-1]), low[-1]
            data = b.column("data")
            gone = np.asarray(data.is_null()) | (d > low)
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), b.column("base"), b.column("last"), pa.compute.if_else(pa.array(gone), pa.scalar(None, pa.binary()), data)], names=["uid", "doc_id", "base", "last", "data"])

    rows = docs.transform(arrow_map, send, _BLOCK).repartition("h").sortWithinPartitions("h", "e", "doc_id")
    return bits, materialize(rows.transform(arrow_map, settle, "uid long, doc_id long, base int, last int, data binary"), "suffix-blocks")


def _again(h: np.ndarray, e: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Rows whose pair of hashes a smaller document has too."""
    order = np.lexsort((d, e, h))
    head = np.ones(len(order), dtype=bool)
    head[1:] = (h[order][1:] != h[order][:-1]) | (e[order][1:] != e[order][:-1])
    out = np.zeros(len(order), dtype=bool)
    if len(order):
        out[order] = d[order] > d[order][head][np.cumsum(head) - 1]
    return out


def contexts(rows: DataFrame, shared: Shared, length: int, settled: Shared | None = None) -> DataFrame:
    """The windows of each extension whose rank isn't unique, of ``rows`` (doc_id, uid, base, text).

    ``context`` starts at byte ``base`` of the text; windows start at 0 to ``last`` in it. Of a hot rank's positions each
    window is a row of its own: ``rank`` is that of the whole window, ``context`` a second hash of it. Rows without a context
    are windows that are repeated for certain. Windows of blocks in ``settled`` are left out.
    """
    sc = rows.sparkSession.sparkContext
    table, out = sc.broadcast(shared), sc.broadcast(settled)

    def of_chunk(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        row, rank, a, z, c = extensions(buf, offs, length, None if out.value is None else unsettled(buf, offs, length, out.value))
        keep = np.flatnonzero(shared_of(table.value, rank))
        row, rank, a, z = row[keep], rank[keep], a[keep], z[keep]
        e = mixed((c[z + length] - c[a]) * _power(len(c))[1][a] + (z - a + length).astype(np.uint64))
        hot = often_of(table.value, rank)
        single = np.zeros(len(row), dtype=bool)
        if hot.any():
            n = (z - a + 1)[hot]
            start = np.repeat(a[hot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            whole = _span_hash(c, start, length)
            row, single = np.concatenate([row[~hot], np.repeat(row[hot], n)]), np.concatenate([single[~hot], np.ones(len(start), dtype=bool)])
            rank, e = np.concatenate([rank[~hot], whole]), np.concatenate([e[~hot], mixed(_span_hash(c, start, length // 2) ^ whole)])
            a, z = np.concatenate([a[~hot], start]), np.concatenate([z[~hot], start])
        return [row, rank, e, a, z, single]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders = _Leaders()

        def of_leaders(least: int) -> Iterator[pa.RecordBatch]:
            if cols := leaders.sent(least):
                yield _batch(_CONTEXT, to_long(cols[0]), *cols[2:])

        for b in batches:
            ids, uids, bases = np.asarray(b.column("doc_id").fill_null(-(1 << 63))), np.asarray(b.column("uid")), np.asarray(b.column("base")).astype(np.int64)
            found, texts = [], []
            for lo, _, buf, offs in chunks(*text_buffer(b.column("text")), _CHUNK):
                row, rank, e, a, z, single = of_chunk(buf, offs)
                found.append((rank, e, ids[lo + row], uids[lo + row], bases[lo + row] + a - offs[row], z - a, a, single, np.full(len(a), len(texts))))
                texts.append(buf)
            if not found:
                continue
            h, e, d, u, base, last, a, single, text = (np.concatenate(x) for x in zip(*found, strict=True))
            again = _again(h, e, d)
            gone = [u[again], base[again], last[again]]
            settled, sure = leaders.meet(np.flatnonzero(~again & single), h, e, d, u, base, last, lambda i, e=e: int(e[i]).to_bytes(8, "little"))
            if sure:
                gone = [np.concatenate([x, np.array(y, dtype=np.int64)]) for x, y in zip(gone, zip(*sure, strict=True), strict=True)]
            again[settled] = True
            if len(gone[0]):  # neighbouring windows are one run
                who, x, y = _joined(gone[0], gone[1], gone[1] + gone[2])
                yield _batch(_CONTEXT, who, who, who, x, y - x, [None] * len(who))
            yield from of_leaders(LEADERS)
            for k, buf in enumerate(texts):
                own = np.flatnonzero((text == k) & ~again)
                data = memoryview(buf)
                kept = [h2 if one else data[x : x + s].tobytes() for one, h2, x, s in zip(single[own].tolist(), _eight(e[own]), a[own].tolist(), (last[own] + length).tolist(), strict=True)]
                yield _batch(_CONTEXT, to_long(h[own]), d[own], u[own], base[own], last[own], kept)
        yield from of_leaders(0)

    return rows.transform(arrow_map, run, _CONTEXT)


def _eight(e: np.ndarray) -> list[bytes]:
    data = e.astype("<u8").tobytes()
    return [data[i : i + 8] for i in range(0, len(data), 8)]


def _joined(who: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts a to z, those of one row that overlap or touch joined."""
    if not len(who):
        return who, a, z
    order = np.lexsort((z, a, who))
    who, a, z = who[order], a[order].astype(np.int64), z[order].astype(np.int64)
    part = np.cumsum(np.append(0, np.diff(who) != 0)) * (int(z.max(initial=0)) + 2)
    far = np.maximum.accumulate(part + z)
    new = np.ones(len(who), dtype=bool)
    new[1:] = part[1:] + a[1:] > far[:-1] + 1
    at = np.flatnonzero(new)
    return who[at], a[at], (far - part)[np.append(at[1:], len(who)) - 1]


def repeated_runs(found: DataFrame, length: int) -> DataFrame:
    """uid, a, z: windows starting at bytes a to z of the text are repeated. ``found`` comes sorted by rank in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of the last rank, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            rank = np.asarray(b.column("rank"))
            if rest and rank[0] != np.asarray(rest[-1].column("rank"))[-1]:
                yield from _reranked(pa.Table.from_batches(rest), length)
                rest = []
            cut = int(np.searchsorted(rank, rank[-1]))
            if cut:
                yield from _reranked(pa.Table.from_batches([*rest, b.slice(0, cut)]), length)
                rest = []
            rest.append(b.slice(cut))
        if rest:
            yield from _reranked(pa.Table.from_batches(rest), length)

    return found.transform(arrow_map, run, "uid long, a int, z int")


def _reranked(t: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    t = t.combine_chunks()
    rank, doc, uid, base, last = (np.asarray(t.column(c).combine_chunks()) for c in ("rank", "doc_id", "uid", "base", "last"))
    base = base.astype(np.int64)
    col = t.column("context").combine_chunks()
    sure = np.asarray(col.is_null())
    out = [(uid[sure], base[sure], base[sure] + last[sure])]
    live = np.flatnonzero(~sure)
    if len(live):
        rank, doc, uid, base, last = rank[live].view(np.uint64), doc[live], uid[live], base[live], last[live].astype(np.int64)
        buf, offs = text_buffer(col.filter(pa.array(~sure)))
        c = _rolling(buf)
        e = mixed((c[offs[1:]] - c[offs[:-1]]) * _power(len(c))[1][offs[:-1]] + (offs[1:] - offs[:-1]).astype(np.uint64))
        # contexts: equal ones of a rank are all repeated but for the smallest document
        order = np.lexsort((doc, e, rank))
        head = np.ones(len(order), dtype=bool)
        head[1:] = (rank[order][1:] != rank[order][:-1]) | (e[order][1:] != e[order][:-1])
        group = np.cumsum(head) - 1
        least = doc[order][head][group]
        again = doc[order] > least
        who = order[again]
        out.append((uid[who], base[who], base[who] + last[who]))
        # contexts still apart in a rank with several: rank their windows, by halves
        lead = order[head]
        r = rank[lead]
        several = np.zeros(len(lead), dtype=bool)
        several[1:] |= r[1:] == r[:-1]
        several[:-1] |= r[1:] == r[:-1]
        lead = lead[several & (offs[1:] - offs[:-1] >= length)[lead]]
        if len(lead):
            n = last[lead] + 1
            first = np.concatenate([[0], np.cumsum(n)])
            start = np.repeat(offs[:-1][lead] - first[:-1], n) + np.arange(first[-1])
            half = length // 2
            key = mixed(_span_hash(c, start, half) + np.uint64(3) * _span_hash(c, start + length - half, half)) ^ np.repeat(rank[lead], n)
            if 2 * half < length:
                key ^= mixed(_span_hash(c, start + half, length - 2 * half))
            owner = np.repeat(np.arange(len(lead)), n)
            by = np.lexsort((doc[lead][owner], key))
            top = np.ones(len(by), dtype=bool)
            top[1:] = key[by][1:] != key[by][:-1]
            low = doc[lead][owner[by]][top][np.cumsum(top) - 1]
            hit = np.zeros(len(by), dtype=bool)
            hit[by] = doc[lead][owner[by]] > low
            # rows of the leading document with an equal context share its windows
            where = start - offs[:-1][lead][owner]
            edge = np.diff(np.concatenate([[0], (hit & True).astype(np.int8), [0]]))
            brk = np.zeros(len(hit) + 1, dtype=bool)
            brk[first[1:-1]] = True
            on = np.flatnonzero(hit & ((edge[:-1] == 1) | brk[:-1]))
            off = np.flatnonzero(hit & ((edge[1:] == -1) | brk[1:]))
            own = lead[owner[on]]
            out.append((uid[own], base[own] + where[on], base[own] + where[off]))
            twin = order[~again & ~head]  # the same smallest doc_id has the context twice
            if len(twin):
                of = np.full(len(order), -1)
                of[order] = group
                run_of: dict[int, list] = {}
                for k, x, y in zip(of[own].tolist(), where[on].tolist(), where[off].tolist(), strict=True):
                    run_of.setdefault(k, []).append((x, y))
                extra = [(i, x, y) for i in twin.tolist() for x, y in run_of.get(int(of[i]), ())]
                if extra:
                    i, x, y = (np.array(v) for v in zip(*extra, strict=True))
                    out.append((uid[i], base[i] + x, base[i] + y))
    u, a, z = _joined(*(np.concatenate(v) for v in zip(*out, strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))], names=["uid", "a", "z"])


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _cut(data: bytes, runs: list, length: int) -> tuple[int, int, bytes]:
    """Bytes and spans removed, and what is left."""
    if not runs:
        return 0, 0, data
    x = np.array(sorted(runs), dtype=np.int64)
    a, z = x[:, 0], np.maximum.accumulate(x[:, 1] + length)
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] > z[:-1]
    s, e = a[new], z[np.append(np.flatnonzero(new)[1:], len(a)) - 1]
    left = [data[p:q] for p, q in zip([0, *e.tolist()], [*s.tolist(), len(data)], strict=True)]
    return int((e - s).sum()), len(s), b"".join(left)


def deduplicated(docs: DataFrame, length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept text of each row.

    A cut may fall inside a character; ``kept`` then has a replacement character there, ``kept_sha256`` is of the bytes.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    # rows are told apart by doc_id, or by their number in a copy of the table where an id is null or there twice
    single = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty()
    docs = docs.withColumn("uid", F.col("doc_id")) if single else materialize(docs.withColumn("uid", F.monotonically_increasing_id()), "suffix-rows")
    with scratch(docs.sparkSession):
        settled, held = shared_blocks(docs, length)
        firsts = held.filter("data IS NOT NULL").select("doc_id", "uid", "base", F.col("data").alias("text"))
        table = docs.sparkSession.sparkContext.broadcast(settled)

        def left(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return extensions(buf, offs, length, unsettled(buf, offs, length, table.value))[:2]

        def all_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return extensions(buf, offs, length)[:2]

        shared = shared_hashes([(docs, left), (firsts, all_of)], HOT)
        found = contexts(docs.withColumn("base", F.lit(0)), shared, length, settled).unionByName(contexts(firsts, shared, length))
        runs = repeated_runs(found.repartition("rank").sortWithinPartitions("rank"), length)
        sure = held.filter("data IS NULL").select("uid", F.col("base").alias("a"), (F.col("base") + F.col("last")).alias("z"))
        runs = runs.unionByName(sure)
        spans = materialize(runs.groupBy("uid").agg(F.collect_list(F.struct("a", "z")).alias("runs")), "suffix-runs", outer=True)
    likely = docs.sparkSession.sparkContext.broadcast(member_bits(spans.select("uid"), "uid"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs_of = b.column("runs").to_pylist() if "runs" in b.schema.names else [None] * b.num_rows
            if "runs" not in b.schema.names:
                b = b.filter(pa.array(~maybe_member(likely.value, b.column("uid"))))
            rows = []
            for d, t, r in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), runs_of, strict=False):
                data = t.encode()
                gone, spans_, left = _cut(data, [(x["a"], x["z"]) for x in r or ()], length)
                rows.append((d, len(data), gone, spans_, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if keep_text else None))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _RESULT.split(", ")])

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(maybe_member(likely.value, b.column("uid"))))

    moved = docs.transform(arrow_map, filtered, docs.schema)
    cut = skew_join(moved, spans, ["uid"], "left").select("doc_id", "text", "uid", "runs").transform(arrow_map, finish, _RESULT)
    return docs.transform(arrow_map, finish, _RESULT).unionByName(cut)
