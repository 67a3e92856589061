"""Which hashes do two documents or more have, and which ones are frequent? Answered in bit tables of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loamstone.llm.common import arrow_map
from loamstone.llm.kernel import chunks, mixed, text_buffer

#: 16 MB, whatever the corpus. When the bits fill up, more hashes pass that one document has alone; shared ones always do.
BITS = 27
#: 1 MB; a hash that isn't frequent may pass for one, a frequent one always does.
OFTEN_BITS = 23
#: Buckets of hashes are at least so many, and four a shuffle partition, so a bucket is no more than a partition is.
BUCKET_BITS, MOST_BUCKET_BITS = 10, 18
CHUNK = 1 << 20
_SALT = np.uint64(0x8CB92BA72F3D8DD7)


class Shared(NamedTuple):
    """Bits over the hashes of two documents or more, and over those that occur often."""

    bits: np.ndarray
    often: np.ndarray


def _spread(h: np.ndarray) -> np.ndarray:
    """The hashes again, evenly spread: sampled ones (minima of windows) are small."""
    return mixed(h ^ _SALT)


def _member(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def shared_of(table: Shared, h: np.ndarray) -> np.ndarray:
    """False for hashes that one document has alone, as far as the table tells."""
    return _member(table.bits, (_spread(h) >> np.uint64(64 - BITS)).astype(np.int64))


def often_of(table: Shared, h: np.ndarray) -> np.ndarray:
    """True for hashes that occur often, and for a few others."""
    return _member(table.often, (_spread(h) >> np.uint64(64 - OFTEN_BITS)).astype(np.int64))


Hashes = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def listed(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the lists in column ``hashes``."""
    col = b.column("hashes")
    off = np.asarray(col.offsets).astype(np.int64)
    return np.repeat(np.arange(len(col)), np.diff(off)), np.asarray(col.values)[off[0] : off[-1]].view(np.uint64)


def shared_hashes(parts: list[tuple[DataFrame, Hashes | None]], often: int, wanted: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> Shared:
    """Of each table (with doc_id and text) ``of(bytes, offsets)`` gives rows and their hashes, or the table has lists of ``hashes``; ``wanted`` picks rows.

    Hashes that occur ``often`` times or more are frequent (255 at most are counted in a batch of rows). Each task sends its
    distinct hashes batch by batch, sorted and packed: five bytes, a count, and whether two documents have it. Buckets of
    hashes meet in one task each.
    """
    n = max(int(parts[0][0].sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    bucket_bits = min(max(BUCKET_BITS, (4 * n - 1).bit_length()), MOST_BUCKET_BITS)
    keep, keep_often = BITS - bucket_bits, OFTEN_BITS - bucket_bits

    def send(of: Hashes | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b if wanted is None else wanted(b)
            hashes, docs_of, ids = [], [], np.asarray(b.column("doc_id").fill_null(-(1 << 63)))
            if of is None:
                row, h = listed(b)
                hashes.append(_spread(h))
                docs_of.append(ids[row])
            for lo, _, buf, offs in chunks(*text_buffer(b.column("text")), CHUNK) if of is not None else ():
                row, h = of(buf, offs)
                hashes.append(_spread(h))
                docs_of.append(ids[lo + row])
            h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            if not len(h):
                continue
            d = np.concatenate(docs_of)
            order = np.argsort(h)
            h, d = h[order], d[order]
            head = np.ones(len(h), dtype=bool)
            head[1:] = h[1:] != h[:-1]
            other = np.zeros(len(h), dtype=np.int64)
            other[1:] = ~head[1:] & (d[1:] != d[:-1])
            at = np.flatnonzero(head)
            several = np.add.reduceat(other, at) > 0
            count = np.minimum(np.diff(np.append(at, len(h))), 255).astype(np.uint8)
            u = h[at]
            cut = np.searchsorted((u >> np.uint64(64 - bucket_bits)).astype(np.int64), np.arange((1 << bucket_bits) + 1))
            # 40 bits below the bucket's: a false match only passes a hash on
            tail = ((u << np.uint64(bucket_bits)) >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            rows = [(k, tail[x:y].tobytes(), count[x:y].tobytes(), np.packbits(several[x:y]).tobytes()) for k, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], names=["bucket", "tails", "counts", "several"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for k, t, c, f in zip(*(b.column(x).to_pylist() for x in ("bucket", "tails", "counts", "several")), strict=True):
                x = np.zeros((len(c), 8), np.uint8)
                x[:, :5] = np.frombuffer(t, np.uint8).reshape(-1, 5)
                held.setdefault(k, []).append((x.view("<u8")[:, 0], np.frombuffer(c, np.uint8).astype(np.int64), np.unpackbits(np.frombuffer(f, np.uint8), count=len(c)).astype(bool)))
                if len(held[k]) > 64:
                    held[k] = [_merged(held[k])]
        for k, parts_ in held.items():
            t, count, several = _merged(parts_)
            table, frequent = np.zeros(1 << keep, bool), np.zeros(1 << keep_often, bool)
            table[(t[several] >> np.uint64(40 - keep)).astype(np.int64)] = True
            frequent[(t[count >= often] >> np.uint64(40 - keep_often)).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(table, bitorder="little").tobytes()], pa.binary()), pa.array([np.packbits(frequent, bitorder="little").tobytes()], pa.binary())], names=["bucket", "bits", "often"])

    sent = reduce(DataFrame.unionAll, [df.select("doc_id", "hashes" if of is None else "text").transform(arrow_map, partial(send, of), "bucket int, tails binary, counts binary, several binary") for df, of in parts])
    out = Shared(np.zeros((1 << BITS) >> 3, np.uint8), np.zeros((1 << OFTEN_BITS) >> 3, np.uint8))
    for r in sent.repartition(min(n, 1 << bucket_bits), "bucket").transform(arrow_map, meet, "bucket int, bits binary, often binary").collect():  # 17 MB in all
        for whole, data in zip(out, (r.bits, r.often), strict=True):
            whole[r.bucket * len(data) : (r.bucket + 1) * len(data)] = np.frombuffer(data, np.uint8)
    return out


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of a bucket, how often each occurs, and whether two batches or documents have it."""
    t, c, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(t)
    t, c, s = t[order], c[order], s[order]
    head = np.ones(len(t), dtype=bool)
    head[1:] = t[1:] != t[:-1]
    at = np.flatnonzero(head)
    if not len(at):
        return t, c, s
    return t[at], np.add.reduceat(c, at), (np.diff(np.append(at, len(t))) > 1) | (np.add.reduceat(s, at) > 0)
