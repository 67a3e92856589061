"""Arrays of fixed size summed over all rows of a table: frequency sketches and membership bits."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.common import arrow_map

PARTS = 16
#: Membership bits: 1 MB, whatever the number of members. When they fill up, more non-members pass; members always do.
MEMBER_BITS = 23
#: Keys that are broadcast at most: 8 MB.
BROADCAST = 1 << 20


def summed_counters(df: DataFrame, count: Callable[[pa.RecordBatch, np.ndarray], None], size: int, finish: Callable[[np.ndarray], np.ndarray], kind: type = np.int64) -> np.ndarray:
    """Sum over all partitions of the ``size`` counters that ``count(batch, counters)`` adds to; ``finish`` gives the bytes to collect.

    Each task holds one array, of numbers of that kind; what it sends is compressed and summed in PARTS tasks, batch by batch.
    """
    part = size // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=kind)
        for b in batches:
            count(b, total)
        packed = [zlib.compress(_narrow(total[i * part : (i + 1) * part]), 1) for i in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for p, c in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
                if p in total:
                    total[p] += _widen(zlib.decompress(c))
                else:
                    total[p] = _widen(zlib.decompress(c))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([finish(c).tobytes() for c in total.values()], pa.binary())], names=["part", "counts"])

    rows = df.transform(arrow_map, run, "part int, counts binary").repartition(PARTS, "part").transform(arrow_map, add, "part int, counts binary").collect()
    empty = finish(np.zeros(part, dtype=np.int64))
    out = np.tile(empty, PARTS)
    for r in rows:
        out[r.part * len(empty) : (r.part + 1) * len(empty)] = np.frombuffer(r.counts, empty.dtype)
    return out


def _narrow(c: np.ndarray) -> bytes:
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if c.max(initial=0) <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + c.astype(kind).tobytes()


def _widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[data[0]], offset=1).astype(np.int64)


def _slots(col: pa.Array) -> np.ndarray:
    x = np.asarray(col.fill_null(0), dtype=np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - MEMBER_BITS)).astype(np.int64)


def member_bits(df: DataFrame, column: str) -> np.ndarray:
    """Bits over the hashes of the long values of ``column``."""

    def count(b: pa.RecordBatch, total: np.ndarray) -> None:
        total[_slots(b.column(0))] = 1

    return summed_counters(df.select(column), count, 1 << MEMBER_BITS, lambda c: np.packbits(c > 0, bitorder="little"), np.uint8)


def maybe_member_of(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def maybe_member(bits: np.ndarray, col: pa.Array) -> np.ndarray:
    """False for values that are not members for certain."""
    return maybe_member_of(bits, _slots(col))


def without_members(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows whose ``key`` (a long) is in ``gone``; null keys stay.

    Up to BROADCAST keys are counted and broadcast; beyond, rows that are none for certain aren't moved.
    """
    if gone.limit(BROADCAST + 1).count() <= BROADCAST:
        return df.join(F.broadcast(gone.select(key)), key, "left_anti").select(*df.columns)
    bits = df.sparkSession.sparkContext.broadcast(member_bits(gone, key))

    def rows(member: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(maybe_member(bits.value, b.column(key)) == member))

        return run

    maybe = df.transform(arrow_map, rows(True), df.schema).join(gone.select(key), key, "left_anti").select(*df.columns)
    return df.transform(arrow_map, rows(False), df.schema).unionByName(maybe)
