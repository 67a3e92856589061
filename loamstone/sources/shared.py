"""Tables in the folder that driver and executors share, to cut the lineage of iterative queries; Arrow batches of bounded bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of an Arrow batch on its way to a Python worker, where the session sets no bound of its own.
BATCH_BYTES = 4 << 20
_LIMIT, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over batches of bounded bytes; the worker's memory is given back when a task ends."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    conf = df.sparkSession.conf
    if conf.get(_LIMIT, _DEFAULT) == _DEFAULT:
        conf.set(_LIMIT, f"{BATCH_BYTES}b")
    return df.mapInArrow(bounded, schema)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset and all is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(spark, "_loamstone_core", None) or tempfile.mkdtemp(prefix="loamstone-core-")
        spark._loamstone_core = found
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back."""
    path = f"{shared_dir(df.sparkSession)}/loamstone-core/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
