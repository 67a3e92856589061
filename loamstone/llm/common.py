"""Session helpers shared by the corpus operators: shared-folder tables, skew-safe joins, table readers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch on its way to a Python worker, where the session sets no bound of its own.
BATCH_BYTES = 4 << 20
_LIMIT, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"


def _release() -> None:
    """Give back to the system what the last task's arrays took; Python workers are used again and again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        return


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over batches of bounded bytes; the worker's memory is given back when a task ends."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    conf = df.sparkSession.conf
    if conf.get(_LIMIT, _DEFAULT) == _DEFAULT:
        conf.set(_LIMIT, f"{BATCH_BYTES}b")
    return df.mapInArrow(bounded, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset and all is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = getattr(spark, "_loamstone_shared", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="loamstone-")
        spark._loamstone_shared = own
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/loamstone/{name}-{uuid.uuid4().hex}"


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def materialize(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table: its lineage is cut, and a lost executor costs nothing.

    Within ``scratch`` the table goes at the scope's end, or if ``outer`` at the end of the scope around it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    scopes = _scopes.get()
    if len(scopes) > int(outer):
        scopes[-1 - int(outer)].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope for tables that nothing reads after it; shuffle files and broadcasts that nothing refers to go with them."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in made:
            _delete(spark, path)
        gc.collect()
        spark._jvm.System.gc()  # Spark's cleaner waits for the driver's collector, which a driver with little to do doesn't start


def _delete(spark: SparkSession, file: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` made, once nothing reads it any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, file)


_OTHER = 0x5DEECE66D


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where ``right`` has each key once and ``left`` may have a third of its rows under one key.

    Both sides are joined on an expression over the keys that Spark doesn't know to be the key of an earlier exchange, so
    either side gets an exchange of its own. That is what lets the adaptive planner split a hot key's partition; a side
    that keeps the exchange of an aggregate can't be split. The expression is evaluated in the exchange and costs no
    column of ``left``. Null keys meet nothing.
    """
    others = [c for c in right.columns if c not in keys]
    if len(keys) == 1 and dict(left.dtypes)[keys[0]] == dict(right.dtypes)[keys[0]] == "bigint":
        r = right.select(F.col(keys[0]).bitwiseXOR(F.lit(_OTHER)).alias("__rk"), *others)
        return left.join(r, F.col(keys[0]).bitwiseXOR(F.lit(_OTHER)) == F.col("__rk"), how).drop("__rk")
    r = right.select(F.xxhash64(*keys).alias("__rk"), *[F.col(k).alias(f"__r_{k}") for k in keys], *others)
    on = F.xxhash64(*[left[k] for k in keys]) == F.col("__rk")
    for k in keys:
        on = on & (left[k] == F.col(f"__r_{k}"))
    return left.join(r, on, how).drop("__rk", *[f"__r_{k}" for k in keys])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
