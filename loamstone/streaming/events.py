"""Event streams: deduplicated appends, counts, windows and retention with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH_FILES = 32
LATE = "2 days"


def read(spark: SparkSession, path: str, schema, files: int = BATCH_FILES, glob: str | None = None) -> DataFrame:
    """A stream over the Parquet files that appear under ``path``, ``files`` at most in a micro-batch; a slow sink slows it, nothing is dropped."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(path)


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = LATE) -> DataFrame:
    """Each key once, however often it is delivered within ``late``."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, size: str = "1 hour", time: str = "ts", late: str = LATE) -> DataFrame:
    """Counts and sums by window and type; a window is given out once no event can come for it."""
    w = events.withWatermark(time, late).groupBy(F.window(time, size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts", late: str = LATE) -> DataFrame:
    """Sessions of each user: runs of events less than ``gap`` apart."""
    w = events.withWatermark(time, late).groupBy(F.session_window(time, gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def seen_counts(events: DataFrame) -> DataFrame:
    """How often each memory was seen, over the whole stream (complete mode)."""
    return events.groupBy(F.concat(F.lit("m-"), F.col("user_id").cast("string")).alias("memory_id")).agg(F.count("*").alias("seen"))


def upsert(df: DataFrame, path: str, checkpoint: str, key: str = "run_id", time: str = "ts") -> StreamingQuery:
    """Append each micro-batch's new keys to the table at ``path``, which is partitioned by day.

    A batch that is delivered again adds nothing: of the table only the days of the batch are read, and the batch's number
    names its part, which a second delivery overwrites.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key]).withColumn("day", F.to_date(time)).withColumn("batch", F.lit(batch_id))
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            days = [r.day for r in new.select("day").distinct().collect()]  # the days that a batch spans
            old = spark.read.parquet(path).filter(F.col("day").isin(days) & (F.col("batch") != batch_id))
            new = new.join(old.select(key), key, "left_anti")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulate(df: DataFrame, path: str, checkpoint: str, key: str = "memory_id", event: str = "event_id") -> StreamingQuery:
    """Write the counts that each micro-batch adds below ``path``, named by the batch's number; ``accumulated`` sums them.

    A batch that is delivered again overwrites its own counts, so it adds nothing, and what becomes of the events changes no count.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates([event]).groupBy(key).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated(spark: SparkSession, path: str, key: str = "memory_id") -> DataFrame:
    """All that was ever counted, by key."""
    return spark.read.parquet(path).groupBy(key).agg(F.sum("n").alias("n"))


def settled(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run the stream over what is there and return the table that it leaves at ``path``: all rows, or in complete mode the last result."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={'last' if mode == 'complete' else batch_id}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/table/*")


def drained(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run the stream over what is there and return its result as the in-memory table ``name`` (small results only)."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def retained(runs: DataFrame, most: int = 5000) -> DataFrame:
    """The newest ``most`` runs."""
    return runs.orderBy(F.desc("run_id")).limit(most)
