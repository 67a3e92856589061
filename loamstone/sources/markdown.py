"""Markdown memory files as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind of memory by the type in a file's front matter (fixed values).
KINDS = {"feedback": "procedural", "project": "episodic", "user": "semantic", "reference": "semantic"}
MAX_CHARS = 6000


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """name, description, kind, content and hash of each ``*.md`` file under ``path`` but MEMORY.md."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    head = F.regexp_extract("value", r"(?s)\A---\s*\n(.*?)\n---", 1)
    field = lambda k: F.trim(F.regexp_extract(head, rf"(?m)^[ \t]*{k}:[ \t]*(.*)$", 1))
    described = F.btrim(field("description"), F.lit('"'))
    body = F.btrim(F.regexp_replace("value", r"(?s)\A---\s*\n.*?\n---[ \t]*\n?", ""), F.lit(" \t\r\n"))
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[field("type")], F.lit("semantic"))
    stem = F.regexp_replace("file", r"\.md$", "")
    df = files.filter("file <> 'MEMORY.md'").select(F.when(field("name") == "", stem).otherwise(field("name")).alias("name"), described.alias("description"), kind.alias("kind"), F.substring(F.when(described == "", body).otherwise(F.concat(described, F.lit("\n\n"), body)), 1, MAX_CHARS).alias("content"))
    return df.withColumn("hash", F.md5(F.col("content").cast("binary")))
