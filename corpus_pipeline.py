"""A corpus pipeline of five stages over ``documents``; each stage works on all that the stage before it kept.

Stages that filter drop documents and keep their columns; PII rewrites the text; the last stage adds the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamstone.llm.bpe import encoded_documents
from loamstone.llm.common import materialize, scratch, table
from loamstone.llm.decontaminate import without_contained
from loamstone.llm.ngram_join import keep_one
from loamstone.llm.pii import replaced
from loamstone.llm.quality import keep_good
from loamstone.llm.queries import PII_KEY, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 over five-word shingles."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_contained(docs, table(spark, sf_dir, "benchmark"))


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the text."""
    from pyspark.sql import functions as F

    out = replaced(docs, PII_KEY).select(*docs.columns)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNull(), None).otherwise(F.char_length("text").cast("long"))) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their tokens."""
    return encoded_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("pseudonymize", pseudonymize), ("encode", encode)]

#: SQL can't express surrogates and subwords; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each keeps is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what the stage wrote for itself goes with it
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
