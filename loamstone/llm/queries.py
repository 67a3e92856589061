"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm.common import table


#: The key of the surrogates in the registered queries; a deployment has a secret one of its own.
PII_KEY = "loamstone"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the public tokenizers installed beside Python; the byte-level one if none is named."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstone.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstone.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=(9, 10)).select("doc_id", "n_shingles", "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstone.llm.decontaminate import contained

    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstone.llm.lattice_lm import scored

    return scored(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstone.llm.suffix_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstone.llm.sharding import sharded

    out = sharded(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstone.llm.pii import replaced

    return replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstone.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstone.llm.quality import verdicts

    out = verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstone.llm.passages import passages

    return passages(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstone.llm.centroids import clustered

    return clustered(table(spark, sf_dir, "embeddings"), k=16, rounds=3)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstone.llm.periodic_runs import digests

    return digests(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstone.llm.token_counts import counted

    return counted(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_ngram_jaccard_join, op3_decontamination, op4_lattice_lm, op5_suffix_dedup, op6_sharding, op7_pii, op8_bpe, op9_quality_rules, op10_passages, op11_centroid_clustering, op12_periodic_runs, op13_token_counts)}
