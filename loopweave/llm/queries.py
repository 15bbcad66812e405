"""The registered queries opN_<name> of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, line_dedup, neardup, secret_scan, spelling, vantage
from .additive import quality_scores
from .common import table
from .neardup import near_duplicates
from .packing import packed
from .rules import quality_rules
from .tokens import token_counts
from .toxicity import toxicity_scores


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.3)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(chat.PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.PROBE_TEXT).alias("text"))
    return chat.turn_digests(chat.format_conversations(turns.unionByName(probe)))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries: blobs whose address starts with 0 to 7 are scanned first, then all documents with that ledger. The
    result is the second scan's, over the whole table."""
    docs = table(spark, sf_dir, "documents")
    _, ledger = secret_scan.scan(docs.where(F.sha2(F.coalesce("text", F.lit("")), 256) < "8"))
    findings, _ = secret_scan.scan(docs, ledger)
    return secret_scan.digests(findings)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary(), 512)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.5)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary(), 2048, 0)


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vantage.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return vantage.nearest(rows.where(F.col("id") % 20 == 0), rows, 20, vantage.EXACT)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spelling.corpus_words(table(spark, sf_dir, "documents"), spoil=31), 10)


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_quality_rules, op3_chat_formatting, op4_decontamination, op5_secret_scan, op6_line_dedup, op7_token_counts, op8_near_dedup, op9_toxicity, op10_best_fit_packing, op11_nearest_neighbours, op12_spelling_variants)}
SQL: dict[str, str] = {"op3_chat_formatting": chat.SQL, "op4_decontamination": decontam.SQL, "op5_secret_scan": secret_scan.SQL, "op6_line_dedup": line_dedup.SQL, "op8_near_dedup": neardup.SQL, "op11_nearest_neighbours": vantage.SQL, "op12_spelling_variants": spelling.SQL}
