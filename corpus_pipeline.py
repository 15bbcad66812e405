"""Corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``, which may have others beside ``doc_id`` and ``text``, of any names. ``run`` writes every stage's result to the
shared folder and rereads it as the next one's input, so a lost executor never costs more than the stage at hand; a stage's
own tables, and its input, go once its result is written.

Odd rows. A document of null or empty text goes at the first stage, as does every other that the base rules fail. Rows
repeated alike are one document to line dedup and to decontamination; near-dedup keeps all rows of the id that stays; packing
packs each row. Ties are broken by the smallest id. Null ids stay. Every stage turns an empty table into an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.llm import decontam, line_dedup, neardup, packing, rules
from loopweave.llm.common import discard, keep, scratch, table, written
from loopweave.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of later occurrences of a repeated three-line window go; a document of which no line stays goes. ``n_chars``, if the
    table has it, follows the text that is left."""
    out = line_dedup.deduplicated(docs).where("_n_removed = 0 or _n_removed < _n_lines")
    size = lambda c: F.when(F.col("_n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return out.select(*(size(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return neardup.one_of_each(docs, 5, 80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return packing.packed(docs, vocabulary(), 2048, 0)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the boosted trees nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch():
            docs = keep(written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower()))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
