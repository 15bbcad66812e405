"""Peptide-like sequences in a growing table of texts, described as the loops of structures are.

    spark-submit jobs/sequence_mining.py --documents DIR --out DIR --checkpoint DIR [--config FILE]

Whoever compares loops of antibody fragments wants to know which sequences papers, patents and notes mention. A sequence is a longest run
of ASCII letters, in either case, that are all letters of residues, of ``least`` to ``most`` letters. The job keeps

- ``out/hits`` (head, batch, doc_id, source, lang, sequence, occurrences): a row for each document and sequence in it;
- ``out/census`` (head, sequence, documents, occurrences, sources, first_doc, length, and its shares of charged, hydrophobic, polar and aromatic
  residues): a row for each sequence over all documents so far. ``head`` is the sequence's first letter.

It is a file stream: the checkpoint knows the files that were read, and a run takes all new ones, ``files_a_batch`` at a time, and ends. A batch
writes its hits into partitions of its own number and computes the census of the letters it has hits of from the hits of those letters alone;
a batch that is tried again replaces what it had written. A run without new files changes nothing. A document that is delivered
again counts once in ``documents`` and adds to ``occurrences``. A null text has no sequences; null ids, sources and languages
stay null and are not counted as ids or sources.
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.common import command_line, log, replace_partitions  # noqa: E402
from loopweave.operators.features import sequence_shares  # noqa: E402
from loopweave.schemas import ALPHABET  # noqa: E402

#: The columns that are read; a table may have others.
DOCUMENTS = "doc_id long, text string, lang string, source string"
#: Hits that a task of the census takes: what it holds before the shuffle is three rows for each, however large the files are.
TASK_HITS = 200_000
HITS = "doc_id long, source string, lang string, sequence string, occurrences long, head string, batch long"


@dataclass(frozen=True)
class Settings:
    least: int = 8
    most: int = 40
    files_a_batch: int = 1000

    def __post_init__(self):
        if not 1 <= self.least <= self.most or self.files_a_batch < 1:
            raise ValueError(f"not possible: {self}")


def hits_of(documents: DataFrame, settings: Settings) -> DataFrame:
    """(head, doc_id, source, lang, sequence, occurrences) of documents."""
    run = F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)))
    found = documents.select("doc_id", "source", "lang", run.alias("run")).where(F.length("run").between(settings.least, settings.most))
    named = found.withColumn("sequence", F.upper("run")).where(F.col("sequence").rlike(f"^[{ALPHABET}]+$"))
    counted = named.groupBy("doc_id", "source", "lang", "sequence").agg(F.count("*").alias("occurrences"))
    return counted.select(F.substring("sequence", 1, 1).alias("head"), "doc_id", "source", "lang", "sequence", "occurrences")


def census_of(hits: DataFrame) -> DataFrame:
    hits = hits.repartition(max(1, -(-hits.count() // TASK_HITS)), "head", "sequence", "doc_id")
    counted = hits.groupBy("head", "sequence").agg(F.countDistinct("doc_id").alias("documents"), F.sum("occurrences").alias("occurrences"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("first_doc"))
    shares = sequence_shares(F.col("sequence"))
    return counted.select("*", F.length("sequence").alias("length"), *(F.round(c, 9).alias(n) for n, c in shares.items()))


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, settings: Settings = Settings()) -> None:  # noqa: B008
    """Takes the files of ``documents`` (parquet) that are new since the last run with this checkpoint, and returns when all are in."""
    def batch(rows: DataFrame, number: int) -> None:
        replace_partitions(hits_of(rows, settings).withColumn("batch", F.lit(number)), f"{out}/hits", "head", "batch")
        hits = spark.read.schema(HITS).parquet(f"{out}/hits")
        heads = [r.head for r in hits.where(F.col("batch") == number).groupBy("head").agg(F.count("*").alias("n")).collect()]  # letters
        if heads:
            replace_partitions(census_of(hits.where(F.col("head").isin(heads))), f"{out}/census", "head")
        log.info("batch %d: wrote hits and census of %d letters below %s", number, len(heads), out)

    path = documents.rstrip("/")
    if path[-1].isalnum():  # a stream takes a folder or a pattern; as a pattern, a table that is one file will do as well
        path = f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", settings.files_a_batch).parquet(path)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new documents from %s", sum(p.numInputRows for p in query.recentProgress), documents)


def output(spark: SparkSession, out: str) -> DataFrame:
    """Every hit beside its sequence's row of the census, as both are on disk."""
    hits = spark.read.parquet(f"{out}/hits").select("doc_id", "source", "lang", "sequence", F.col("occurrences").alias("in_document"))
    return hits.join(spark.read.parquet(f"{out}/census").drop("head"), "sequence")


if __name__ == "__main__":
    command_line(__doc__, {"documents": "table of texts, parquet", "out": "folder of hits and census", "checkpoint": "folder of the stream's progress"}, Settings, run, "sequence_mining.toml")
