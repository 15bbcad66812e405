"""Labelled rows for training: a bounded sample, chosen by hash, of the rows that are not held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text as bytes) of at most ``most`` labelled documents that are not held out: so many rows, whatever repeats.

    The choice is the ``most`` smallest hashes of the id, so it is the same at every run. Null labels are left out; an id
    labelled twice takes the larger label; an id that several rows have takes the text with the smallest hash. A count of the
    labels gives a hash below which about ``most`` and a fifth lie, so that few rows are sorted however many labels there are.
    The chosen ids are broadcast: ``most`` bounds them.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    share = min(1.0, 1.2 * (most + 100) / max(1, usable.count()))
    below = F.xxhash64("id") <= int((share - 0.5) * 2**64) if share < 1 else F.lit(True)
    chosen = usable.where(below).groupBy("id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    # map tasks reduce repeats of an id first, so one that many rows share is no hot key
    return texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
