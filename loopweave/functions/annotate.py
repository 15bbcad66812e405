"""Region labels from residue positions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FRAMEWORK, REGION_RANGES


def region_of(position: Column) -> Column:
    """The region whose range holds the position, both ends included; framework otherwise and for null."""
    out = None
    for name, (low, high) in REGION_RANGES.items():
        test = position.between(low, high)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(FRAMEWORK)


def classify_ranges(values: DataFrame, value: str, ranges: DataFrame, default: str = FRAMEWORK) -> DataFrame:
    """``values`` with a column ``region``: the label of ``ranges`` (label, lo, hi; both ends included) that holds the value, of
    several the first by low end, then label; ``default`` without any and for null.

    General form of ``region_of`` for a table of ranges, of any number and length: a range lies in one or two cells of the
    smallest power of two that is as long as it, and a distinct value is looked up in its cell of each power that occurs (at
    most 64), so the join is an equality. An empty range holds nothing.
    """
    number = F.col(value).cast("double")
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("_level")))
    sized = ranges.where("lo <= hi").select("label", "lo", "hi", F.ceil(F.log2(F.col("hi") - F.col("lo") + 1.0)).cast("int").alias("_level"))
    cells = sized.select("*", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("_cell"))
    levels = sized.agg(F.collect_set("_level").alias("_levels"))
    asked = values.select(number.alias("_v")).where("_v is not null").distinct().crossJoin(F.broadcast(levels)).select("_v", F.explode("_levels").alias("_level")).withColumn("_cell", cell(F.col("_v")))
    found = asked.join(cells, ["_level", "_cell"]).where("_v between lo and hi").groupBy("_v").agg(F.min(F.struct("lo", "label")).alias("_r"))
    return values.join(found, number == F.col("_v"), "left").withColumn("region", F.coalesce("_r.label", F.lit(default))).drop("_v", "_r")


def annotate(residues: DataFrame, renumber=None) -> DataFrame:
    """Residues with ``imgt_pos`` and ``region``. The position is the file's residue number, unless ``renumber`` is given: a
    function from a sequence to its positions (or None), run once for each structure; a residue beyond what it returns or without
    a position, or a structure for which it fails, keeps the file's number. ``numbering.Aligner`` is such a function, for many sequences
    at once."""
    if renumber is None:
        return residues.withColumn("imgt_pos", F.col("res_seq")).withColumn("region", region_of(F.col("imgt_pos")))

    def run(batches):
        for batch in batches:
            out = renumber.many(batch.column(1).to_pylist()) if hasattr(renumber, "many") else []
            for letters in [] if out else batch.column(1).to_pylist():
                try:
                    out.append(renumber(letters))
                except Exception:  # a plug-in may fail on any sequence; the file's numbers then hold
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["structure_id", "positions"])

    letters = residues.groupBy("structure_id").agg(F.expr("listagg(one_letter, '') within group (order by ordinal)").alias("sequence"))
    found = letters.mapInArrow(run, "structure_id string, positions array<int>")
    place = F.row_number().over(Window.partitionBy("structure_id").orderBy("ordinal")) - 1
    out = residues.withColumn("_place", place).join(found, "structure_id", "left")
    position = F.coalesce(F.get("positions", F.col("_place")), F.col("res_seq"))
    return out.withColumn("imgt_pos", position).withColumn("region", region_of(F.col("imgt_pos"))).drop("_place", "positions")
