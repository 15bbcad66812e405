"""Deterministic views over the driver's tables: structures made from embeddings, as DataFrame and as SQL.

Ten consecutive vectors are a family: copies of one base structure with small changes, each turned and moved rigidly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.annotate import annotate
from ..schemas import ALPHABET


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, own, base): each vector beside the first of its family."""
    a = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("own"))
    b = table(spark, sf_dir, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("_base"), F.col("embedding").alias("base"))
    return a.join(b, F.col("vec_id") - F.col("vec_id") % 10 == F.col("_base")).drop("_base")


def residue_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues with the columns of the residue schema, and seq_no, the input order of structures."""
    k, v = F.col("k"), F.col("vec_id")
    rows = with_base(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20)))).where((F.floor(v / 10) + k) % 11 != 0)
    raw = [30 * F.get("base", 3 * k + c).cast("double") + 1.5 * F.get("own", 3 * k + c).cast("double") for c in range(3)]
    rows = rows.select("vec_id", "label", "k", raw[0].alias("x0"), raw[1].alias("y0"), raw[2].alias("z0"))
    turn = v % 4
    x = F.when(turn == 0, F.col("x0")).when(turn == 1, -F.col("y0")).when(turn == 2, -F.col("x0")).otherwise(F.col("y0")) + v % 7
    y = F.when(turn == 0, F.col("y0")).when(turn == 1, F.col("x0")).when(turn == 2, -F.col("y0")).otherwise(-F.col("x0")) - v % 5
    letter = F.substring(F.lit(ALPHABET), (1 + (v * 7 + k * 3 + F.col("label")) % 20).cast("int"), F.lit(1))
    return rows.select(v.cast("string").alias("structure_id"), v.alias("seq_no"), k.alias("ordinal"), F.lit("A").alias("chain_id"), (1 + 6 * k).alias("res_seq"), F.lit("").alias("icode"), F.lit("UNK").alias("res_name"), letter.alias("one_letter"),
                       x.alias("ca_x"), y.alias("ca_y"), (F.col("z0") + v % 3).alias("ca_z"), (20 + (v + k) % 50).cast("double").alias("b_factor"))


def annotated_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(residue_view(spark, sf_dir))


#: The same as common table expressions.
SQL = f"""
own as (select a.vec_id, a.label, a.embedding as own, b.embedding as base from embeddings a join embeddings b on b.vec_id = a.vec_id - a.vec_id % 10),
raw as (
  select vec_id, label, k, 30 * base[3*k+1]::double + 1.5::double * own[3*k+1]::double as x0, 30 * base[3*k+2]::double + 1.5::double * own[3*k+2]::double as y0, 30 * base[3*k+3]::double + 1.5::double * own[3*k+3]::double as z0
  from (select *, unnest(generate_series(0, 20))::int as k from own) where (vec_id // 10 + k) % 11 <> 0
),
residues as (
  select vec_id, vec_id::varchar as structure_id, k as ordinal, (1 + 6 * k)::int as res_seq, substr('{ALPHABET}', (1 + (vec_id * 7 + k * 3 + label) % 20)::int, 1) as one_letter,
    case vec_id % 4 when 0 then x0 when 1 then -y0 when 2 then -x0 else y0 end + vec_id % 7 as x,
    case vec_id % 4 when 0 then y0 when 1 then x0 when 2 then -y0 else -x0 end - vec_id % 5 as y,
    z0 + vec_id % 3 as z, (20 + (vec_id + k) % 50)::double as b_factor
  from raw
),
annotated as (
  select *, case when res_seq between 27 and 38 then 'CDR-H1' when res_seq between 56 and 65 then 'CDR-H2' when res_seq between 105 and 117 then 'CDR-H3' else 'framework' end as region from residues
)
"""
