"""Clusters of structures by the shape of their loops, with what is asked of them afterwards.

    spark-submit jobs/cluster_report.py --tables DIR --out DIR [--config FILE]

Whoever keeps a library of antibody fragments runs this over all of it: which structures have loops of one shape, which one stands for a
cluster, how far its members are from it, and how its paratopes score. The structures are those of the residue view over
``embeddings`` below ``tables``. The job writes

- ``out/members`` (kind, structure, cluster, representative, distance, hotspot_score, rank, and the three loop sequences): a row for each
  structure. ``distance`` is that of its superposed loops to the representative's, 0 for the representative; ``rank`` counts the
  members of a cluster by falling score, then input order; ``kind`` is ``alone`` or ``family``;
- ``out/clusters`` (kind, cluster, representative, members, best, mean_hotspot, widest, loops): a row for each cluster: its best scored member, the
  mean score, the largest distance from the representative, and how many different third loops it has.

Both are partitioned by ``kind`` and replaced as a whole: a run over the same table writes the same rows, whatever was there. An empty
table gives empty folders with the same columns, but for ``kind``.
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.common import command_line, log  # noqa: E402
from loopweave.operators.cluster import structural_clusters  # noqa: E402
from loopweave.operators.features import extract_features  # noqa: E402
from loopweave.operators.geometry import paired_rmsd, structures  # noqa: E402
from loopweave.plans.views import annotated_view  # noqa: E402
from loopweave.schemas import REGIONS  # noqa: E402
from loopweave.storage import scratch, written  # noqa: E402


@dataclass(frozen=True)
class Settings:
    threshold: float = 1.25

    def __post_init__(self):
        if not 0.5 <= self.threshold <= 5.0:
            raise ValueError(f"not possible: {self}")


def members_of(annotated: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``out/members``."""
    structs = written(structures(annotated, "seq_no"), "structures")
    clusters = structural_clusters(structs, threshold)
    far = paired_rmsd(structs, clusters.where("structure_id <> representative").select(F.col("representative").alias("i"), F.col("structure_id").alias("j")))
    scored = extract_features(annotated).select("structure_id", "hotspot_score", *(F.element_at("cdr_sequences", F.lit(r)).alias(r) for r in REGIONS))
    joined = clusters.join(scored, "structure_id").join(far.select(F.col("j").alias("structure_id"), "rmsd"), "structure_id", "left")
    together = Window.partitionBy("structural_cluster")
    kind = F.when(F.count("*").over(together) > 1, "family").otherwise("alone")
    rank = F.row_number().over(together.orderBy(F.desc("hotspot_score"), "seq_no"))
    return joined.select(kind.alias("kind"), F.col("structure_id").alias("structure"), F.col("structural_cluster").alias("cluster"), "representative", F.round(F.coalesce("rmsd", F.lit(0.0)), 6).alias("distance"),
                         F.round("hotspot_score", 9).alias("hotspot_score"), rank.alias("rank"), *(F.col(f"`{r}`").alias(r.lower().replace("-", "_")) for r in REGIONS))


def clusters_of(members: DataFrame) -> DataFrame:
    """The rows of ``out/clusters``."""
    return members.groupBy("kind", "cluster").agg(F.min("representative").alias("representative"), F.count("*").alias("members"), F.min_by("structure", "rank").alias("best"), F.round(F.avg("hotspot_score"), 6).alias("mean_hotspot"),
                                                  F.max("distance").alias("widest"), F.countDistinct("cdr_h3").alias("loops"))


def run(spark: SparkSession, tables: str, out: str, settings: Settings = Settings()) -> None:  # noqa: B008
    """Writes the report over all structures; the job's own tables go when it ends."""
    with scratch():
        annotated = annotated_view(spark, tables)
        members = written(members_of(annotated, settings.threshold), "members")
        members.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/members")
        clusters_of(members).write.mode("overwrite").partitionBy("kind").parquet(f"{out}/clusters")
        log.info("read %s/embeddings; wrote %d structures below %s", tables, members.count(), out)


def output(spark: SparkSession, out: str) -> DataFrame:
    """Every member beside its cluster's row, as both are on disk."""
    clusters = spark.read.parquet(f"{out}/clusters").select("cluster", "members", "best", "mean_hotspot", "widest", "loops")
    return spark.read.parquet(f"{out}/members").join(clusters, "cluster")


if __name__ == "__main__":
    command_line(__doc__, {"tables": "folder with the table embeddings, parquet", "out": "folder of members and clusters"}, Settings, run, "cluster_report.toml")
