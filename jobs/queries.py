"""The registered queries of the jobs and their SQL: each runs its job twice into one new folder and returns what is there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loopweave.plans.registry import FEATURE_SQL, LETTERS_SQL, SHARE_SQL, SUPERPOSED_SQL
from loopweave.plans.views import SQL as VIEW
from loopweave.schemas import ALPHABET, AROMATIC, HYDROPHOBIC, NEGATIVE, POLAR, POSITIVE, REGIONS
from loopweave.storage import shared_dir

from . import cluster_report, sequence_mining


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder; its files stay."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_sequence_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds no new file."""
    out = _folder(spark, "sequence-mining")
    for _ in range(2):
        sequence_mining.run(spark, f"{sf_dir}/documents.parquet", out, f"{out}/checkpoint")
    return sequence_mining.output(spark, out)


def job2_cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run replaces the first one's output."""
    out = _folder(spark, "cluster-report")
    for _ in range(2):
        cluster_report.run(spark, sf_dir, out)
    return cluster_report.output(spark, out)


_SHARES = {"pos_frac": POSITIVE, "neg_frac": NEGATIVE, "hydro": HYDROPHOBIC, "polar": POLAR, "aromatic": AROMATIC}
_NAMES = {r: r.lower().replace("-", "_") for r in REGIONS}

QUERIES = {f.__name__: f for f in (job1_sequence_mining, job2_cluster_report)}
SQL = {
    "job1_sequence_mining": f"""with runs as (select doc_id, source, lang, upper(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as sequence from documents),
 hits as (select doc_id, source, lang, sequence, count(*) as in_document from runs where length(sequence) between 8 and 40 and regexp_full_match(sequence, '[{ALPHABET}]+') group by all),
 census as (select sequence, count(distinct doc_id) as documents, sum(in_document)::bigint as occurrences, count(distinct source) as sources, min(doc_id) as first_doc from hits group by sequence)
 select hits.*, documents, occurrences, sources, first_doc, length(sequence)::int as length, round({SHARE_SQL("sequence", POSITIVE)} - {SHARE_SQL("sequence", NEGATIVE)}, 9) as net_charge,
 {", ".join(f"round({SHARE_SQL('sequence', letters)}, 9) as {n}" for n, letters in _SHARES.items())} from hits join census using (sequence)""",
    # as in structural_cluster, complete linkage is the components where these are cliques; one that is none gives a null and so a mismatch
    "job2_cluster_report": f"""with {VIEW}, {LETTERS_SQL}, {SUPERPOSED_SQL}, close_by as materialized (select vi, vj, rmsd from superposed where rmsd < 1.25 union all select vj, vi, rmsd from superposed where rmsd < 1.25 union all select vec_id, vec_id, 0 from embeddings),
 firsts as (select vi, min(vj) as f, count(*) as n from close_by group by vi), sizes as (select f, count(*) as m from firsts group by f),
 named as (select vi, case when n = m then f end as f, (dense_rank() over (order by f) - 1)::int as cluster from firsts join sizes using (f)),
 members as materialized (select case when count(*) over (partition by cluster) > 1 then 'family' else 'alone' end as kind, vi::varchar as structure, cluster, f::varchar as representative, round(c.rmsd, 6) + 0.0::double as distance, round({FEATURE_SQL['hotspot_score']}, 9) as hotspot_score,
  row_number() over (partition by cluster order by {FEATURE_SQL['hotspot_score']} desc, vi)::int as rank, {", ".join(f'"{r}" as {n}' for r, n in _NAMES.items())} from named join letters l on l.structure_id = vi::varchar join close_by c using (vi) where c.vj = f),
 clusters as (select cluster, count(*) as members, arg_min(structure, rank) as best, round(avg(hotspot_score), 6) as mean_hotspot, max(distance) as widest, count(distinct cdr_h3) as loops from members group by cluster)
 select * from members join clusters using (cluster)""",
}
