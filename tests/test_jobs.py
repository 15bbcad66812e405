"""The jobs: growing input, reruns, batches that are tried again, and the command line."""

import os
import re
import subprocess
import sys
from collections import Counter, defaultdict

import duckdb
import pytest

from jobs import cluster_report, queries, sequence_mining
from jobs.common import configured

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
LETTERS = set("ACDEFGHIKLMNPQRSTVWY")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FIRST = [(1, "the PEPTIDE ACDEFGHIK and acdefghik, again", "en", "a", 0), (2, None, "en", "a", 0), (3, "", None, None, 0), (4, "GGGGGGGGG" * 9 + " yyyyyyyy1yyyyyyyy", "de", "b", 0), (None, "WWWWWWWW", None, None, 0)]
SECOND = [(5, "acdefghik WWWWWWWW", "fr", "c", 0), (6, "nothing here", "fr", "c", 0), (1, "the PEPTIDE ACDEFGHIK and acdefghik, again", "en", "a", 0)]


def census(rows, least=8, most=40):
    documents, count, sources = defaultdict(set), Counter(), defaultdict(set)
    for doc, text, _, source, _ in rows:
        for run in re.findall("[A-Za-z]+", text or ""):
            if least <= len(run) <= most and set(run.upper()) <= LETTERS:
                documents[run.upper()].add(doc)
                sources[run.upper()].add(source)
                count[run.upper()] += 1
    return {s: (len(documents[s] - {None}), count[s], len(sources[s] - {None}), min(documents[s] - {None}, default=None)) for s in count}


def found(spark, out):
    return {r.sequence: (r.documents, r.occurrences, r.sources, r.first_doc) for r in spark.read.parquet(f"{out}/census").collect()}


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names}


def test_mining_takes_only_what_is_new(spark, tmp_path):
    documents, out, checkpoint = (str(tmp_path / n) for n in ("documents", "out", "checkpoint"))
    run = lambda: sequence_mining.run(spark, documents, out, checkpoint)
    spark.createDataFrame(FIRST, DOCS).coalesce(1).write.parquet(documents)
    run()
    assert found(spark, out) == census(FIRST) and found(spark, out)["ACDEFGHIK"] == (1, 2, 1, 1) and "YYYYYYYY" in found(spark, out)
    before = files(out)
    run()
    assert files(out) == before
    spark.createDataFrame(SECOND, DOCS).coalesce(1).write.mode("append").parquet(documents)
    run()
    # document 1 came twice: one document, four occurrences; the letter y had nothing new, so its files are the old ones
    assert found(spark, out) == census(FIRST + SECOND) and found(spark, out)["ACDEFGHIK"] == (2, 5, 2, 1)
    assert {f for f in before if "/census/head=Y/" in f} <= files(out).keys() and sorted(r.batch for r in spark.read.parquet(f"{out}/hits").select("batch").distinct().collect()) == [0, 1]
    # as if the job had died after it wrote the last batch and before it said so
    want = sorted(map(tuple, sequence_mining.output(spark, out).collect()), key=str)
    for name in os.listdir(f"{checkpoint}/commits"):
        if name.strip(".").startswith("1"):
            os.remove(f"{checkpoint}/commits/{name}")
    run()
    assert sorted(map(tuple, sequence_mining.output(spark, out).collect()), key=str) == want


def test_tasks_of_the_census_are_bounded(spark, monkeypatch):
    """One file of many hits, most of one sequence, is dealt to as many tasks as its hits ask for."""
    monkeypatch.setattr(sequence_mining, "TASK_HITS", 50)
    rows = [("A", k, f"s{k % 7}", "en", "ACDEFGHI" if k % 10 else f"ACDEFGH{'ACDEF'[k // 10 % 5]}", 2, 0) for k in range(1000)]
    hits = spark.createDataFrame(rows, "head string, doc_id long, source string, lang string, sequence string, occurrences long, batch long").coalesce(1)
    census = sequence_mining.census_of(hits)
    assert "hashpartitioning(head#" in (plan := census._jdf.queryExecution().executedPlan().toString()) and ", 20), REPARTITION_BY_NUM" in plan
    assert {r.sequence: (r.documents, r.occurrences, r.sources, r.first_doc) for r in census.collect()} == {"ACDEFGHI": (900, 1800, 7, 1), **{f"ACDEFGH{c}": (20, 40, 7, 10 * k) for k, c in enumerate("ACDEF")}}


def test_mining_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents"))
    sequence_mining.run(spark, str(tmp_path / "documents"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), sequence_mining.Settings(files_a_batch=1))
    assert spark.read.schema(sequence_mining.HITS).parquet(str(tmp_path / "out/hits")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    answer = duck.execute(queries.SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[names.index(c)] for c in columns) for r in answer.fetchall()), key=str)


def test_report_is_replaced(spark, tmp_path):
    """Another threshold leaves other kinds; nothing of the earlier run stays."""
    os.makedirs(tmp_path / "tables")
    spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 30").coalesce(1).write.parquet(str(tmp_path / "tables/embeddings.parquet"))
    run = lambda t: cluster_report.run(spark, str(tmp_path / "tables"), str(tmp_path / "out"), cluster_report.Settings(t))
    run(0.5)
    fine = cluster_report.output(spark, str(tmp_path / "out")).collect()
    assert len(fine) == 30 and {r.kind for r in fine} == {"alone", "family"} and all(r.distance < 0.5 and (r.distance == 0) == (r.structure == r.representative) for r in fine)
    run(1.25)
    rows = cluster_report.output(spark, str(tmp_path / "out")).collect()
    assert len(rows) == 30 and {(r.cluster, r.representative, r.members, r.kind) for r in rows} == {(k, str(10 * k), 10, "family") for k in range(3)}
    for k in range(3):
        family = sorted((r for r in rows if r.cluster == k), key=lambda r: r.rank)
        assert [r.rank for r in family] == list(range(1, 11)) and family[0].structure == family[0].best and family[0].hotspot_score == max(r.hotspot_score for r in family)
        assert family[0].widest == max(r.distance for r in family) and family[0].loops == len({r.cdr_h3 for r in family})


def test_settings(tmp_path):
    (tmp_path / "s.toml").write_text("least = 5\n")
    assert configured(sequence_mining.Settings, str(tmp_path / "s.toml")) == sequence_mining.Settings(least=5)
    (tmp_path / "s.toml").write_text("leest = 5\n")
    with pytest.raises(ValueError, match="leest"):
        configured(sequence_mining.Settings, str(tmp_path / "s.toml"))
    for wrong in (lambda: sequence_mining.Settings(least=0), lambda: sequence_mining.Settings(9, 8), lambda: cluster_report.Settings(9.0)):
        with pytest.raises(ValueError, match="not possible"):
            wrong()
    for job, kind in (("sequence_mining", sequence_mining.Settings), ("cluster_report", cluster_report.Settings)):
        assert configured(kind, os.path.join(ROOT, "jobs", f"{job}.toml")) == kind()


def test_command_line(tmp_path):
    args = [sys.executable, os.path.join(ROOT, "jobs", "sequence_mining.py"), "--documents", f"{SF}/documents.parquet", "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "checkpoint")]
    done = subprocess.run(args, capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert done.returncode == 0 and "read 200 new documents" in done.stderr and "wrote hits and census" in done.stderr, done.stderr[-2000:]
    assert duckdb.sql(f"select count(*) from '{tmp_path}/out/census/*/*.parquet'").fetchall()[0][0] > 100
