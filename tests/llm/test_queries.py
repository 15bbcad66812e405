"""The registered queries over their whole tables, against SQL where SQL can say them, and the pipeline stage by stage."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from loopweave.llm import queries

SF = "/root/testdata/sf0.001"


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    columns, got = rows(queries.QUERIES[name](spark, SF))
    found = duck.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)


def test_registered():
    known = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in known if n.startswith("op")} == set(range(1, 13)) and "pipeline" in known


ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, key string, row string, value string"


def test_stages_on_odd_tables(spark):
    """Null, empty, white and very long texts, repeated rows, ties, a null id, clashing names, and empty tables."""
    plain = [" ".join(f"w{k}x{j}" for j in range(80)) + "." for k in range(12)]
    texts = [(1, None), (2, ""), (3, " \n "), *((10 + k, t) for k, t in enumerate(plain)), (10, plain[0]), (40, plain[3]), (None, plain[5] + "\nline two\nline three\nline four"),
             (50, " ".join(f"long{k} word" for k in range(60_000)))]
    docs = spark.createDataFrame([(i, t, None, None, None, *"abcde") for i, t in texts], ODD_COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id is not None, r.doc_id or 0) for r in df.collect())
    judged = stage["quality rules"](spark, docs, SF)
    assert judged.columns == docs.columns and not {1, 2, 3} & {i for _, i in ids(judged)}
    lined = stage["line dedup"](spark, docs, SF)
    # equal texts of one line keep their first: 40 repeats 13; the rows of 10 are one document
    assert lined.columns == docs.columns and {i for _, i in ids(lined)} == {0, 1, 2, 3, *range(10, 22), 50} and ids(lined).count((True, 10)) == 2
    near = stage["MinHash near-dedup"](spark, docs, SF)
    assert near.columns == docs.columns and (True, 40) not in ids(near) and ids(near).count((True, 10)) == 2 and (False, 0) in ids(near)
    clean = stage["benchmark decontamination"](spark, docs, SF)
    assert ids(clean) == ids(docs)
    packed = stage["best-fit packing"](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        after = docs.count()
        assert 0 < after <= before
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert rows(last)[1] == rows(corpus_pipeline.run(spark, SF))[1]
    assert {r.doc_id for r in last.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
