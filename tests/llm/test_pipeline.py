"""Stages on whole small tables, each against a plain restatement of what it decides."""

import pytest

import __spark_entry__
import corpus_pipeline
from netloom.llm import linededup
from netloom.plans.session import cut


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, sf_dir))
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_keep_columns_and_never_invent(steps, spark, sf_dir):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    for _, before, after in steps[:-1]:
        assert after.columns == columns and ids(after) <= ids(before)
    assert ids(steps[-1][2]) == ids(steps[-1][1])


def test_decisions(steps):
    from test_operators import brute_contamination, brute_groups, brute_print

    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    assert ids(steps[0][2]) == {i for i, t in text(steps[0][1]).items() if t and any(c.isalpha() for c in t)}
    # tests/llm/test_lines.py holds what the operator returns against brute force
    left = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(steps[1][1]).collect()}
    assert text(steps[1][2]) == {i: t for i, t in left.items() if t.strip(" \n") or t == text(steps[1][1])[i]}
    rows = sorted(text(steps[2][1]).items())
    roots = brute_groups([brute_print(t) for _, t in rows])
    assert ids(steps[2][2]) == {rows[r][0] for r in set(roots)}
    items = [(r["item_id"], r["text"]) for r in steps[0][1].sparkSession.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    small = dict(list(text(steps[3][1]).items())[:60])
    bad = {d for d, _ in brute_contamination(list(small.items()), items)}
    assert ids(steps[3][2]) & set(small) == set(small) - bad


def test_stages_on_odd_input(spark, sf_dir):
    from test_operators import ODD, SCHEMA

    odd = spark.createDataFrame(ODD, SCHEMA).drop("word")
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() >= 0 and (n or out.count() == 0)


def test_registration(spark, sf_dir):
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(__spark_entry__.llm_queries.oracle_sql()))
def test_queries_with_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()[name](spark, sf_dir)
    assert got.columns == columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
