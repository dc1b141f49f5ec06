"""The pipeline, stage by stage, against what each stage must do."""

import os

import duckdb
import pytest

import corpus_pipeline as pipeline
from tests.llm.test_ops import WORD, brute_join
from tidegraph.llm import queries
from tidegraph.llm.line_crf import fit, judge
from tidegraph.llm.mixing import mix
from tidegraph.llm.secrets import find_secrets
from tidegraph.llm.shared import table, written


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    at = {}
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, sf))
        at[name] = docs
        assert name == "packing" or docs.columns == columns
    source = table(spark, sf, "documents")
    model = fit(source, table(spark, sf, "labels"))
    kept = {r.doc_id for r in judge(source, model).filter("kept").collect()}
    assert {r.doc_id for r in at["quality"].collect()} == kept
    rows = [(r.doc_id, r.text) for r in at["quality"].collect()]
    want = {i for i, (_, c) in brute_join(rows, 5, 80).items() if i == c}
    assert sorted(r.doc_id for r in at["near_duplicates"].collect()) == sorted(want)
    assert find_secrets(at["secrets"]).filter("size(spans) > 0").count() == 0
    assert at["secrets"].count() == len(want)
    words = lambda df: sum(len(WORD.findall(r.text or "")) for r in df.collect())
    assert words(at["mixing"]) == mix(at["secrets"]).agg({"taken": "sum"}).first()[0]
    pieces = at["packing"].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in at["mixing"].collect()}
    assert pipeline.run(spark, sf).count() == len(pieces)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    df = queries.queries()[name](spark, sf)
    res = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    want = [str(r) for r in res.fetchall()]
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == sorted(want)
