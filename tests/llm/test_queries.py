from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from postlake.llm.queries import QUERIES
from postlake.llm.queries_sql import SQL
from tests.compare import connect, difference
from tests.llm import brute

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_entry_has_the_queries():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(SQL) <= set(entry_points.oracle_sql())


@needs_data
@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert difference(got, connect(SF_DIR).execute(SQL[name]).df()) is None


@needs_data
def test_token_queries(spark, documents, tokenizer):
    n = {d: len(brute.ids(tokenizer, t)) for d, t in documents}
    got = QUERIES["op6_token_counts"](spark, SF_DIR).collect()
    assert {r.doc_id: r.n_tokens for r in got} == n
    got = QUERIES["op4_token_files"](spark, SF_DIR).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {d: k + 1 for d, k in n.items()}


@needs_data
def test_pipeline_equals_its_stages_by_brute_force(spark, documents, tokenizer):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = dict(documents)
    kept, sets = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF_DIR)
        assert kept.columns == docs.columns, name
        sets.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert 0 < len(sets[0]) < len(texts)
    unique = {r[0] for r in brute.exact_dedup([(d, texts[d]) for d in sets[0]]) if r[3]}
    assert sets[1] == unique
    assert sets[2] == {c for _, _, c in brute.near_components([(d, texts[d]) for d in unique])}
    assert sets[3] < sets[2]
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    want = {d: len(brute.ids(tokenizer, texts[d])) + 1 for d in sets[3]}
    found = {}
    for r in got:
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == want
