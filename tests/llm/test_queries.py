import pytest

import corpus_pipeline
from docloom.llm import queries
from tests.llm import brute
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def test_substring_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute.substrings(docs, 400)
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op8_substring_dedup"](spark, SF).collect()}
    assert got == {i: (*v, v[1] > 0) for i, v in want.items()}


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns, name
        if name == "line dedup":
            want = brute.lines(before)
            assert {r.doc_id: brute.sha(r.text) for r in after.collect()} == {i: v[2] for i, v in want.items()}
        if name == "n-gram Jaccard join":
            want = brute.jaccard_components(before, 5, (4, 5))
            assert ids(after) == {i for i, (_, c) in want.items() if i == c}
        if name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert ids(after) == {i for i, _ in before} - {i for i, _ in brute.contained(before, items)}
        docs = after
    assert docs.count() > 0
