import re

import corpus_pipeline
import pytest
from parity import compare, duck
from roundtide.llm import queries
from roundtide.llm.common import stage_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_one_query_for_each_operator():
    import __spark_entry__ as entry

    numbers = sorted(int(m[1]) for m in (re.match(r"op(\d+)_", k) for k in entry.queries()) if m)
    assert numbers == list(range(1, 11)) and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near duplicates", "benchmark decontamination", "mixing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    assert compare(duck(sf_dir), queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name]) == ""


def test_stages_keep_columns_and_drop_what_they_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage_table(stage(spark, docs, sf_dir), "test-stage")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "mixing":
            assert docs.columns == [*COLUMNS, "domain", "rate", "copies"]
        else:
            assert docs.columns == COLUMNS
        if name == "line dedup":
            assert set(after) == set(before)
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        else:
            assert all(before[i] == t for i, t in after.items())
    assert len(after) > 100


def test_stages_on_odd_and_empty_documents(spark, odd_docs, empty_docs, odd_labels, tmp_path):
    odd_labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd_docs, empty_docs):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage_table(stage(spark, docs, str(tmp_path)), "test-odd")
            assert out.columns[: len(docs.columns)] == docs.columns
            if name not in ("near duplicates", "mixing"):
                assert out.count() == n, name
            docs = out if name != "mixing" else docs
            n = docs.count()
