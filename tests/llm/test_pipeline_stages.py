import corpus_pipeline
import pytest


def test_one_row_of_each_group_stays(spark, documents):
    docs = documents.withColumnRenamed("key", "_copy")
    kept = corpus_pipeline.ngram_jaccard_join(spark, docs, "")
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    # 1 has a copy in capitals (2) and one with another word (3); 7 comes twice
    assert [i for none, i in ids if not none] == [1, 4, 5, 6, 7, 8, 9, 10] and ids[-1] == (True, 0)


def test_rows_of_one_id_have_a_defined_choice(spark):
    rows = [(1, "b b b", "x"), (1, "a a a", "y"), (1, "a a a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert [tuple(r) for r in corpus_pipeline.ngram_jaccard_join(spark, docs, "").collect()] == [(1, "a a a", "x")]


@pytest.mark.parametrize("stage", ["ngram_jaccard_join", "pii"])
def test_empty_tables(spark, nothing, stage):
    assert dict(corpus_pipeline.STAGES)[stage](spark, nothing, "").count() == 0
