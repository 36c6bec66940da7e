"""Rows of one document that fall into different batches."""

import pytest

from binomia.llm import ngram_join


class _Seen(Exception):
    pass


def test_repeated_rows_hold_their_tokens_once(spark, monkeypatch):
    def prefixes(held, similarity):
        raise _Seen(sorted(r.doc_id for r in held.select("doc_id").collect()))

    monkeypatch.setattr(ngram_join, "prefixes", prefixes)
    rows = [(k, " ".join(f"r{k}_{n}" for n in range(40))) for k in range(6)]
    docs = spark.createDataFrame(rows * 4, "doc_id long, text string").repartition(8)
    with pytest.raises(_Seen) as seen:
        ngram_join.ngram_join(docs)
    assert seen.value.args[0] == list(range(6))
