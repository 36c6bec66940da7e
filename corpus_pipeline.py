"""A corpus pipeline: rules, near copies, benchmark leaks, personal data, packing.

Each stage takes the documents that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binomia.llm.common import filter_batches, read_table, stash
from binomia.llm.decontamination import Search, blocks
from binomia.llm.ngram_join import ngram_join
from binomia.llm.packing import best_fit_packing
from binomia.llm.pii import Finder, masked
from binomia.llm.quality_rules import Reader, train_chain, verdict


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the chain of line labels keep.

    The chain is fitted on the labelled rows of the stage's own documents.
    """
    chain = train_chain(docs, read_table(spark, sf_dir, "labels"))
    return filter_batches(docs, lambda texts, reader: [verdict(reader, chain, t)["kept"] for t in texts], Reader)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the row with the smallest id. Rows without id stay.

    Of several rows with that id the one with the least text stays (null first), then the least other columns.
    """
    # five words and 0.8, as near copies are understood throughout
    groups = ngram_join(docs, words=5, similarity=0.8)
    first = groups.filter("doc_id = component_id").select("doc_id").distinct()
    others = [f.name for f in docs.schema if f.name not in ("doc_id", "text") and f.dataType.typeName() not in ("map", "variant")]
    once = Window.partitionBy("doc_id").orderBy("text", *others)
    # a name that no column has
    copy = "_copy" + "_" * sum(len(c) for c in docs.columns)
    kept = docs.join(first, "doc_id", "left_semi").withColumn(copy, F.row_number().over(once)).filter(F.col(copy) == 1)
    return kept.select(docs.columns).unionAll(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    for block in blocks(read_table(spark, sf_dir, "benchmark")):
        shared = spark.sparkContext.broadcast(block)
        docs = filter_batches(docs, lambda texts, search: [not found for found in search.find(texts)], lambda shared=shared: Search(shared), rows=2048)
    return docs


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data masked; n_chars follows where it was known."""
    fields = docs.schema.names

    def run(batches):
        finder = Finder()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = [finder.spans(t) if t else [] for t in texts]
            texts = [masked(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            columns = dict(zip(fields, batch.columns, strict=True))
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in columns:
                sizes = zip(columns["n_chars"].to_pylist(), texts, spans, strict=True)
                columns["n_chars"] = pa.array([len(t) if s and n is not None else n for n, t, s in sizes], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents in sequences of 2048 tokens."""
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("pii", pii),
    ("best_fit_packing", packing),
]

#: No SQL can fit the chain or evolve the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
