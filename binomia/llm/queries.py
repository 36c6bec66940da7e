"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binomia.llm.common import fold, read_table
from binomia.llm.decontamination import decontamination
from binomia.llm.html_text import html_text
from binomia.llm.language_id import language_id, train_language
from binomia.llm.ngram_join import ngram_join
from binomia.llm.packing import best_fit_packing
from binomia.llm.pii import personal_data
from binomia.llm.quality_classifier import quality_scores, train_quality
from binomia.llm.quality_rules import quality_rules, train_chain
from binomia.llm.ranked_search import ORACLE as RANKED_SEARCH
from binomia.llm.ranked_search import ranked_search
from binomia.llm.substring_dedup import substring_dedup
from binomia.llm.token_counts import token_counts
from binomia.llm.token_files import token_files
from binomia.llm.vector_codes import oracle as vector_codes_oracle
from binomia.llm.vector_codes import vector_codes


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(read_table(spark, folder, "documents"))


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text(read_table(spark, folder, "pages"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit_packing(read_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(read_table(spark, folder, "documents")).drop("masked")


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    scores = quality_scores(docs, train_quality(docs, read_table(spark, folder, "labels")))
    return scores.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup(read_table(spark, folder, "documents"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return quality_rules(docs, train_chain(docs, read_table(spark, folder, "labels")))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    found = language_id(docs, train_language(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes(read_table(spark, folder, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_html_extraction, op3_decontamination, op4_token_counts, op5_best_fit_packing, op6_pii,
        op7_quality_classifier, op8_substring_dedup, op9_quality_rules, op10_language_id, op11_token_files, op12_ranked_search,
        op13_vector_codes,
    )
}
ORACLES: dict[str, str] = {"op12_ranked_search": RANKED_SEARCH, "op13_vector_codes": vector_codes_oracle()}
