"""A training-data pipeline over `documents`: five stages, each over all rows that the one before it kept.

Rows with null or repeated ids and repeated rows are told apart by their id and a hash of their text. A text without
letters (null and empty ones too) is rejected by the first stage; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm import exact, language, leaks, packing, simhash
from alertloom.llm.common import documents, keep_rows, row_id, stage_result, table

#: Several stages have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None
#: Share of a text's n-grams that must belong to its language.
LEAST_COVERAGE = 0.2


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject: it knows a language, and the text reads like it."""
    return language.accepted(docs, language.learn(documents(docs, "lang")), LEAST_COVERAGE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    key = row_id(first=False)
    found = exact.exact_dedup(docs.select(key.alias("doc_id"), "text"))
    return keep_rows(docs, key, found.where("kept").select("doc_id"), once=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity of 0.8 or more, or two or fewer fingerprint bits), the row with the smallest doc_id."""
    key = row_id(first=True)
    found = simhash.similar_documents(docs.select(key.alias("doc_id"), "text"))
    return keep_rows(docs, key, found.where("doc_id = component_id").select("doc_id"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window like a benchmark item."""
    key = row_id(first=True)
    leaked = leaks.find_leaks(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select("doc_id")
    return docs.withColumn("__llm_row_key", key).join(leaked.toDF("__llm_row_key").distinct(), "__llm_row_key", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens packed into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack(docs, special=packing.SPECIAL)


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage_result(spark, lambda: step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
