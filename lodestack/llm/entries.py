"""Queries and SQL of this subpackage for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import decontaminate, licences, packing, pages, pii, quality, repeats, simhash, sql, tokenfile, vectors
from lodestack.llm.common import table

#: Vocabulary of the token operators.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(_documents(spark, sf_dir))


def op5_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(_documents(spark, sf_dir), TOKENIZER)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(_documents(spark, sf_dir), TOKENIZER)


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.matches(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op3_decontaminate": op3_decontaminate,
    "op4_repeats": op4_repeats,
    "op5_tokenfile": op5_tokenfile,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_vectors": op8_vectors,
    "op9_pages": op9_pages,
    "op10_licences": op10_licences,
}

SQL: dict[str, str] = {"op4_repeats": sql.REPEATS, "op10_licences": sql.licences()}
