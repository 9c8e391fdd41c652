"""Five stages that turn raw documents into packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of documents. Documents with a null text count as empty; rows that repeat a ``doc_id`` are
judged each by their own text, and rows that repeat a whole document are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import decontaminate, packing, pii, quality, simhash
from lodestack.llm.common import table
from lodestack.llm.entries import TOKENIZER
from lodestack.scratch import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    docs = docs.select(*COLUMNS)
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id (rows without an id stay).

    Groups are by five-word shingles and a similarity of 0.8. Candidates come from the Gray-order index over
    SimHash fingerprints and from MinHash bands (the README says what the index alone would miss).
    """
    docs = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    groups = materialise(simhash.similar_documents(docs.select("doc_id", "text")), "groups")
    on = ["doc_id", "text_hash"]
    again = materialise(groups.where("kept").groupBy(*on).count().where("count > 1").select(*on), "again")  # rows that repeat a document
    left = docs.join(groups.where("not kept").select(*on).unionByName(again).distinct(), on, "left_anti")
    if not again.isEmpty():
        left = left.unionByName(docs.join(again, on, "left_semi").dropDuplicates(on))
    return left.select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    docs = pii.redacted(docs.select(*COLUMNS))
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, one row per piece of a document, with the piece's ids."""
    return packing.sequences(docs.select("doc_id", "text"), TOKENIZER, with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express neither a fitted classifier nor XXH64 shingles nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    df = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if i + 1 < len(STAGES):
            df = materialise(df, name)
    return df
