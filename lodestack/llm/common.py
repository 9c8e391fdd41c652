"""What the operators share: reading tables, running Arrow functions over rows, grouping streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; any other column is never read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(df: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` with null as empty; other columns are left out."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def batch_of(names: list[str], types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    """A record batch from Python lists or NumPy arrays."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def partitions_for(df: DataFrame, rows: int, per_task: int, least: int = 1) -> int:
    """Tasks so that each gets about ``per_task`` rows, and no fewer than the session's setting."""
    setting = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, setting, -(-rows // per_task))
