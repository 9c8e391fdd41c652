"""Change feeds and stateful operators on Structured Streaming, and the batch forms they agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.scratch import new_path


def read_stream(spark: SparkSession, path: str, schema, glob: str | None = None, max_files: int = 100) -> DataFrame:
    """A folder of Parquet files (those that match ``glob``) as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def drain(df: DataFrame, name: str, mode: str = "append", batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Run a stream until all that is there has been read; checkpoints and result lie in the shared folder.

    Without ``batch`` the result comes back as a table: all rows in append mode, the last batch's in
    complete mode. Nothing of it passes through the driver.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if batch is None:
        spark.createDataFrame([], df.schema).write.parquet(f"{path}/batch=-1")  # a stream without rows gives an empty table

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True)
    writer.foreachBatch(batch or write).start().awaitTermination()
    return None if batch else spark.read.schema(df.schema).parquet(path).select(*df.columns)


def activities(versions: DataFrame, key: str, time: str, tiebreak: str, deleted: Column | None = None) -> DataFrame:
    """Versions as activities: create for the first of a key, delete where flagged, update otherwise."""
    w = W.partitionBy(key).orderBy(time, tiebreak)
    first = F.row_number().over(w) == 1
    kind = F.when(first, "create")
    if deleted is not None:
        kind = F.when(F.coalesce(deleted, F.lit(False)), "delete").when(first, "create")
    return versions.withColumn("activity", kind.otherwise("update"))


def page_with_ties(df: DataFrame, time: str, until, size: int) -> DataFrame:
    """The latest ``size`` rows not after ``until``, and all that are as old as the last of them.

    A top-k finds the boundary; the rows come from a filter, not from a window over the table.
    """
    rows = df.where(F.col(time) <= until) if until is not None else df
    last = rows.select(time).orderBy(F.col(time).desc()).limit(size).agg(F.min(time).alias("_last"))
    return rows.join(F.broadcast(last), F.col(time) >= F.col("_last")).drop("_last")


def harvest(df: DataFrame, time: str, key: str, since, until, token: tuple | None, size: int) -> DataFrame:
    """A page of an interval in the order of (time, key), behind a resumption token."""
    rows = df.where((F.col(time) >= since) & (F.col(time) <= until))
    if token:
        at, last = token
        rows = rows.where((F.col(time) > at) | ((F.col(time) == at) & (F.col(key) > last)))
    return rows.orderBy(time, key).limit(size)


def counter_stream(stream: DataFrame, by: list[str], delta: Column) -> DataFrame:
    """Running signed counters (complete or update mode)."""
    return stream.groupBy(*by).agg(F.sum(delta).alias("n"))


def windowed_stream(stream: DataFrame, time: str, size: str, by: list[str], value: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows with a watermark: rows and sums."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = stream.withWatermark(time, late).groupBy(window, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, by: list[str]) -> DataFrame:
    """Session windows of each key."""
    out = df.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def expired(df: DataFrame, time: str, now, days: int) -> DataFrame:
    """Rows older than a number of days."""
    return df.where(F.col(time) < now - F.make_interval(days=F.lit(days)))


def upsert_batches(path: str, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink that keeps each batch under its number: a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def digest(observations: DataFrame, subscriptions: DataFrame, concerns: str, category: str, created: str, since) -> DataFrame:
    """``subscriber, concerned, categories, latest``: what each subscriber is told about, since a time.

    Observations that name their subscriber are joined by subscriber and category, so a category that
    everybody takes is no single key; others go to all who take their category.
    """
    new = observations.where(F.col(created) > since)
    on = [category, *[c for c in ("subscriber",) if c in observations.columns]]
    joined = new.join(subscriptions.withColumnRenamed("category", category), on)
    return joined.groupBy("subscriber", concerns).agg(F.array_sort(F.collect_set(category)).alias("categories"), F.max(created).alias("latest"))


def apply_activities(dump: DataFrame, activities: DataFrame, key: str, order: list[str], kind: str = "activity") -> DataFrame:
    """A dump brought up to date: each key's latest activity replaces its row, or deletes it."""
    columns = dump.columns
    last = activities.groupBy(key).agg(F.max_by(F.struct(*columns, kind), F.struct(*order)).alias("a"))
    kept = dump.join(last.select(key), key, "left_anti").select(*columns)
    return kept.unionByName(last.where(F.col(f"a.{kind}") != "delete").select(*[F.col(f"a.{c}").alias(c) for c in columns]))


def card_changes(versions: DataFrame, key: str, time: str, tiebreak: str, card: Column) -> DataFrame:
    """Versions whose card (what others show of the record) differs from the one before."""
    w = W.partitionBy(key).orderBy(time, tiebreak)
    marked = versions.withColumn("_card", card).withColumn("_before", F.lag("_card").over(w)).withColumn("_nth", F.row_number().over(w))
    return marked.where((F.col("_nth") > 1) & ~F.col("_card").eqNullSafe(F.col("_before"))).drop("_card", "_before", "_nth")
