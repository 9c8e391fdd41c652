"""Record store operators: lookups, as-of reads, versions, upserts, deletes, edges, link deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def effective_time(*columns: str) -> Column:
    """The latest of several times; a missing one does not count."""
    return F.greatest(*map(F.col, columns)) if len(columns) > 1 else F.col(columns[0])


def scan(df: DataFrame, time: str | None = None, since=None, until=None, deleted: str | None = None, include_deleted: bool = False, collection: tuple[str, str] | None = None) -> DataFrame:
    """Full scan, optionally of one collection (column, value) or bounded in time, without deleted rows unless asked."""
    if collection:
        df = df.where(F.col(collection[0]) == collection[1])
    if time and since is not None:
        df = df.where(F.col(time) >= since)
    if time and until is not None:
        df = df.where(F.col(time) <= until)
    return df.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted and not include_deleted else df


def multi_get(df: DataFrame, ids: DataFrame, key: str, keep_misses: bool = False) -> DataFrame:
    """Rows of the given ids; missing ids are dropped, or kept with nulls."""
    return ids.join(df, key, "left" if keep_misses else "inner")


def lookup(df: DataFrame, side: DataFrame, on: str, other: str) -> DataFrame:
    """Rows whose key stands in another table (semi join)."""
    return df.join(side.select(F.col(other).alias(on)), on, "left_semi")


def missing(df: DataFrame, side: DataFrame, on: str, other: str) -> DataFrame:
    """Rows whose key does not stand in another table (anti join)."""
    return df.join(side.select(F.col(other).alias(on)), on, "left_anti")


def as_of(versions: DataFrame, key: str, time: str, tiebreak: str, at, columns: list[str]) -> DataFrame:
    """Each key's latest version not after ``at``: one partial aggregation, no window over all versions."""
    payload = F.struct(F.col(time), F.col(tiebreak), *[F.col(c) for c in columns if c not in (time, tiebreak)])
    best = versions.where(F.col(time) <= at).groupBy(key).agg(F.max_by(payload, F.struct(time, tiebreak)).alias("v"))
    return best.select(key, "v.*")


def before_after(versions: DataFrame, key: str, time: str, tiebreak: str, since, until, value: str) -> DataFrame:
    """Each key's value before an interval and at its end, in one aggregation."""
    order, v = F.struct(time, tiebreak), F.col(value)
    early, late = F.col(time) <= since, F.col(time) <= until
    return versions.groupBy(key).agg(F.max_by(F.when(early, v), F.when(early, order)).alias("before"), F.max_by(F.when(late, v), F.when(late, order)).alias("after"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, tiebreak: str, columns: list[str]) -> DataFrame:
    """For each left row the latest right row of its key not after it, by one sorted union and a running last value.

    Cost is a sort of both sides, whatever the number of versions per key.
    """
    names = [f.name for f in left.schema.fields]
    a = left.select(key, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tiebreak].dataType).alias("_tb"), F.struct(*names).alias("_row"), F.lit(None).cast(right.select(F.struct(*columns).alias("x")).schema["x"].dataType).alias("_v"))
    b = right.select(key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tiebreak).alias("_tb"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*columns).alias("_v"))
    w = W.partitionBy(key).orderBy("_t", "_side", "_tb").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_row.*", *[F.col(f"_v.{c}").alias(f"asof_{c}") for c in columns])


def history(versions: DataFrame, key: str, time: str, tiebreak: str) -> DataFrame:
    """Versions numbered from the oldest (1)."""
    return versions.withColumn("version", F.row_number().over(W.partitionBy(key).orderBy(time, tiebreak)))


def nth_version(versions: DataFrame, key: str, time: str, tiebreak: str, n: int) -> DataFrame:
    """The n-th version of each key from the oldest (0), or from the newest (-1)."""
    order = (F.col(time), F.col(tiebreak)) if n >= 0 else (F.col(time).desc(), F.col(tiebreak).desc())
    w = W.partitionBy(key).orderBy(*order)
    return versions.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == (n + 1 if n >= 0 else -n)).drop("_n")


def interval_and_one_before(versions: DataFrame, key: str, time: str, tiebreak: str, since, until) -> DataFrame:
    """Versions inside (since, until] and exactly one before, for each key."""
    w = W.partitionBy(key, F.col(time) > since).orderBy(F.col(time).desc(), F.col(tiebreak).desc())
    return versions.where(F.col(time) <= until).withColumn("_n", F.row_number().over(w)).where((F.col(time) > since) | (F.col("_n") == 1)).drop("_n")


def changed_from_previous(versions: DataFrame, key: str, time: str, tiebreak: str, value: str) -> DataFrame:
    """Each version with the value before it and whether that differs (null-safe; the first is a change)."""
    w = W.partitionBy(key).orderBy(time, tiebreak)
    first = F.row_number().over(w) == 1
    return versions.withColumn("previous", F.lag(value).over(w)).withColumn("changed", first | ~F.col("previous").eqNullSafe(F.col(value)))


def path_owner(versions: DataFrame, key: str, time: str, tiebreak: str, value: str, agent: str) -> DataFrame:
    """Who last changed a value, at each version (running last writer)."""
    changed = changed_from_previous(versions, key, time, tiebreak, value)
    w = W.partitionBy(key).orderBy(time, tiebreak).rowsBetween(W.unboundedPreceding, W.currentRow)
    return changed.withColumn("owner", F.last(F.when(F.col("changed"), F.col(agent)), ignorenulls=True).over(w))


def checksum(columns: list[str]) -> Column:
    """Order-insensitive over the names, null-safe hash of a row's content."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in sorted(columns)])


def upsert(current: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Merge incoming rows, those with equal content left alone: columns plus ``action``.

    A key of the incoming side counts once, by the greatest content.
    """
    inc = incoming.groupBy(key).agg(F.max(F.struct(*columns)).alias("n"))
    cur = current.select(key, F.struct(*columns).alias("o"))
    both = cur.join(inc, key, "full_outer")
    action = F.when(F.col("o").isNull(), "create").when(F.col("n").isNull(), "keep").when(F.col("o").eqNullSafe(F.col("n")), "same").otherwise("update")
    new = F.coalesce("n", "o")
    return both.select(key, *[new.getField(c).alias(c) for c in columns], action.alias("action"))


def dataset_diff(stored: DataFrame, given: DataFrame, key: str, value: str) -> DataFrame:
    """What an import of a whole dataset does with each id: create, update, delete or same."""
    both = stored.select(key, F.col(value).alias("old"), F.lit(True).alias("s")).join(given.select(key, F.col(value).alias("new"), F.lit(True).alias("g")), key, "full_outer")
    action = F.when(F.col("s").isNull(), "create").when(F.col("g").isNull(), "delete").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("update")
    return both.select(key, action.alias("action"))


def latest_writes(writes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last write wins: one row for each key."""
    names = writes.columns
    return writes.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("r")).select("r.*")


def link_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Links that were added or removed: the columns plus ``change``."""
    gone = before.distinct().join(after, before.columns, "left_anti").withColumn("change", F.lit("removed"))
    new = after.distinct().join(before, before.columns, "left_anti").withColumn("change", F.lit("added"))
    return gone.unionByName(new)


def evict(cache: DataFrame, ids: str, changed: DataFrame, key: str) -> DataFrame:
    """Cached rows none of whose ``ids`` changed (the list is joined exploded: no pairwise compare)."""
    hit = cache.select(key, F.explode(ids).alias("_id")).join(changed.select(F.col(key).alias("_id")), "_id", "left_semi").select(key).distinct()
    return cache.join(hit, key, "left_anti").join(changed.select(key), key, "left_anti")


def archive(df: DataFrame, time: str, older_than, order: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """The oldest rows past a date, at most ``limit`` of them, and the rest."""
    old = df.where(F.col(time) < older_than).orderBy(*order).limit(limit)
    return old, df.join(old.select(*order), order, "left_anti")


def apply_counter_deltas(counts: DataFrame, deltas: DataFrame, key: list[str], n: str = "n") -> DataFrame:
    """Add signed deltas to stored counters."""
    return counts.select(*key, n).unionByName(deltas.select(*key, n)).groupBy(*key).agg(F.sum(n).alias(n))


def chunks(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Chunk numbers of ``size`` rows in order: ranks come from per-partition counts, not from one window.

    Only one count per partition reaches the driver.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from lodestack.scratch import materialise

    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    counts = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}
    before, offsets = 0, []
    for p in sorted(counts):
        offsets += [F.lit(p), F.lit(before)]
        before += counts[p]
    base = F.create_map(*offsets)[F.col("_p")] if offsets else F.lit(0)
    rank = F.row_number().over(W.partitionBy("_p").orderBy(*order)) + base
    return ranged.withColumn("chunk", ((rank - 1) / size).cast("long")).drop("_p")


def attached(holdings: DataFrame, records: DataFrame, item_of: str, ids: str) -> DataFrame:
    """Holdings whose ``item_of`` is one of a record's identifiers (an array column), each once."""
    known = records.select(F.explode(ids).alias(item_of)).distinct()
    return holdings.join(known, item_of, "left_semi")


def holding_of(holdings: DataFrame, wanted: DataFrame, item_of: str, held_by: str) -> DataFrame:
    """Holdings by what they are of and who holds them (two-key join; pairs without a holding are left out)."""
    return wanted.select(item_of, held_by).distinct().join(holdings, [item_of, held_by])
