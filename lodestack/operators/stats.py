"""Statistics operators: counters with examples, thresholds, quantiles, JSON shapes, collected notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions.jsontree import walk_rows
from lodestack.scratch import materialise

#: Distinct values per path above which a shape reports a total only.
MAX_VALUES = 512


def counter_with_examples(df: DataFrame, by: list[str], key: str, k: int = 3) -> DataFrame:
    """Rows per group and its ``k`` smallest keys (bounded state: no group is collected)."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.min(key).alias("example"))
    if k == 1:
        return out
    ranked = df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(key))).where(F.col("_n") <= k)
    return out.drop("example").join(ranked.groupBy(*by).agg(F.array_sort(F.collect_list(key)).alias("examples")), by)


def threshold_counts(df: DataFrame, by: str, limits: dict[str, int], default: int) -> DataFrame:
    """Rows per group with the group's limit and whether it is exceeded."""
    limit = F.coalesce(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])[F.col(by)], F.lit(default)) if limits else F.lit(default)
    return df.groupBy(by).agg(F.count("*").alias("n")).withColumn("threshold", limit).withColumn("exceeded", F.col("n") > F.col("threshold"))


def quantiles(df: DataFrame, by: str, value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact quantiles by linear interpolation.

    From counts of distinct values, so a group's state is never in one task: values are counted and
    range-partitioned, running counts within partitions and the totals of partitions before give every
    value's ranks, and the two values around each quantile are picked by them.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(counted.repartitionByRange(n, by, value).withColumn("_p", F.spark_partition_id()), "ranged")
    own = W.partitionBy(by, "_p")
    parts = ranged.groupBy(by, "_p").agg(F.sum("_n").alias("_in_part"))
    before = parts.withColumn("_before", F.sum("_in_part").over(W.partitionBy(by).orderBy("_p")) - F.col("_in_part")).withColumn("_all", F.sum("_in_part").over(W.partitionBy(by))).drop("_in_part")
    last = F.sum("_n").over(own.orderBy(value)) + F.col("_before")
    ranked = ranged.join(before, [by, "_p"]).withColumn("_last", last - 1).withColumn("_first", F.col("_last") - F.col("_n") + 1)
    out = []
    for p in points:
        place = F.lit(p) * (F.col("_all") - 1)
        low, high = (f(place) for f in (F.floor, F.ceil))
        at = lambda rank: F.max(F.when((F.col("_first") <= rank) & (rank <= F.col("_last")), F.col(value)))
        share = F.max(place - F.floor(place))
        out.append((at(low) + (at(high) - at(low)) * share).alias(f"p{round(p * 100)}"))
    return ranked.groupBy(by).agg(*out)


def collect_notes(df: DataFrame, key: str, time: str, since, until, note: Column) -> DataFrame:
    """Notes of each key in (since, until], in order of time, with the latest time."""
    rows = df.where((F.col(time) > since) & (F.col(time) <= until))
    return rows.groupBy(key).agg(F.max(time).alias("latest"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(time), note.alias("note")))), lambda x: x["note"]).alias("notes"))


def json_shape(df: DataFrame, column: str, by: str | None = None, max_values: int = MAX_VALUES) -> DataFrame:
    """Usage of the top-level keys and values of a JSON column; many-valued keys report a total."""
    keys = F.explode(F.from_json(column, "map<string,string>"))
    rows = df.select(*([F.col(by).alias("shape_type")] if by else [F.lit("").alias("shape_type")]), keys.alias("key", "value"))
    counted = rows.groupBy("shape_type", "key", "value").agg(F.count("*").alias("n"))
    distinct = counted.groupBy("shape_type", "key").agg(F.count("*").alias("n_values"), F.sum("n").alias("total"))
    many = distinct.where(F.col("n_values") > max_values).select("shape_type", "key", F.lit(None).cast("string").alias("value"), F.col("total").alias("n"))
    few = counted.join(distinct.where(F.col("n_values") <= max_values).select("shape_type", "key"), ["shape_type", "key"], "left_semi")
    return few.unionByName(many)


def distinct_holders(df: DataFrame, work: str, holder: str) -> DataFrame:
    """Distinct holders of each work."""
    return df.groupBy(work).agg(F.count_distinct(holder).alias("n_holders"))


def path_values(df: DataFrame, key: str, data: str, examples: int = 1) -> DataFrame:
    """``path, value, n, example``: how often each value stands at each path of a JSON column (list places left out)."""
    rows = walk_rows(df, key, data).withColumn("path", F.regexp_replace("path", r"/\d+(?=/|$)", ""))
    return counter_with_examples(rows, ["path", "value"], key, examples)


def shape_query(values: DataFrame, prefix: str) -> DataFrame:
    """``key, n``: what stands below a path prefix, summed by the next step, the most frequent first.

    ``values``: ``path, n`` as ``path_values`` gives them.
    """
    rest = F.substring(F.col("path"), len(prefix) + 2, 1 << 20)
    below = values.where(F.col("path").startswith(prefix + "/")).select(F.split(rest, "/")[0].alias("key"), "n")
    return below.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "key")


def classify_text(df: DataFrame, text: str, patterns: list[tuple[str, str]], other: str = "other") -> DataFrame:
    """``class, n``: rows by the first pattern that their text matches."""
    name = F.lit(other)
    for label, pattern in reversed(patterns):
        name = F.when(F.col(text).rlike(pattern), label).otherwise(name)
    return df.groupBy(name.alias("class")).agg(F.count("*").alias("n"))


def relation_paths(edges: DataFrame, relation: str = "relation") -> DataFrame:
    """``path, n, sources``: how often each relation path is used, and by how many nodes."""
    return edges.groupBy(F.col(relation).alias("path")).agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"))


def unique_by_period(df: DataFrame, value: Column, period: Column) -> DataFrame:
    """``period, n``: distinct values that count (not null) by period."""
    rows = df.select(period.alias("period"), value.alias("value")).where("value is not null and period is not null")
    return rows.groupBy("period").agg(F.count_distinct("value").alias("n"))


def earliest(df: DataFrame, time: str) -> DataFrame:
    """One row: the earliest time of all."""
    return df.agg(F.min(time).alias("earliest"))
