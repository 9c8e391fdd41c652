"""Duplicate detection, clustering and merging of records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.operators.cells import met
from lodestack.operators.components import connected_components
from lodestack.scratch import materialise


def duplicates_by_keys(incoming: DataFrame, stored: DataFrame, strategies: list[tuple[str, str]], key: str, type_column: str | None = None, wildcard: str = "Instance") -> DataFrame:
    """``key, match, strategy``: the first strategy, in order, that finds anything for an incoming row.

    A strategy is (incoming column, stored column), each a value or an array of values. Candidates
    of another type are dropped unless either type is the wildcard. Which strategy counts for a row is
    found without making pairs: only the pairs of that strategy are made, a value's pairs in cells.
    """

    def rows(df: DataFrame, column: str, name: str, kind: str) -> DataFrame:
        value = F.explode(column) if df.schema[column].dataType.typeName() == "array" else F.col(column)
        out = df.select(F.col(key).alias(name), value.alias("v"), *([F.col(type_column).alias(kind)] if type_column else []))
        return materialise(out.where(F.col(name).isNotNull() & F.col("v").isNotNull()).distinct(), "keys")

    def repeats(df: DataFrame, name: str) -> bool:
        return not df.groupBy(name).count().where("count > 1").isEmpty()

    sides = [(rows(incoming, a, "key", "lt"), rows(stored, b, "match", "rt")) for a, b in strategies]
    found = None
    for rank, (left, right) in enumerate(sides):
        ends = right.groupBy("v").agg(F.min("match").alias("low"), F.max("match").alias("high"))
        hit = left.join(ends, "v").where("key <> low or key <> high").select("key", F.lit(rank).alias("strategy"))
        found = hit if found is None else found.unionByName(hit)
    first = materialise(found.groupBy("key").agg(F.min("strategy").alias("strategy")), "first")
    out = None
    for rank, (left, right) in enumerate(sides):
        asked = left.join(first.where(F.col("strategy") == rank).select("key"), "key", "left_semi")
        pairs = met(asked, right, "v").where("key <> match")
        if type_column:
            pairs = pairs.where((F.col("lt") == F.col("rt")) | (F.col("lt") == wildcard) | (F.col("rt") == wildcard))
        pairs = pairs.select("key", "match", F.lit(rank).alias("strategy"))
        # a pair comes twice only by several values: of both sides, or, where types differ, of either
        again = repeats(left, "key") or repeats(right, "match") if type_column else repeats(left, "key") and repeats(right, "match")
        pairs = pairs.distinct() if again else pairs
        out = pairs if out is None else out.unionByName(pairs)
    return out


def groups_by_key(df: DataFrame, value: Column, key: str) -> DataFrame:
    """``key, group_id, n``: rows that share a value, named by their smallest key; single rows left out.

    Grouped by the value, never paired: a value may be shared by any number of rows.
    """
    rows = df.select(F.col(key), value.alias("_v")).where("_v is not null")
    sizes = rows.groupBy("_v").agg(F.min(key).alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return rows.join(sizes, "_v").select(key, "group_id", "n")


def components_by_keys(df: DataFrame, values: list[Column], key: str) -> DataFrame:
    """``key, component``: rows connected by any shared value; every row of ``df`` with a key appears.

    Each value links its rows to the smallest of them (a star, not all pairs).
    """
    edges = None
    for v in values:
        rows = df.select(F.col(key).alias("src"), v.alias("_v")).where("_v is not null and src is not null")
        low = rows.groupBy("_v").agg(F.min("src").alias("dst"))
        part = rows.join(low, "_v").where("src <> dst").select("src", "dst")
        edges = part if edges is None else edges.unionByName(part)
    comp = connected_components(edges).withColumnRenamed("node", "_node")
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(comp, F.col(key) == F.col("_node"), "left").select(key, F.coalesce("component", key).alias("component"))


def greedy_partition(df: DataFrame, block: str, key: str, value: str, match: Callable[[str, str], bool], shares: Column | None = None) -> DataFrame:
    """``key, cluster``: within each block, a row joins the first cluster all of whose members it matches.

    Order dependent: rows in key order. ``shares`` is an array of values of which two rows must have one in
    common to match at all: rows that no chain of shared values connects never meet, so each connected
    part of a block is a block by itself, with the same result. Rows come in order from a sorted stream.
    """
    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(block).cast("string").alias("_block"), key, value)
    if shares is not None:
        shared = df.select(F.col(block).cast("string").alias("_block"), key, F.explode(shares).alias("_share")).where("_share is not null")
        low = shared.groupBy("_block", "_share").agg(F.min(key).alias("dst"))
        comp = connected_components(shared.join(low, ["_block", "_share"]).select(F.col(key).alias("src"), "dst"))
        rows = rows.join(comp, F.col(key) == F.col("node"), "left").withColumn("_block", F.concat_ws("\x1f", "_block", F.coalesce("component", key).cast("string"))).select("_block", key, value)

    def partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, clusters = None, []
        for pdf in batches:
            out = []
            for part, k, v in pdf.itertuples(index=False):
                if part != last:
                    last, clusters = part, []
                home = next((c for c in clusters if all(match(v, other) for other in c[1])), None)
                if home is None:
                    clusters.append((k, [v]))
                    out.append((k, k))
                else:
                    home[1].append(v)
                    out.append((k, home[0]))
            yield pd.DataFrame(out, columns=[key, "cluster"])

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "_block").sortWithinPartitions("_block", key).mapInPandas(partition, f"`{key}` {key_type}, cluster {key_type}")


def most_common(df: DataFrame, group: str, value: str, level: str | None = None, tie: str | None = None) -> DataFrame:
    """Each group's most common value on its highest level; ties go to the smallest ``tie`` (or value)."""
    keys = [group, *([level] if level else []), value]
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(tie or value).alias("_tie"))
    order = [*([F.col(level).desc()] if level else []), F.col("n").desc(), F.col("_tie").asc()]
    return counted.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).where("_rn = 1").drop("_rn", "_tie")


def merge_fields(df: DataFrame, group: str, order: str, scalars: list[str], sets: list[str]) -> DataFrame:
    """One row per group: scalars from the first row in order that has one (ties: the smallest), sets united."""
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c) for c in scalars]
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in sets]
    return df.groupBy(group).agg(*first, *united)


def shape_clusters(df: DataFrame, key: Column, columns: list[str], least: int = 2) -> DataFrame:
    """``shape_key, n_shapes, n``: keys whose rows have at least ``least`` different contents."""
    return df.groupBy(key.alias("shape_key")).agg(F.count_distinct(F.md5(F.to_json(F.struct(*columns)))).alias("n_shapes"), F.count("*").alias("n")).where(F.col("n_shapes") >= least)


def same_work(a: dict, b: dict, fields: dict[str, Callable[[object, object], str]]) -> bool:
    """Whether two descriptions can be of one work: every field is EQUAL or COMPATIBLE, none CONFLICT."""
    return all(compare(a.get(k), b.get(k)) != "CONFLICT" for k, compare in fields.items())


def compatible_sets(a, b) -> str:
    """EQUAL sets, COMPATIBLE if one holds the other (or is missing), else CONFLICT."""
    x, y = (set(v if isinstance(v, list) else [] if v is None else [v]) for v in (a, b))
    return "EQUAL" if x == y else "COMPATIBLE" if x <= y or y <= x else "CONFLICT"


def merge_ordered(df: DataFrame, group: str, order: str, pickers: dict[str, str]) -> DataFrame:
    """One row per group by a picker for each field: ``first``, ``longest``, ``most`` (the commonest), ``union`` (arrays), ``min``, ``max``.

    Ties go to the first row in order, then to the smallest value.
    """
    ways = {
        "first": lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(order, c))),
        "longest": lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct((-F.length(c)).alias("l"), F.col(order), F.col(c)))),
        "union": lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))),
        "min": F.min,
        "max": F.max,
    }
    out = df.groupBy(group).agg(F.count("*").alias("_n"), *[ways[w](c).alias(c) for c, w in pickers.items() if w != "most"])
    for c in (c for c, w in pickers.items() if w == "most"):
        best = most_common(df, group, c, tie=None).select(F.col(group).alias("_g"), c)
        out = out.join(best, F.col(group) == F.col("_g"), "left").drop("_g")
    return out.select(group, *pickers)


def blocked_pairs(df: DataFrame, key: str, blocks: list[Column]) -> DataFrame:
    """``key, block``: the blocks in which a row may find its likes; rows without any block value are left out."""
    return df.select(key, F.explode(F.array_distinct(F.filter(F.array(*blocks), lambda b: b.isNotNull() & (b != "")))).alias("block"))
