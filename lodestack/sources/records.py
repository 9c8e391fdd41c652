"""Reading records: tables, JSON lines, id lists, cluster lines; promoting paths to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Paths that are promoted to columns (graph item 0: metadata, 1: the main entity).
PROMOTED = {
    "record_id": "$['@graph'][0]['@id']",
    "thing_id": "$['@graph'][1]['@id']",
    "type": "$['@graph'][1]['@type']",
    "held_by": "$['@graph'][1].heldBy['@id']",
    "item_of": "$['@graph'][1].itemOf['@id']",
    "control_number": "$['@graph'][0].controlNumber",
    "encoding_level": "$['@graph'][0].encodingLevel",
    "generation_date": "$['@graph'][0].generationDate",
}


def read_table(spark: SparkSession, path: str, where: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, filter and columns pushed to the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document a line: typed by ``schema``, or as texts in ``data``."""
    return spark.read.schema(schema).json(path) if schema else spark.read.text(path).withColumnRenamed("value", "data").where("trim(data) <> ''")


def promote(df: DataFrame, data: str = "data", paths: dict[str, str] | None = None) -> DataFrame:
    """Promoted columns beside the document."""
    return df.withColumns({k: F.get_json_object(data, p) for k, p in (paths or PROMOTED).items()})


def json_path(column: str, *steps: str | int) -> Column:
    """Text at a path."""
    return F.get_json_object(column, "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps))


def containment(array: Column, fields: dict[str, str]) -> Column:
    """Whether an array of objects has one with all the given fields (more are allowed)."""
    def has(e: Column) -> Column:
        test = F.lit(True)
        for k, v in fields.items():
            test = test & (e.getField(k) == F.lit(v))
        return test

    return F.coalesce(F.exists(array, has), F.lit(False))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids, one a line."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """``cluster, id``: white-space separated ids, one cluster a line; the cluster is named by its smallest id."""
    rows = spark.read.text(path).select(F.filter(F.split(F.trim("value"), r"\s+"), lambda v: v != "").alias("ids")).where(F.size("ids") > 0)
    return rows.select(F.array_min("ids").alias("cluster"), F.explode("ids").alias("id"))


def select_by_sql(df: DataFrame, where: str) -> DataFrame:
    """Rows by a SQL predicate."""
    return df.where(F.expr(where))


def identifiers(df: DataFrame, data: str = "data", key: str = "record_id") -> DataFrame:
    """``id, iri, graph_index, main_id``: own ids and aliases of graph items 0 and 1."""
    parts = None
    for i in (0, 1):
        own = F.array(F.struct(F.get_json_object(data, f"$['@graph'][{i}]['@id']").alias("iri"), F.lit(True).alias("main_id")))
        same = F.coalesce(F.from_json(F.get_json_object(data, f"$['@graph'][{i}].sameAs"), "array<struct<`@id`:string>>"), F.array().cast("array<struct<`@id`:string>>"))
        alias = F.transform(same, lambda x: F.struct(x["@id"].alias("iri"), F.lit(False).alias("main_id")))
        part = df.select(F.col(key).alias("id"), F.explode(F.concat(own, alias)).alias("x"), F.lit(i).alias("graph_index"))
        part = part.select("id", "x.iri", "graph_index", "x.main_id").where("iri is not null")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def load_sql(spark: SparkSession, sql: str, **named) -> DataFrame:
    """A query text with named parameters (``:name``); values are bound, never put into the text."""
    return spark.sql(sql, args=named)


def iterate(df: DataFrame, prefetch: bool = True):
    """Rows one after the other, a partition at a time on the driver."""
    yield from df.toLocalIterator(prefetch)


def in_dataset(df: DataFrame, array: str, dataset: str) -> DataFrame:
    """Rows whose list of datasets has the given one."""
    return df.where(F.coalesce(F.array_contains(array, dataset), F.lit(False)))
