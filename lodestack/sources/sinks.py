"""Sinks: tables by partition, search documents, dumps in chunks, reports. All writes are whole tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.store import chunks


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet; with ``by`` one folder per value, rows of a folder brought together first (salted by task)."""
    if by:
        salt = F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(8)) if len(df.columns) > len(by) else F.lit(0)
        df.repartition(*by, salt).write.partitionBy(*by).mode(mode).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_lines(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    """One text a line."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_chunks(df: DataFrame, order: list[str], size: int, path: str, mode: str = "errorifexists") -> DataFrame:
    """Files of ``size`` rows in order, with an index ``chunk, n, first, last``; returns the index."""
    numbered = chunks(df, order, size)
    numbered.write.mode(mode).partitionBy("chunk").json(path)
    return numbered.groupBy("chunk").agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def dump_page(df: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """A page of a dump."""
    return df.orderBy(*order).offset(offset).limit(size)


def sync_graphs(stored: DataFrame, changed: DataFrame, deleted: DataFrame, graph: str = "g") -> DataFrame:
    """Quads after graphs were written anew or deleted: a graph is replaced as a whole."""
    gone = changed.select(graph).distinct().unionByName(deleted.select(graph).distinct())
    return stored.join(gone, graph, "left_anti").select(*stored.columns).unionByName(changed.select(*stored.columns))


def oai_records(page: DataFrame, key: str, time: str, xml: str, deleted: str | None = None) -> DataFrame:
    """``value``: one OAI-PMH record element for each row; a deleted one has a header only. ``xml`` is a column of well-formed metadata."""
    def escaped(c: Column) -> Column:
        out = c.cast("string")
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            out = F.replace(out, F.lit(raw), F.lit(safe))
        return out

    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    stamp = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(F.when(gone, '<header status="deleted">').otherwise("<header>"), F.lit("<identifier>"), escaped(F.col(key)), F.lit("</identifier><datestamp>"), stamp, F.lit("</datestamp></header>"))
    body = F.when(gone, "").otherwise(F.concat(F.lit("<metadata>"), F.col(xml), F.lit("</metadata>")))
    return page.select(key, F.concat(F.lit("<record>"), head, body, F.lit("</record>")).alias("value"))


def write_report(df: DataFrame, path: str, name: str) -> str:
    """A named report as tab-separated text with a header; returns its folder."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/{name}")
    return f"{path}/{name}"
