"""Shaping records: lenses (chips and cards), framing and flattening, search documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.plans.catalog import Hierarchy


class Lenses:
    """Lens specs: for each group (chips, cards, full) the properties that a type shows.

    A lens may extend another (``extends``); a property may be ``{"inverseOf": p}`` or
    ``{"alternatives": [p, q]}``.
    """

    def __init__(self, groups: dict[str, dict[str, dict]], types: Hierarchy, inverses: dict[str, str] | None = None):
        self.groups, self.types, self.inverses = groups, types, inverses or {}

    def properties(self, group: str, type_: str) -> list:
        """Properties of the lens for a type, or for its nearest superclass that has one."""
        lenses = self.groups.get(group, {})
        name = next((t for t in [type_, *self.types.ancestors(type_)] if t in lenses), None)
        return self._resolve(group, name, set()) if name else []

    def _resolve(self, group: str, name: str, open_: set) -> list:
        if (group, name) in open_:
            raise ValueError(f"lens {group}/{name} extends itself")
        lens = self.groups[group][name]
        out: list = []
        if base := lens.get("extends"):
            g, n = base if isinstance(base, tuple) else (group, base)
            out = self._resolve(g, n, open_ | {(group, name)})
        for p in lens.get("show", []):
            if isinstance(p, dict) and "inverseOf" in p:
                p = self.inverses.get(p["inverseOf"], f"@reverse.{p['inverseOf']}")
            if p not in out:
                out.append(p)
        return out

    def columns(self, group: str, type_: str, available: list[str]) -> list[Column]:
        """Columns of a lens; alternatives take the first that has a value; unknown ones are skipped."""
        out = []
        for p in self.properties(group, type_):
            names = [n for n in (p["alternatives"] if isinstance(p, dict) else [p]) if n in available]
            if names:
                out.append((F.coalesce(*map(F.col, names)) if len(names) > 1 else F.col(names[0])).alias(names[0]))
        return out

    def apply(self, df: DataFrame, group: str, type_: str, key: str) -> DataFrame:
        """``key`` and the lens as a struct; a card with fewer than two properties falls back to the chip."""
        columns = self.columns(group, type_, df.columns)
        if group == "cards" and len(columns) < 2:
            columns = self.columns("chips", type_, df.columns)
        return df.select(key, F.struct(*columns).alias("lens")) if columns else df.select(key)

    def text(self, group: str, type_: str, available: list[str], separator: str = " • ") -> Column:
        """What a lens shows, joined."""
        return F.concat_ws(separator, *[c.cast("string") for c in self.columns(group, type_, available)])


def frame(graph: dict[str, dict], main: str, depth: int = 2, chain: tuple[str, ...] = ()) -> dict:
    """A tree from a graph of items by id: links are replaced by what they name, never within their own chain."""
    def fill(value, level: int, above: tuple[str, ...]):
        if isinstance(value, list):
            return [fill(v, level, above) for v in value]
        if isinstance(value, dict):
            target = value.get("@id")
            if set(value) == {"@id"} and target in graph and target not in above and level > 0:
                item = graph[target]
                return {k: v if k == "@id" else fill(v, level - 1, (*above, target)) for k, v in item.items()}
            return {k: fill(v, level, above) for k, v in value.items()}
        return value

    item = graph.get(main, {"@id": main})
    return {k: v if k == "@id" else fill(v, depth, (*chain, main)) for k, v in item.items()}


def flatten(tree: dict) -> list[dict]:
    """Items of a tree as a list, each id once, links in their place; the outermost comes last."""
    items: dict[str, dict] = {}

    def walk(value):
        if isinstance(value, list):
            return [walk(v) for v in value]
        if isinstance(value, dict):
            new = {k: walk(v) for k, v in value.items()}
            if "@id" in new and len(new) > 1:
                old = items.setdefault(new["@id"], {})
                old.update({k: v for k, v in new.items() if k not in old})
                return {"@id": new["@id"]}
            return new
        return value

    walk(tree)
    return list(items.values())


def language_strings(plain: str, by_language: str) -> Column:
    """``[x] + values of xByLang``."""
    return F.filter(F.concat(F.array(plain), F.coalesce(F.map_values(by_language), F.array().cast("array<string>"))), lambda v: v.isNotNull())


def sort_key(column: Column) -> Column:
    """Text without what precedes its first letter or digit."""
    return F.regexp_replace(column, r"^[^\p{L}\p{N}]+", "")


def year_of(column: Column) -> Column:
    """The first four digits of a text as a number; 0000 and 9999 do not count."""
    digits = F.regexp_extract(column, r"(\d{4})", 1)
    return F.when(~digits.isin("", "0000", "9999"), digits.cast("int"))


def record_ids(*columns: str) -> Column:
    """All identifiers of a record, each once."""
    return F.array_distinct(F.filter(F.concat(*[F.col(c) for c in columns]), lambda v: v.isNotNull()))


def classification_fields(array: Column, schemes: dict[str, str]) -> list[Column]:
    """One array column for each scheme, from an array of ``struct<scheme, code>``."""
    def of(scheme: str) -> Column:
        return F.transform(F.filter(array, lambda x: x["scheme"] == F.lit(scheme)), lambda x: x["code"])

    return [of(s).alias(name) for name, s in schemes.items()]


def search_document(df: DataFrame, lenses: Lenses, type_: str, key: str, names: list[str]) -> DataFrame:
    """What is searched of each record: texts of its chip, card and full lens, sort key, all ids."""
    text = [F.lower(lenses.text(group, type_, df.columns, " ")).alias(f"_{group}_text") for group in ("chips", "cards", "full") if lenses.properties(group, type_)]
    return df.select(key, *text, sort_key(lenses.text("chips", type_, df.columns, " ")).alias("_sort_key"), record_ids(*names).alias("_ids"))


def drop_internal(df: DataFrame, names: tuple[str, ...] = (), prefix: str = "_") -> DataFrame:
    """Without columns that are not for readers: named ones, and those that begin with ``prefix``."""
    return df.select(*[F.col(c) for c in df.columns if c not in names and not c.startswith(prefix)])


def result_item(df: DataFrame, key: str, lens: str, scores: dict[str, Column], reverse_links: DataFrame | None = None) -> DataFrame:
    """``key``, the fields of the lens flattened, ``total_score`` with its ``parts``, and ``reverse_links`` (count of links to it)."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in scores.values()), F.lit(0.0))
    parts = F.create_map(*[x for n, c in scores.items() for x in (F.lit(n), F.coalesce(c, F.lit(0.0)))])
    out = df.select(key, f"{lens}.*", total.alias("total_score"), parts.alias("parts"))
    if reverse_links is None:
        return out
    counts = reverse_links.groupBy(F.col("dst").alias(key)).agg(F.count("*").alias("reverse_links"))
    return out.join(counts, key, "left").withColumn("reverse_links", F.coalesce("reverse_links", F.lit(0).cast("long")))


def keep_links(df: DataFrame, lenses: Lenses, group: str, type_: str, key: str, links: list[str]) -> DataFrame:
    """The lens of each row with the ids of given links put back beside it."""
    return lenses.apply(df, group, type_, key).join(df.select(key, *links), key)


def virtual_records(df: DataFrame, key: str, embedded: str, suffix: str = "#work") -> DataFrame:
    """``key, data, part_of``: embedded descriptions (a struct column) as records of their own, named after their record."""
    return df.where(F.col(embedded).isNotNull()).select(F.concat(F.col(key).cast("string"), F.lit(suffix)).alias("id"), F.to_json(embedded).alias("data"), F.col(key).alias("part_of"))


def inverse_properties(edges: DataFrame, inverses: dict[str, str]) -> DataFrame:
    """``node, property, value``: links to a node as properties of its own, by the inverse of their relation; relations without one are left out."""
    name = F.create_map(*[F.lit(x) for kv in inverses.items() for x in kv])[F.col("relation")]
    return edges.select(F.col("dst").alias("node"), name.alias("property"), F.col("src").alias("value")).where("property is not null").distinct()
