"""Search: hits, totals and facets of a query over a table, as lazily planned DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.plans.catalog import FieldCatalog
from lodestack.plans.compiler import Compiler, token_column, two_valued
from lodestack.plans.tree import And, Builder, Condition, FreeText, combine, expand_types, merge, reduce

# Page sizes of the query service.
DEFAULT_LIMIT, MAX_LIMIT = 20, 210


@dataclass
class Facet:
    """One dimension: values with their number of rows, the largest first (ties by value)."""

    name: str
    size: int = 10
    multi: bool = False  # a selection in it does not narrow its own counts
    sub: str | None = None  # dimension within each value
    by_key: bool = False
    parents: bool = True  # nested fields: count rows (True) or elements (False)


@dataclass
class Request:
    query: str = ""
    defaults: list[str] = field(default_factory=list)
    facets: list[Facet] = field(default_factory=list)
    sort: list[str] = field(default_factory=list)
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    aliases: dict[str, str] = field(default_factory=dict)


@dataclass
class Result:
    hits: DataFrame
    page: DataFrame
    facets: dict[str, DataFrame]

    def total(self) -> int:
        """Exact number of hits."""
        return self.hits.count()


def sort_columns(spec: list[str], catalog: FieldCatalog, unique: str) -> list[Column]:
    """Sort keys; ``-`` means descending, missing values come last in both directions, the id breaks ties."""
    out = []
    for s in spec:
        f = catalog.get(s.lstrip("-"))
        path = f.path if f else s.lstrip("-")
        out.append(F.col(path).desc_nulls_last() if s.startswith("-") else F.col(path).asc_nulls_last())
    return [*out, F.col(unique).asc()]


def page_of(df: DataFrame, order: list[Column], limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """A page of an ordered result; the limit is bounded by the service's maximum."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, min(limit, MAX_LIMIT)))


def page_links(total: int, limit: int, offset: int) -> dict[str, int | None]:
    """Offsets of the first, previous, next and last page."""
    if limit <= 0 or total <= 0:
        return {"first": 0, "previous": None, "next": None, "last": 0}
    last = (total - 1) // limit * limit
    return {"first": 0, "previous": max(0, offset - limit) if offset > 0 else None, "next": offset + limit if offset + limit < total else None, "last": last}


def after(df: DataFrame, order: tuple[str, str], last: tuple[Column, Column]) -> DataFrame:
    """Keyset paging: rows behind ``last`` in the order of two columns."""
    (a, b), (x, y) = order, last
    return df.where((F.col(a) > x) | ((F.col(a) == x) & (F.col(b) > y)))


def terms(df: DataFrame, value: Column, unique: str | None, size: int = 10, by_key: bool = False, ascending: bool = False) -> DataFrame:
    """``value, n``: number of rows (of distinct ``unique`` if given) for each value; top ``size``."""
    n = F.count_distinct(F.col(unique)) if unique else F.count("*")
    counted = df.select(value.alias("value"), *([F.col(unique)] if unique else [])).where("value is not null").groupBy("value").agg(n.alias("n"))
    key = F.col("value").asc() if by_key else F.col("n").asc() if ascending else F.col("n").desc()
    return counted.orderBy(key, F.col("value").asc()).limit(size)


def sub_terms(df: DataFrame, outer: str, inner: str, size: int) -> DataFrame:
    """``parent, value, n``: the top ``size`` inner values of each outer value."""
    counted = df.groupBy(F.col(outer).alias("parent"), F.col(inner).alias("value")).agg(F.count("*").alias("n")).where("parent is not null and value is not null")
    w = W.partitionBy("parent").orderBy(F.col("n").desc(), F.col("value").asc())
    return counted.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= size).drop("rn")


def predicate_counts(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """``predicate, n``: rows that match each named predicate, counted in one pass."""
    one = df.agg(*[F.count_if(two_valued(p)).alias(k) for k, p in predicates.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("predicate"), F.col(k).alias("n")) for k in predicates])).alias("p")).select("p.*")


def grouping_sets(df: DataFrame, columns: list[str], n: str = "n") -> DataFrame:
    """One grouping per column, fused in a single aggregation: ``dimension, value, n``."""
    sets = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(sets.alias("d")).groupBy("d.dimension", "d.value").agg(F.count("*").alias(n))


def score(text: Column, tokens: list[str], boosts: dict[str, tuple[Column, float]], phrase_divisor: float = 2.0) -> Column:
    """Deterministic relevance: boost times the share of query words, per field, plus a phrase part.

    A field's part is damped by its length in words when that is over the number of query words.
    """
    total = F.lit(0.0)
    for column, boost in boosts.values():
        words = token_column(column)
        hits = sum((F.array_contains(words, t).cast("double") for t in tokens), F.lit(0.0))
        total = total + F.lit(boost) * hits / F.greatest(F.size(words), F.lit(len(tokens))).cast("double")
        if len(tokens) > 1:
            total = total + F.when(F.contains(F.lower(column), F.lit(" ".join(tokens))), boost / phrase_divisor).otherwise(0.0)
    return total


def function_score(value: Column, weight: float) -> Column:
    """``ln(1 + 10 x) * weight``; a missing or negative value adds nothing."""
    return F.log1p(10 * F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0))) * weight


def search(df: DataFrame, catalog: FieldCatalog, request: Request, unique: str, arrays: tuple[str, ...] = ()) -> Result:
    """Plan a request: rewrites on the tree, then one predicate for hits and one per multi-select facet."""
    builder, compile_ = Builder(catalog, request.aliases), Compiler(catalog, arrays)
    tree = merge(builder.build(request.query), [builder.build(d) for d in request.defaults], catalog.types)
    tree = expand_types(reduce(tree, catalog.types), catalog.types)
    parts = list(tree.children) if isinstance(tree, And) else [tree]
    multi = {f.name for f in request.facets if f.multi}
    own = {name: [p for p in parts if _field_of(p) == name] for name in multi}
    base = [p for p in parts if _field_of(p) not in multi]
    hits = df.where(compile_(tree))
    facets = {}
    for f in request.facets:
        others = combine("and", base + [p for name, ps in own.items() if name != f.name for p in ps]) if multi else tree
        rows = df.where(compile_(others)) if multi else hits
        logical = catalog.get(f.name)
        if f.sub:
            facets[f.name] = sub_terms(rows, logical.path, catalog.get(f.sub).path, f.size)
        elif logical.nested:
            rows = rows.select(unique, F.explode(logical.nested).alias("element"))
            facets[f.name] = terms(rows, F.col("element").getField(logical.path), unique if f.parents else None, f.size, f.by_key)
        else:
            facets[f.name] = terms(rows, F.explode(logical.path) if logical.path in arrays else F.col(logical.path), None, f.size, f.by_key)
    return Result(hits, page_of(hits, sort_columns(request.sort, catalog, unique), request.limit, request.offset), facets)


def _field_of(node) -> str | None:
    """The one field that a selection is about."""
    if isinstance(node, Condition):
        return node.field.name
    names = {_field_of(c) for c in getattr(node, "children", ())}
    return names.pop() if len(names) == 1 else None


def suggest(df: DataFrame, column: str, typed: str, limit: int = 10) -> DataFrame:
    """Distinct values that begin with what is typed, without regard to case, in order."""
    low = F.lower(F.col(column))
    return df.where(low.startswith(typed.lower())).select(column).distinct().orderBy(column).limit(limit)


def suggest_query(text: str, cursor: int) -> str:
    """The query text with the word at the cursor as prefix or exact word."""
    start = text.rfind(" ", 0, cursor) + 1
    end = text.find(" ", cursor)
    end = len(text) if end < 0 else end
    word = text[start:end]
    return text if not word else f"{text[:start]}({word}* OR {word}){text[end:]}"


def spelling(vocabulary: DataFrame, word: str, distance: int = 2) -> DataFrame:
    """Words of ``vocabulary`` (``word, df``) near a word: the nearest, then the most frequent first."""
    d = F.levenshtein(F.col("word"), F.lit(word), distance)
    return vocabulary.withColumn("distance", d).where("distance >= 0")


def free_text_of(query: str, catalog: FieldCatalog) -> list[str]:
    """Plain words of a query's free text, for scoring."""
    tree = Builder(catalog).build(query)
    nodes = tree.children if isinstance(tree, And) else (tree,)
    return [t.lower() for n in nodes if isinstance(n, FreeText) for t, _ in n.tokens]


def facet_tree(df: DataFrame, catalog: FieldCatalog, tree: dict, selected: dict[str, str], prefix: str = "") -> DataFrame:
    """``path, value, n``: a tree of facets ``{name: {"size": n, "sub": {...}}}``.

    A facet's own selection does not narrow it; a sub-facet is counted within the selected value of
    the one above it.
    """
    out = None
    for name, spec in tree.items():
        rows = df
        for other, value in selected.items():
            if other != name:
                rows = rows.where(two_valued(F.col(catalog.get(other).path).cast("string") == value))
        path = f"{prefix}{name}"
        part = terms(rows, F.col(catalog.get(name).path).cast("string"), None, spec.get("size", 10)).select(F.lit(path).alias("path"), "value", "n")
        if spec.get("sub") and name in selected:
            inside = df.where(two_valued(F.col(catalog.get(name).path).cast("string") == selected[name]))
            rest = {k: v for k, v in selected.items() if k != name}
            part = part.unionByName(facet_tree(inside, catalog, spec["sub"], rest, path + "."))
        out = part if out is None else out.unionByName(part)
    return out


def constant_score(boosts: list[tuple[Column, float]], base: float = 1.0) -> Column:
    """``base`` and the weight of every condition that holds; nothing is left out by it."""
    out = F.lit(base)
    for condition, weight in boosts:
        out = out + F.when(two_valued(condition), weight).otherwise(0.0)
    return out


def default_facet(df: DataFrame, type_column: str = "type", size: int = 10) -> DataFrame:
    """What a request without facets gets: rows by type."""
    return terms(df, F.col(type_column), None, size)


def range_facet(df: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """``low, high, n``: rows in the half-open ranges between ascending bounds, open at both ends."""
    ends = [None, *bounds, None]
    low = F.lit(None).cast("double")
    for b in bounds:
        low = F.when(F.col(column) >= b, F.lit(float(b))).otherwise(low)
    counted = df.where(F.col(column).isNotNull()).groupBy(low.alias("low")).agg(F.count("*").alias("n"))
    high = F.lit(None).cast("double")
    for a, b in list(zip(ends[:-1], ends[1:]))[:-1]:
        high = F.when(F.col("low").eqNullSafe(F.lit(a).cast("double")), F.lit(float(b))).otherwise(high)
    return counted.select("low", high.alias("high"), "n")


def range_template(catalog: FieldCatalog, query: str, name: str) -> dict[str, str | None]:
    """The bounds that a query sets on a field, for a form: ``{"min": …, "max": …}``."""
    tree = Builder(catalog).build(query)
    out: dict[str, str | None] = {"min": None, "max": None}
    for n in tree.children if isinstance(tree, And) else (tree,):
        if isinstance(n, Condition) and n.field.name.lower() == name.lower():
            if n.operator in (">", ">="):
                out["min"] = n.value
            elif n.operator in ("<", "<="):
                out["max"] = n.value
    return out


def sort_field(df: DataFrame, name: str) -> Column:
    """The column that a field is sorted by: its four-digit form, its key form, or itself."""
    return F.col(next((c for c in (f"{name}_4_digits", f"{name}_key", name) if c in df.columns)))


def nested_sort(array: str, part: str, where: Callable[[Column], Column]) -> Column:
    """The part of the first element that fits, to sort rows by (null: no such element)."""
    return F.get(F.filter(array, where), F.lit(0)).getField(part)


def collated(column: Column, locale: str = "sv") -> Column:
    """A text to be sorted by the rules of a language, whatever its case."""
    return F.collate(column, f"{locale}_CI" if locale else "UNICODE_CI")


def scroll(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """All rows with the number of their page (from 0), for readers that take page after page."""
    from lodestack.operators.store import chunks

    return chunks(df, order, size).withColumnRenamed("chunk", "page")


def multi_search(df: DataFrame, catalog: FieldCatalog, requests: dict[str, Request], unique: str) -> DataFrame:
    """``request`` and the id of every hit of several requests, in one plan."""
    out = None
    for name, request in requests.items():
        hits = search(df, catalog, request, unique).hits.select(F.lit(name).alias("request"), unique)
        out = hits if out is None else out.unionByName(hits)
    return out


def merged_targets(targets: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Results of several targets as one: of rows with one key the first target's (ties: the smallest row)."""
    out = None
    for rank, (name, df) in enumerate(targets):
        part = df.withColumn("target", F.lit(name)).withColumn("_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    columns = [c for c in out.columns if c not in ("_rank", key)]
    return out.groupBy(key).agg(F.min(F.struct("_rank", *columns)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in columns])


def intersect_ids(lists: list[DataFrame], key: str) -> DataFrame:
    """Ids that stand in every list."""
    every = lists[0].select(key).distinct()
    for other in lists[1:]:
        every = every.join(other.select(key), key, "left_semi")
    return every


def approximate_distinct(df: DataFrame, by: str, column: str, error: float = 0.02) -> DataFrame:
    """``by, n``: distinct values of each group within a relative standard error."""
    return df.groupBy(by).agg(F.approx_count_distinct(column, error).alias("n"))


def facet_page(counts: DataFrame, size: int, parents: dict[str, str] | None = None, parent: str | None = None) -> DataFrame:
    """Facet values, the most frequent first; below a chosen parent only the values narrower than it."""
    if parent is not None:
        below = {v for v in (parents or {}) if _under(v, parent, parents or {})}
        counts = counts.where(F.col("value").isin(*sorted(below)) if below else F.lit(False))
    return counts.orderBy(F.col("n").desc(), "value").limit(size)


def _under(value: str, parent: str, parents: dict[str, str]) -> bool:
    seen = set()
    while value in parents and value not in seen:
        seen.add(value)
        value = parents[value]
        if value == parent:
            return True
    return False
