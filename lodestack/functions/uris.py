"""URIs and query strings, search keys, and what belongs to a work or to its instance."""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote_value(text: str) -> str:
    """A query value in quotes, quotes and backslashes in it escaped."""
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def find_url(base: str, params: Mapping[str, str | list[str]]) -> str:
    """A URL with its query string; parameters in their order, the values of one in theirs."""
    pairs = [(k, v) for k, vs in params.items() for v in (vs if isinstance(vs, list) else [vs])]
    return base + ("?" if pairs else "") + "&".join(f"{quote(k, safe='')}={quote(v, safe='')}" for k, v in pairs)


def find_url_column(base: str, params: dict[str, Column]) -> Column:
    """The same over columns; a null value leaves its parameter out."""
    pairs = [F.concat(F.lit(quote(k, safe="") + "="), F.replace(F.url_encode(v.cast("string")), F.lit("+"), F.lit("%20"))) for k, v in params.items()]
    return F.concat(F.lit(base), F.lit("?"), F.array_join(F.filter(F.array(*pairs), lambda x: x.isNotNull()), "&"))


def search_key(*parts: Column) -> Column:
    """What records are matched by: the parts that have a value, in comparison form, joined by slashes."""
    plain = [F.nullif(F.trim(F.regexp_replace(F.lower(p.cast("string")), r"[^\p{L}\p{N}]+", " ")), F.lit("")) for p in parts]
    return F.concat_ws("/", *plain)


def split_work(record: dict, work_keys: frozenset[str], link: str = "instanceOf") -> dict:
    """A description whose properties of the work stand under its link to the work; what the work has already stays."""
    work = dict(record.get(link) or {})
    own = {}
    for k, v in record.items():
        if k == link:
            continue
        if k in work_keys:
            work.setdefault(k, v)
        else:
            own[k] = v
    return {**own, link: work} if work else own


def specific_type(types: list[tuple[Column, str]], default: str) -> Column:
    """The first type whose condition holds."""
    out = F.lit(default)
    for condition, name in reversed(types):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out


def quality_flags(checks: dict[str, Column]) -> list[Column]:
    """One boolean for each named check; a missing value does not pass."""
    return [F.coalesce(c, F.lit(False)).alias(name) for name, c in checks.items()]
