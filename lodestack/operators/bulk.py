"""Bulk changes: scripts over selected records, match-and-target forms, specifications, previews."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.jsontree import get_path, matches_form, walk

BLANK = "_id"  # names a node of a form, so both forms can speak of it


class NotRepeatable(ValueError):
    """A second value for a property that takes one."""


def run_script(df: DataFrame, key: str, data: str, script: Callable[[dict], dict | None], limit: int | None = None) -> DataFrame:
    """``key, before, after, action``: what a script does to each record; nothing is stored (dry run).

    The script gets a copy and returns it changed, or None to delete. An exception fails the job with
    the record's key. ``limit`` bounds the records taken, in key order.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, data)
    if limit is not None:
        rows = rows.orderBy(key).limit(limit)

    def run(batches):
        for pdf in batches:
            out = []
            for k, text in pdf.itertuples(index=False):
                if text is None:
                    continue
                item = json.loads(text)
                try:
                    new = script(copy.deepcopy(item))
                except Exception as e:
                    raise RuntimeError(f"script failed on record {k!r}: {e}") from e
                if new is None:
                    out.append((k, text, None, "delete"))
                elif new != item:
                    out.append((k, text, json.dumps(new, ensure_ascii=False, sort_keys=True), "update"))
            yield pd.DataFrame(out, columns=[key, "before", "after", "action"])

    return rows.mapInPandas(run, f"`{key}` {kind}, before string, after string, action string")


@dataclass
class FormTransform:
    """From a match form and a target form to changes: what only one of them has is removed or added.

    Nodes of both forms are the same if they have the same ``_id``. Lists are bags.
    """

    match: dict
    target: dict
    repeatable: frozenset[str] = frozenset()
    is_a: Callable[[str, str], bool] | None = None
    ids: dict[str, set[str]] = field(default_factory=dict)

    def changes(self) -> list[tuple[str, str, str, object]]:
        """``(node, action, property, value)``, removals first."""
        sides = []
        for form in (self.match, self.target):
            nodes: dict[str, dict] = {}
            for _, v in walk(form):
                if isinstance(v, dict) and BLANK in v:
                    nodes[v[BLANK]] = v
            sides.append(nodes)
        out = []
        for action, a, b in (("remove", sides[0], sides[1]), ("add", sides[1], sides[0])):
            for node, item in a.items():
                other = b.get(node)
                if other is None:
                    continue
                for k, v in item.items():
                    if k in (BLANK, "_match", "_ids"):
                        continue
                    have = other.get(k)
                    have = have if isinstance(have, list) else [] if have is None else [have]
                    for x in v if isinstance(v, list) else [v]:
                        same = any(x == y or (isinstance(x, dict) and isinstance(y, dict) and BLANK in x and x[BLANK] == y.get(BLANK)) for y in have)
                        if not same:
                            out.append((node, action, k, x))
        return out

    def __call__(self, record: dict) -> dict:
        """The record changed wherever it has what the match form asks for; exact types are tried first."""
        form = _strip(self.match)
        if not matches_form(form, record, self.is_a, self.ids):
            return record
        out = copy.deepcopy(record)
        placed: dict[str, dict] = {}
        self._bind(self.match, out, placed)
        for node, action, k, v in self.changes():
            at = placed.get(node)
            if at is None:
                continue
            if action == "remove":
                values = at.get(k)
                listed = values if isinstance(values, list) else [] if values is None else [values]
                kept = [x for x in listed if not matches_form(_strip(v), x, self.is_a, self.ids)]
                if kept:
                    at[k] = kept if isinstance(values, list) else kept[0]
                else:
                    at.pop(k, None)
            else:
                new, old = _strip(v), at.get(k)
                if old is None:
                    at[k] = [new] if k in self.repeatable else new
                elif k in self.repeatable or isinstance(old, list):
                    listed = old if isinstance(old, list) else [old]
                    at[k] = listed if new in listed else [*listed, new]
                elif old != new:
                    raise NotRepeatable(f"{k} has a value already")
        return _prune(out)

    def _bind(self, form, node, placed: dict) -> bool:
        """Which node of the record stands for which node of the form; most specific types first."""
        if not isinstance(form, dict) or not isinstance(node, dict):
            return False
        if BLANK in form:
            placed[form[BLANK]] = node
        for k, v in form.items():
            have = node.get(k)
            options = have if isinstance(have, list) else [have]
            for x in v if isinstance(v, list) else [v]:
                if isinstance(x, dict):
                    fitting = [o for o in options if matches_form(_strip(x), o, self.is_a, self.ids)]
                    fitting.sort(key=lambda o, x=x: o.get("@type") != x.get("@type"))
                    if fitting:
                        self._bind(x, fitting[0], placed)
        return True


def _strip(form):
    if isinstance(form, dict):
        return {k: _strip(v) for k, v in form.items() if k != BLANK}
    return [_strip(x) for x in form] if isinstance(form, list) else form


def _prune(item):
    if isinstance(item, dict):
        new = {k: _prune(v) for k, v in item.items()}
        return {k: v for k, v in new.items() if v not in ({}, [])}
    return [x for x in map(_prune, item) if x not in ({}, [])] if isinstance(item, list) else item


@dataclass(frozen=True)
class Specification:
    """A declared bulk change: update (forms), delete (match form), create (target), merge (ids into one), other (a function)."""

    kind: str
    match: dict | None = None
    target: dict | None = None
    keep: str | None = None
    deprecate: tuple[str, ...] = ()
    repeatable: frozenset[str] = frozenset()
    function: Callable[[dict], dict | None] | None = None

    def script(self) -> Callable[[dict], dict | None]:
        if self.kind == "update":
            return FormTransform(self.match, self.target, self.repeatable)
        if self.kind == "delete":
            return lambda r: None if matches_form(_strip(self.match), r) else r
        if self.kind == "merge":
            gone = set(self.deprecate)

            def relink(item):
                if isinstance(item, dict):
                    return {k: self.keep if k == "@id" and v in gone and len(item) == 1 else relink(v) for k, v in item.items()}
                if isinstance(item, list):
                    out: list = []
                    for x in map(relink, item):
                        out += [] if x in out else [x]
                    return out
                return item

            return lambda r: None if r.get("@id") in gone else relink(r)
        if self.kind == "other":
            return self.function
        raise ValueError(f"unknown kind {self.kind!r}")

    def created(self, ids: list[str]) -> list[dict]:
        """The records that a specification of kind create makes, one for each id."""
        if self.kind != "create":
            raise ValueError(f"{self.kind} makes no records")
        return [{"@id": i, **_strip(self.target)} for i in ids]


def preview(changed: DataFrame, key: str, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of recorded changes."""
    return changed.orderBy(key).offset(offset).limit(limit)


def link_pattern(form: dict) -> list[tuple[str, str, str]]:
    """The graph pattern that a form stands for: variables for its nodes, constants for its values."""
    out, n = [], 0

    def visit(node: dict, name: str) -> None:
        nonlocal n
        for k, v in node.items():
            if k in (BLANK, "_match", "_ids"):
                continue
            for x in v if isinstance(v, list) else [v]:
                if isinstance(x, dict) and set(x) != {"@id"}:
                    n += 1
                    out.append((name, k, f"?n{n}"))
                    visit(x, f"?n{n}")
                elif not (k == "@type" and x == "Any"):
                    out.append((name, k, x["@id"] if isinstance(x, dict) else str(x)))

    visit(form, "?n0")
    return out


def query_from_node(node: dict, fields: dict[str, str]) -> str:
    """Query text that finds records like a node: its values under the fields they are known by."""
    parts = []
    for path, v in walk(node):
        name = fields.get(".".join(s for s in path if isinstance(s, str)))
        if name and isinstance(v, str | int) and not isinstance(v, bool):
            text = str(v)
            parts.append(f"{name}:{text}" if text.isalnum() else f'{name}:"{text}"'.replace("\\", "\\\\"))
    return " ".join(parts)


def validated(changed: DataFrame, problems: Callable[[dict], list]) -> DataFrame:
    """Changes with the number of problems that the new record has."""
    from lodestack.functions.jsontree import json_udf

    count = json_udf(lambda r: len(problems(r)), "long")
    return changed.withColumn("problems", F.coalesce(count("after"), F.lit(0).cast("long")))


def at(record: dict, *path):
    """Shorthand for scripts."""
    return get_path(record, list(path))
