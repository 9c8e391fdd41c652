"""From logical trees to Spark columns.

NOT is two-valued: a row without the field matches NOT(equals). Comparisons are inverted before
they get here, so a row without the field matches neither a comparison nor its inverse. Conditions
on fields of one array of structs that stand together in an AND must hold for one element; fields
marked flat, and a second condition on the same field, may hold for another.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.dates import DatePart, parse_date
from lodestack.plans.catalog import Field, FieldCatalog
from lodestack.plans.tree import Alias, And, Condition, FreeText, MatchAll, Not, Or

_YEARS = re.compile(r"(\d{4})?-(\d{4})?")


def tokens_of(text: str) -> list[str]:
    """Words of a text as the token columns hold them: compatibility form, lower case."""
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text).lower())


def token_column(column: Column) -> Column:
    """Distinct lower-case words of a text column."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def two_valued(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def has_tokens(text: Column, tokens: tuple[tuple[str, bool], ...], connective: str) -> Column:
    """Plain tokens by word (a trailing * by prefix), quoted ones as phrases."""
    words = token_column(text)
    padded = F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " "), F.lit(" "))
    parts = []
    for value, quoted in tokens:
        found = tokens_of(value)
        if quoted or len(found) > 1:
            parts.append(padded.contains(" " + " ".join(found) + " "))
        elif not found:
            parts.append(F.lit(True))
        elif value.endswith("*"):
            parts.append(padded.contains(" " + found[0]))
        else:
            parts.append(F.array_contains(words, found[0]))
    out = parts[0]
    for p in parts[1:]:
        out = out & p if connective == "and" else out | p
    return out


def date_bounds(part: DatePart) -> tuple[Column, Column]:
    return F.lit(part.start.isoformat(sep=" ")).cast("timestamp_ntz"), F.lit(part.end.isoformat(sep=" ")).cast("timestamp_ntz")


def compare(value: Column, f: Field, operator: str, text: str) -> Column:
    """A scalar against the literal of a condition; what makes no sense matches nothing."""
    if f.kind == "number":
        if operator == ":" and (m := _YEARS.fullmatch(text)) and (m[1] or m[2]):
            low = value >= int(m[1]) if m[1] else F.lit(True)
            return low & (value <= int(m[2])) if m[2] else low
        try:
            number = float(text)
        except ValueError:
            return F.lit(False)
        literal = F.lit(int(text)) if re.fullmatch(r"-?\d+", text) else F.lit(number)
        return {":": value == literal, "<": value < literal, "<=": value <= literal, ">": value > literal, ">=": value >= literal}[operator]
    if f.kind == "date":
        when = value.cast("timestamp_ntz")
        if operator == ":" and (m := _YEARS.fullmatch(text)) and (m[1] or m[2]) and parse_date(text) is None:
            low = F.year(when) >= int(m[1]) if m[1] else F.lit(True)
            return low & (F.year(when) <= int(m[2])) if m[2] else low
        part = parse_date(text)
        if part is None:
            return F.lit(False)
        start, end = date_bounds(part)
        return {":": (when >= start) & (when < end), "<": when < start, "<=": when < end, ">": when >= end, ">=": when >= start}[operator]
    if operator in ("<", "<=", ">", ">="):
        number = value.try_cast("double")
        return compare(number, Field(f.name, f.path, "number"), operator, text) if re.fullmatch(r"-?\d+(\.\d+)?", text) else F.lit(False)
    if text.endswith("*") and len(text) > 1:
        return value.startswith(text[:-1])
    return value == F.lit(text)


class Compiler:
    """Compiles trees for one table; ``arrays`` are its columns of simple arrays."""

    def __init__(self, catalog: FieldCatalog, arrays: tuple[str, ...] = ()):
        self.catalog, self.arrays = catalog, arrays

    def __call__(self, node) -> Column:
        if isinstance(node, MatchAll):
            return F.lit(True)
        if isinstance(node, Alias):
            return self(node.tree)
        if isinstance(node, Not):
            return ~two_valued(self(node.node))
        if isinstance(node, FreeText):
            fields = [self.catalog.get(n) for n in self.catalog.text]
            text = F.concat_ws(" ", *[F.col(f.path) for f in fields])
            return has_tokens(text, node.tokens, node.connective)
        if isinstance(node, Or):
            return self._fold([self(c) for c in node.children], Column.__or__)
        if isinstance(node, And):
            return self._and(node)
        return self._condition(node)

    @staticmethod
    def _fold(parts: list[Column], op: Callable) -> Column:
        out = two_valued(parts[0])
        for p in parts[1:]:
            out = op(out, two_valued(p))
        return out

    def _and(self, node: And) -> Column:
        """Conditions on elements of one array go into one ``exists``."""
        plain, groups = [], []
        for c in node.children:
            inner = c.node if isinstance(c, Not) else c
            if not (isinstance(inner, Condition) and inner.field.nested and not inner.field.flat):
                plain.append(self(c))
                continue
            for g in groups:
                if g[0] == inner.field.nested and inner.field.name not in g[1]:
                    g[1].add(inner.field.name)
                    g[2].append(c)
                    break
            else:
                groups.append((inner.field.nested, {inner.field.name}, [c]))
        for array, _, members in groups:
            if all(isinstance(m, Not) for m in members):  # nothing to be near to: no element may have it
                plain += [self(m) for m in members]
            else:
                plain.append(F.exists(array, self._together(members)))
        return self._fold(plain, Column.__and__)

    def _together(self, members: list) -> Callable[[Column], Column]:
        """All members of a group hold for one element."""

        def test(e: Column) -> Column:
            return self._fold([~two_valued(self._element(m.node, e)) if isinstance(m, Not) else self._element(m, e) for m in members], Column.__and__)

        return test

    def _element(self, c: Condition, e: Column) -> Column:
        value = e
        for step in c.field.path.split("."):
            value = value.getField(step)
        test = value.isNotNull() if c.exists else has_tokens(value, c.tokens, c.connective) if c.tokens else compare(value, c.field, c.operator, c.value)
        for name, wanted in c.field.fixed:
            test = test & (e.getField(name) == F.lit(wanted))
        return test

    def _condition(self, c: Condition) -> Column:
        f = c.field
        if f.parts:  # a composite property: any of its parts
            return self._fold([self._condition(Condition(self.catalog.get(p), c.operator, c.value, c.quoted, c.tokens if self.catalog.get(p).kind == "text" else (), c.connective)) for p in f.parts], Column.__or__)
        if f.nested:
            return F.exists(f.nested, lambda e: two_valued(self._element(c, e)))
        value = F.col(f.path)
        if f.path in self.arrays:
            if c.exists:
                return F.size(value) > 0
            return F.exists(f.path, lambda e: two_valued(compare(e, f, c.operator, c.value)))
        if c.exists:
            return value.isNotNull()
        if c.operator == "~":  # linked, or not linked and named alike
            linked = compare(value, f, ":", c.value)
            return two_valued(linked) | (value.isNull() & has_tokens(F.col(f.label), ((c.value, False),), "and")) if f.label else linked
        if c.tokens:
            return has_tokens(value, c.tokens, c.connective)
        return compare(value, f, c.operator, c.value)
