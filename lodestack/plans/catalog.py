"""What the query language knows about a table: fields, their kinds, aliases, and class hierarchies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A logical property.

    ``path`` is a column, or a field inside the elements of an array of structs (``items.price``).
    ``kind``: keyword, text, number, date, link. ``parts``: a composite property stands for any of
    them. ``fixed``: conditions that a restricted property adds within the same element.
    """

    name: str
    path: str
    kind: str = "keyword"
    nested: str | None = None  # array column whose elements hold the field
    flat: bool = False  # nested fields that also match across elements
    parts: tuple[str, ...] = ()
    fixed: tuple[tuple[str, str], ...] = ()
    label: str | None = None  # text column that stands for an unlinked value
    domain: tuple[str, ...] = ()


@dataclass
class Hierarchy:
    """Classes with their superclasses; closures are computed once."""

    supers: dict[str, tuple[str, ...]] = field(default_factory=dict)
    deprecated: frozenset[str] = frozenset()

    def ancestors(self, term: str) -> list[str]:
        """All superclasses, nearest first."""
        out, level = [], list(self.supers.get(term, ()))
        while level:
            out += [x for x in dict.fromkeys(level) if x not in out]
            level = [y for x in level for y in self.supers.get(x, ()) if y not in out]
        return out

    def descendants(self, term: str) -> list[str]:
        """All subclasses in alphabetical order, deprecated ones left out."""
        return sorted(c for c in self.supers if term in self.ancestors(c) and c not in self.deprecated)

    def is_a(self, term: str, other: str) -> bool:
        return term == other or other in self.ancestors(term)

    def minimal(self, terms: list[str]) -> list[str]:
        """Terms without those of which a subclass is present too."""
        return [t for t in terms if not any(o != t and self.is_a(o, t) for o in terms)]

    def expand(self, terms: list[str]) -> list[str]:
        """Minimal terms and all their subclasses."""
        return sorted({x for t in self.minimal(terms) for x in [t, *self.descendants(t)]})


class FieldCatalog:
    """Fields by name, case-insensitive, with aliases and named sub-queries."""

    def __init__(self, fields: list[Field], aliases: dict[str, str] | None = None, filters: dict[str, str] | None = None, types: Hierarchy | None = None, text: tuple[str, ...] = (), coerce: dict[tuple[str, str], str] | None = None, labels: dict[str, Labels] | None = None, codes: dict[str, dict[str, str]] | None = None):
        self.fields = {f.name.lower(): f for f in fields}
        self.aliases = {k.lower(): v.lower() for k, v in (aliases or {}).items()}
        self.filters = dict(filters or {})
        self.types = types or Hierarchy()
        self.text = text  # fields that free text is looked up in
        self.coerce = coerce or {}  # (field, value) -> narrower field
        self.labels = labels or {}  # field -> labels of its terms
        self.codes = {k.lower(): v for k, v in (codes or {}).items()}  # old code -> value -> query text that it stands for

    def get(self, name: str) -> Field | None:
        key = name.lower()
        return self.fields.get(self.aliases.get(key, key))

    def term(self, f: Field, value: str) -> str:
        """The term that a label names for a field; an unknown or ambiguous label stays as it is."""
        known = self.labels.get(f.name)
        return (known.get(value) if known else None) or value

    def narrower(self, f: Field, value: str) -> Field:
        """The property that replaces ``f`` for a given value."""
        other = self.coerce.get((f.name, value))
        return self.get(other) or f if other else f

    @staticmethod
    def of(df: DataFrame, strip: str = "", **more) -> FieldCatalog:
        """Catalog of a DataFrame's columns and of the fields in its arrays of structs."""
        fields = []

        def kind(t: T.DataType) -> str:
            if isinstance(t, T.NumericType):
                return "number"
            return "date" if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType) else "keyword"

        for c in df.schema.fields:
            name = c.name.removeprefix(strip)
            if isinstance(c.dataType, T.ArrayType) and isinstance(c.dataType.elementType, T.StructType):
                fields += [Field(f"{name}.{e.name}", e.name, kind(e.dataType), nested=c.name) for e in c.dataType.elementType.fields]
            else:
                element = c.dataType.elementType if isinstance(c.dataType, T.ArrayType) else c.dataType
                fields.append(Field(name, c.name, kind(element)))
        return FieldCatalog(fields, **more)


class Labels:
    """Terms by their labels and codes, without regard to case; a label of several terms is ambiguous."""

    def __init__(self, entries: list[tuple[str, str]]):
        self.terms: dict[str, set[str]] = {}
        for label, term in entries:
            self.terms.setdefault(" ".join(label.lower().split()), set()).add(term)

    def get(self, label: str) -> str | None:
        found = self.terms.get(" ".join(label.lower().split()), set())
        return next(iter(found)) if len(found) == 1 else None

    def ambiguous(self, label: str) -> list[str]:
        found = self.terms.get(" ".join(label.lower().split()), set())
        return sorted(found) if len(found) > 1 else []
