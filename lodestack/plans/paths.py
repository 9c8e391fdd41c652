"""Logical properties as physical paths: shorthands, detours over integral relations, nested stems.

A path is a tuple of property names; ``@reverse.p`` goes against p. A property that belongs to one
part of a whole may be asked of another part: the integral relation between them is put before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestack.plans.catalog import Field, FieldCatalog

Path = tuple[str, ...]
_REVERSE = "@reverse."


def inverse(step: str) -> str:
    """The step back."""
    return step.removeprefix(_REVERSE) if step.startswith(_REVERSE) else _REVERSE + step


def goes_back(path: Path) -> bool:
    """Whether a step of the path only undoes the one before it."""
    return any(b == inverse(a) for a, b in zip(path, path[1:]))


def alternatives(path: Path, integral: tuple[str, ...]) -> list[Path]:
    """The path itself, then the ways over each integral relation, along and against it; ways that go back are left out."""
    ways = [path, *[(step, *path) for r in integral for step in (r, inverse(r))]]
    return [w for i, w in enumerate(ways) if not goes_back(w) and w not in ways[:i]]


def _key_type(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    return "date" if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType) else "keyword"


def nested_stem(path: Path, schema: T.StructType) -> int:
    """Steps of the longest prefix that is an array of structs (0: none)."""
    at: T.DataType = schema
    for i, step in enumerate(path):
        if not isinstance(at, T.StructType) or step not in at.names:
            return 0
        at = at[step].dataType
        if isinstance(at, T.ArrayType) and isinstance(at.elementType, T.StructType):
            return i + 1
    return 0


def field_at(name: str, path: Path, schema: T.StructType, fixed: tuple[tuple[str, str], ...] = ()) -> Field | None:
    """The field that a path leads to in a table, if it is there."""
    stem = nested_stem(path, schema)
    at: T.DataType = schema
    for i, step in enumerate(path):
        if isinstance(at, T.ArrayType):
            at = at.elementType
        if not isinstance(at, T.StructType) or step not in at.names:
            return None
        at = at[step].dataType
    kind = _key_type(at.elementType if isinstance(at, T.ArrayType) else at)
    if stem and stem < len(path):
        return Field(name, ".".join(path[stem:]), kind, nested=".".join(path[:stem]), fixed=fixed)
    return Field(name, ".".join(path), kind)


def with_paths(catalog: FieldCatalog, df: DataFrame, shorthands: dict[str, Path], integral: tuple[str, ...] = (), fixed: dict[str, tuple[tuple[str, str], ...]] | None = None) -> FieldCatalog:
    """The catalog with properties that stand for paths.

    Each becomes the field at its path; if integral relations offer several ways that the table has,
    a composite of all of them. ``fixed`` adds conditions that a restricted property asks of the element.
    """
    more = []
    for name, path in shorthands.items():
        found = [(w, f) for w in alternatives(path, integral) if (f := field_at("/".join(w) + f"#{name}", w, df.schema, (fixed or {}).get(name, ())))]
        more += [f for _, f in found]
        if len(found) == 1:
            f = found[0][1]
            more.append(Field(name, f.path, f.kind, nested=f.nested, fixed=f.fixed))
        elif found:
            more.append(Field(name, "", found[0][1].kind, parts=tuple(f.name for _, f in found)))
    return FieldCatalog([*catalog.fields.values(), *more], catalog.aliases, catalog.filters, catalog.types, catalog.text, catalog.coerce, catalog.labels, catalog.codes)
