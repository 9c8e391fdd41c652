"""Key-value parameters: values of one key are alternatives, different keys must all match.

Prefixes: ``and-`` (every value must match), ``or-`` (keys with it are alternatives of each other),
``not-``, ``exists-`` (true/false), ``min-``, ``minEx-``, ``max-``, ``maxEx-``, ``matches-``
(comma-separated values, with everything narrower).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.plans.catalog import FieldCatalog
from lodestack.plans.compiler import Compiler, two_valued
from lodestack.plans.tree import And, Condition

_BOUNDS = {"min-": ">=", "minEx-": ">", "max-": "<=", "maxEx-": "<"}


def predicate(params: dict[str, list[str]], catalog: FieldCatalog, arrays: tuple[str, ...] = (), match_missing: tuple[str, ...] = ()) -> Column:
    """Column for a parameter dictionary; unknown keys are ignored. A key in ``match_missing`` also matches rows without it."""
    compile_ = Compiler(catalog, arrays)

    def test(name: str, value: str, op: str = ":") -> Column:
        f = catalog.get(name)
        tokens = ((value, False),) if f.kind == "text" and op == ":" else ()
        return two_valued(compile_(Condition(f, op, value, tokens=tokens)))

    def fold(parts: list[Column], either: bool) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = out | p if either else out & p
        return out

    must, alternatives, bounds = [], [], {}
    for key, values in params.items():
        prefix = next((p for p in ("and-", "or-", "not-", "exists-", "matches-", *_BOUNDS) if key.startswith(p)), "")
        name = key.removeprefix(prefix)
        f = catalog.get(name)
        if f is None or not values:
            continue
        if prefix in _BOUNDS:
            bounds.setdefault(name, {})[prefix] = [v for x in values for v in x.split(",")]
        elif prefix == "exists-":
            present = two_valued(compile_(Condition(f, ":", "*")))
            must.append(fold([present if v.lower() == "true" else ~present for v in values], True))
        elif prefix == "not-":
            must += [~test(name, v) for v in values]
        elif prefix == "and-":
            must += [test(name, v) for v in values]
        elif prefix == "or-":
            alternatives += [test(name, v) for v in values]
        elif prefix == "matches-":
            terms = [v for x in values for v in x.split(",")]
            must.append(fold([test(name, v) for v in sorted({y for t in terms for y in [t, *catalog.types.descendants(t)]})], True))
        else:
            same = fold([test(name, v) for v in values], True)
            must.append(same | F.col(f.path).isNull() if name in match_missing else same)
    for name, by in bounds.items():
        # bounds pair up in order; several pairs are alternatives
        n = max(len(v) for v in by.values())
        must.append(fold([fold([test(name, v[i], _BOUNDS[p]) for p, v in by.items() if i < len(v)], False) for i in range(n)], True))
    if alternatives:
        must.append(fold(alternatives, True))
    return fold(must, False) if must else F.lit(True)


def site_filter(prefix: str, iri: str = "id", same_as: str | None = None) -> Column:
    """Rows whose identifier, or one of its aliases, begins with ``prefix``."""
    own = two_valued(F.col(iri).startswith(prefix))
    return own | two_valued(F.exists(same_as, lambda x: x.startswith(prefix))) if same_as else own


def nested_predicate(params: dict[str, list[str]], catalog: FieldCatalog) -> Column:
    """``and-`` values on fields of one array: the n-th values of all its keys must hold for one element each."""
    by_array: dict[str, dict[str, list[str]]] = {}
    for key, values in params.items():
        f = catalog.get(key.removeprefix("and-"))
        if key.startswith("and-") and f is not None and f.nested:
            by_array.setdefault(f.nested, {})[f.name] = values
    compile_, out = Compiler(catalog), F.lit(True)
    for fields in by_array.values():
        for i in range(max(map(len, fields.values()))):
            wanted = [Condition(catalog.get(name), ":", values[i]) for name, values in fields.items() if i < len(values)]
            out = out & two_valued(compile_(And(tuple(wanted))))
    return out
