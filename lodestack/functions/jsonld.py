"""Linked-data algorithms on JSON trees: contexts, expanding and compacting, flattening, statements, vocabulary maps, lens paths."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"


class Context:
    """Terms, prefixes, ``@vocab``, coercion (``@type``) and containers (``@set, @list, @language``)."""

    def __init__(self, source: dict):
        self.vocab = source.get("@vocab", "")
        self.base = source.get("@base", "")
        self.language = source.get("@language")
        self.terms: dict[str, dict] = {}
        for name, v in source.items():
            if not name.startswith("@"):
                self.terms[name] = {"@id": v} if isinstance(v, str) else dict(v or {})
        self.ids = {name: self.iri(d.get("@id", name), True) for name, d in self.terms.items()}
        self.by_iri: dict[str, list[str]] = {}
        for name in sorted(self.ids, key=lambda n: (len(n), n)):
            self.by_iri.setdefault(self.ids[name], []).append(name)

    def iri(self, name: str, vocab: bool = False, depth: int = 8) -> str:
        """Full form of a term, a prefixed or a relative name."""
        if name.startswith(("@", "_:")) or "://" in name or depth == 0:
            return name
        if vocab and name in self.terms and (target := self.terms[name].get("@id")) not in (None, name):
            return self.iri(target, True, depth - 1)
        prefix, colon, local = name.partition(":")
        if colon and prefix in self.terms:
            return self.iri(self.terms[prefix].get("@id", prefix), True, depth - 1) + local
        if colon:
            return name
        return (self.vocab if vocab else self.base) + name

    def compact(self, iri: str, vocab: bool = False) -> str:
        """Shortest form of an IRI."""
        if vocab and iri in self.by_iri:
            return self.by_iri[iri][0]
        if vocab and self.vocab and iri.startswith(self.vocab):
            return iri[len(self.vocab) :]
        fits = [(len(full), name) for name, full in self.ids.items() if full and iri.startswith(full) and iri != full and full[-1] in "/#:?"]
        if fits:
            size, name = max(fits)
            return f"{name}:{iri[size:]}"
        return iri[len(self.base) :] if self.base and iri.startswith(self.base) and not vocab else iri


def expand(item, context: Context, coerce: str | None = None):
    """Expanded form: full names, every value in a list of value or node objects."""
    if isinstance(item, list):
        return [y for x in item for y in _listed(expand(x, context, coerce))]
    if not isinstance(item, dict):
        if item is None:
            return []
        if coerce in ("@id", "@vocab") and isinstance(item, str):
            return [{"@id": context.iri(item, coerce == "@vocab")}]
        value = {"@value": item}
        if coerce:
            value["@type"] = context.iri(coerce, True)
        elif isinstance(item, str) and context.language:
            value["@language"] = context.language
        return [value]
    if "@value" in item:
        return [{k: context.iri(v, True) if k == "@type" else v for k, v in item.items()}]
    if "@list" in item:
        return [{"@list": expand(item["@list"], context, coerce)}]
    out: dict = {}
    for k, v in item.items():
        if k == "@context":
            continue
        if k == "@id":
            out["@id"] = context.iri(v)
        elif k == "@type":
            out["@type"] = [context.iri(t, True) for t in _listed(v)]
        elif k in ("@graph", "@included"):
            out[k] = expand(v, context)
        elif k == "@reverse":
            out[k] = {context.iri(p, True): expand(x, context, "@id") for p, x in v.items()}
        else:
            spec = context.terms.get(k, {})
            full = context.iri(k, True)
            if "@reverse" in spec:
                out.setdefault("@reverse", {}).setdefault(context.iri(spec["@reverse"], True), []).extend(expand(v, context, "@id"))
                continue
            if ":" not in full:
                continue  # no name, no meaning
            container = spec.get("@container")
            if container == "@language" and isinstance(v, dict):
                values = [{"@value": s, "@language": lang} for lang, texts in sorted(v.items()) for s in _listed(texts)]
            elif container == "@list":
                values = [{"@list": expand(_listed(v), context, spec.get("@type"))}]
            else:
                values = expand(v, context, spec.get("@type"))
            out.setdefault(full, []).extend(_listed(values))
    return [out]


def _listed(x) -> list:
    return x if isinstance(x, list) else [x]


def compact(item, context: Context, key: str | None = None):
    """Compacted form of an expanded tree."""
    spec = context.terms.get(key, {}) if key else {}
    if isinstance(item, list):
        values = [compact(x, context, key) for x in item]
        return values[0] if len(values) == 1 and spec.get("@container") not in ("@set", "@list") and key != "@graph" else values
    if not isinstance(item, dict):
        return item
    if "@value" in item:
        kind, lang = item.get("@type"), item.get("@language")
        plain = kind == (context.iri(spec["@type"], True) if spec.get("@type") else None) and lang == (context.language if isinstance(item["@value"], str) and not kind else None)
        if plain:
            return item["@value"]
        return {k: context.compact(v, True) if k == "@type" else v for k, v in item.items()}
    if "@list" in item:
        inner = [compact(x, context, key) for x in item["@list"]]
        return inner if spec.get("@container") == "@list" else {"@list": inner}
    if set(item) == {"@id"} and spec.get("@type") in ("@id", "@vocab"):
        return context.compact(item["@id"], spec["@type"] == "@vocab")
    out: dict = {}
    for k, v in item.items():
        if k == "@id":
            out[k] = context.compact(v)
        elif k == "@type":
            types = [context.compact(t, True) for t in v]
            out[k] = types[0] if len(types) == 1 else types
        elif k == "@graph":
            out[k] = [compact(x, context) for x in v]
        elif k == "@reverse":
            out[k] = {context.compact(p, True): compact(x, context, context.compact(p, True)) for p, x in v.items()}
        else:
            names = context.by_iri.get(k, [])
            by_language = next((n for n in names if context.terms[n].get("@container") == "@language"), None)
            if by_language and all("@language" in x for x in v):
                texts: dict = {}
                for x in v:
                    texts.setdefault(x["@language"], []).append(x["@value"])
                out[by_language] = {lang: t[0] if len(t) == 1 else t for lang, t in texts.items()}
                continue
            name = context.compact(k, True)
            if context.terms.get(name, {}).get("@container") == "@list" and len(v) == 1 and "@list" in v[0]:
                out[name] = [compact(x, context, name) for x in v[0]["@list"]]
            else:
                out[name] = compact(v, context, name)
    return out


def statements(expanded: list[dict]) -> Iterator[tuple[str, str, str, str, str | None, str | None]]:
    """``s, p, o, o_type, datatype, lang`` of an expanded tree; blank nodes are numbered in order."""
    count = 0

    def name(node: dict) -> str:
        nonlocal count
        if "@id" not in node:
            node["@id"] = f"_:b{count}"
            count += 1
        return node["@id"]

    def value(x: dict):
        if "@value" in x:
            v = x["@value"]
            kind = x.get("@type") or (XSD + "boolean" if isinstance(v, bool) else XSD + "integer" if isinstance(v, int) else XSD + "double" if isinstance(v, float) else None)
            return (json.dumps(v) if not isinstance(v, str) else v), "literal", kind, x.get("@language")
        n = name(x)
        return n, "blank" if n.startswith("_:") else "iri", None, None

    def visit(node: dict):
        s = name(node)
        for t in node.get("@type", []):
            yield s, RDF_TYPE, t, "iri", None, None
        for p, xs in node.get("@reverse", {}).items():
            for x in xs:
                yield name(x), p, s, "blank" if s.startswith("_:") else "iri", None, None
                yield from visit(x)
        for k, xs in node.items():
            if k.startswith("@"):
                if k in ("@graph", "@included"):
                    for x in xs:
                        yield from visit(x)
                continue
            for x in xs:
                for y in x["@list"] if "@list" in x else [x]:
                    yield s, k, *value(y)
                    if "@value" not in y:
                        yield from visit(y)

    for node in expanded:
        yield from visit(node)


def to_quads(df: DataFrame, data: str, context: dict, graph: str) -> DataFrame:
    """``s, p, o, o_type, datatype, lang, g``: statements of a column of JSON documents; a text that is no JSON gives none."""
    columns = ["s", "p", "o", "o_type", "datatype", "lang", "g"]

    def run(batches):
        known = Context(context)
        for pdf in batches:
            rows = []
            for text, g in pdf.itertuples(index=False):
                try:
                    item = json.loads(text) if text else None
                except json.JSONDecodeError:
                    continue
                if item is not None:
                    rows += [(*t, None if g is None else str(g)) for t in statements(expand(item, known))]
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return df.select(data, graph).mapInPandas(run, ", ".join(f"{c} string" for c in columns))


def target_map(axioms: list[tuple[str, str, str]], wanted: set[str]) -> dict[str, list[str]]:
    """Names of another vocabulary for each name, by equivalence or the nearest broader one.

    ``axioms``: ``(name, relation, other)`` with relation ``same`` or ``broader``.
    """
    same: dict[str, set[str]] = {}
    broader: dict[str, set[str]] = {}
    for a, relation, b in axioms:
        if relation == "same":
            same.setdefault(a, set()).add(b)
            same.setdefault(b, set()).add(a)
        else:
            broader.setdefault(a, set()).add(b)
    out = {}
    for name in {x for a, _, b in axioms for x in (a, b)}:
        level, seen = {name}, {name}
        while level:
            near = set(level)
            grown = True
            while grown:
                more = {y for x in near for y in same.get(x, ())} - near
                near |= more
                grown = bool(more)
            if hits := sorted(near & wanted):
                out[name] = hits
                break
            seen |= near
            level = {y for x in near for y in broader.get(x, ())} - seen
    return out


def map_vocabulary(item, names: dict[str, list[str]], keep_unmapped: bool = True):
    """A tree with its keys and types renamed; values of keys that become one are put together."""
    if isinstance(item, list):
        return [map_vocabulary(x, names, keep_unmapped) for x in item]
    if not isinstance(item, dict):
        return item
    out: dict = {}
    for k, v in item.items():
        if k == "@type":
            types = [t for x in _listed(v) for t in names.get(x, [x] if keep_unmapped else [])]
            if types:
                out[k] = types[0] if len(types) == 1 else types
            continue
        for name in [k] if k.startswith("@") else names.get(k, [k] if keep_unmapped else []):
            new = map_vocabulary(v, names, keep_unmapped)
            out[name] = _listed(out[name]) + [x for x in _listed(new) if x not in _listed(out[name])] if name in out else new
    return out


def select_path(node: dict, path: str, is_a=lambda a, b: a == b) -> list:
    """Values at a lens path: property and type steps in turn (``prop/Type/prop``), ``in::p`` for inverse links, ``*`` for any type."""
    level = [node]
    for i, step in enumerate(path.split("/")):
        if i % 2:
            level = [x for x in level if step == "*" or (isinstance(x, dict) and any(is_a(t, step) for t in _listed(x.get("@type"))))]
        else:
            found = []
            for x in level:
                if isinstance(x, dict):
                    v = x.get("@reverse", {}).get(step[4:]) if step.startswith("in::") else x.get(step)
                    found += [] if v is None else _listed(v)
            level = found
    return level


def format_values(values: list, before: str = "", after: str = "", first: str | None = None, last: str | None = None) -> str:
    """Values as text with what comes before and after each; the first and the last may differ."""
    out = []
    for i, v in enumerate(values):
        lead = first if i == 0 and first is not None else before
        tail = last if i == len(values) - 1 and last is not None else after
        out.append(f"{lead}{v}{tail}")
    return "".join(out)


def promote_id(record: dict, old: str, new: str):
    """The record with every occurrence of an id replaced."""
    if isinstance(record, dict):
        return {k: new if k == "@id" and v == old else promote_id(v, old, new) for k, v in record.items()}
    return [promote_id(x, old, new) for x in record] if isinstance(record, list) else record


def normalise(record: dict, steps: list) -> dict:
    """A record after a chain of normalisers, each a function from a record to a record."""
    for step in steps:
        record = step(record)
    return record


def drop_nulls(item):
    """Without null values and what is left empty by that."""
    if isinstance(item, dict):
        new = {k: drop_nulls(v) for k, v in item.items() if v is not None}
        return {k: v for k, v in new.items() if v not in ({}, [])}
    return [y for x in item if x is not None and (y := drop_nulls(x)) not in ({}, [])] if isinstance(item, list) else item


def single_types(item, is_a=lambda a, b: a == b):
    """Of several types only those that no other one specialises."""
    if isinstance(item, dict):
        new = {k: single_types(v, is_a) for k, v in item.items()}
        if isinstance(new.get("@type"), list):
            kept = [t for t in new["@type"] if not any(o != t and is_a(o, t) for o in new["@type"])]
            new["@type"] = kept[0] if len(kept) == 1 else kept
        return new
    return [single_types(x, is_a) for x in item] if isinstance(item, list) else item


def flatten_graph(expanded: list[dict]) -> list[dict]:
    """Node objects of an expanded tree, each id once with the values of all its places, links in their place."""
    nodes: dict[str, dict] = {}
    for s, p, o, kind, datatype, lang in statements(json.loads(json.dumps(expanded))):
        node = nodes.setdefault(s, {"@id": s})
        if p == RDF_TYPE:
            if o not in node.setdefault("@type", []):
                node["@type"].append(o)
            continue
        value = {"@id": o} if kind != "literal" else {"@value": o, **({"@type": datatype} if datatype else {}), **({"@language": lang} if lang else {})}
        if value not in node.setdefault(p, []):
            node[p].append(value)
    return sorted(nodes.values(), key=lambda n: n["@id"])


def from_statements(rows: list[tuple]) -> list[dict]:
    """Expanded node objects of statements ``s, p, o, o_type, datatype, lang``; numbers and booleans as values of their own."""
    nodes: dict[str, dict] = {}
    for s, p, o, kind, datatype, lang in rows:
        node = nodes.setdefault(s, {"@id": s})
        if p == RDF_TYPE:
            node.setdefault("@type", []).append(o)
        elif kind != "literal":
            node.setdefault(p, []).append({"@id": o})
        elif datatype in (XSD + "integer", XSD + "boolean", XSD + "double"):
            node.setdefault(p, []).append({"@value": json.loads(o)})
        else:
            node.setdefault(p, []).append({"@value": o, **({"@type": datatype} if datatype else {}), **({"@language": lang} if lang else {})})
    return sorted(nodes.values(), key=lambda n: n["@id"])
