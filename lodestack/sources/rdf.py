"""RDF: N-Quads to rows and back, a Turtle subset, graph-pattern selection over quads."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_IRI, _BLANK = r"<([^<>\"{}|^`\\\x00-\x20]*)>", r"(_:[^\s<>\"]+)"
_LITERAL = r"\"((?:[^\"\\\n\r]|\\.)*)\"(?:\^\^<([^<>\s]*)>|@([A-Za-z0-9-]+))?"
_QUAD = rf"^\s*(?:{_IRI}|{_BLANK})\s+{_IRI}\s+(?:{_IRI}|{_BLANK}|{_LITERAL})\s*(?:{_IRI}|{_BLANK})?\s*\.\s*(?:#.*)?$"
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))")
_SIMPLE = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """``s, p, o, o_type, datatype, lang, g``: one row per statement, by expressions on each line."""
    lines = spark.read.text(path).where(F.col("value").rlike(_QUAD))

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract("value", _QUAD, i), F.lit(""))

    is_literal = F.regexp_extract("value", rf"^\s*(?:{_IRI}|{_BLANK})\s+{_IRI}\s+(\")", 4) == '"'
    literal = F.regexp_extract("value", _QUAD, 6)
    for sign, char in (("t", "\t"), ("n", "\n"), ("r", "\r"), ("b", "\b"), ("f", "\f")):
        literal = F.regexp_replace(literal, rf"(?<!\\)((?:\\\\)*)\\{sign}", "$1" + char)
    literal = F.regexp_replace(literal, r"\\([\"\\])", "$1")
    kind = F.when(is_literal, "literal").when(part(4).isNotNull(), "iri").otherwise("blank")
    return lines.select(F.coalesce(part(1), part(2)).alias("s"), part(3).alias("p"), F.when(is_literal, literal).otherwise(F.coalesce(part(4), part(5))).alias("o"), kind.alias("o_type"), part(7).alias("datatype"), part(8).alias("lang"), F.coalesce(part(9), part(10)).alias("g"))


def bad_nquads(spark: SparkSession, path: str) -> DataFrame:
    """``value``: lines that ``read_nquads`` leaves out although they are neither empty nor comments."""
    return spark.read.text(path).where(~F.col("value").rlike(_QUAD) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


def nquad_lines(quads: DataFrame) -> DataFrame:
    """``value``: statements as N-Quads lines."""
    def node(c: str) -> Column:
        return F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))

    text = F.col("o")
    for raw, safe in (("\\\\", "\\\\\\\\"), ("\"", "\\\\\""), ("\n", "\\\\n"), ("\r", "\\\\r")):
        text = F.regexp_replace(text, raw, safe)
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">"))).otherwise("")
    value = F.when(F.col("o_type") == "literal", F.concat(F.lit('"'), text, F.lit('"'), tail)).otherwise(node("o"))
    graph = F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), node("g"))).otherwise("")
    return quads.select(F.concat(node("s"), F.lit(" <"), "p", F.lit("> "), value, graph, F.lit(" .")).alias("value"))


_TURTLE = re.compile(r"(?P<iri><[^<>\s]*>)|(?P<long>\"\"\"(?:[^\\]|\\.)*?\"\"\")|(?P<text>\"(?:[^\"\\\n]|\\.)*\")|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w:]))|(?P<lang>@[A-Za-z][\w-]*)|(?P<type>\^\^)|(?P<name>(?:[A-Za-z_][\w.-]*)?:[\w%.-]*(?<!\.)|_:[\w.-]+(?<!\.))|(?P<word>[A-Za-z]+)|(?P<sign>[.;,\[\]()])|(?P<skip>\s+|#[^\n]*)")


def parse_turtle(text: str, base: str = "") -> Iterator[tuple[str, str, str, str, str | None, str | None]]:
    """``s, p, o, o_type, datatype, lang`` of a Turtle document (prefixes, lists of objects, blank nodes, collections)."""
    tokens, at = [], 0
    while at < len(text):
        m = _TURTLE.match(text, at)
        if not m:
            raise ValueError(f"no Turtle at character {at}: {text[at : at + 20]!r}")
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m.group()))
        at = m.end()
    prefixes: dict[str, str] = {}
    pos, blanks = 0, 0
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    xsd = "http://www.w3.org/2001/XMLSchema#"

    def unescape(s: str) -> str:
        return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _SIMPLE.get(m[3], m[3]), s)

    def fresh() -> str:
        nonlocal blanks
        blanks += 1
        return f"_:t{blanks}"

    def iri(kind: str, value: str) -> str:
        if kind == "iri":
            inner = value[1:-1]
            return inner if ":" in inner else base + inner
        if value.startswith("_:"):
            return value
        prefix, _, local = value.partition(":")
        return prefixes[prefix] + local

    def node(out: list):
        nonlocal pos
        kind, value = tokens[pos]
        pos += 1
        if kind in ("iri", "name"):
            n = iri(kind, value)
            return n, "blank" if n.startswith("_:") else "iri", None, None
        if kind in ("text", "long"):
            body, lang, datatype = unescape(value[3:-3] if kind == "long" else value[1:-1]), None, None
            if pos < len(tokens) and tokens[pos][0] == "lang":
                lang = tokens[pos][1][1:]
                pos += 1
            elif pos < len(tokens) and tokens[pos][0] == "type":
                datatype = iri(*tokens[pos + 1])
                pos += 2
            return body, "literal", datatype, lang
        if kind == "number":
            return value, "literal", xsd + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None
        if kind == "word" and value in ("true", "false"):
            return value, "literal", xsd + "boolean", None
        if value == "[":
            b = fresh()
            if tokens[pos][1] != "]":
                predicates(b, out)
            pos += 1
            return b, "blank", None, None
        if value == "(":
            members = []
            while tokens[pos][1] != ")":
                members.append(node(out))
            pos += 1
            head = rdf + "nil"
            for m in reversed(members):
                b = fresh()
                out.append((b, rdf + "first", *m))
                out.append((b, rdf + "rest", head, "blank" if head.startswith("_:") else "iri", None, None))
                head = b
            return head, "blank" if head.startswith("_:") else "iri", None, None
        raise ValueError(f"unexpected {value!r} in Turtle")

    def predicates(subject: str, out: list) -> None:
        nonlocal pos
        while True:
            kind, value = tokens[pos]
            pos += 1
            predicate = rdf + "type" if (kind, value) == ("word", "a") else iri(kind, value)
            while True:
                out.append((subject, predicate, *node(out)))
                if tokens[pos][1] != ",":
                    break
                pos += 1
            while tokens[pos][1] == ";":
                pos += 1
            if tokens[pos][1] in (".", "]"):
                return

    while pos < len(tokens):
        kind, value = tokens[pos]
        if value in ("@prefix", "@base") or (kind == "word" and value.upper() in ("PREFIX", "BASE")):
            if value.lower().endswith("prefix"):
                prefixes[tokens[pos + 1][1].rstrip(":")] = iri(*tokens[pos + 2])
                pos += 3
            else:
                base = tokens[pos + 1][1][1:-1]
                pos += 2
            if pos < len(tokens) and tokens[pos][1] == "." and value.startswith("@"):
                pos += 1
            continue
        out: list = []
        subject = node(out)[0]
        if tokens[pos][1] != ".":
            predicates(subject, out)
        pos += 1
        yield from out


def read_turtle(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """``s, p, o, o_type, datatype, lang, g``: whole Turtle files, each parsed in one task; ``g`` is the file."""
    columns = ["s", "p", "o", "o_type", "datatype", "lang", "g"]

    def run(batches):
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                rows += [(*t, file) for t in parse_turtle(bytes(content).decode("utf-8"), base)]
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ", ".join(f"{c} string" for c in columns))


def select_pattern(quads: DataFrame, pattern: list[tuple[str, str, str]]) -> DataFrame:
    """Solutions of a conjunctive pattern: names with ``?`` are variables; the rest are constants."""
    out: DataFrame | None = None
    for triple in pattern:
        rows, names = quads, []
        first: dict[str, str] = {}
        for column, term in zip(("s", "p", "o"), triple):
            if not term.startswith("?"):
                rows = rows.where(F.col(column) == term)
            elif term in first:
                rows = rows.where(F.col(column) == F.col(first[term]))
            else:
                first[term] = column
                names.append((column, term[1:]))
        rows = rows.select(*[F.col(c).alias(n) for c, n in names]).distinct()
        if out is None:
            out = rows
        else:
            shared = [n for _, n in names if n in out.columns]
            if not shared:
                raise ValueError("a pattern's parts must share a variable")
            out = out.join(rows, shared)
    return out.distinct()


def turtle(rows: list[tuple], prefixes: dict[str, str]) -> str:
    """Turtle of statements ``(s, p, o, o_type, datatype, lang)``, grouped by subject and predicate."""
    def short(iri: str) -> str:
        if iri.startswith("_:"):
            return iri
        for p, full in sorted(prefixes.items(), key=lambda x: -len(x[1])):
            if iri.startswith(full) and re.fullmatch(r"[A-Za-z_][\w-]*", iri[len(full) :]):
                return f"{p}:{iri[len(full):]}"
        return f"<{iri}>"

    def value(o, kind, datatype, lang) -> str:
        if kind != "literal":
            return short(o)
        text = o.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
        return f'"{text}"' + (f"@{lang}" if lang else f"^^{short(datatype)}" if datatype and datatype != XSD_STRING else "")

    by: dict[str, dict[str, list[str]]] = {}
    for s, p, *o in rows:
        by.setdefault(s, {}).setdefault(p, []).append(value(*o))
    head = "".join(f"@prefix {p}: <{iri}> .\n" for p, iri in sorted(prefixes.items()))
    kind = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    blocks = [short(s) + " " + " ;\n    ".join(("a" if p == kind else short(p)) + " " + ", ".join(os) for p, os in ps.items()) + " ." for s, ps in by.items()]
    return head + "\n" + "\n\n".join(blocks) + "\n"


def trig(graphs: dict[str, list[tuple]], prefixes: dict[str, str]) -> str:
    """TriG of named graphs."""
    head = "".join(f"@prefix {p}: <{iri}> .\n" for p, iri in sorted(prefixes.items()))
    return head + "".join(f"\n<{g}> {{\n{turtle(rows, prefixes).split(chr(10) * 2, 1)[-1] if not prefixes else turtle(rows, prefixes)[len(head):].strip()}\n}}\n" for g, rows in graphs.items())


def rdf_xml(rows: list[tuple]) -> str:
    """RDF/XML of statements; predicates are cut at their last ``/`` or ``#``."""
    from xml.sax.saxutils import escape, quoteattr

    names: dict[str, str] = {}
    out = []
    for s, p, o, kind, datatype, lang in rows:
        cut = max(p.rfind("/"), p.rfind("#")) + 1
        ns = names.setdefault(p[:cut], f"n{len(names)}")
        about = f"rdf:nodeID={quoteattr(s[2:])}" if s.startswith("_:") else f"rdf:about={quoteattr(s)}"
        if kind == "literal":
            more = f" xml:lang={quoteattr(lang)}" if lang else f" rdf:datatype={quoteattr(datatype)}" if datatype else ""
            inner = f"<{ns}:{p[cut:]}{more}>{escape(o)}</{ns}:{p[cut:]}>"
        else:
            link = f"rdf:nodeID={quoteattr(o[2:])}" if o.startswith("_:") else f"rdf:resource={quoteattr(o)}"
            inner = f"<{ns}:{p[cut:]} {link}/>"
        out.append(f"<rdf:Description {about}>{inner}</rdf:Description>")
    spaces = "".join(f' xmlns:{n}={quoteattr(iri)}' for iri, n in names.items())
    return f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"{spaces}>' + "".join(out) + "</rdf:RDF>"


_PIECE = re.compile(r'"""(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*"|<[^<>\s]*>|#[^\n]*|[{}]|[^"<#{}]+|.', re.DOTALL)
_NAME_BEFORE = re.compile(r"(?:\bGRAPH\s+)?(<[^<>\s]*>|[A-Za-z_][\w.-]*:[\w%.-]*|:[\w%.-]+|_:[\w.-]+)?\s*$")


def parse_trig(text: str, base: str = "") -> Iterator[tuple]:
    """``s, p, o, o_type, datatype, lang, g`` of a TriG document: Turtle with named graphs in braces."""
    prefixes = dict(re.findall(r"(?im)^\s*@?prefix\s+([\w-]*):\s*<([^>]*)>", text))
    heads = "\n".join(f"@prefix {p}: <{iri}> ." for p, iri in prefixes.items()) + "\n"
    outside, inside, name = "", None, None
    for m in _PIECE.finditer(text):  # braces count outside literals, names and comments only
        piece = m.group()
        if piece == "{" and inside is None:
            before = _NAME_BEFORE.search(outside)
            name, outside, inside = before.group(1), outside[: before.start()], ""
            if name and name[0] != "<" and not name.startswith("_:"):
                p, _, local = name.partition(":")
                name = prefixes.get(p, p + ":") + local
        elif piece == "}" and inside is not None:
            body = inside.strip()
            for row in parse_turtle(heads + body + ("" if not body or body.endswith(".") else " ."), base):
                yield (*row, name.strip("<>") if name else None)
            inside = None
        elif inside is None:
            outside += piece
        else:
            inside += piece
    for row in parse_turtle(outside, base):
        yield (*row, None)


def read_trig(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """``s, p, o, o_type, datatype, lang, g``: statements of TriG files, one file in one task."""
    columns = ["s", "p", "o", "o_type", "datatype", "lang", "g"]

    def run(batches):
        for pdf in batches:
            rows = [r for content in pdf["content"] for r in parse_trig(bytes(content).decode("utf-8"), base)]
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"{c} string" for c in columns))
