"""MARC records: ISO 2709 and JSON forms, as rows of fields, and usage statistics."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_END, FIELD_END, SUBFIELD = b"\x1d", b"\x1e", b"\x1f"


def parse_iso2709(data: bytes) -> dict:
    """Leader and fields of one record: ``{"leader": …, "fields": [{tag: value | {ind1, ind2, subfields}}]}``."""
    base = int(data[12:17])
    directory, body, fields = data[24 : base - 1], data[base:], []
    for i in range(0, len(directory) - 11, 12):
        tag, size, start = directory[i : i + 3].decode(), int(directory[i + 3 : i + 7]), int(directory[i + 7 : i + 12])
        raw = body[start : start + size].rstrip(FIELD_END)
        if tag < "010":
            fields.append({tag: raw.decode("utf-8", "replace")})
        else:
            parts = raw.split(SUBFIELD)
            ind = parts[0].decode("utf-8", "replace").ljust(2)
            fields.append({tag: {"ind1": ind[0], "ind2": ind[1], "subfields": [{p[:1].decode(): p[1:].decode("utf-8", "replace")} for p in parts[1:] if p]}})
    return {"leader": data[:24].decode("utf-8", "replace"), "fields": fields}


def format_iso2709(record: dict) -> bytes:
    """The bytes of one record; lengths in the leader and the directory are set anew."""
    directory, body = b"", b""
    for field in record["fields"]:
        (tag, value), = field.items()
        if isinstance(value, str):
            raw = value.encode()
        else:
            raw = (value["ind1"] + value["ind2"]).encode() + b"".join(SUBFIELD + k.encode() + v.encode() for s in value["subfields"] for k, v in s.items())
        raw += FIELD_END
        directory += f"{tag}{len(raw):04d}{len(body):05d}".encode()
        body += raw
    base = 24 + len(directory) + 1
    total = base + len(body) + 1
    leader = record["leader"].ljust(24)
    head = f"{total:05d}{leader[5:12]}{base:05d}{leader[17:24]}".encode()
    return head + directory + FIELD_END + body + RECORD_END


def read_iso2709(spark: SparkSession, path: str) -> DataFrame:
    """``file, position, marc``: every record of every file, as JSON text; a record that cannot be read has null."""

    def run(batches):
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                for i, raw in enumerate(r for r in bytes(content).split(RECORD_END) if r.strip()):
                    try:
                        rows.append((file, i, json.dumps(parse_iso2709(raw + RECORD_END), ensure_ascii=False)))
                    except (ValueError, IndexError):
                        rows.append((file, i, None))
            yield pd.DataFrame(rows, columns=["file", "position", "marc"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, position int, marc string")


def to_xml(record: dict) -> str:
    """MARCXML of one record."""
    from xml.sax.saxutils import escape, quoteattr

    out = [f"<record><leader>{escape(record['leader'])}</leader>"]
    for field in record["fields"]:
        (tag, value), = field.items()
        if isinstance(value, str):
            out.append(f"<controlfield tag={quoteattr(tag)}>{escape(value)}</controlfield>")
        else:
            inner = "".join(f"<subfield code={quoteattr(k)}>{escape(v)}</subfield>" for s in value["subfields"] for k, v in s.items())
            out.append(f"<datafield tag={quoteattr(tag)} ind1={quoteattr(value['ind1'])} ind2={quoteattr(value['ind2'])}>{inner}</datafield>")
    return "".join(out) + "</record>"


def from_xml(text: str) -> list[dict]:
    """Records of a MARCXML document, whatever its namespace prefix."""
    import xml.etree.ElementTree as tree

    def local(e) -> str:
        return e.tag.rpartition("}")[2]

    out = []
    for record in (e for e in tree.fromstring(text).iter() if local(e) == "record"):
        made: dict = {"leader": " " * 24, "fields": []}
        for e in record:
            if local(e) == "leader":
                made["leader"] = e.text or ""
            elif local(e) == "controlfield":
                made["fields"].append({e.get("tag"): e.text or ""})
            elif local(e) == "datafield":
                subfields = [{x.get("code"): x.text or ""} for x in e if local(x) == "subfield"]
                made["fields"].append({e.get("tag"): {"ind1": e.get("ind1", " "), "ind2": e.get("ind2", " "), "subfields": subfields}})
        out.append(made)
    return out


def read_marcxml(spark: SparkSession, path: str) -> DataFrame:
    """``file, position, marc``: every record of every MARCXML file, as JSON text; a file that is no XML has one null."""

    def run(batches):
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(file, i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(from_xml(bytes(content).decode("utf-8", "replace")))]
                except SyntaxError:
                    rows.append((file, 0, None))
            yield pd.DataFrame(rows, columns=["file", "position", "marc"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, position int, marc string")


def usage(df: DataFrame, marc: str = "marc", floor: int = 1) -> DataFrame:
    """``tag, code, n``: how many subfields (or control fields) of each kind occur, from ``floor`` on."""

    def run(batches):
        for pdf in batches:
            counts: dict[tuple[str, str], int] = {}
            for text in pdf[marc].dropna():
                for field in json.loads(text)["fields"]:
                    (tag, value), = field.items()
                    for code in [""] if isinstance(value, str) else [k for s in value["subfields"] for k in s]:
                        counts[tag, code] = counts.get((tag, code), 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["tag", "code", "n"])

    return df.select(marc).mapInPandas(run, "tag string, code string, n long").groupBy("tag", "code").agg(F.sum("n").alias("n")).where(F.col("n") >= floor)
