"""Identifiers: ISBN forms and hyphens, ISNI, generated ids, term and IRI forms, status codes."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of generated ids (no vowels), and the groups of the registration ranges in use.
ID_ALPHABET = "0123456789bcdfghjklmnpqrstvwxz"
ENCODING_LEVELS = {" ": "FullLevel", "1": "FullLevelInputFromExternalAgency", "2": "LessThanFullLevel", "3": "AbbreviatedLevel", "4": "PrepublicationLevel", "5": "PartialPreliminaryLevel", "7": "MinimalLevel", "8": "PreliminaryLevel"}


def looks_like_isbn(column: Column) -> Column:
    """Ten or thirteen digits (the last may be X), hyphens apart."""
    return F.regexp_replace(column, "-", "").rlike(r"^(?:\d{9}[\dXx]|97[89]\d{10})$")


def isbn13(column: Column) -> Column:
    """ISBN-13 of an ISBN-10 (checksum by expression); null if it is none."""
    core = F.regexp_replace(column, "[- ]", "")
    body = F.concat(F.lit("978"), F.substring(core, 1, 9))
    total = sum((F.try_to_number(F.substring(body, i + 1, 1), F.lit("9")).cast("int") * (3 if i % 2 else 1) for i in range(12)), F.lit(0))
    return F.when(core.rlike(r"^\d{9}[\dXx]$"), F.concat(body, ((10 - total % 10) % 10).cast("string")))


def isbn10(column: Column) -> Column:
    """ISBN-10 of an ISBN-13 that begins with 978; null if there is none."""
    core = F.regexp_replace(column, "[- ]", "")
    body = F.substring(core, 4, 9)
    total = sum((F.try_to_number(F.substring(body, i + 1, 1), F.lit("9")).cast("int") * (10 - i) for i in range(9)), F.lit(0))
    check = (11 - total % 11) % 11
    return F.when(core.rlike(r"^978\d{10}$"), F.concat(body, F.when(check == 10, "X").otherwise(check.cast("string"))))


def hyphenate_isbn(isbn: str, ranges: dict[str, list[tuple[int, int, int]]]) -> str:
    """Hyphens by ranges: ``{"978-91": [(first, last, registrant digits)]}`` over the next seven digits."""
    raw = re.sub("[^0-9Xx]", "", isbn)
    prefix, rest = ("978", raw) if len(raw) == 10 else (raw[:3], raw[3:])
    for size in range(1, 6):
        group = rest[:size]
        for low, high, digits in ranges.get(f"{prefix}-{group}", ()):
            tail = rest[size:-1]
            if low <= int(tail[:7].ljust(7, "0")) <= high:
                parts = [group, tail[:digits], tail[digits:], rest[-1].upper()]
                return "-".join(([prefix] if len(raw) == 13 else []) + parts)
    return raw


def format_isni(column: Column) -> Column:
    """Sixteen characters in groups of four."""
    core = F.regexp_replace(column, r"\s", "")
    return F.when(core.rlike(r"^\d{15}[\dXx]$"), F.regexp_replace(core, r"(.{4})(?=.)", "$1 ")).otherwise(column)


def base_encode(n: int, alphabet: str = ID_ALPHABET) -> str:
    out = ""
    while n:
        n, digit = divmod(n, len(alphabet))
        out = alphabet[digit] + out
    return out or alphabet[0]


def checksum_id(data: str) -> str:
    """CRC-32 of a text in the digits of generated ids."""
    return base_encode(zlib.crc32(data.encode()))


def checksum_id_column(column: Column, width: int = 7) -> Column:
    """The same as expression, padded with zeros: digits from arithmetic on ``crc32``."""
    n, base = F.crc32(column.cast("binary")), len(ID_ALPHABET)
    digits = [F.substring(F.lit(ID_ALPHABET), ((F.floor(n / (base**i)) % base) + 1).cast("int"), F.lit(1)) for i in reversed(range(width))]
    return F.concat(*digits)


def expand_term(column: Column, prefixes: dict[str, str], vocab: str) -> Column:
    """IRI of ``prefix:name`` or of a plain term."""
    out = F.concat(F.lit(vocab), column)
    for p, iri in sorted(prefixes.items()):
        out = F.when(column.startswith(p + ":"), F.concat(F.lit(iri), F.substring(column, len(p) + 2, 1 << 20))).otherwise(out)
    return F.when(column.contains("://"), column).otherwise(out)


def compact_iri(column: Column, prefixes: dict[str, str], vocab: str) -> Column:
    """Shortest known form of an IRI."""
    out = column
    for p, iri in sorted(prefixes.items(), key=lambda x: len(x[1])):
        out = F.when(column.startswith(iri), F.concat(F.lit(p + ":"), F.substring(column, len(iri) + 1, 1 << 20))).otherwise(out)
    return F.when(column.startswith(vocab), F.substring(column, len(vocab) + 1, 1 << 20)).otherwise(out)


def encoding_level(column: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ENCODING_LEVELS.items() for x in kv])[column], column)
