"""Text functions. Built-in expressions where Spark has them; Arrow functions where it has no normaliser."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, IntegerType, StringType

# Ligatures written out, and quotation marks that count as the plain one.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
QUOTES = "“”„‟«»″"
#: Letters with marks that are letters of their own in Swedish.
OWN_LETTERS = "åäöÅÄÖ"

_SCRIPTS = {"Arab": "ARABIC", "Armn": "ARMENIAN", "Cyrl": "CYRILLIC", "Geor": "GEORGIAN", "Grek": "GREEK", "Hebr": "HEBREW", "Hang": "HANGUL", "Hani": "CJK", "Hira": "HIRAGANA", "Kana": "KATAKANA", "Thai": "THAI", "Deva": "DEVANAGARI", "Latn": "LATIN"}
RIGHT_TO_LEFT = frozenset({"Arab", "Hebr"})


def normalize(text: str) -> str:
    """Composed form, ligatures written out, byte-order mark removed."""
    return unicodedata.normalize("NFC", "".join(LIGATURES.get(c, c) for c in text.replace("\ufeff", "")))


def normalize_for_search(text: str) -> str:
    """Compatibility form with plain quotation marks."""
    return re.sub(f"[{QUOTES}]", '"', unicodedata.normalize("NFKC", text))


def strip_marks(text: str, keep: str = "") -> str:
    """Without diacritics, but for the letters in ``keep``."""
    out = []
    for c in unicodedata.normalize("NFC", text):
        out.append(c if c in keep else "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)))
    return unicodedata.normalize("NFC", "".join(out))


def guess_script(text: str) -> str | None:
    """ISO 15924 code of the script that most letters belong to; None without letters."""
    counts: dict[str, int] = {}
    for c in text:
        if c.isalpha():
            name = unicodedata.name(c, "").split(" ")[0].split("-")[0]
            code = next((k for k, v in _SCRIPTS.items() if v == name), "Zyyy")
            counts[code] = counts.get(code, 0) + 1
    return max(sorted(counts), key=counts.__getitem__) if counts else None


def damerau_levenshtein(a: str, b: str, most: int = 100) -> int:
    """Edit distance with transpositions of neighbours; texts are compared up to ``most`` characters."""
    a, b = a[:most], b[:most]
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def _series(fn):
    return lambda s: s.map(lambda v: None if v is None else fn(v))


@pandas_udf(StringType())
def normalize_udf(s: pd.Series) -> pd.Series:
    return _series(normalize)(s)


@pandas_udf(StringType())
def normalize_for_search_udf(s: pd.Series) -> pd.Series:
    return _series(normalize_for_search)(s)


@pandas_udf(StringType())
def strip_marks_udf(s: pd.Series) -> pd.Series:
    return _series(strip_marks)(s)


@pandas_udf(StringType())
def guess_script_udf(s: pd.Series) -> pd.Series:
    return _series(guess_script)(s)


@pandas_udf(IntegerType())
def damerau_levenshtein_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else damerau_levenshtein(x, y) for x, y in zip(a, b)], dtype="Int32")


def trim_noise(column: Column) -> Column:
    """Without white space and punctuation at both ends."""
    return F.regexp_replace(column, r"^[\s\p{Punct}]+|[\s\p{Punct}]+$", "")


def collapse(column: Column) -> Column:
    """Lower case, white space runs as one space, no ends: a comparison key."""
    return F.trim(F.regexp_replace(F.lower(column), r"\s+", " "))


def flat_title(column: Column, generic: tuple[str, ...] = ()) -> Column:
    """Comparison form of a title: words in lower case, a generic subtitle removed."""
    out = column
    if generic:
        out = F.regexp_replace(out, r"(?i)\s*[:;]\s*(?:" + "|".join(map(re.escape, generic)) + r")\s*$", "")
    return F.trim(F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}]+", " "))


def page_count(column: Column) -> Column:
    """Number of pages that an extent text names (the first number before s, p or their words)."""
    return F.try_to_number(F.nullif(F.regexp_extract(column, r"(?i)(\d{1,5})\s*(?:s\.?|sidor|p\.?|pp\.?|pages)(?![\p{L}])", 1), F.lit("")), F.lit("99999")).cast("int")


def differs(before: str | None, after: str | None) -> bool:
    """Whether two names or titles differ by more than a slip: one is missing, or over one edit apart.

    Compared without case, diacritics and anything but letters and digits; long ones must be equal.
    """
    if before is None or after is None:
        return before is not after
    a, b = ("".join(c for c in strip_marks(x.lower()) if c.isalnum()) for x in (before, after))
    return a != b if max(len(a), len(b)) > 100 else damerau_levenshtein(a, b) > 1


def life_span_differs(before: str | None, after: str | None) -> bool:
    """Whether a birth or death year named before is another one, or none, after (``birth-death``).

    A year that only comes in is no change, nor is a text without a dash on either side.
    """
    if not isinstance(before, str) or not isinstance(after, str) or "-" not in before or "-" not in after:
        return False
    (birth, _, death), (new_birth, _, new_death) = (x.partition("-") for x in (before, after))
    return any(x.strip() and x.strip() != y.strip() for x, y in ((birth, new_birth), (death, new_death)))


@pandas_udf(BooleanType())
def string_changed(before: pd.Series, after: pd.Series) -> pd.Series:
    """``differs`` as a column."""
    return pd.Series([differs(x, y) for x, y in zip(before, after)], dtype=bool)


@pandas_udf(BooleanType())
def life_span_changed(before: pd.Series, after: pd.Series) -> pd.Series:
    """``life_span_differs`` as a column."""
    return pd.Series([life_span_differs(x, y) for x, y in zip(before, after)], dtype=bool)
