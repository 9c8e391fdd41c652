"""Romanisation by rule tables, and classification mapping by prefix tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Latin letters for Cyrillic and Greek ones (ISO 9 and ISO 843 style, lower case).
TABLES = {
    "Cyrl": {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "ë", "ж": "ž", "з": "z", "и": "i", "й": "j", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "č", "ш": "š", "щ": "ŝ", "ъ": "ʺ", "ы": "y", "ь": "ʹ", "э": "è", "ю": "û", "я": "â"},
    "Grek": {"ου": "ou", "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "ī", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "ō"},
}


def romanize(text: str, table: dict[str, str]) -> str:
    """Longest rule first; a capital keeps its first letter's case; what has no rule stays."""
    longest, out, i = max(map(len, table)), [], 0
    while i < len(text):
        for n in range(min(longest, len(text) - i), 0, -1):
            piece = text[i : i + n]
            new = table.get(piece.lower())
            if new is not None:
                out.append(new if piece == piece.lower() else new[:1].upper() + new[1:])
                i += n
                break
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def romanize_column(column: Column, script: str) -> Column:
    table = TABLES[script]

    @pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else romanize(v, table))

    return run(column)


def map_by_prefix(df: DataFrame, code: str, table: DataFrame, longest: int = 8) -> DataFrame:
    """Rows with the class of the longest prefix of their code. ``table``: ``prefix, mapped`` (one row per prefix).

    Each code is joined by its prefixes, so the cost is ``longest`` rows per code, not a range join.
    """
    coded = df.select(code).where(F.col(code).isNotNull()).distinct()
    prefixes = coded.select(code, F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length(code), F.lit(longest))), lambda n: F.substring(F.col(code), F.lit(1), n))).alias("prefix"))
    best = prefixes.join(table, "prefix").groupBy(code).agg(F.max_by("mapped", F.length("prefix")).alias("mapped"))
    return df.join(best, code, "left")
