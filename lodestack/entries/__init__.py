"""The registered queries, each with its DuckDB SQL, by subject."""

from lodestack.entries.core import QUERIES, SQL, flagship
from lodestack.entries import functions, language, records, relations, shaping  # noqa: F401  they register themselves

__all__ = ["QUERIES", "SQL", "flagship"]
