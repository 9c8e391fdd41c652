"""Command line: ``python -m lodestack list | query NAME DIR [OUT] | sql NAME | reindex DIR TABLE KEY BODY BY OUT``.

``query`` writes Parquet to OUT, or shows the first rows. The session is the one that spark-submit
gives, or a local one.
"""

from __future__ import annotations

import sys


def main(arguments: list[str]) -> int:
    from lodestack import entries

    match arguments:
        case ["list"]:
            print(*sorted(entries.QUERIES), sep="\n")
        case ["sql", name] if name in entries.SQL:
            print(entries.SQL[name])
        case ["query", name, folder, *out] if name in entries.QUERIES:
            df = entries.QUERIES[name](_session(), folder)
            df.write.parquet(out[0]) if out else df.show(truncate=60)
        case ["reindex", folder, table, key, body, by, out]:
            from lodestack.entries.core import read
            from lodestack.operators.upkeep import reindex

            reindex(read(_session(), folder, table).select(key, body, by), key, body, out, by).show(1000, truncate=False)
        case _:
            print(__doc__, file=sys.stderr)
            return 2
    return 0


def _session():
    from pyspark.sql import SparkSession

    from lodestack.session import local_session

    return SparkSession.getActiveSession() or local_session()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
