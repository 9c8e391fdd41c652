"""Small documents with the cases that every operator must stand."""

import random

WORDS = "the of and that with river stone over under light copper seven lantern across meadow quiet harbour signal winter bridge".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edge_rows():
    """doc_id, text: nulls, empty, white space, ties, repeated rows, a long text, a null id."""
    long = prose(7, 20_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, prose(1, 60)), (5, prose(1, 60)), (5, prose(1, 60)), (6, long), (None, prose(1, 60)), (8, "ÄÖÜ ß 字 \U0001f600\x00"), (9, prose(2, 3))]


def documents(spark, rows=None):
    """Rows with extra columns whose names clash with those that operators make."""
    rows = edge_rows() if rows is None else rows
    df = spark.createDataFrame([(*r, "x", 1, "y", 0.5, 7, "k") for r in rows], "doc_id long, text string, fingerprint string, start long, spans string, score double, tag int, u string")
    return df


def empty(spark):
    return documents(spark, []).limit(0)
