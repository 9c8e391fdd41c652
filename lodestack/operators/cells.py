"""Equi-joins whose large groups are cut into cells, so that no value's pairs stay in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.scratch import materialise

#: Rows of a value on either side of one cell.
CELL_ROWS = 2048
#: Full cells for one task, at most about; more tasks are made where the session's number of them would get more.
TASK_CELLS = 16


def met(left: DataFrame, right: DataFrame, on: str, rows: int = CELL_ROWS, less: tuple[str, str] | None = None) -> DataFrame:
    """The inner join of two tables on one column; each pair of rows is made once.

    A value's rows are dealt into blocks of about ``rows`` on each side, and any two blocks meet in one
    cell. A row is sent once for each block of the other side, so what is sent stays far below the pairs.
    ``less``: a list on the left and a column on the right; pairs whose list holds the column's value are
    left out, where they would be made, and a row's list goes only to the cells of its members.
    """
    listed, member = less or (None, None)

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(on).isNotNull()).groupBy(on).agg(F.ceil(F.count("*") / rows).cast("int").alias(name), F.count("*").alias(name + "n"))

    def dealt(df: DataFrame, own: str, other: str, by: list[str]) -> DataFrame:
        placed = df.join(shared, on).withColumn(own, F.pmod(F.xxhash64(*by), F.col(own)).cast("int"))
        if listed in df.columns:
            placed = placed.withColumn("_all", F.col(other))
        placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        if listed in df.columns:
            placed = placed.withColumn(listed, F.filter(listed, lambda x: F.pmod(F.xxhash64(x), F.col("_all")) == F.col(other))).drop("_all")
        return placed.repartition(n, on, "_a", "_b")  # a number keeps the adaptive planner from joining partitions: small inputs, many pairs

    shared = materialise(blocks(left, "_a").join(blocks(right, "_b"), on), "blocks")
    full = shared.agg(F.sum(F.col("_an").cast("double") * F.col("_bn"))).first()[0] or 0
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(full / (rows * rows * TASK_CELLS)) + 1)
    shared = shared.select(on, "_a", "_b")
    pairs = dealt(left, "_a", "_b", left.columns).join(dealt(right, "_b", "_a", [member] if less else right.columns), [on, "_a", "_b"]).drop("_a", "_b")
    return pairs.where(~F.coalesce(F.array_contains(listed, F.col(member)), F.lit(False))).drop(listed) if less else pairs
