"""Keeping a store and its index in order: deletes, versions, copies, index documents, propagation, queues, schedules."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators import graph, store
from lodestack.operators.cells import met


def soft_delete(records: DataFrame, edges: DataFrame, ids: DataFrame, key: str, deleted: str = "deleted") -> tuple[DataFrame, DataFrame]:
    """Records with the given ones flagged as deleted, and the edges without those that leave from them."""
    gone = ids.select(F.col(key).alias("_gone")).distinct()
    flagged = records.join(gone, F.col(key) == F.col("_gone"), "left")
    before = F.coalesce(F.col(deleted), F.lit(False)) if deleted in records.columns else F.lit(False)
    flagged = flagged.withColumn(deleted, before | F.col("_gone").isNotNull()).drop("_gone")
    return flagged, edges.join(gone, F.col("src") == F.col("_gone"), "left_anti")


def append_versions(versions: DataFrame, writes: DataFrame, key: str, time: str, tiebreak: str, columns: list[str]) -> DataFrame:
    """Versions with those writes whose content differs from the key's latest version before them."""
    both = versions.withColumn("_new", F.lit(False)).unionByName(writes.withColumn("_new", F.lit(True)))
    both = both.withColumn("_sum", store.checksum(columns))
    marked = store.changed_from_previous(both, key, time, tiebreak, "_sum")
    return marked.where(~F.col("_new") | F.col("changed")).drop("_new", "_sum", "previous", "changed")


def copy_selection(records: DataFrame, versions: DataFrame, edges: DataFrame, chosen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The chosen records with all that they depend on, and the versions of these."""
    nodes = chosen.select(F.col(key).alias("node")).distinct()
    wanted = graph.closure(edges, nodes).select(F.col("node").alias(key)).distinct()
    return records.join(wanted, key, "left_semi"), versions.join(wanted, key, "left_semi")


def id_collisions(identifiers: DataFrame, iri: str = "iri", key: str = "id") -> DataFrame:
    """``iri, first, n``: identifiers that several records claim, with the smallest claimant."""
    return identifiers.groupBy(iri).agg(F.min(key).alias("first"), F.count_distinct(key).alias("n")).where("n > 1")


def map_ids(ids: DataFrame, strategies: list[tuple[DataFrame, str, str]], given: str = "given") -> DataFrame:
    """``given, id``: each given id by the first strategy (table, its column, id column) that knows it; unknown ids are left out."""
    found = None
    for rank, (table, column, target) in enumerate(strategies):
        hit = ids.select(given).join(table.select(F.col(column).alias(given), F.col(target).alias("id")), given).withColumn("rank", F.lit(rank))
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy(given).agg(F.min(F.struct("rank", "id")).alias("best")).select(given, "best.id")


def index_documents(df: DataFrame, key: str, body: str, most: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Documents that an index takes, and ``key, error`` of those that it refuses (no id, no body, too large)."""
    error = F.when(F.col(key).isNull(), "no id").when(F.col(body).isNull(), "no body").when(F.octet_length(body) > most, "too large")
    judged = df.withColumn("error", error)
    return judged.where("error is null").drop("error"), judged.where("error is not null").select(key, "error")


def reindex(df: DataFrame, key: str, body: str, path: str, by: str, most: int = 1 << 20) -> DataFrame:
    """Write index documents into one folder per ``by``; returns ``by, n, failed`` without a second pass over the text."""
    df.withColumn("_ok", F.col(key).isNotNull() & F.col(body).isNotNull() & (F.octet_length(body) <= most)).write.mode("overwrite").partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(by).agg(F.count_if("_ok").alias("n"), F.count_if(~F.col("_ok")).alias("failed"))


def propagation(before: DataFrame, after: DataFrame, integral: tuple[str, ...] = (), relation: str = "relation") -> DataFrame:
    """``id, reason``: what must be indexed anew after edges changed.

    The ends of added and removed edges (their link counts change), and the records that hold the
    changed record as a part of themselves (over ``integral`` relations).
    """
    delta = store.link_delta(before.select("src", relation, "dst"), after.select("src", relation, "dst"))
    ends = delta.select(F.col("dst").alias("id"), F.col("change").alias("reason"))
    changed = delta.select(F.col("src").alias("dst")).distinct()
    holders = after.where(F.col(relation).isin(*integral)).join(changed, "dst", "left_semi").select(F.col("src").alias("id"), F.lit("part").alias("reason"))
    return ends.unionByName(holders).distinct()


def historic_embellish(records: DataFrame, edge_versions: DataFrame, content_versions: DataFrame, at, levels: list[str], time: str = "time") -> DataFrame:
    """Embellished records as they were: the last state of each edge and each record's content not after ``at``.

    ``edge_versions``: ``src, dst, relation, time, removed``; ``content_versions``: ``node, data, time``.
    """
    edges = edge_versions.where(F.col(time) <= at).groupBy("src", "dst", "relation").agg(F.max_by("removed", time).alias("removed")).where(~F.col("removed")).drop("removed")
    content = content_versions.where(F.col(time) <= at).groupBy("node").agg(F.max_by("data", time).alias("data"))
    return graph.embellish(records, edges, {level: content for level in levels}, levels)


def embellish_by_collection(records: DataFrame, edges: DataFrame, content: dict[str, DataFrame], levels: dict[str, list[str]], collection: str = "collection") -> DataFrame:
    """``embellish`` with the levels that each collection of records asks for."""
    out = None
    for name, wanted in levels.items():
        part = graph.embellish(records.where(F.col(collection) == name).select("node"), edges, content, wanted)
        out = part if out is None else out.unionByName(part)
    return out


def queue_take(queue: DataFrame, key: str, time: str, n: int, state: str = "state") -> DataFrame:
    """The ``n`` oldest waiting entries, one for each key (its oldest)."""
    waiting = queue.where(F.col(state).isin("NEW", "REQUEUED")).groupBy(key).agg(F.min(time).alias(time))
    return waiting.orderBy(time, key).limit(n)


def queue_settle(queue: DataFrame, results: DataFrame, key: str, tries: int = 3, state: str = "state") -> DataFrame:
    """The queue after a batch: handled entries go, failed ones wait again, until they have failed ``tries`` times.

    ``results``: key and ``outcome`` (HANDLED, FAIL_REQUEUE, FAIL_RETRY). A retry keeps the entry's place,
    a requeue counts as a failure (column ``failures``).
    """
    joined = queue.join(results.select(key, "outcome"), key, "left")
    failures = F.col("failures") + F.when(F.col("outcome") == "FAIL_REQUEUE", 1).otherwise(0)
    after = F.when(F.col("outcome").isNull(), F.col(state)).when(F.col("outcome") == "FAIL_RETRY", F.lit("NEW")).when(failures >= tries, F.lit("FAILED")).otherwise(F.lit("REQUEUED"))
    return joined.where("outcome is null or outcome <> 'HANDLED'").select(*[c for c in queue.columns if c not in (state, "failures")], failures.alias("failures"), after.alias(state))


def due(job: str, now: dt.datetime) -> bool:
    """Whether a job of a five-field schedule (minute hour day month weekday, Monday is 1) is due at a minute."""
    values = now.minute, now.hour, now.day, now.month, now.isoweekday() % 7

    def fits(spec: str, value: int) -> bool:
        for part in spec.split(","):
            span, _, step = part.partition("/")
            low, _, high = span.partition("-")
            if span == "*":
                ok = True
            else:
                ok = int(low) <= value <= int(high or low)
            if ok and (not step or (value - (0 if span == "*" else int(low))) % int(step) == 0):
                return True
        return False

    return all(fits(s, v) for s, v in zip(job.split(), values, strict=True))


def run_due(jobs: Iterable[tuple[str, str, Callable[[], None]]], now: dt.datetime) -> list[str]:
    """Run the jobs (name, schedule, function) that are due; a job that fails does not stop the others. Returns ``name: outcome``."""
    out = []
    for name, schedule, job in jobs:
        if due(schedule, now):
            try:
                job()
                out.append(f"{name}: done")
            except Exception as e:  # noqa: BLE001  a job's failure is its own
                out.append(f"{name}: {e}")
    return out


def allowed(roles: dict[str, set[str]], collection: str = "collection", holder: str = "holder") -> Column:
    """Rows that a user may change: any where a role is global (``*``), else the holdings of the agents that the user acts for."""
    test = F.lit(False)
    for agent, collections in sorted(roles.items()):
        own = F.lit(True) if agent == "*" else F.col(holder) == F.lit(agent)
        test = test | (own & F.col(collection).isin(*sorted(collections)))
    return F.coalesce(test, F.lit(False))


def overlaps(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose half-open intervals overlap, by an equi-join on the buckets that they touch.

    Each pair is found in the first bucket that both touch, so none is doubled and no cross join is made.
    """
    on = on or []
    (a, b), (c, d) = left_span, right_span

    def bucketed(df: DataFrame, low: str, high: str, name: str) -> DataFrame:
        first, last = (F.floor(F.col(x) / width).cast("long") for x in (low, high))
        return df.where(F.col(high) > F.col(low)).withColumn(name, first).withColumn("_bucket", F.explode(F.sequence(first, last)))

    x, y = bucketed(left, a, b, "_x"), bucketed(right, c, d, "_y")
    pairs = x.join(y, ["_bucket", *on]).where((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & (F.col("_bucket") == F.greatest("_x", "_y")))
    return pairs.drop("_bucket", "_x", "_y")


def within(left: DataFrame, right: DataFrame, a: str, b: str, distance: float, on: list[str]) -> DataFrame:
    """Pairs of rows that agree in ``on`` and whose numbers differ by less than ``distance``; the difference itself decides.

    Numbers closer than that are in one bucket of twice the width or in neighbours, however they are rounded;
    missing and non-finite numbers are near nothing.
    """

    def bucketed(df: DataFrame, x: str, reach: Iterable[int]) -> DataFrame:
        known = F.abs(F.col(x)) < float("inf")
        for c in on:
            known = known & F.col(c).isNotNull()
        bucket = F.floor(F.least(F.greatest(F.col(x) / (2 * distance), F.lit(-1e18)), F.lit(1e18)))
        return df.where(known).withColumn("_bucket", F.explode(F.array(*[bucket + i for i in reach]))).withColumn("_v", F.struct(*on, "_bucket")).drop("_bucket")

    pairs = met(bucketed(left, a, (0,)), bucketed(right, b, (-1, 0, 1)).drop(*on), "_v")
    return pairs.where(F.abs(F.col(a) - F.col(b)) < distance).drop("_v")
