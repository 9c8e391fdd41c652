"""Embedding near-duplicates with an inverted multi-index.

Vectors are brought to length one and cut in halves. Each half has a codebook of its own (k-means on
a bounded sample, more centroids for more vectors), and the pairs of centroids form a grid of cells.
Two vectors with cosine at least t differ by at most sqrt(2 - 2t); a half that falls into another
centroid's cell differs by at least its distance to the plane between the two centroids. A query
visits the cells of the grid in the order of the lower bound that its two halves give, nearest first
(multi-sequence order), until the target recall is reached: up to the bound below which the cell of
a neighbour at the threshold itself, in a random direction, lies with that probability (measured on
the sample). A target of one stops at the exact bound, which no neighbour can pass. Every candidate
is verified by its cosine in double precision.

A vector visits only cells that come after its own, so each pair of vectors meets in one cell. Equal
vectors of a label count as one with a weight. Cells with many vectors are cut into blocks that meet
pairwise, and a task returns counts and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import batch_of, map_batches
from lodestack.llm.simhash import unite
from lodestack.operators.components import connected_components
from lodestack.scratch import discard, materialise

THRESHOLD = 0.98
#: Bound of the sample that the codebooks are fitted on, and how many of its pairs at the threshold are tried.
FIT_ROWS, TRIALS = 4096, 32_768
#: Share of the neighbours at the threshold itself whose cell is visited; nearer ones are found more often.
RECALL = 0.9999
#: Centroids of a codebook: so many times the fourth root of the vectors, between these bounds.
CENTROIDS, LEAST_CENTROIDS, MOST_CENTROIDS = 1.6, 16, 512
#: Vectors of a cell that one task compares at once; four times as many may ask.
BLOCK = 256


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds, started from rows spread over the order of their first component."""
    x = x[np.lexsort(x.T[::-1])]
    centres = x[np.unique(np.linspace(0, len(x) - 1, k).astype(int))].copy()
    for _ in range(rounds):
        near = (x @ centres.T * -2 + (centres**2).sum(1)).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and for each centroid the least squared way into its cell."""
    d = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    near = d.argmin(1)
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
    with np.errstate(invalid="ignore", divide="ignore"):
        way = (d - d[np.arange(len(x)), near][:, None]) / (2 * apart[near])
    way[np.arange(len(x)), near] = 0.0
    return near, np.maximum(way, 0.0) ** 2


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) by ascending ``first[i] + second[j]``, as long as the sum is within ``limit``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap = [(x[0] + y[0], 0, 0)]
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            return
        yield int(a[i]), int(b[j])
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


def units(raw: list[bytes]) -> np.ndarray:
    """Vectors of one size from their bytes (32-bit floats), in double precision and of length one."""
    v = np.frombuffer(b"".join(raw), "<f4").reshape(len(raw), -1).astype(np.float64)
    return v / np.sqrt((v**2).sum(1))[:, None]


def _usable(table: DataFrame) -> DataFrame:
    """``vec_id, label, v``: vectors as bytes of 32-bit floats; null where a vector can link with nothing."""

    def run(batch: pa.RecordBatch):
        lists = batch.column("embedding")
        sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = np.cumsum(sizes)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f4") + np.float32(0)  # nulls are not a number, and no zero is negative
        out = []
        for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            v = flat[a:b]
            out.append(v.tobytes() if b > a and np.isfinite(v).all() and v.any() else None)
        yield batch_of(["vec_id", "label", "v"], [pa.int64(), pa.string(), pa.binary()], [batch.column("vec_id"), batch.column("label"), out])

    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>").alias("embedding"))
    return map_batches(rows, run, "vec_id long, label string, v binary")


Books = dict[int, tuple[np.ndarray, np.ndarray, float]]


def stop_at(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float, recall: float) -> float:
    """Bound up to which cells are visited, so that a neighbour at the threshold is found with probability ``recall``."""
    exact = 2 - 2 * threshold + 1e-9
    if recall >= 1:
        return exact
    rng, half = np.random.default_rng(8), x.shape[1] // 2
    x = np.repeat(x, -(-TRIALS // len(x)), axis=0)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1)[:, None] * x
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * away / np.sqrt((away**2).sum(1))[:, None]
    at, total = np.arange(len(x)), np.zeros(len(x))
    for centres, part in zip(books, (slice(None, half), slice(half, None)), strict=True):
        total += bounds(x[:, part], centres)[1][at, bounds(y[:, part], centres)[0]]
    return min(exact, float(np.quantile(total, recall, method="higher")))


def codebooks(groups: DataFrame, threshold: float, recall: float, rows: int = FIT_ROWS) -> Books:
    """For each number of dimensions the two codebooks and the bound to stop at.

    They are fitted on at most ``rows`` vectors, those with the smallest hash.
    """
    sample = groups.orderBy(F.xxhash64("v"), "v").limit(rows).select("v").distinct().collect()
    k = int(min(MOST_CENTROIDS, max(LEAST_CENTROIDS, CENTROIDS * groups.count() ** 0.25)))
    by_size: dict[int, list[bytes]] = {}
    for r in sorted(bytes(r["v"]) for r in sample):
        by_size.setdefault(len(r) // 4, []).append(r)
    out = {}
    for d, raw in by_size.items():
        if d > 1:
            x = units(raw)
            books = k_means(x[:, : d // 2], k), k_means(x[:, d // 2 :], k)
            out[d] = *books, stop_at(x, books, threshold, recall)
    return out


def _visits(books: Books):
    """Arrow function: each vector's own cell (``asks`` 0), and the later cells that it visits (``asks`` 1)."""

    def run(batch: pa.RecordBatch):
        label, raw, g = (batch.column(c).to_pylist() for c in ("label", "v", "g"))
        cells, asks, of = [], [], []
        sizes = np.array([len(r) // 4 for r in raw])
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d).tolist()
            if d not in books:  # a size that the sample lacks, or that has no halves: one cell holds it
                cells += [f"{label[i]}\x1f{d}" for i in at]
                asks += [0] * len(at)
                of += [g[i] for i in at]
                continue
            x, (one, two, limit) = units([raw[i] for i in at]), books[d]
            (n1, b1), (n2, b2) = bounds(x[:, : d // 2], one), bounds(x[:, d // 2 :], two)
            for k, i in enumerate(at):
                own = int(n1[k]), int(n2[k])
                later = [c for c in multi_sequence(b1[k], b2[k], limit) if c > own]
                cells += [f"{label[i]}\x1f{d}.{p}.{q}" for p, q in (own, *later)]
                asks += [0] + [1] * len(later)
                of += [g[i]] * (1 + len(later))
        yield batch_of(["cell", "asks", "g"], [pa.string(), pa.int32(), pa.int64()], [cells, asks, of])

    return run


#: Part of a row in a cell: held rows that all meet, the two sides of held rows that meet across, held rows that only askers meet, askers.
ALL, LEFT, RIGHT, HELD, ASKER = range(5)


def _verify(threshold: float):
    """Arrow function over rows (key, part, v, weight, g) sorted by key: links by cosine.

    Returns ``g, n, root``: the weight of the vectors linked with each one in a cell, and its root in the
    spanning forest of the cell's links.
    """

    def compare(part: np.ndarray, raw: list[bytes], weight: np.ndarray, g: np.ndarray) -> pa.RecordBatch | None:
        x, label, n = units(raw), np.arange(len(part)), np.zeros(len(part), dtype=np.int64)

        def meet(a: np.ndarray, b: np.ndarray) -> None:
            for at in range(0, len(a), BLOCK):
                some = a[at : at + BLOCK]
                near = x[some] @ x[b].T >= threshold
                near &= some[:, None] != b  # all-pairs: a row is not its own neighbour
                n[some] += near @ weight[b]
                if a is not b:
                    n[b] += weight[some] @ near
                i, j = np.nonzero(near)
                unite(label, some[i], b[j])

        held = np.flatnonzero((part == ALL) | (part == HELD))
        everyone = np.flatnonzero(part == ALL)
        meet(everyone, everyone)
        meet(np.flatnonzero(part == LEFT), np.flatnonzero(part == RIGHT))
        meet(np.flatnonzero(part == ASKER), held)
        at = np.flatnonzero(n)
        return batch_of(["g", "n", "root"], [pa.int64()] * 3, [g[at], n[at], g[label[at]]]) if len(at) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def out() -> Iterator[pa.RecordBatch]:
            part, raw, weight, g = zip(*rows, strict=True)
            found = compare(np.array(part), list(raw), np.array(weight), np.array(g)) if len(rows) > 1 else None
            if found is not None:
                yield found

        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "v", "weight", "g")), strict=True):
                if k != key:
                    if rows:
                        yield from out()
                    key, rows = k, []
                rows.append(tuple(row))
        if rows:
            yield from out()

    return run


def _dealt(visits: DataFrame) -> DataFrame:
    """``key, part, g``: the rows of each cell, those of large cells in blocks.

    Held block i meets itself and the first askers in the cell's key (i, i), a held block j in (i, j),
    and the askers of block a in (i, a).
    """
    large = visits.groupBy(F.col("cell").alias("l_cell")).agg(F.ceil(F.sum(1 - F.col("asks")) / BLOCK).cast("int").alias("held"), F.ceil(F.sum("asks") / (4 * BLOCK)).cast("int").alias("asked"))
    large = materialise(large.where("held > 1 or asked > 1"), "large")
    rows = visits.join(large, F.col("cell") == F.col("l_cell"), "left")
    small = rows.where("l_cell is null").select(F.concat("cell", F.lit("|0|0")).alias("key"), F.when(F.col("asks") == 1, ASKER).otherwise(ALL).alias("part"), "g")
    rows = rows.where("l_cell is not null and held > 0")
    own = F.pmod(F.xxhash64("g"), F.greatest(F.when(F.col("asks") == 1, F.col("asked")).otherwise(F.col("held")), F.lit(1))).cast("int")
    rows = rows.withColumn("own", own)
    pairs = F.transform(F.sequence(F.lit(0), F.col("held") - 1), lambda j: F.struct(F.concat_ws("|", F.least("own", j), F.greatest("own", j)).alias("k"), F.when(j == F.col("own"), ALL).when(j > F.col("own"), LEFT).otherwise(RIGHT).alias("part")))
    more = F.when(F.col("asked") > 1, F.transform(F.sequence(F.lit(1), F.col("asked") - 1), lambda a: F.struct(F.concat_ws("|", F.col("own"), F.lit("a"), a).alias("k"), F.lit(HELD).alias("part")))).otherwise(F.array().cast("array<struct<k:string,part:int>>"))
    asking = F.transform(F.sequence(F.lit(0), F.col("held") - 1), lambda i: F.struct(F.when(F.col("own") == 0, F.concat_ws("|", i, i)).otherwise(F.concat_ws("|", i, F.lit("a"), F.col("own"))).alias("k"), F.lit(ASKER).alias("part")))
    blocks = rows.select("cell", "g", F.explode(F.when(F.col("asks") == 1, asking).otherwise(F.concat(pairs, more))).alias("x"))
    return small.unionByName(blocks.select(F.concat("cell", F.lit("|"), "x.k").alias("key"), "x.part", "g"))


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``table`` (``vec_id, embedding, label``).

    Rows link if their labels are equal and not null and the cosine of their vectors is at least
    ``threshold``. Null or empty vectors, vectors of length zero and vectors with null or non-finite
    components link with nothing, nor do vectors of different dimensions. ``component_id`` is the
    smallest ``vec_id`` reachable, itself included; ``kept`` says that it is the row's own. A row
    with a null ``vec_id`` cannot be named: it links with nothing and its component is null. Rows
    that repeat a ``vec_id`` count each, whatever their vectors and labels. Other columns are
    ignored; an empty table gives an empty result. ``recall`` is the share of neighbours at the
    threshold itself that the traversal reaches; with 1 no link is missed.
    """
    spark = table.sparkSession
    rows = materialise(_usable(table), "vectors")
    linked = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    groups = rows.where(linked).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    groups = materialise(groups.withColumn("g", F.monotonically_increasing_id()), "groups")  # written, so the numbers stay
    visits = materialise(map_batches(groups.select("label", "v", "g"), _visits(codebooks(groups, threshold, recall)), "cell string, asks int, g long"), "visits")
    keyed = _dealt(visits).join(groups.select("g", "v", "weight"), "g").select("key", "part", "v", "weight", "g")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialise(keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_verify(threshold), "g long, n long, root long"), "found")
    discard(visits)
    comp = connected_components(found, "g", "root")
    least = groups.select("g", "rep").join(comp, F.col("g") == F.col("node")).groupBy("component").agg(F.min("rep").alias("least"))
    totals = found.groupBy(F.col("g").alias("of")).agg(F.sum("n").alias("n"))
    named = groups.join(totals, groups["g"] == totals["of"], "left").join(comp, F.col("g") == F.col("node"), "left").join(least, "component", "left")
    named = named.select(F.col("label").alias("g_label"), F.col("v").alias("g_v"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    named = materialise(named, "named")
    discard(found, comp, groups)
    on = (F.col("label") == F.col("g_label")) & (F.col("v") == F.col("g_v"))
    joined = rows.where(linked).join(named, on, "left").select("vec_id", "n_links", "component_id")
    alone = rows.where(~linked).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
