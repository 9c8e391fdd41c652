"""SimHash near-duplicate detection with a Gray-order hierarchical index.

Fingerprints that differ in at most ``distance`` of 64 bits agree in one of ``distance + 1`` bands,
so bands route fingerprints to tasks. In a task the fingerprints are sorted by Gray rank and put
into a tree: each node keeps the bits on which all its descendants agree and that no ancestor holds
yet (a masked pattern). A search walks the tree from the root, adds up the differences between the
query and the masked patterns, and leaves a whole group as soon as the sum passes the limit.

A band value with many distinct fingerprints is divided by the bits outside the band (the same
pigeonhole argument on fewer bits), again and again until its groups are small; after six divisions
at most twelve bits are free, so a group is bounded by construction. No link is lost, and a task
returns a spanning forest of its links.

The stage for near-duplicates by five-word shingles (``similar_documents``) takes its candidates from
this index and, since no fingerprint distance that it can search reaches a shingle similarity of 0.8
(the README has the figures), from MinHash bands as well; the shingles decide on both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import documents, map_batches
from lodestack.operators.components import connected_components
from lodestack.scratch import discard, materialise

FANOUT = 8
#: One-bit values of a sketch; the standard error of a similarity of 0.8 is 0.019. Estimates within
#: this many standard errors of the threshold are not final: the shingles themselves decide.
SKETCH, ERRORS = 1024, 4
#: MinHash bands: texts with a similarity of J share one with probability 1 - (1 - J^5)^24, which is
#: 0.99993 at 0.8, wherever in the texts they differ.
BANDS, BAND_ROWS = 24, 5
#: Keys of a text: the component of its fingerprint by the index, then its bands.
KEYS = 1 + BANDS
#: Groups of a band up to this size are compared in bulk; larger ones row by row against what is not linked yet.
BULK_GROUP = 64
#: Rows of a band value that one task compares; larger groups are linked to a pivot first, and what is left meets in cells of this size.
CELL_ROWS = 2048
#: Rows of a band value whose shingle sets one task holds, likewise.
CELL_SETS = 256
#: Distinct fingerprints of a band value that one task compares without further division.
GROUP_LIMIT = 600
#: Bits that may stay free when fingerprints are divided no further: a group then has at most 4096 of them.
FREE_BITS = 12


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit words have each bit set; eight byte-wide counters share a word."""
    lanes, counts = np.uint64(0x0101010101010101), np.zeros((8, 8), dtype=np.int64)
    padded = np.zeros(-(-len(hashes) // 255) * 255, dtype=np.uint64)
    padded[: len(hashes)] = hashes
    for shift in range(8):
        sums = ((padded >> np.uint64(shift)) & lanes).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        counts[:, shift] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.ravel()


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash of a text: a bit is set if it is in over half of the shingles' XXH64."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(g, 42) for g in grams], dtype="<u8")
    ones = bit_counts(hashes)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every whole text as a signed long."""

    def run(batch: pa.RecordBatch):
        fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(documents(docs), run, "doc_id long, fp long")


_RANDOM = np.random.default_rng(42).integers(1, 1 << 62, size=(2, SKETCH), dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; texts of fewer words are one shingle."""
    words = text.encode("utf-8", "replace").lower().split()
    n = max(1, len(words) - shingle + 1)
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(b" ".join(words[i : i + shingle]), 7) for i in range(n)], dtype=np.uint64))


def least_hashes(grams: np.ndarray) -> np.ndarray:
    """MinHash: the least value of the shingles under each of the random functions."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 256):
        least = np.minimum(least, (grams[at : at + 256, None] * _RANDOM[0] + _RANDOM[1]).min(axis=0))
    return least


def one_bit(least: np.ndarray) -> bytes:
    """One bit of each least value."""
    return np.packbits(((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.uint8)).tobytes()


def sketch(text: str, shingle: int = 5) -> bytes:
    """One-bit MinHash of the word shingles; texts of fewer words are one shingle."""
    return one_bit(least_hashes(shingle_hashes(text, shingle)))


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band: equal exactly if all least values of the band are (but for hash collisions)."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).T:
        key = (key ^ column) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of each pair, and all that is joined to them, their smallest label (in place)."""
    while len(a):
        low = np.minimum(label[a], label[b])
        high = np.maximum(label[a], label[b])
        differ = low != high
        if not differ.any():
            break
        a, b, low, high = a[differ], b[differ], low[differ], high[differ]
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label[:] = label[label]


class GrayIndex:
    """Tree over fingerprints in (group, Gray rank) order; searches stay within a group."""

    def __init__(self, groups: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), groups))
        self.order, self.groups, self.codes = order, groups[order], codes[order]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        levels = [(self.codes, np.full(len(codes), full), self.groups, self.groups)]
        while len(levels[-1][0]) > 1:
            pattern, mask, first, last = levels[-1]
            at = np.arange(0, len(pattern), FANOUT)
            both = np.bitwise_and.reduceat(mask, at)
            agree = both & ~(np.bitwise_and.reduceat(pattern, at) ^ np.bitwise_or.reduceat(pattern, at))
            levels.append((pattern[at] & agree, agree, first[at], last[np.minimum(at + FANOUT, len(last)) - 1]))
        # what an ancestor holds is taken out of its descendants' masks
        self.levels = []
        for depth, (pattern, mask, first, last) in enumerate(levels):
            if depth + 1 < len(levels):
                mask = mask & ~np.repeat(levels[depth + 1][1], FANOUT)[: len(mask)]
            self.levels.append((pattern & mask, mask, first, last))

    def search(self, start: int, stop: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, later entry of its group) within ``limit`` differences, by sorted position."""
        q = np.arange(start, stop)
        node, acc, code, group = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64), self.codes[start:stop], self.groups[start:stop]
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, mask, first, last = self.levels[depth]
            if depth < len(self.levels) - 1:
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q, acc = np.repeat(q, FANOUT), np.repeat(acc, FANOUT)
                inside = node < len(pattern)
                node, q, acc = node[inside], q[inside], acc[inside]
                g = self.groups[q]
                near = (first[node] <= g) & (last[node] >= g)
                if depth == 0:
                    near &= node > q
                node, q, acc = node[near], q[near], acc[near]
            acc = acc + np.bitwise_count((self.codes[q] ^ pattern[node]) & mask[node])
            kept = acc <= limit
            node, q, acc = node[kept], q[kept], acc[kept]
        pairs = node > q
        return q[pairs], node[pairs]

    def forest(self, limit: int, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Spanning forest of all links: original positions of a child and of its root."""
        label = np.arange(len(self.codes))
        for start in range(0, len(label), step):
            a, b = self.search(start, min(start + step, len(label)), limit)
            unite(label, a, b)
        child = np.flatnonzero(label != np.arange(len(label)))
        return self.order[child], self.order[label[child]]


def _linked(limit: int):
    """Arrow function over rows (key, fp, rep) sorted by key: links of each key's fingerprints."""

    def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, fp, rep = (np.concatenate([p[i] for p in parts]) for i in range(3))
        child, root = GrayIndex(key, fp.view(np.uint64)).forest(limit)
        return pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[root])], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "rep"))
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if cut:
                held.append((key[:cut], fp[:cut], rep[:cut]))
                yield flush(held)
                held = []
            held.append((key[cut:], fp[cut:], rep[cut:]))
        if held:
            yield flush(held)

    return run


def _finer(fixed: int, parts: int) -> list[int]:
    """Masks of ``fixed`` with one of ``parts`` runs of the other bits each."""
    bits = [b for b in range(64) if not fixed >> b & 1]
    cut = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [fixed | sum(1 << b for b in bits[cut[i] : cut[i + 1]]) for i in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(reps: DataFrame, distance: int = 3, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links ``src, dst`` between the ``rep`` of distinct fingerprints (``fp, rep``) that are near.

    Transitively complete: two fingerprints within ``distance`` bits are connected by the links.
    A row's ``path`` says which runs of bits its group agrees on; its key is written out at every
    level, and only the rows of large groups go on to the next one.
    """
    rows, masks, parts = reps.select("fp", "rep", F.lit(0).alias("path")), [0], []
    while True:
        finer = [_finer(m, distance + 1) for m in masks]
        table = F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for ms in finer])
        dealt = rows.select("fp", "rep", "path", F.posexplode(F.element_at(table, F.col("path") + 1)).alias("band", "mask"))
        path = (F.col("path") * (distance + 1) + F.col("band")).cast("int")
        key = F.xxhash64(F.lit(len(parts)), path, F.col("fp").bitwiseAND(F.col("mask")))
        dealt = materialise(dealt.select("fp", "rep", path.alias("path"), key.alias("key")), "dealt")
        parts.append([dealt, None])
        masks = [m for ms in finer for m in ms]
        if min(m.bit_count() for m in masks) >= 64 - FREE_BITS:
            break
        hot = materialise(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group_limit).select(F.col("key").alias("hot_key")), "hot")
        if hot.isEmpty():
            discard(hot)
            break
        parts[-1][1] = hot
        rows = dealt.join(hot, F.col("key") == F.col("hot_key"), "left_semi").select("fp", "rep", "path")
    small = None
    for dealt, hot in parts:
        part = dealt if hot is None else dealt.join(hot, F.col("key") == F.col("hot_key"), "left_anti")
        small = part.select("key", "fp", "rep") if small is None else small.unionByName(part.select("key", "fp", "rep"))
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialise(small.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_linked(distance), "src long, dst long"), "links")
    discard(*[x for p in parts for x in p])
    return found


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (``doc_id, text``).

    Texts link if their fingerprints differ in at most ``distance`` bits; ``component_id`` is the
    smallest ``doc_id`` reachable. Null text counts as empty (fingerprint zero). Rows with a null
    ``doc_id`` cannot be named: they keep their fingerprint, link with nothing and get a null
    component. Repeated rows each give a row, and rows that repeat an id with another text are linked
    by their own fingerprints only. Other columns of ``docs`` are ignored. An empty table
    gives an empty result.
    """
    fps = materialise(fingerprints(docs, shingle), "fp")
    reps = materialise(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "reps")
    found = links(reps.select("fp", F.col("fp").alias("rep")), distance)
    comp = connected_components(found)
    ours = reps.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = ours.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"))
    named = materialise(ours.join(ids, F.col("component") == F.col("c")).select(F.col("fp").alias("named_fp"), "component_id"), "named")
    discard(found, comp, reps)
    out = fps.join(named, fps["fp"] == named["named_fp"], "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column ``key``, those that share it with another row."""
    last, again = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        key = batch.column(0).to_numpy(zero_copy_only=False)
        same = key[1:] == key[:-1]
        kept = np.concatenate([[again], same]) | np.concatenate([same, [False]])
        last, again = batch.slice(len(key) - 1), bool(kept[-1])
        yield batch.slice(0, len(key) - 1).filter(pa.array(kept[:-1]))
    if again:
        yield last


def differences(sketches: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the sketches of the rows ``a`` and ``b`` differ."""
    out = np.empty(len(a), dtype=np.int64)
    for at in range(0, len(a), 1 << 15):
        part = slice(at, at + (1 << 15))
        out[part] = np.bitwise_count(sketches[a[part]] ^ sketches[b[part]]).sum(axis=1)
    return out


def _links_and_doubts(src: np.ndarray, dst: np.ndarray, key: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    """Rows ``src, dst, key, kind``: sure links first, then rows in doubt."""
    a, b = pa.nulls(len(src), pa.int64()), pa.nulls(len(key), pa.int64())
    columns = [pa.concat_arrays(x) for x in ([pa.array(src), b], [pa.array(dst), b], [a, pa.array(key)], [a, pa.array(kind)])]
    return pa.RecordBatch.from_arrays(columns, names=["src", "dst", "key", "kind"])


def _sketches_of(batch: pa.RecordBatch, column: str = "sketch") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype="<u8").reshape(-1, SKETCH // 64)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups, from rows sorted by ``cell``; groups are bounded by those who deal them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        cut = int(np.searchsorted(cell, cell[-1]))  # the last group may go on in the next batch
        if cut:
            held.append(batch.slice(0, cut))
        if held and (cut or held[0].column("cell")[0].as_py() != cell[0]):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _compared(accept: float, reject: float):
    """Arrow function over rows (cell, key, side, rep, kind, sketch) sorted by cell: links within each cell.

    Sketches that differ in at most ``accept`` bits link for sure, in more than ``reject`` bits never.
    Of the sure links a spanning forest is returned (``src, dst``). A row that has a pair in between,
    which no sure links of its cell join, is returned as ``key, kind``: rows, not pairs, so the
    output never grows with the square of a group. In cells of two sides only pairs across count.
    """

    def bulk(cell: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label of each row (its smallest row by sure links) and the doubtful pairs."""
        label = np.arange(len(cell))
        room = np.searchsorted(cell, cell, side="right") - 1 - label  # later rows of the same cell
        order = np.argsort(-room, kind="stable")
        least = -room[order]
        doubtful = []
        for step in range(1, int(room.max(initial=0)) + 1):
            a = order[: np.searchsorted(least, -step, side="right")]
            a = a[label[a] != label[a + step]]
            d = differences(sketches, a, a + step)
            unite(label, a[d <= accept], a[d <= accept] + step)
            a = a[(d > accept) & (d <= reject)]
            doubtful.append(np.stack([a, a + step]))
        a, b = np.concatenate(doubtful, axis=1) if doubtful else np.empty((2, 0), dtype=np.int64)
        apart = label[a] != label[b]
        return label, a[apart], b[apart]

    def one_by_one(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for one large group, whose linked rows are never compared with each other."""
        rest, label = np.arange(len(sketches)), np.arange(len(sketches))
        between = []
        while len(rest):
            first, queue, rest = rest[0], [rest[0]], rest[1:]
            while queue and len(rest):
                at = queue.pop()
                d = differences(sketches, np.full(len(rest), at), rest)
                near, doubt = rest[d <= accept], rest[(d > accept) & (d <= reject)]
                between.append(np.stack([np.full(len(doubt), at), doubt]))
                rest = rest[d > accept]
                label[near] = first
                queue += list(near)
        a, b = np.concatenate(between, axis=1) if between else np.empty((2, 0), dtype=np.int64)
        apart = label[a] != label[b]
        return label, a[apart], b[apart]

    def across(sketches: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for a cell of two sides."""
        label, between = np.arange(len(side)), []
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        if len(left) < len(right):
            left, right = right, left
        for at in right.tolist():
            d = differences(sketches, np.full(len(left), at), left)
            near = left[d <= accept]
            unite(label, np.full(len(near), at), near)
            doubt = left[(d > accept) & (d <= reject)]
            between.append(np.stack([np.full(len(doubt), at), doubt]))
        a, b = np.concatenate(between, axis=1) if between else np.empty((2, 0), dtype=np.int64)
        apart = label[a] != label[b]
        return label, a[apart], b[apart]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            cell, key, side, rep, kind = (group.column(c).to_numpy() for c in ("cell", "key", "side", "rep", "kind"))
            sketches = _sketches_of(group)
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            sizes = np.diff(np.append(starts, len(cell)))
            alone = (sizes > BULK_GROUP) | (np.maximum.reduceat(side, starts) > 0)
            parts = [(np.flatnonzero(np.repeat(~alone, sizes)), None)] if not alone.all() else []
            parts += [(np.arange(a, a + n), side[a : a + n]) for a, n in zip(starts[alone].tolist(), sizes[alone].tolist(), strict=True)]
            for at, sides in parts:
                label, a, b = bulk(cell[at], sketches[at]) if sides is None else across(sketches[at], sides) if sides.any() else one_by_one(sketches[at])
                child, doubt = np.flatnonzero(label != np.arange(len(label))), at[np.union1d(a, b)]
                yield _links_and_doubts(rep[at[child]], rep[at[label[child]]], key[doubt], kind[doubt])

    return run


def _to_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many bits each row's sketch differs from its pivot's: ``key, rep, kind, p_rep, p_kind, bits``."""
    names = ["key", "rep", "kind", "p_rep", "p_kind"]
    for batch in batches:
        if batch.num_rows:
            bits = np.bitwise_count(_sketches_of(batch) ^ _sketches_of(batch, "p_sketch")).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(bits)], names=[*names, "bits"])


def _blocks(n: str, size: int):
    """Column: blocks that ``n`` rows make."""
    return F.ceil(F.col(n) / size).cast("int")


def _up_to(n):
    """Column: 0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _pairs_of_blocks(rows: DataFrame, blocks: str = "blocks") -> DataFrame:
    """``rows`` with ``cell, side``: cut into blocks, of which any two meet in one cell."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")).withColumn("other", F.explode(_up_to(F.col(blocks))))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return dealt.withColumn("cell", F.xxhash64("key", F.lit("pair"), F.least("own", "other"), F.greatest("own", "other"))).withColumn("side", side)


def _met(shared: DataFrame, sketches: DataFrame, accept: float, reject: float, cell_rows: int) -> DataFrame:
    """``src, dst, key, kind``: links and rows in doubt of all band values (see ``_compared``).

    ``shared`` has ``key, rep, kind``, ``sketches`` has ``kind, sketch``. A band value with over
    ``cell_rows`` rows is linked to its smallest row (the pivot) first: the rows near the pivot are one
    group and need not meet each other, so only the others meet them and themselves, in cells.
    """
    n = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["cell", "key", "side", "rep", "kind", "sketch"]
    hot = materialise(shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).select(F.col("key").alias("hot_key")), "hot")
    one_cell = [F.col("key").alias("cell"), "key", F.lit(0).alias("side"), "rep", "kind"]
    if hot.isEmpty():
        cells, more, old = shared.select(*one_cell), None, []
    else:
        cells = shared.join(hot, F.col("key") == F.col("hot_key"), "left_anti").select(*one_cell)
        rows = materialise(shared.join(hot, F.col("key") == F.col("hot_key"), "left_semi").join(sketches, "kind").select("key", "rep", "kind", "sketch"), "large")
        pivots = materialise(rows.groupBy(F.col("key").alias("p_key")).agg(F.min(F.struct("rep", "kind", "sketch")).alias("p")).select("p_key", F.col("p.rep").alias("p_rep"), F.col("p.kind").alias("p_kind"), F.col("p.sketch").alias("p_sketch")), "pivots")
        judged = rows.join(pivots, F.col("key") == F.col("p_key")).mapInArrow(_to_pivot, "key long, rep long, kind long, p_rep long, p_kind long, bits int")
        judged = materialise(judged.withColumn("near", F.col("bits") <= accept), "judged")
        none = F.lit(None).cast("long")
        sure = judged.where("near and rep <> p_rep").select(F.col("rep").alias("src"), F.col("p_rep").alias("dst"), none.alias("key"), none.alias("kind"))
        doubt = judged.where((~F.col("near")) & (F.col("bits") <= reject)).select("key", F.explode(F.array("kind", "p_kind")).alias("kind")).distinct()
        more = sure.unionByName(doubt.select(none.alias("src"), none.alias("dst"), "key", "kind"))
        counts = judged.groupBy(F.col("key").alias("n_key")).agg(F.count_if("near").alias("near_rows"), F.count_if(~F.col("near")).alias("rest_rows"))
        counts = materialise(counts.select("n_key", _blocks("near_rows", cell_rows).alias("near_blocks"), _blocks("rest_rows", cell_rows).alias("blocks")).where("blocks > 0"), "counts")
        placed = judged.select("key", "rep", "kind", "near").join(counts, F.col("key") == F.col("n_key"))
        rest = placed.where("not near")
        own = F.pmod(F.xxhash64("rep"), F.when(F.col("near"), F.col("near_blocks")).otherwise(F.col("blocks"))).cast("int")
        met = placed.withColumn("own", own).withColumn("other", F.explode(_up_to(F.when(F.col("near"), F.col("blocks")).otherwise(F.col("near_blocks")))))
        ends = F.when(F.col("near"), F.col("own")).otherwise(F.col("other")), F.when(F.col("near"), F.col("other")).otherwise(F.col("own"))
        met = met.withColumn("cell", F.xxhash64("key", F.lit("rest"), *ends)).withColumn("side", F.when(F.col("near"), 1).otherwise(2))
        cells = cells.unionByName(_pairs_of_blocks(rest).select(*columns[:-1])).unionByName(met.select(*columns[:-1]))
        old = [rows, pivots, judged, counts]
    dealt = cells.join(sketches, "kind").select(*columns).repartition(n, "cell").sortWithinPartitions("cell")
    found = dealt.mapInArrow(_compared(accept, reject), "src long, dst long, key long, kind long")
    found = materialise(found if more is None else found.unionByName(more), "found")
    discard(hot, *old)
    return found


def common(one: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many members of the sorted set ``one`` are in each of the sets at ``starts`` of ``flat``."""
    out = np.empty(len(starts), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(starts):  # about a million members at a time
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20))))
        others = np.concatenate([flat[s : s + n] for s, n in zip(starts[at:stop], sizes[at:stop], strict=True)])
        hit = one[np.minimum(np.searchsorted(one, others), len(one) - 1)] == others
        out[at:stop] = np.add.reduceat(hit, np.cumsum(sizes[at:stop]) - sizes[at:stop], dtype=np.int64)
        at = stop
    return out


def _decided(accept: float, reject: float, similarity: float):
    """Arrow function over rows (cell, key, side, rep, component, sketch, keys, grams) sorted by cell.

    Pairs of a cell that the sketches leave open and that no links join yet link if the Jaccard
    similarity of their whole shingle sets is high enough. A pair is decided at its first common key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            cell, key, side, rep, component = (group.column(c).to_numpy() for c in ("cell", "key", "side", "rep", "component"))
            sketches, keys = _sketches_of(group), group.column("keys").flatten().to_numpy().reshape(-1, KEYS)
            sizes, flat = group.column("grams").value_lengths().to_numpy().astype(np.int64), group.column("grams").flatten().to_numpy().view(np.uint64)
            starts, label = np.cumsum(sizes) - sizes, np.unique(component, return_inverse=True)[1]
            ends = np.searchsorted(cell, cell, side="right")
            src, dst = [], []
            for i in range(len(rep)):
                others = i + 1 + np.flatnonzero((label[i + 1 : ends[i]] != label[i]) & ((side[i] == 0) | (side[i + 1 : ends[i]] != side[i])))
                d = differences(sketches, np.full(len(others), i), others)
                others = others[(d > accept) & (d <= reject)]
                same = keys[others] == keys[i]
                others = others[keys[i][same.argmax(axis=1)] == key[i]]
                if len(others):
                    both = common(flat[starts[i] : starts[i] + sizes[i]], flat, starts[others], sizes[others])
                    for j in others[both / (sizes[i] + sizes[others] - both) >= similarity]:
                        if label[j] != label[i]:
                            label[label == label[j]] = label[i]
                            src.append(rep[j])
                            dst.append(rep[i])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def shingle_sets(kinds: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """``kind, grams``: all shingle hashes of one text of each of the ``kinds``; only these texts are fetched.

    ``reps`` names a document ``doc`` and the hash ``text_hash`` of its text for each kind.
    """
    wanted = kinds.join(reps.select("kind", "doc", "text_hash"), "kind")
    texts = docs.join(wanted, (F.col("doc_id") == F.col("doc")) & (F.xxhash64("text") == F.col("text_hash"))).select("kind", "text")

    def run(batch: pa.RecordBatch):
        sets = [shingle_hashes(t.as_py(), shingle).view(np.int64) for t in batch.column("text")]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["kind", "grams"])

    return map_batches(texts, run, "kind long, grams array<long>").dropDuplicates(["kind"])


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, cell_rows: int = CELL_ROWS, cell_sets: int = CELL_SETS) -> DataFrame:
    """``doc_id, text_hash, component_id, kept`` for every row of ``docs`` with an id: texts linked by similar shingles.

    Equal texts always link; other texts link if the Gray-order index joins their SimHash fingerprints
    (``near_duplicates``) or they share a MinHash band of their five-word shingles, and they have a
    Jaccard similarity of at least ``similarity``: by their sketches where these are sure, else by
    their whole shingle sets. ``component_id`` is the smallest ``doc_id`` reachable;
    ``kept`` says that the row has the one text that stands for its group (of the smallest id, then of
    the smallest ``text_hash``, the XXH64 of the text). Null text counts as empty; rows with a null
    ``doc_id`` are left out; repeated rows each give a row, and rows that repeat an id with another
    text are linked by their own texts only; an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch):
        sketches, keys, fps = [], [], np.empty(batch.num_rows, dtype=np.uint64)
        for i, t in enumerate(batch.column("text").to_pylist()):
            least = least_hashes(shingle_hashes(t, shingle))
            sketches.append(one_bit(least))
            keys.append(band_keys(least))
            fps[i] = fingerprint(t)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(keys)))
        columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(sketches, pa.binary()), bands, pa.array(fps.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "sketch", "bands", "fp"])

    rows = documents(docs).where("doc_id is not null")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = materialise(map_batches(rows.withColumn("text_hash", F.xxhash64("text")), run, "doc_id long, text_hash long, sketch binary, bands array<long>, fp long").withColumn("kind", F.xxhash64("sketch", "bands", "fp")), "marks")
    near = links(marks.select("fp").distinct().withColumn("rep", F.col("fp")))
    joined = connected_components(near)
    first = F.min(F.struct("doc_id", "text_hash", "sketch", "bands", "fp")).alias("first")
    reps = marks.groupBy("kind").agg(first).select("kind", F.col("first.doc_id").alias("doc"), "first.text_hash", "first.sketch", "first.bands", "first.fp")
    index_key = F.xxhash64(F.lit("index"), F.coalesce("component", "fp"))
    reps = reps.join(joined, F.col("fp") == F.col("node"), "left").select("kind", "doc", "text_hash", "sketch", F.concat(F.array(index_key), "bands").alias("keys"))
    reps = materialise(reps, "reps")
    discard(near, joined)
    spread = reps.select(F.explode("keys").alias("key"), F.col("kind").alias("rep"), "kind").repartition(n, "key").sortWithinPartitions("key")
    shared = materialise(spread.mapInArrow(_repeated, "key long, rep long, kind long"), "shared")
    error = ERRORS * ((1 - similarity) * (1 + similarity) / SKETCH) ** 0.5
    accept, reject = (1 - similarity - error) / 2 * SKETCH, (1 - similarity + error) / 2 * SKETCH
    found = _met(shared, reps.select("kind", "sketch"), accept, reject, cell_rows)
    discard(shared)
    comp = connected_components(found.where("src is not null"))
    known = materialise(reps.join(comp, F.col("kind") == F.col("node"), "left").select("kind", "doc", "text_hash", F.coalesce("component", "kind").alias("component")), "known")
    discard(comp)
    # a band value whose rows in doubt have all been joined elsewhere is settled
    doubtful = found.where("key is not null").select("key", "kind").distinct().join(known, "kind")
    open_ = doubtful.groupBy(F.col("key").alias("o_key")).agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).where("a <> b").select("o_key", _blocks("n", cell_sets).alias("blocks"))
    doubtful = materialise(doubtful.join(open_, F.col("key") == F.col("o_key")).select("key", "kind", F.col("kind").alias("rep"), "component", "blocks"), "doubtful")
    grams = materialise(shingle_sets(doubtful.select("kind").distinct(), rows, known, shingle), "grams")
    dealt = _pairs_of_blocks(doubtful).select("cell", "key", "side", "rep", "kind", "component").join(reps.select("kind", "sketch", "keys"), "kind").join(grams, "kind").drop("kind")
    more = dealt.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_decided(accept, reject, similarity), "src long, dst long")
    more = materialise(more, "decided")
    comp = connected_components(known.where("kind <> component").select(F.col("kind").alias("src"), F.col("component").alias("dst")).unionByName(more))
    ours = known.join(comp.withColumnRenamed("component", "joined"), F.col("kind") == F.col("node"), "left").select("kind", "doc", "text_hash", F.coalesce("joined", "kind").alias("c"))
    stays = ours.groupBy(F.col("c").alias("of")).agg(F.min(F.struct("doc", "text_hash")).alias("first"))
    named = ours.join(stays, F.col("c") == F.col("of")).select(F.col("kind").alias("named_kind"), F.col("first.doc").alias("component_id"), F.col("first.text_hash").alias("kept_hash"))
    named = materialise(named, "named")
    discard(found, doubtful, grams, more, comp, known, reps)
    out = marks.select("doc_id", "text_hash", "kind").join(named, marks["kind"] == named["named_kind"], "left")
    return out.select("doc_id", "text_hash", "component_id", ((F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("kept_hash"))).alias("kept"))
