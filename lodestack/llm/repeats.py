"""Removal of repeated passages by common-prefix interval trees over enhanced suffix arrays.

A string of ``LENGTH`` bytes (a window) always holds the same anchor, wherever it stands: the least
of its ``GRAM``-byte hashes. Anchors bring equal windows together without shuffling the text:

1. every run of windows with the same anchor sends the anchor's hash and a few bits of the bytes
   on either side: a window holds the anchor and at least ``GRAM`` bytes to its left or to its right,
   so equal windows agree on one side; runs that agree with no other document end here;
2. the other runs send their bytes to their anchor's task. Equal runs are kept once. Where an
   anchor's runs differ, an enhanced suffix array is built over them, a stack scan of its LCP array
   yields the tree of common-prefix intervals, and each interval whose occurrences have different
   left neighbours is a maximal repeat, reported with all its occurrences;
3. an occurrence is covered where a document with a smaller id has the same repeat.

Tasks combine before they send: what a batch of documents shares is decided there, and only its
smallest (and largest) document goes on, so a passage that stands in a third of all documents
reaches its bucket once for each batch. An anchor with very many contexts is divided by the ``GRAM``
bytes on either side: its runs go to one task for each side. Buckets are cut by the bytes of text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import batch_of, documents
from lodestack.scratch import discard, materialise

LENGTH, GRAM = 50, 16
#: Bytes of text that are hashed at once; longer documents are cut into overlapping segments.
SEGMENT, CHUNK = 1 << 19, 1 << 20
_PLACE = np.uint64((1 << 28) - 1)
#: Bytes of text for each bucket: some 250,000 runs, of which a bucket holds a few tens of bytes each.
BUCKET_BYTES = 1 << 22
#: Windows that a run's bytes are sent for at once; a longer run (of one character, say) goes in pieces, most of them equal.
PIECE = 64
#: Runs of one anchor above which it is divided, and how many such anchors there can be at most (8 bytes each).
HOT_RUNS, HOT_ANCHORS = 1 << 16, 1 << 20


def _hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``GRAM`` bytes at each place, by doubling."""
    h, base, width = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base & (1 << 64) - 1, 2 * width
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def window_runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with the same anchor hash, within segments that begin at ``starts``.

    Returns the anchor's hash, the first window, the number of windows and the segment of each run;
    then, as (run, left, right), the hashes of the ``GRAM`` bytes on either side of its anchors (zero:
    the segment ends there). A run has one such pair, or a few where its anchor repeats.
    """
    none = np.zeros(0, dtype=np.int64)
    empty = (none.astype(np.uint64), none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    if len(data) < LENGTH:
        return empty
    h = _hashes(data)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    anchor = (_sliding_min(key, LENGTH - GRAM + 1) & _PLACE).astype(np.int64)
    ok = np.ones(len(anchor), dtype=bool)
    ends = np.append(starts[1:], len(data))
    for back in range(1, LENGTH):  # the last windows of a segment would reach into the next one
        at = ends - back
        at = at[(at >= 0) & (at < len(ok)) & (at >= starts)]
        ok[at] = False
    place = np.flatnonzero(ok)
    if not len(place):
        return empty
    a = anchor[place]
    gap = place[1:] != place[:-1] + 1
    part = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | gap]))  # the same anchor place
    new = part[np.concatenate([[True], (h[a[part[1:]]] != h[a[part[:-1]]]) | gap[part[1:] - 1]])]
    run = np.searchsorted(new, part, side="right") - 1
    first, count = place[new], np.diff(np.append(new, len(place)))
    segment = np.searchsorted(starts, first, side="right") - 1
    a, of = a[part], segment[run]

    def side(at: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return np.where(inside, h[np.clip(at, 0, len(h) - 1)] | np.uint64(1), np.uint64(0))

    left, right = side(a - GRAM, a - GRAM >= starts[of]), side(a + GRAM, a + 2 * GRAM <= ends[of])
    kept = np.concatenate([[True], (run[1:] != run[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
    return h[anchor[first]], first, count, segment, run[kept], left[kept], right[kept]


def document_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of many documents: document number, anchor hash, first byte, number of windows; then the sides (run, left, right)."""
    segments: list[tuple[int, int, bytes]] = []
    held = 0

    def flush():
        data = np.frombuffer(b"".join(s[2] for s in segments), dtype=np.uint8)
        sizes = np.array([len(s[2]) for s in segments])
        starts = np.cumsum(sizes) - sizes
        h, first, count, seg, *sides = window_runs(data, starts)
        doc, offset = np.array([s[0] for s in segments]), np.array([s[1] for s in segments])
        return doc[seg], h, first - starts[seg] + offset[seg], count, *sides

    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for at in range(0, len(text) - LENGTH + 1, SEGMENT):
            segments.append((i, at, text[at : at + SEGMENT + LENGTH - 1]))
            held += len(segments[-1][2])
            if held >= CHUNK:
                yield flush()
                segments, held = [], 0
    if segments:
        yield flush()


def _ordinals(doc: np.ndarray) -> np.ndarray:
    """Number of each run within its document; runs stand in document order."""
    new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, dtype=np.int64)
    return np.arange(len(doc)) - np.repeat(new, np.diff(np.append(new, len(doc))))


def _gather(batch: pa.RecordBatch) -> tuple:
    """All runs of a batch: row, hash, first byte, windows, number within the row; their sides (run, left, right); the texts."""
    texts = [t.as_py().encode("utf-8", "replace") for t in batch.column("text")]
    parts = list(document_runs(texts))
    if not parts:
        z, u = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        return z, u, z, z, z, (z, u, u), texts
    doc, h, first, count = (np.concatenate([p[i] for p in parts]) for i in range(4))
    before = np.cumsum([0] + [len(p[0]) for p in parts])
    sides = np.concatenate([p[4] + n for p, n in zip(parts, before)]), *(np.concatenate([p[i] for p in parts]) for i in (5, 6))
    return doc, h, first, count, _ordinals(doc), sides, texts


def _bits(side: np.ndarray) -> np.ndarray:
    """Twelve bits of a side's hash; zero only if there is no such side."""
    return np.where(side > 0, (side >> np.uint64(50)) % np.uint64(4095) + np.uint64(1), np.uint64(0))


def _group_starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)


def _shared(sent: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each row (forty bits of an anchor's hash, then twelve of either side) agrees on a side with another document."""
    out = np.zeros(len(sent), dtype=bool)
    right = (sent >> np.uint64(24) << np.uint64(12)) | (sent & np.uint64(4095))
    for key, bits in ((sent >> np.uint64(12), sent >> np.uint64(12)), (right, sent)):
        known = np.flatnonzero(bits & np.uint64(4095))  # that side is there
        by = known[np.argsort(key[known])]
        new = _group_starts(key[by])
        if len(new):
            least, most = np.minimum.reduceat(doc[by], new), np.maximum.reduceat(doc[by], new)
            out[by[np.repeat(least < most, np.diff(np.append(new, len(by))))]] = True
    return out


def _combined(sent: np.ndarray, doc: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch stand for more than one document, and which rows must be sent.

    Of equal rows only those of the smallest and of the largest document are, one for each text.
    """
    order = np.argsort(sent)
    new = _group_starts(sent[order])
    times = np.diff(np.append(new, len(order)))
    several = order[np.repeat(times > 1, times)]
    several = several[np.lexsort((tag[several], doc[several], sent[several]))]
    s, d, t = sent[several], doc[several], tag[several]
    group = _group_starts(s)
    n = np.diff(np.append(group, len(s)))
    low, high = (np.repeat(d[x], n) for x in (group, np.append(group[1:], len(s))[: len(group)] - 1))
    first = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1]) | (t[1:] != t[:-1])]) if len(s) else np.zeros(0, dtype=bool)
    known = np.zeros(len(sent), dtype=bool)
    known[several[low < high]] = True
    return known, np.concatenate([order[np.repeat(times == 1, times)], several[first & ((d == low) | (d == high))]])


def _by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])) if len(order) else []
    for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays of one length (the first says how many) and bytes, compressed together but for the first."""
    rest = b"".join(a if isinstance(a, bytes) else a.tobytes() for a in arrays[1:])
    return struct.pack("<Q", len(arrays[0])) + arrays[0].tobytes() + zstandard.ZstdCompressor(level=1).compress(rest)


def _unpack(blob: bytes, *types: str) -> list:
    n = struct.unpack_from("<Q", blob)[0]
    out = [np.frombuffer(blob, types[0], n, 8)]
    rest, at = zstandard.ZstdDecompressor().decompress(blob[8 + out[0].nbytes :]), 0
    for t in types[1:]:
        out.append(np.frombuffer(rest, t, n, at))
        at += out[-1].nbytes
    return [*out, rest[at:]]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch | None, list[bytes]]]:
    """From rows (bucket, doc_id, tag, data) sorted by bucket: rows that name a document as they are, and the blobs of each bucket."""
    bucket, blobs = None, []
    for batch in batches:
        named = batch.column("doc_id").is_valid()
        rest = batch.filter(pc.invert(named))
        if rest.num_rows < batch.num_rows:
            yield batch.filter(named).select(["doc_id", "tag", "data"]), []
        for b, blob in zip(rest.column("bucket").to_pylist(), rest.column("data"), strict=True):
            if b != bucket:
                if blobs:
                    yield None, blobs
                bucket, blobs = b, []
            blobs.append(blob.as_py())
    if blobs:
        yield None, blobs


def _sent(rows: list[tuple[int, bytes]], decided: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, doc_id, tag, data): blobs for buckets, and what is known of documents already."""
    if rows:
        buckets, blobs = zip(*rows, strict=True)
        yield batch_of(["bucket", "doc_id", "tag", "data"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()], [buckets, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), blobs])
    if decided is not None:
        spread = (decided.column("tag").to_numpy() & 0x7FFFFFFF).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(spread), *decided.columns], names=["bucket", "doc_id", "tag", "data"])


def _per_document(doc: np.ndarray, tag: np.ndarray, first: np.ndarray, last: np.ndarray, kind: str = "<i8") -> pa.RecordBatch | None:
    """``doc_id, tag, data``: the half-open spans of each document, joined where they touch, as packed pairs."""
    if not len(doc):
        return None
    order = np.lexsort((first, tag, doc))
    doc, tag, first, last = doc[order], tag[order], first[order].astype(np.int64), last[order].astype(np.int64)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    apart = np.int64(last.max() + 1) * (np.cumsum(new) - 1)  # documents one behind the other
    ends = np.maximum.accumulate(last + apart)
    begin = np.flatnonzero(new | np.concatenate([[True], (first + apart)[1:] > ends[:-1]]))
    spans = np.stack([first[begin], (ends - apart)[np.append(begin[1:], len(doc)) - 1]], axis=1).astype(kind)
    heads = np.flatnonzero(new[begin])
    offsets = (np.append(heads, len(begin)) * spans[0].nbytes).astype("<i4")
    data = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(spans.tobytes())])
    at = begin[heads]
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(tag[at]), data], names=["doc_id", "tag", "data"])


def suffix_array(data: np.ndarray, remaining: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array of texts in a row; ``remaining`` is the way to each place's text's end.

    Built by prefix doubling from seven bytes; suffixes end with their text.
    """
    n = len(data)
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = data.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | np.where(remaining > i, padded[i : i + n], np.uint64(0))
    ranks, width, longest = [], 7, int(remaining.max())
    while True:
        order = np.argsort(key)
        new = np.concatenate([[0], (key[order][1:] != key[order][:-1]).astype(np.int64)])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new) + 1
        ranks.append((width, rank))
        if width >= longest or new.sum() == n - 1:
            break
        later = np.zeros(n, dtype=np.int64)
        inside = np.flatnonzero(remaining > width)
        later[inside] = rank[inside + width]
        key = (rank.astype(np.uint64) << np.uint64(32)) | later.astype(np.uint64)
        width *= 2
    left, right = order[:-1].copy(), order[1:].copy()
    most = np.minimum(remaining[left], remaining[right])
    lcp = np.zeros(n - 1, dtype=np.int64)
    for width, rank in reversed(ranks):
        at, other = np.minimum(left + lcp, n - 1), np.minimum(right + lcp, n - 1)
        same = (lcp + width <= most) & (rank[at] == rank[other])
        lcp[same] += width
    for _ in range(7):
        at, other = np.minimum(left + lcp, n - 1), np.minimum(right + lcp, n - 1)
        same = (lcp < most) & (data[at] == data[other])
        lcp[same] += 1
    return order, np.concatenate([[0], lcp])


def maximal_repeats(data: np.ndarray, starts: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Maximal repeats of the texts that begin at ``starts``: length, and all places where it occurs.

    The LCP array is scanned with a stack; when an interval closes, it is a maximal repeat if the
    bytes left of its suffixes differ (the start of a text differs from everything).
    """
    if not len(data):
        return
    ends = np.append(starts[1:], len(data))
    remaining = np.repeat(ends, ends - starts) - np.arange(len(data))
    order, lcp = suffix_array(data, remaining)
    left = np.concatenate([[0], data[:-1].astype(np.int64)])
    left[starts] = -1 - np.arange(len(starts))
    diverse = np.concatenate([[0], np.cumsum(left[order][1:] != left[order][:-1])])
    tall = np.flatnonzero(lcp >= least)
    if not len(tall):
        return
    cut = np.flatnonzero(np.concatenate([[True], np.diff(tall) > 1]))
    heights = lcp.tolist()
    for a, b in zip(tall[cut].tolist(), np.append(tall[cut[1:] - 1], tall[-1]).tolist(), strict=True):
        stack: list[tuple[int, int]] = []  # (height, first suffix)
        for i in range(a, b + 2):
            height, first = heights[i] if i <= b else 0, i - 1
            while stack and stack[-1][0] > height:
                top, first = stack.pop()
                if diverse[i - 1] > diverse[first]:
                    yield top, order[first:i]
            if height and (not stack or stack[-1][0] < height):
                stack.append((height, first))


def _covered(blobs: list[bytes]) -> pa.RecordBatch | None:
    """What the documents of one bucket have of strings that also start in a smaller document."""
    h, doc, tag, first, size, texts = [], [], [], [], [], []
    for blob in blobs:
        a, b, c, d, e, rest = _unpack(blob, "<u8", "<i8", "<i8", "<i8", "<i4")
        ends = np.cumsum(e, dtype=np.int64).tolist()
        texts += [rest[x:y] for x, y in zip([0, *ends], ends)]
        for held, part in zip((h, doc, tag, first, size), (a, b, c, d, e), strict=True):
            held.append(part)
    h, doc, tag, first, size = (np.concatenate(x) for x in (h, doc, tag, first, size))
    kinds: dict[tuple[int, bytes], int] = {}
    kind = np.fromiter((kinds.setdefault(k, len(kinds)) for k in zip(h.tolist(), texts, strict=True)), dtype=np.int64, count=len(h))
    least = np.full(len(kinds), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, doc)
    whole = np.flatnonzero(doc > least[kind])
    found = [(doc[whole], tag[whole], first[whole], first[whole] + size[whole])]
    # anchors whose runs differ; only runs of their smallest document are not covered as a whole yet
    _, number, times = np.unique(np.array([k[0] for k in kinds], dtype=np.uint64), return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[number] > 1)
    if len(several):
        all_texts = list(kinds)
        parts = [all_texts[k][1] for k in several.tolist()]
        sizes = np.array([len(p) for p in parts])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        low, reach = np.repeat(least[several], sizes), np.zeros(len(data), dtype=np.int64)  # of each place: bytes covered from there
        for length, at in maximal_repeats(data, starts, LENGTH):
            mins = low[at]
            late = at[mins > mins.min()]
            reach[late] = np.maximum(reach[late], length)
        at = np.flatnonzero(reach)
        if len(at):
            k, a = several[np.searchsorted(starts, at, side="right") - 1], at - np.repeat(starts, sizes)[at]
            kept = np.flatnonzero(doc == least[kind])
            order = kept[np.argsort(kind[kept], kind="stable")]
            begin = np.searchsorted(kind[order], np.arange(len(kinds) + 1))
            # the spans of a kind, joined, for each of its rows
            n_kind = np.concatenate([[True], (k[1:] != k[:-1]) | (a[1:] > np.maximum.accumulate((a + reach[at]) + k * (1 << 32))[:-1] - k[:-1] * (1 << 32))])
            top = np.maximum.accumulate(a + reach[at] + k * (1 << 32)) - k * (1 << 32)
            head = np.flatnonzero(n_kind)
            k, a, b = k[head], a[head], top[np.append(head[1:], len(top)) - 1]
            n = begin[k + 1] - begin[k]
            row = order[np.repeat(begin[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            found.append((doc[row], tag[row], first[row] + np.repeat(a, n), first[row] + np.repeat(b, n)))
    doc, tag, a, b = (np.concatenate([f[i] for f in found]) for i in range(4))
    return _per_document(doc, tag, a, b)


def union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of a set of half-open spans; touching spans join."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > ends[:-1]]))
    return np.stack([spans[new, 0], ends[np.append(new[1:] - 1, len(spans) - 1)]], axis=1)


def _anchors(buckets: int):
    """Arrow function over documents: anchors with a few bits of both sides, by bucket; and runs that the batch shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, h, _, _, number, (of, left, right), _ = _gather(batch)
            ids, tags = (batch.column(c).to_numpy()[doc[of]] for c in ("doc_id", "tag"))
            h, number = h[of], number[of]
            sent = (h << np.uint64(24)) | (_bits(left) << np.uint64(12)) | _bits(right)
            known, at = _combined(sent, ids, tags)
            rows = [(k, _pack(sent[at[x]], ids[at[x]], tags[at[x]], number[at[x]].astype("<i4"))) for k, x in _by_bucket(h[at], buckets)]
            yield from _sent(rows, _per_document(ids[known], tags[known], number[known], number[known] + 1, "<i4"))

    return run


def _repeated(hot_runs: int):
    """Arrow function over the blobs of buckets: numbers of the runs that agree on a side with another document.

    Rows without a document list the anchors that have more than ``hot_runs`` such runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for decided, blobs in _grouped(batches):
            if decided is not None:
                yield decided
                continue
            parts = [_unpack(b, "<u8", "<i8", "<i8", "<i4") for b in blobs]
            h, doc, tag, number = (np.concatenate([p[i] for p in parts]) for i in range(4))
            kept = _shared(h, doc)
            out = _per_document(doc[kept], tag[kept], number[kept].astype(np.int64), number[kept].astype(np.int64) + 1, "<i4")
            if out is not None:
                yield out
            anchor, times = np.unique(h[kept] >> np.uint64(24), return_counts=True)
            if (times > hot_runs).any():
                hot = [int(x).to_bytes(8, "little") for x in anchor[times > hot_runs]]
                yield batch_of(["doc_id", "tag", "data"], [pa.int64(), pa.int64(), pa.binary()], [pa.nulls(len(hot), pa.int64()), pa.nulls(len(hot), pa.int64()), hot])

    return run


def _run_bytes(buckets: int, hot: np.ndarray):
    """Arrow function over documents with the numbers of their runs: the runs' bytes, by bucket; and spans that the batch decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, h, first, count, _, (side_of, left, right), texts = _gather(batch)
            ids, tags = (batch.column(c).to_numpy() for c in ("doc_id", "tag"))
            wanted = np.zeros(len(doc), dtype=bool)
            begin = np.searchsorted(doc, np.arange(len(texts) + 1))
            for i, lists in enumerate(batch.column("numbers")):
                own = slice(begin[i], begin[i + 1])
                marks = np.zeros(begin[i + 1] - begin[i] + 1, dtype=np.int64)
                ranges = np.minimum(np.frombuffer(b"".join(lists.as_py()), "<i4").reshape(-1, 2), len(marks) - 1)
                np.add.at(marks, ranges[:, 0], 1)
                np.add.at(marks, ranges[:, 1], -1)
                some = h[own][np.cumsum(marks)[:-1] > 0]
                wanted[own] = np.isin(h[own], some)  # and the document's other runs of these anchors
            at = np.flatnonzero(wanted)
            cuts = -(-count[at] // PIECE)
            of = np.repeat(at, cuts)
            nth = (np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * PIECE
            start, size = first[of] + nth, (np.minimum(PIECE, count[of] - nth) + LENGTH - 1).astype("<i4")
            d, t = ids[doc[of]], tags[doc[of]]
            parts = [texts[i][a : a + n] for i, a, n in zip(doc[of].tolist(), start.tolist(), size.tolist(), strict=True)]
            # equal pieces of this batch: all but those of the smallest document are covered for sure
            kinds: dict[tuple[int, bytes], int] = {}
            kind = np.fromiter((kinds.setdefault(k, len(kinds)) for k in zip(h[of].tolist(), parts, strict=True)), dtype=np.int64, count=len(of))
            low = np.full(len(kinds), np.iinfo(np.int64).max)
            np.minimum.at(low, kind, d)
            late = np.flatnonzero(d > low[kind])
            decided = _per_document(d[late], t[late], start[late], start[late] + size[late])
            x = np.flatnonzero(d == low[kind])
            divided = np.isin(h[of[x]] & np.uint64((1 << 40) - 1), hot)
            route, ways = h[of[x[~divided]]], [x[~divided]]
            if divided.any():  # one way for each side that a run has
                x = x[divided]
                for s, m in ((left, 0x9E3779B97F4A7C15), (right, 0xC2B2AE3D27D4EB4F)):
                    there = np.flatnonzero((s > 0) & np.isin(side_of, of[x]))
                    begin, end = (np.searchsorted(of[x], side_of[there], side=side) for side in ("left", "right"))
                    n = end - begin
                    ways.append(x[np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
                    route = np.concatenate([route, np.repeat(h[side_of[there]] ^ (s[there] * np.uint64(m)), n)])
            x = np.concatenate(ways)
            rows = [(k, _pack(route[y], d[x[y]], t[x[y]], start[x[y]].astype("<i8"), size[x[y]], b"".join([parts[z] for z in x[y].tolist()]))) for k, y in _by_bucket(route, buckets)]
            yield from _sent(rows, decided)

    return run


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for decided, blobs in _grouped(batches):
        out = _covered(blobs) if decided is None else decided
        if out is not None:
            yield out


def covered_spans(docs: DataFrame, hot_runs: int = HOT_RUNS) -> tuple[DataFrame, DataFrame]:
    """``doc_id, tag, text, spans`` of documents that share an anchor (spans: lists of byte spans to
    remove, packed pairs), and all documents as ``doc_id, tag, n_bytes, sha256`` of the whole text."""
    spark = docs.sparkSession
    base = documents(docs).withColumn("tag", F.xxhash64("text").bitwiseAND(F.lit((1 << 40) - 1)))  # tells apart texts of one id
    named = base.where("doc_id is not null")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * n, -(-size // BUCKET_BYTES))
    n = max(n, buckets // 4)
    hot_runs = max(hot_runs, size // HOT_ANCHORS)  # at most HOT_ANCHORS anchors have so many

    def spread(df: DataFrame) -> DataFrame:
        return df.repartition(n, "bucket").sortWithinPartitions("bucket")

    sent, per_document = "bucket int, doc_id long, tag long, data binary", "doc_id long, tag long, data binary"
    found = spread(named.mapInArrow(_anchors(buckets), sent)).mapInArrow(_repeated(hot_runs), per_document)
    listed = materialise(found.groupBy("doc_id", "tag").agg(F.collect_list("data").alias("numbers")), "numbers")
    hot = [int.from_bytes(x, "little") for r in listed.where("doc_id is null").collect() for x in r["numbers"]]
    numbers = listed.where("doc_id is not null").select(F.col("doc_id").alias("n_doc"), F.col("tag").alias("n_tag"), "numbers")
    shared = materialise(named.join(numbers, (F.col("doc_id") == F.col("n_doc")) & (F.col("tag") == F.col("n_tag"))).select("doc_id", "tag", "text", "numbers"), "shared")
    discard(listed)
    found = spread(shared.mapInArrow(_run_bytes(buckets, np.array(hot, dtype=np.uint64)), sent)).mapInArrow(_cover, per_document)
    spans = materialise(found.groupBy("doc_id", "tag").agg(F.collect_list("data").alias("spans")), "spans")
    spans = spans.select(F.col("doc_id").alias("n_doc"), F.col("tag").alias("n_tag"), "spans")
    out = shared.select("doc_id", "tag", "text").join(spans, (F.col("doc_id") == F.col("n_doc")) & (F.col("tag") == F.col("n_tag")), "left").select("doc_id", "tag", "text", "spans")
    whole = base.select("doc_id", "tag", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return out, whole.join(shared.select(F.col("doc_id").alias("n_doc"), F.col("tag").alias("n_tag")).distinct(), (F.col("doc_id") == F.col("n_doc")) & (F.col("tag") == F.col("n_tag")), "left_anti")


def removed(docs: DataFrame, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs`` (``doc_id, text``).

    A byte goes if a string of 50 bytes covers it that also starts in a document with a smaller
    ``doc_id``; strings are judged on the input and never cross documents. Null text counts as
    empty. Rows with a null ``doc_id`` have no place in the order: they keep all bytes and count for
    no other row. Rows that repeat a ``doc_id`` are judged each against smaller ids only. Other
    columns are ignored; an empty table gives an empty result.
    """
    shared, rest = covered_spans(docs, hot_runs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, t, lists in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans"), strict=True):
                data, packed = t.as_py().encode("utf-8", "replace"), b"".join(lists.as_py() or [])
                spans = union(np.frombuffer(packed, "<i8").reshape(-1, 2)).tolist() if packed else []
                kept, done = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[done:a])
                    done = b
                kept.update(data[done:])
                rows.append((doc_id, len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            if rows:
                yield batch_of(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()], list(zip(*rows, strict=True)))

    with_spans = shared.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    return with_spans.unionByName(rest.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha256").alias("kept_sha256")))
