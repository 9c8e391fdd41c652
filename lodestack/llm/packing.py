"""Order-preserving packing of token ids into sequences of a fixed size, by dynamic programming.

Within a block of documents (in their order) the candidate cuts are the ends of documents and of
sentences, places inside sentences that are longer than a step, and every place in the block's last
sequence. The program chooses cuts that minimise padding plus truncation penalties. The cheapest way
to each cut comes from a monotone queue over the cuts that are at most one sequence before it;
sequences whose length is a power of two need no padding and are looked up directly. So the end of a
block is cut into powers of two for a few penalties, and padding does not depend on how many tasks
the documents are dealt over.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestack.llm.common import batch_of, documents
from lodestack.llm.tokens import encoder

SIZE = 2048
#: Cost of a cut, in padding tokens: between documents, between sentences, inside a sentence.
DOCUMENT_CUT, SENTENCE_CUT, INNER_CUT = 0.0, 2.0, 12.0
#: Longest stretch without a candidate cut.
STEP = 64
#: Tokens after which a block is packed and written out.
BLOCK_TOKENS = 1 << 21


def padding(length: int, size: int = SIZE) -> int:
    """Tokens that a sequence is padded by: none at a power of two."""
    return 0 if length & (length - 1) == 0 else size - length


def candidates(ids: np.ndarray, ends: np.ndarray, doc_ends: np.ndarray, size: int = SIZE, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions in ascending order and their penalties."""
    is_doc = np.zeros(len(ids) + 1, dtype=bool)
    is_doc[doc_ends] = True
    is_whole = is_doc.copy()
    is_whole[1:] |= ends[ids]
    is_whole[0] = is_whole[-1] = True
    whole = np.flatnonzero(is_whole)
    gaps = np.diff(whole)
    parts = -(-gaps // step)
    inner = np.repeat(whole[:-1], parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * step
    last = max(0, len(ids) - size)
    at = np.concatenate([inner[inner < last], np.arange(last, len(ids) + 1)])
    cost = np.where(is_doc[at], DOCUMENT_CUT, np.where(is_whole[at], SENTENCE_CUT, INNER_CUT))
    cost[0] = cost[-1] = 0.0
    return at, cost


def cuts(at: np.ndarray, cost: np.ndarray, size: int = SIZE) -> list[int]:
    """Positions of the cheapest cuts, the ends included. Neighbouring candidates are at most ``size`` apart."""
    places, costs = at.tolist(), cost.tolist()
    index = np.full(places[-1] + 1, -1, dtype=np.int64)
    index[at] = np.arange(len(at))
    to, back = [], []  # candidates that are a power of two apart
    for p in (1 << b for b in range(size.bit_length()) if 1 << b < size):
        later = np.searchsorted(at, p) + np.arange(len(at) - np.searchsorted(at, p))
        before = index[at[later] - p]
        to.append(later[before >= 0])
        back.append(before[before >= 0])
    to, back = np.concatenate(to), np.concatenate(back)
    jumps = back[np.argsort(to, kind="stable")].tolist()
    bounds = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=len(at)))]).tolist()
    best, came = [0.0] * len(places), [0] * len(places)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # (best + place, place, index), ascending
    for i in range(1, len(places)):
        x = places[i]
        while queue[0][1] < x - size:
            queue.popleft()
        low, j = queue[0][0] + size - x, queue[0][2]
        for k in jumps[bounds[i] : bounds[i + 1]]:
            if best[k] < low:
                low, j = best[k], k
        best[i], came[i] = low + costs[i], j
        key = best[i] + x
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, x, i))
    out, i = [places[-1]], len(places) - 1
    while i:
        i = came[i]
        out.append(places[i])
    return out[::-1]


def pack(lengths: list[int], ids: np.ndarray, ends: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, ...]:
    """Pieces of a block: document number, start in it, length, sequence number, offset in it."""
    doc_ends = np.cumsum(lengths)
    chosen = np.array(cuts(*candidates(ids, ends, doc_ends, size), size))
    cut = np.zeros(len(ids) + 1, dtype=bool)
    cut[chosen] = cut[doc_ends] = True
    bounds = np.flatnonzero(cut)
    start, length = bounds[:-1], np.diff(bounds)
    doc = np.searchsorted(doc_ends, start, side="right")
    sequence = np.searchsorted(chosen, start, side="right") - 1
    return doc, start - (doc_ends[doc] - np.array(lengths)[doc]), length, sequence, start - chosen[sequence], start


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{n} long" for n in NAMES)


def sequences(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Pack every whole text of ``docs`` (``doc_id, text``): one row per piece of a document.

    Documents keep the order of their partition's rows; no shuffle is needed, and a task holds one block of
    ``BLOCK_TOKENS`` tokens (a longer document is packed as a whole). ``sequence_id`` is the
    partition's number times 2^40 plus a count. ``with_ids`` adds the piece's ids (little-endian
    unsigned 32-bit integers). Null text counts as empty, which is the end id alone; a null
    ``doc_id`` stays null; repeated rows are packed each; other columns are ignored; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        ends, base = encode.sentence_ends(), TaskContext.get().partitionId() << 40
        doc_ids, arrays, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal base
            ids, lengths = np.concatenate(arrays), [len(a) for a in arrays]
            doc, start, length, sequence, offset, at = pack(lengths, ids, ends, size)
            parts = [ids[a : a + n].tobytes() for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            names = pa.array(doc_ids, pa.int64()).take(pa.array(doc))
            columns = [names, start, length, [zlib.crc32(p) for p in parts], np.array(lengths)[doc], base + sequence, offset]
            base += int(sequence[-1]) + 1
            return batch_of(NAMES + ["ids"] * with_ids, [pa.int64()] * 7 + [pa.binary()] * with_ids, columns + [parts] * with_ids)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                doc_ids.append(doc_id)
                arrays.append(np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4"))
                held += len(arrays[-1])
                if held >= BLOCK_TOKENS:
                    yield flush()
                    doc_ids, arrays, held = [], [], 0
        if arrays:
            yield flush()

    return documents(docs).mapInArrow(run, SCHEMA + ", ids binary" * with_ids)
