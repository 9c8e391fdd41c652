"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to ``budget`` character edits. Cut into budget-plus-one
pieces, one piece must then occur unchanged; an automaton over all pieces finds those in one pass of
each whole text. Around each hit the least edit distance between the item and a passage is computed
by Myers' bit-parallel algorithm, and the item is reported if it is within the budget.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import batch_of, documents

#: Edits allowed per character of an item.
ERROR_RATE = 0.08
#: Characters of items matched in one pass over the documents (an automaton of some 300 MB); more take more passes.
BLOCK_CHARS = 4_000_000


def normalise(text: str) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join(text.lower().split())


def budget_of(item: str, rate: float = ERROR_RATE) -> int:
    return int(len(item) * rate)


def myers(item: str, text: str, limit: int) -> tuple[int, int]:
    """Least edit distance between ``item`` and any passage of ``text``, and the end of the first such passage.

    Returns ``(limit + 1, -1)`` if the distance is over the limit.
    """
    m = len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = limit + 1, -1
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full  # a passage may begin anywhere
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if score < best:
            best, at = score, i + 1
    return best, at


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items = [(i, t, budget_of(t, rate)) for i, t in ((i, normalise(t or "")) for i, t in items) if t]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, budget) in enumerate(self.items):
            cut = [round(j * len(text) / (budget + 1)) for j in range(budget + 2)]
            for a, b in zip(cut, cut[1:]):
                pieces[text[a:b]].append((k, a))
        self.machine = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.machine.add_word(piece, (len(piece), places))
        if pieces:
            self.machine.make_automaton()
        self.empty = not pieces

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item_id, edits, start, end)`` of each item found, at its best passage, in the normalised text."""
        if self.empty:
            return []
        text = normalise(text)
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.machine.iter(text):
            for k, offset in places:
                starts[k].add(end + 1 - size - offset)
        out = []
        for k in sorted(starts):
            item_id, item, budget = self.items[k]
            found = self._best(text, item, budget, sorted(starts[k]))
            if found:
                out.append((item_id, *found))
        return out

    def _best(self, text: str, item: str, budget: int, starts: list[int]) -> tuple[int, int, int] | None:
        at = text.find(item, max(0, starts[0]), starts[-1] + len(item))
        while at >= 0:
            end = at + len(item)
            if budget or not (text[at - 1 : at].isalnum() or text[end : end + 1].isalnum()):
                return 0, at, end  # an item too short for any edit must stand as whole words
            at = text.find(item, at + 1)
        if not budget:
            return None
        best: tuple[int, int, int] | None = None
        i = 0
        while i < len(starts):
            j = i
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= len(item):
                j += 1
            low, high = max(0, starts[i] - budget), min(len(text), starts[j] + len(item) + budget)
            edits, end = myers(item, text[low:high], best[0] - 1 if best else budget)
            if end >= 0:
                length = myers(item[::-1], text[low : low + end][::-1], edits)[1]
                best = (edits, low + end - length, low + end)
            i = j + 1
        return best


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """The stated query set, a block at a time; items that normalise alike under one id count once."""
    block: list[tuple[int, str]] = []
    held = 0
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if block and held + len(r["text"]) > size:
            yield block
            block, held = [], 0
        block.append((r["item_id"], r["text"]))
        held += len(r["text"])
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, edits, match_start, match_end``: every item that a document holds within its budget.

    An item's budget is ``rate`` times its normalised length, rounded down; an item too short for
    one edit must stand unchanged as whole words. Offsets are code points of the normalised text
    (lower case, white space runs as one space), end exclusive, of the first best passage. Null or
    empty texts hold no item, null or empty items and null item ids match nothing, a null ``doc_id``
    stays null, repeated rows each give their rows, repeated items count once. Other columns are
    ignored; an empty table of documents or of items gives an empty result.
    """
    names, schema = ["doc_id", "item_id", "edits", "match_start", "match_end"], "doc_id long, item_id long, edits int, match_start long, match_end long"
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    texts, out = documents(docs), None
    for block in _blocks(items, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            match = Matcher(block, rate)
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for m in match(t.as_py())]
                if rows:
                    yield batch_of(names, types, list(zip(*rows, strict=True)))

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    at, schema = docs.columns.index(text), docs.schema
    for block in _blocks(items, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            match = Matcher(block, rate)
            for batch in batches:
                yield batch.filter(pa.array([not match(t.as_py() or "") for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
