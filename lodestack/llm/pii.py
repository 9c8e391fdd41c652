"""Personal data in text: plain detection, and offset-preserving detection of disguised identifiers.

Plain ("base") spans are the leftmost non-overlapping matches of four patterns on the text itself.
For disguises transducers rewrite the text one after the other: invisible characters are stripped,
look-alike characters folded, spelled digits and at/dot disguises spelt out. Each keeps where what it
writes came from, and the offset maps are composed. The same detectors run on the rewritten text; a
hit that covers a rewritten piece is mapped back to the source characters and added unless it
overlaps a base span of its kind.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestack.llm.common import batch_of, documents, map_batches

KINDS = ("email", "ip", "card", "phone")

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
# A match never starts inside a run of digits, so the look-behind only saves time on long runs.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    """Checksum of a card number."""
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """Base spans ``(start, kind, end)`` in code points, by start, then kind."""
    found = []
    if "@" in text:
        least = 0
        for m in _AT.finditer(text):
            start = at = m.start()
            while start > least and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((start, 0, m.end()))
                least = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def _look_alikes() -> dict[str, str]:
    """Single characters that stand for an ASCII one: by Unicode's own data, and by shape."""
    out = {}
    for first, last in ((0x0660, 0x0669), (0x06F0, 0x06F9), (0x0966, 0x096F), (0x2070, 0x2089), (0x2460, 0x2468), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF)):
        for c in map(chr, range(first, last + 1)):
            plain = unicodedata.normalize("NFKC", c)
            digit = unicodedata.digit(c, None)
            if digit is not None:
                out[c] = str(digit)
            elif len(plain) == 1 and plain.isascii():
                out[c] = plain
    # Cyrillic and Greek letters, dashes, dots and signs by the ASCII sign they look like.
    shapes = {
        "a": "аα", "c": "с", "e": "е", "i": "іι", "j": "ј", "o": "оο", "p": "рρ", "s": "ѕ", "x": "х", "y": "у",
        "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "K": "КΚ", "M": "МΜ", "N": "Ν",
        "O": "ОΟ", "P": "РΡ", "T": "ТΤ", "X": "ХΧ", "Z": "Ζ",
        "-": "‐‑‒–—−", ".": "․。｡", "@": "﹫", " ": "    　",
    }
    for plain, signs in shapes.items():
        out |= dict.fromkeys(signs, plain)
    return out


_TABLE = str.maketrans(_look_alikes())
_ODD = frozenset(map(chr, _TABLE))
_INVISIBLE = "​‌‍⁠﻿­"

# Names of the digits and of the signs, in the languages of the corpus.
DIGIT_NAMES = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "fuenf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
AT_NAMES = ("at", "@", "arroba", "arobase", "klammeraffe")
DOT_NAMES = ("dot", ".", "punkt", "point", "punto")
PLUS_NAMES = ("plus",)
# Top-level domains that an address written in plain words (a at b dot com) may end in.
DOMAINS = frozenset("com org net edu gov mil int info biz io co me app dev ai tv example test invalid de fr es it se no dk fi nl be at ch uk ie pl pt eu us ca au nz in jp cn br mx ru".split())

_named = "|".join(sorted(map(re.escape, DIGIT_NAMES), key=len, reverse=True))
_digit = rf"(?:\b(?:{_named})\b|[0-9])"
_at = "|".join(map(re.escape, AT_NAMES))
_dot = "|".join(map(re.escape, DOT_NAMES))
_dot_word = "|".join(x for x in DOT_NAMES if x != ".")
# White space before a bracket counts from its first sign only, so that long runs of it take linear time.
_open, _close, _blank = r"(?:(?<!\s)\s++)?+", r"\s*+", r"[ \t]"


def _bracketed(names: str) -> str:
    return "|".join(rf"{re.escape(a)}\s*+(?:{names})\s*+{re.escape(b)}" for a, b in ("[]", "()", "{}", "<>"))


_DISGUISE = re.compile(
    rf"(?P<at>{_open}(?:{_bracketed(_at)}){_close})"
    rf"|(?P<dot>{_open}(?:{_bracketed(_dot)}){_close})"
    rf"|(?P<word>(?<=[A-Za-z0-9]){_blank}++(?:at|arroba|arobase){_blank}++(?=[A-Za-z0-9-]+(?:{_blank}+(?:{_dot_word}){_blank}|\s*+[\[({{<])))"
    rf"|(?P<stop>(?<=[A-Za-z0-9]){_blank}++(?:{_dot_word}){_blank}++(?=[A-Za-z0-9]))"
    rf"|(?P<digits>(?:\bplus{_blank}++)?+(?<![A-Za-z0-9]){_digit}(?:[ \t.-]*+{_digit})+)"
    rf"|(?P<single>\b(?:{_named})\b)",
    re.IGNORECASE,
)
_DIGIT_OR_DOT = re.compile(rf"{_named}|[0-9]|(?<=[^ \t.-])\.(?=[^ \t.-])", re.IGNORECASE)
_ONE = re.compile(rf"\b(?:{_named})\b", re.IGNORECASE)
_BRACKETED = re.compile(rf"[\[({{<]\s*+(?:{_at}|{_dot})\s*+[\])}}>]")
_STOP = re.compile(rf"{_blank}(?:{_dot_word}){_blank}")
_PAIR = re.compile(rf"\b(?:{_named})[ \t.-]*+(?:(?:{_named})\b|[0-9])|[0-9][ \t.-]*+(?:{_named})\b")
_NAMES, _DOT_WORDS = frozenset(DIGIT_NAMES), tuple(x for x in DOT_NAMES if x != ".")
_APART = str.maketrans({c: " " for c in map(chr, range(128)) if not (c.isalnum() or c == "_")})
_NO_WORD = re.compile(r"\W")
_HIDDEN = re.compile(f"[{_INVISIBLE}]")


def may_change(plain: str) -> bool:
    """A necessary condition of a disguise that ``_DISGUISE`` rewrites, cheap on texts that have none."""
    low = plain.lower()
    if any(b in low for b in "[({<") and _BRACKETED.search(low):
        return True
    if any(w in low for w in _DOT_WORDS) and _STOP.search(low):
        return True
    words = (low.translate(_APART) if low.isascii() else _NO_WORD.sub(" ", low)).split()
    return not _NAMES.isdisjoint(words) and bool(_PAIR.search(low))


class Rewritten:
    """Text after the transducers, with the source place of every piece.

    A dot alone between digits of a run that holds a spelled one stays a dot (addresses), or goes
    with the other separators (card numbers) if ``dots`` is false; ``dotted`` says that there was one.
    """

    def __init__(self, source: str, dots: bool = True):
        self.changed: list[tuple[int, int]] = []  # pieces of the source that were rewritten
        self.worded: list[tuple[int, int]] = []  # those that were plain words
        self.kept: list[int] | None = None  # source place of each character after stripping
        plain = source
        if not source.isascii():
            if _HIDDEN.search(source):
                self.kept = [i for i, c in enumerate(source) if c not in _INVISIBLE]
                self.changed += [m.span() for m in _HIDDEN.finditer(source)]
                plain = _HIDDEN.sub("", source)
            if not _ODD.isdisjoint(plain):
                self.changed += [(i, i + 1) for i, c in enumerate(source) if c in _ODD]
                plain = plain.translate(_TABLE)  # one sign for one sign
        pieces, self.starts, self.sources = [], [], []  # of each piece: start here, (start, end, copied) in the stripped text
        self.dotted = False
        done = size = 0
        dot_end = -1  # where the last dot piece ends

        def put(piece: str, start: int, end: int, copied: bool) -> None:
            nonlocal size
            pieces.append(piece)
            self.starts.append(size)
            self.sources.append((start, end, copied))
            size += len(piece)

        if may_change(plain):
            for m in _DISGUISE.finditer(plain):
                kind, start, end = m.lastgroup, *m.span()
                if kind == "digits":
                    body = m.group()
                    if not _ONE.search(body):
                        continue
                    found = _DIGIT_OR_DOT.findall(body)
                    self.dotted |= "." in found
                    new = ("+" if body[:4].lower() == "plus" else "") + "".join(str(DIGIT_NAMES.get(d.lower(), d)) for d in found if dots or d != ".")
                elif kind == "single":
                    after = _DISGUISE.match(plain, end)
                    if start != dot_end and not (after and after.lastgroup in ("dot", "stop")):
                        continue
                    new = str(DIGIT_NAMES[m.group().lower()])
                else:
                    new = {"at": "@", "word": "@", "dot": ".", "stop": "."}[kind]
                put(plain[done:start], done, start, True)
                put(new, start, end, False)
                place = self._source(start, end)
                self.changed.append(place)
                if kind in ("dot", "stop"):
                    dot_end = end
                if kind in ("word", "stop"):
                    self.worded.append(place)
                done = end
        put(plain[done:], done, len(plain), True)
        self.text = "".join(pieces)
        self.changed.sort()

    def _source(self, start: int, end: int) -> tuple[int, int]:
        """Source span of a span of the stripped text."""
        return (start, end) if self.kept is None else (self.kept[start], self.kept[end - 1] + 1)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Source span of a span of the rewritten text."""
        i = bisect.bisect_right(self.starts, start) - 1
        j = bisect.bisect_left(self.starts, end) - 1
        (a, _, copied), (b, last, whole) = self.sources[i], self.sources[j]
        return self._source(a + start - self.starts[i] if copied else a, b + end - self.starts[j] if whole else last)

    @staticmethod
    def touches(pieces: list[tuple[int, int]], start: int, end: int) -> bool:
        """Whether one of the ascending pieces lies in this source span."""
        i = bisect.bisect_left(pieces, (end,)) - 1
        return i >= 0 and pieces[i][1] > start


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the rewritten text shows, in source offsets; none overlaps a base span of its kind."""
    if (text.isascii() or (_ODD.isdisjoint(text) and not _HIDDEN.search(text))) and not may_change(text):
        return []
    new = Rewritten(text)
    if not new.changed:
        return []
    taken: list[list[tuple[int, int]]] = [[(s, e) for s, k, e in base if k == kind] for kind in range(len(KINDS))]
    out = []
    for rewritten in (new, Rewritten(text, dots=False)) if new.dotted else (new,):
        more = []
        for start, kind, end in detect(rewritten.text):
            s, e = rewritten.back(start, end)
            if rewritten.touches(rewritten.changed, s, e):
                if kind == 0 and rewritten.touches(rewritten.worded, s, e) and rewritten.text[start:end].rpartition(".")[2].lower() not in DOMAINS:
                    continue  # words in a sentence
                i = bisect.bisect_left(taken[kind], (e,)) - 1
                if i < 0 or taken[kind][i][1] <= s:
                    more.append((s, kind, e))
        for s, kind, e in more:
            bisect.insort(taken[kind], (s, e))
        out += more
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    """``kind:start:end`` by start, then kind, joined by commas."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each maximal run of overlapping spans replaced by ``[KIND]`` of its first span."""
    out, done = [], 0
    for s, k, e in sorted(spans):
        if s >= done:
            out += [text[done:s], f"[{KINDS[k].upper()}]"]
        done = max(done, e)
    return "".join(out) + text[done:]


def find(docs: DataFrame) -> DataFrame:
    """All personal data of every whole text, one row per row of ``docs`` (``doc_id, text``).

    ``n_email, n_ip, n_card, n_phone`` count base spans, ``n_added`` the disguised ones;
    ``base_sha256`` is over the joined base spans, ``spans`` joins all. Offsets are code points, end
    exclusive. Null text counts as empty; a null ``doc_id`` stays null; repeated rows each give a
    row; other columns are ignored; an empty table gives an empty result.
    """
    longs, texts = ["n_email", "n_ip", "n_card", "n_phone"], ["base_sha256", "spans"]

    def run(batch: pa.RecordBatch):
        counts, hashes, spans, added = [[] for _ in KINDS], [], [], []
        for t in batch.column("text"):
            text = t.as_py()
            base = detect(text)
            more = disguised(text, base)
            for kind, column in enumerate(counts):
                column.append(sum(1 for x in base if x[1] == kind))
            hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(base + more))
            added.append(len(more))
        yield batch_of(["doc_id", *longs, *texts, "n_added"], [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()], [batch.column("doc_id"), *counts, hashes, spans, added])

    return map_batches(documents(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in its text column replaced by its kind; all else as it was (null stays null)."""
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch):
        new = []
        for t in batch.column(at):
            value = t.as_py()
            if value:
                base = detect(value)
                value = redact(value, base + disguised(value, base))
            new.append(value)
        yield batch.set_column(at, text, pa.array(new, pa.string()))

    return map_batches(docs, run, docs.schema)
