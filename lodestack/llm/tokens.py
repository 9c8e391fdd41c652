"""Token ids of whole texts, by the tokenizers library, each distinct word encoded once.

A byte-level BPE never merges across the words that its own splitting pattern makes. Texts of Latin
letters and common signs are therefore split here by that pattern and looked up word by word in a
bounded table, which the library fills; any other text goes to the library as a whole.
"""

from __future__ import annotations

import functools
import os
import re
import struct

import numpy as np

#: Words that the table holds before it is emptied (about 160 MB).
CACHE_WORDS = 800_000

# The splitting pattern of the byte-level vocabulary, written out for U+0009..U+024F.
_L, _N, _S = r"A-Za-zªµºÀ-ÖØ-öø-ɏ", r"0-9²³¹¼-¾", r"\t\n\r "
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_L}{_N}{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]")


class Encoder:
    """Token ids as little-endian unsigned 32-bit integers; vocabularies below 65,536 ids are kept by two bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = self.library.get_vocab_size() <= 1 << 16 and self._splits_alike()
        self.words: dict[str, bytes] = {}
        self.blank = np.zeros(self.library.get_vocab_size(), dtype=bool)
        for piece, i in self.library.get_vocab().items():
            self.blank[i] = piece.startswith("Ġ")

    def _splits_alike(self) -> bool:
        """Whether the library splits a trial text as ``_SPLIT`` does and has no normaliser."""
        trial = "It's  a test,\n\nof 12½ (words) we'll   split\tÀ la carte…! x\r\n  «ça» §3 'tis I'm\n "
        trial = _OTHER.sub("", trial)
        if self.library.normalizer is not None or self.library.pre_tokenizer is None:
            return False
        pieces = [trial[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(trial)]
        return pieces == _SPLIT.findall(trial)

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text by the library alone."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def __call__(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not self.fast or _OTHER.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        words, known = _SPLIT.findall(text), self.words
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = set(words)
            self._learn(new)
        return np.frombuffer(b"".join(map(known.__getitem__, words)), dtype="<u2").astype("<u4")

    def _learn(self, new: set[str]) -> None:
        """Encode words: those that are a blank and letters all in one call, cut where a blank begins."""
        plain = [w for w in new if w[0] == " " and w[1:].isalpha()]
        if plain:
            ids = np.array(self.library.encode_batch_fast(["".join(plain)], add_special_tokens=False)[0].ids, dtype="<u2")
            cut = np.append(np.flatnonzero(self.blank[ids]), len(ids)) * 2
            if len(cut) != len(plain) + 1:
                raise ValueError("a word was split in two: the vocabulary is not a byte-level one")
            data, ends = ids.tobytes(), cut.tolist()
            for w, a, b in zip(plain, ends, ends[1:]):
                self.words[w] = data[a:b]
        other = list(new.difference(plain))
        for w, e in zip(other, self.library.encode_batch_fast(other, add_special_tokens=False), strict=True):
            ids = e.ids
            self.words[w] = struct.pack(f"<{len(ids)}H", *ids)

    def sentence_ends(self) -> np.ndarray:
        """Whether the text of each id ends a sentence or a line."""
        ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
        for piece, i in self.library.get_vocab().items():
            ends[i] = piece.rstrip("\"')]»”").endswith((".", "!", "?", "Ċ", "…"))
        return ends


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker, so the table of words outlives a task."""
    return Encoder(path)
