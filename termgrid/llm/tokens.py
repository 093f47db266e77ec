"""Token ids of whole texts, by distinct words.

Where a tokenizer file defines the steps below, they are followed on arrays: normalise, cut into letter runs, single digits and runs of other signs,
and look each distinct word up. Words not seen before by a worker go to the tokenizers library, so each is encoded about
once; texts that hold special-token strings go there whole, and so does every text of a file that defines other steps.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cached_property

import numpy as np

#: Code points of one call, and words a worker keeps before it starts afresh.
CALL, KEEP = 1 << 17, 500_000
#: The steps that are followed here, as tokenizer files state them; fixed values.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_LETTER, _DIGIT, _BLANK, _SIGN = 0, 1, 2, 3
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
_tables: dict[str, Words] = {}


def _classes() -> np.ndarray:
    kind = np.full(sys.maxunicode + 1, _SIGN, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kind[c] = _LETTER
        elif major == "N":
            kind[c] = _DIGIT
    for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        kind[c] = _BLANK
    return kind


def _rolled(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span of code points, the same for equal spans; different ones may share it, so it only groups."""
    if not _powers or len(_powers[0]) < len(c) + 1:
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(max(len(c), 2 * CALL), b, dtype=np.uint64))), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(c)], dtype=np.uint64)))
    return (total[ends] - total[starts]) * _powers[1][starts]


class Words:
    """The ids of the words met so far, by the words themselves."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.path = path
        stated = json.loads(self.full.to_str())
        self.by_words = stated["normalizer"] == _NORMALIZER and stated["pre_tokenizer"] == _SPLITTER and stated["model"].get("end_of_word_suffix") == "</w>"
        if not self.by_words:
            return
        del stated
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.plain = Tokenizer(self.full.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.kind = _classes()
        del self.full  # read again where a text needs it
        self.clear()

    @cached_property
    def full(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.begin, self.count = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.flat, self.used = np.empty(1 << 16, dtype=np.uint32), 0

    def learn(self, words: list[str]) -> None:
        found, n = [], []
        for lo in range(0, len(words), 256):
            part = words[lo : lo + 256]
            ids = np.array(self.plain.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(part) or stop[-1] != len(ids):
                alone = [self.plain.encode(w, add_special_tokens=False).ids for w in part]
                ids, stop = np.array([i for w in alone for i in w], dtype=np.uint32), np.cumsum([len(w) for w in alone])
            found.append(ids)
            n.append(np.diff(stop, prepend=0))
        ids, n = np.concatenate(found), np.concatenate(n)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin = np.append(self.begin, self.used + np.cumsum(n) - n)
        self.count = np.append(self.count, n)
        self.used += len(ids)
        for w in words:
            self.number[w] = len(self.number)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, by as few calls as the limit on code points allows."""
        if not self.by_words:
            return [np.array(e.ids, dtype=np.uint32) for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[np.ndarray] = []
        ready, size = [], 0
        for text in texts:
            if "<|" in text and any(s in text for s in self.special):
                out += self._call(ready) + [np.array(self.full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)]
                ready, size = [], 0
                continue
            if ready and size + len(text) > CALL:
                out += self._call(ready)
                ready, size = [], 0
            ready.append(text)
            size += len(text)
        return out + self._call(ready)

    def _call(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if len(self.number) > KEEP:
            self.clear()
        texts = [(t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)).replace("Σ", "σ").lower() for t in texts]
        whole = "\n".join(texts) + "\n"
        c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        row = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        kind = self.kind[c]
        start = np.empty(len(c), dtype=bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == _DIGIT
        blank = kind == _BLANK
        start &= ~blank
        for p in np.flatnonzero((c == 0x27) & start):  # contractions are words of their own
            tail = whole[p + 1 : p + 3]
            n = 2 if tail in ("re", "ve", "ll") else 1 if tail[:1] in ("s", "t", "m", "d") else 0
            if n:
                start[p + 1] = False
                start[p + 1 + n] = not blank[p + 1 + n]
        edges = np.flatnonzero(start | blank)
        first = np.flatnonzero(start[edges])
        starts, ends = edges[first], edges[first + 1]
        h = _rolled(c, starts, ends)
        _, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        # a hash only groups: each word is compared in full with the first one of its group
        size, first = ends - starts, where[inverse]
        at = np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)
        if (size != size[first]).any() or (c[at] != c[at + np.repeat(starts[first] - starts, size)]).any():
            return [np.array(self.full.encode(t, add_special_tokens=False).ids, dtype=np.uint32) for t in texts]
        words = [whole[i:j] for i, j in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        new = [w for w in words if w not in self.number]
        if new:
            self.learn(new)
        spot = np.array([self.number[w] for w in words], dtype=np.int64)[inverse]
        n = self.count[spot]
        stop = np.cumsum(n)
        flat = self.flat[np.repeat(self.begin[spot] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        cut = np.concatenate(([0], stop))[np.searchsorted(starts, row)]
        return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def words_for(path: str) -> Words:
    """This worker's table for a tokenizer file."""
    if path not in _tables:
        _tables[path] = Words(path)
    return _tables[path]
