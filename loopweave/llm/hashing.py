"""Hashes of words and shingles, for many texts at once."""

from __future__ import annotations

import numpy as np

#: Lower-case A-Z only; a word is a run of anything but the six ASCII spaces.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes; runs of other lengths have other hashes."""
    n = len(words)
    if n < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, np.uint64(k + (seed << 32)))
        for j in range(k):
            h = mixed(h * _ODD + words[j : n - k + 1 + j])
        return h


class Words:
    """Hashes of the words of texts in UTF-8, as polynomials, all words of about ``STRIDE`` bytes at once. ``table`` maps bytes
    before words are parted at spaces."""

    STRIDE = 1 << 20

    def __init__(self, table: bytes = LOWER):
        self.table = table
        self.powers = np.ones(1, np.uint64)

    def _stretch(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words in a stretch of bytes that parts no word."""
        space = _SPACE[raw]
        edge = np.diff(np.concatenate([[True], space, [True]]).view(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(starts):
            return starts, np.empty(0, np.uint64)
        size = ends - starts
        begun = np.zeros(len(raw), np.int64)
        begun[starts] = starts
        place = np.arange(len(raw)) - np.maximum.accumulate(begun)
        place[space] = 0
        with np.errstate(over="ignore"):
            if (longest := int(size.max())) >= len(self.powers):
                self.powers = np.multiply.accumulate(np.full(2 * longest + 1, np.uint64(0xD1342543DE82EF95)))
            terms = (raw.astype(np.uint64) + np.uint64(1)) * self.powers[place]
            terms[space] = 0
            return starts, mixed(np.add.reduceat(terms, starts) + size.astype(np.uint64) * _ODD)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, and the bounds of each text's part of them. A form feed between texts parts their
        words."""
        raw = np.frombuffer((b"\x0c".join(texts) + b"\x0c").translate(self.table), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts, words, at = [], [], 0
        while at < len(raw):
            stop = min(at + self.STRIDE, len(raw))
            while stop < len(raw) and not _SPACE[raw[stop - 1]]:
                stop += 1
            s, w = self._stretch(raw[at:stop])
            starts.append(s + at)
            words.append(w)
            at = stop
        bounds = np.concatenate([[0], np.searchsorted(np.concatenate(starts), ends)]) if texts else np.zeros(1, np.int64)
        return np.concatenate(words), bounds
