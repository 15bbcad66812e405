"""Statistics of a whole text: the counts that the base rules name, and the features that the learnt models read."""

from __future__ import annotations

from collections import Counter
from math import log1p
from typing import NamedTuple

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
CONTINUED = bytes(range(0x80, 0xC0))


class Base(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


FEATURES = ("log_words", "mean_word", "symbols_a_word", "repeat_share", "dup_line_share", "upper_share", "digit_share", "distinct_share", "top_word_share",
            "bars_a_word", "calls_a_word", "stops_a_word", "commas_a_word", "log_line_words", "log_longest_word", "other_share", "odd_share", "short_share")


def _without(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which occurs twice or more, its first occurrence included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    hit = bytearray(len(words))
    for i, w in enumerate(windows):
        if found[w] > 1:
            hit[i : i + 3] = b"\1\1\1"
    return sum(hit)


def base(data: bytes, words: list[bytes] | None = None) -> Base:
    """Counts of a text in UTF-8. Words are runs of anything but the six ASCII spaces."""
    words = data.split() if words is None else words
    lines = [x for x in data.split(b"\n") if x.strip()]
    dense = data.translate(None, SPACES)
    return Base(len(words), len(dense) - _without(dense, CONTINUED), _without(data, SYMBOLS), len(lines) - len(set(lines)), repeated_words(words))


def features(data: bytes) -> tuple[Base, list[float]]:
    words = data.split()
    b = base(data, words)
    n, chars = max(b.n_words, 1), max(b.word_chars, 1)
    found = Counter(words)
    lines = max(1, sum(1 for x in data.split(b"\n") if x.strip()))
    upper, lower, digits = _without(data, UPPER), _without(data, LOWER), _without(data, DIGITS)
    beyond = _without(data, CONTINUED)
    odd = b.word_chars - upper - lower - digits - beyond
    return b, [
        log1p(b.n_words), b.word_chars / n, b.n_symbols / n, b.n_repeat_words / n, b.n_dup_lines / lines, upper / chars, digits / chars, len(found) / n,
        max(found.values(), default=0) / n, data.count(b"|") / n, data.count(b"!") / n, data.count(b".") / n, data.count(b",") / n, log1p(b.n_words / lines),
        log1p(max(map(len, found), default=0)), beyond / chars, odd / chars, sum(v for w, v in found.items() if len(w) <= 2) / n,
    ]
