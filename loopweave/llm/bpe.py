"""Byte-level BPE with a whole-token shortcut.

Most pre-tokens of natural text are themselves vocabulary entries. ``proven`` shows, once for a file, on the driver and before
any text is read, which vocabulary strings are cut into exactly one pre-token and merge to exactly one token; texts then need one
dictionary lookup for such a pre-token, and only the others are merged (each distinct one once per task).
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

#: Fixed values of the byte-level pre-tokenizer: contraction endings, and the letters, numbers and white space below U+0100.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t-\r \x85\xa0"

#: Distinct pre-tokens that a task remembers at most; it starts anew beyond.
REMEMBERED = 400_000


def _pattern(letters: str, numbers: str, spaces: str) -> re.Pattern:
    return re.compile(f"{ENDINGS}| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


def byte_letters() -> dict[int, int]:
    """The printable stand-in of every byte, as byte-level vocabularies write it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


def supported(spec: dict) -> bool:
    """Whether the shortcut is exact for this tokenizer file: byte-level BPE, no normaliser, plain special tokens."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    return (plain and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding") and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model.get("type") == "BPE" and not model.get("dropout"))


class Splitter:
    """Text to pre-tokens. Texts below U+0100 take a compiled pattern; any other takes the library's own splitter."""

    def __init__(self, tokenizer):
        self.library = tokenizer.pre_tokenizer
        self.ascii = _pattern("A-Za-z", "0-9", "\t-\r ").findall
        self.latin = _pattern(LETTERS, NUMBERS, SPACES).findall
        back = {v: k for k, v in byte_letters().items()}
        self.back = {k: chr(v) for k, v in back.items()}

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return [p.translate(self.back).encode("latin-1").decode() for p, _ in self.library.pre_tokenize_str(text)]
        return self.latin(text)


class Merged(dict):
    """Pre-token to what ``value`` makes of its ids. ``dict`` lookups serve what is known; a missing one is merged once."""

    def __init__(self, tokenizer, value, whole: dict[str, int]):
        super().__init__()
        self.model, self.value, self.whole = tokenizer.model, value, whole
        self.letters = {k: chr(v) for k, v in byte_letters().items()}
        self.start()

    def start(self) -> None:
        self.clear()
        value = self.value
        self.update((text, value((number,))) for text, number in self.whole.items())

    def __missing__(self, piece: str):
        out = self.value([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))])
        self[piece] = out
        return out


def whole_tokens(tokenizer) -> dict[str, int]:
    """The proof: vocabulary strings that are one pre-token and one token when they stand alone, with their ids."""
    back = {v: k for k, v in byte_letters().items()}
    split, model, out = Splitter(tokenizer), tokenizer.model, {}
    for word, number in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(back[ord(c)] for c in word).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if split(text) == [text] and [t.id for t in model.tokenize(word)] == [number]:
            out[text] = number
    return out


@lru_cache(maxsize=4)
def proven(content: str) -> dict[str, int]:
    """``whole_tokens`` of a tokenizer file; empty where the shortcut is not exact."""
    from tokenizers import Tokenizer

    return whole_tokens(Tokenizer.from_str(content)) if supported(json.loads(content)) else {}


class Encoder:
    """Counts or encodes whole texts as the library does by default: special strings in a text are their tokens."""

    def __init__(self, content: str, value, joined, whole: dict[str, int] | None = None):
        """``value`` maps ids to what is remembered of a pre-token; ``joined`` puts a text's values together; ``whole`` is what
        ``proven`` returned for this file, else it is proven here."""
        from tokenizers import Tokenizer

        spec = json.loads(content)
        self.tokenizer = Tokenizer.from_str(content)
        self.value, self.joined = value, joined
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.exact = supported(spec)
        if self.exact:
            self.split = Splitter(self.tokenizer)
            self.known = Merged(self.tokenizer, value, whole_tokens(self.tokenizer) if whole is None else whole)
            self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def __call__(self, text: str):
        if not self.exact:
            return self.joined([self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)])
        known = self.known
        if len(known) > REMEMBERED:
            known.start()
        if self.cut and any(s in text for s in self.special):
            out = []
            for i, part in enumerate(self.cut(text)):
                out += [self.value((self.special[part],))] if i % 2 else map(known.__getitem__, self.split(part))
            return self.joined(out)
        return self.joined(map(known.__getitem__, self.split(text)))
