"""Exact tokenisation by the ``tokenizers`` library with memoised words.

A byte-level BPE tokenizer splits a text into pre-tokens before it merges, and a boundary lies
before every space or newline that stands alone between other characters. Where all white
space of a text is of that kind, the ids of the text are the concatenated ids of its words,
each taken with the space before it; every distinct word is then encoded once per worker.
Any other text (adjacent white space, control separators, the text of a special token) is
encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array

_WHOLE = re.compile(r"\s\s|[\x1c-\x1f\x85  ]")
#: Words kept per generation; two generations live at once, which bounds a worker's memory.
GENERATION = 300_000


#: Letters, then marks that no pre-token shares with letters.
_TAIL = re.compile(r"([^\W\d_]+)([.,!?;:*#$%&]+)")


class _Words(dict):
    def __init__(self, encode, letters, prefix: str):
        super().__init__()
        self.encode, self.letters, self.prefix, self.older, self.tails = encode, letters, prefix, {}, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word.isalpha():
                ids = self.letters(self.prefix + word)
            elif parts := _TAIL.fullmatch(word):
                stem, tail = parts.groups()
                seen = stem in self or stem in self.older
                ids = self[stem] + (self.tails.get(tail) or self.tails.setdefault(tail, self.encode(tail)))
                if not seen:  # most likely a rare word: its stem is enough
                    return ids
            else:
                ids = self.encode(self.prefix + word)
        if len(self) >= GENERATION:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE: itself if printable, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordCachedEncoder:
    """``encode(text)`` gives the ids of a whole text as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        self.whole = lambda s: array("I", tokenizer.encode(s, add_special_tokens=False).ids).tobytes()
        shown, model = _byte_alphabet(), tokenizer.model
        # letters with at most one space before them are one pre-token: the BPE model alone sees them
        letters = lambda s: array("I", [t.id for t in model.tokenize("".join(map(shown.__getitem__, s.encode())))]).tobytes()
        self.first, self.spaced = _Words(self.whole, letters, ""), _Words(self.whole, letters, " ")
        self.newline = self.whole("\n")
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _WHOLE.search(text) or (self.special and self.special.search(text)):
            return self.whole(text)
        first, spaced, lines = self.first, self.spaced.__getitem__, []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            lines.append((first[head] if head else b"") + b"".join(map(spaced, rest)))
        return self.newline.join(lines)


_ENCODERS: dict[str, WordCachedEncoder] = {}


def encoder(tokenizer_json: str) -> WordCachedEncoder:
    """One encoder per Python worker and tokenizer, kept between tasks."""
    key = hashlib.sha1(tokenizer_json.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = WordCachedEncoder(tokenizer_json)
    return _ENCODERS[key]


def read_tokenizer(path: str) -> str:
    """The tokenizer's JSON, read once on the driver and broadcast (about 1.5 MB) to the workers."""
    with open(path, encoding="utf-8") as f:
        return f.read()
