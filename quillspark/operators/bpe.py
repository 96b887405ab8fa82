"""Byte-level BPE with given ranks: specials by longest match, pre-tokens, lowest-rank merges."""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import PRETOKEN


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class BytePairEncoder:
    """Encodes with a vocabulary and its merges; memoises the pre-tokens that it met last."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], specials: dict[str, int]):
        import regex

        self.vocabulary, self.specials = vocabulary, specials
        self.ranks = {pair: n for n, pair in enumerate(merges)}
        self.symbols = byte_symbols()
        self.pretoken = regex.compile(PRETOKEN)
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None
        self.piece = lru_cache(1 << 16)(self._piece)

    @classmethod
    def from_json(cls, content: str) -> BytePairEncoder:
        """From the text of a ``tokenizer.json``."""
        j = json.loads(content)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
        return cls(j["model"]["vocab"], merges, {a["content"]: a["id"] for a in j["added_tokens"]})

    def _piece(self, text: str) -> tuple[int, ...]:
        """Ids of one pre-token: of the neighbours, the pair of lowest rank joins (leftmost first).

        Symbols are a linked list and pairs a heap, so a piece of n bytes takes n log n.
        """
        from heapq import heapify, heappop, heappush

        parts: list[str | None] = [self.symbols[b] for b in text.encode()]
        after = [*range(1, len(parts)), -1]
        before = list(range(-1, len(parts) - 1))
        none = len(self.ranks)
        heap = [(self.ranks.get((a, b), none), i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        heap = [h for h in heap if h[0] < none]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue  # one of the two has joined another symbol since
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (pair := (parts[left], parts[right])) in self.ranks:
                    heappush(heap, (self.ranks[pair], left, *pair))
        return tuple(self.vocabulary[p] for p in parts if p is not None)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for part in self.special.split(text or "") if self.special else [text or ""]:
            if part in self.specials:
                out.append(self.specials[part])
            else:
                for match in self.pretoken.finditer(part):
                    out.extend(self.piece(match.group()))
        return out


def encode_texts(rows: DataFrame, encoder: BytePairEncoder, key: str, text: str) -> DataFrame:
    """``key, ids`` of each row's text; a null text has no ids. The tables (some MB) are broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast((encoder.vocabulary, list(encoder.ranks), encoder.specials))

    def encode(batches):
        import pyarrow as pa

        own = BytePairEncoder(*shared.value)
        for batch in batches:
            ids = pa.array([own.encode(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return rows.select(key, F.col(text)).mapInArrow(encode, f"{key} {dict(rows.dtypes)[key]}, ids array<int>")
