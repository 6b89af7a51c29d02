"""Token counts by the whole-token shortcut for byte-level BPE vocabularies.

Offline, every vocabulary string is merged on its own; those that end as one token are whole
tokens. A text is cut into pre-tokens; those that are whole tokens count one at once, and only the
rest is merged (and remembered, within a bound).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.session import ready

#: Merged pre-tokens that a worker remembers, and the code points that each may have; then it starts anew.
REMEMBERED, REMEMBERED_CHARS = 600_000, 64
#: Symbols up to which scanning for the lowest rank is cheaper than a heap.
SHORT = 48
#: Code points up to which a text is cut into pre-tokens at once; longer ones are streamed.
AT_ONCE = 1 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class Merger:
    """Pair merges of a byte-level BPE file."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        self.ranks = ranks
        self.letters = byte_letters()

    def letters_of(self, piece: str) -> list[str]:
        return [self.letters[b] for b in piece.encode()]

    def merge(self, symbols: list[str]) -> list[str]:
        """The tokens of one pre-token: lowest rank first, leftmost among equals.

        Short ones by scanning; the others by a heap over a linked list, in n log n.
        """
        n = len(symbols)
        if n < 2:
            return symbols
        symbols, ranks = list(symbols), self.ranks
        if n <= SHORT:
            none = len(ranks)
            order = [ranks.get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
            while order and (least := min(order)) < none:
                i = order.index(least)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                del order[i]
                if i:
                    order[i - 1] = ranks.get((symbols[i - 1], symbols[i]), none)
                if i < len(order):
                    order[i] = ranks.get((symbols[i], symbols[i + 1]), none)
            return symbols
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for x in (left[i], i):
                y = right[x] if x >= 0 else n
                if y < n and (r := ranks.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return [s for s in symbols if s is not None]


@lru_cache(maxsize=4)
def load(path: str) -> tuple[dict, list[str], list[str]]:
    """(merge ranks, whole tokens as text, special strings) of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    ranks = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(model["merges"])}
    special = [t["content"] for t in spec["added_tokens"]]
    return ranks, whole_tokens(model["vocab"], ranks), special


def whole_tokens(vocab, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Vocabulary strings that are text and that merge, alone, into themselves as one token."""
    merger = Merger(ranks)
    byte_of = {c: b for b, c in enumerate(merger.letters)}
    out = []
    for token in vocab:
        if not all(c in byte_of for c in token) or merger.merge(list(token)) != [token]:
            continue
        try:
            out.append(bytes(byte_of[c] for c in token).decode())
        except UnicodeDecodeError:
            continue
    return out


class Counter(dict):
    """Pre-token to number of tokens; a missing one is merged and remembered."""

    def __init__(self, ranks, whole, special):
        super().__init__(dict.fromkeys(whole, 1))
        self.base, self.whole, self.merger = len(self), whole, Merger(ranks)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def __missing__(self, piece: str) -> int:
        n = len(self.merger.merge(self.merger.letters_of(piece)))
        if len(self) < self.base + REMEMBERED and len(piece) <= REMEMBERED_CHARS:
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, parts = 0, [text]
        if self.special:
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            found = self.pattern.findall(part) if len(part) <= AT_ONCE else (m.group() for m in self.pattern.finditer(part))
            total += sum(map(self.__getitem__, found))
        return total

    def tidy(self) -> None:
        if len(self) >= self.base + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    Counts are those of the tokenizer file at path without added tokens; special strings inside
    texts are one token each. Null and empty texts have 0 bytes and tokens. Repeated and null ids
    stay as they are; an empty table gives an empty result; other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared, path)
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(2).to_pylist()]
            counter.tidy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    counted = slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


_counters: dict[str, Counter] = {}


def _counter(shared, key: str) -> Counter:
    """One counter for each worker process and tokenizer file."""
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(*shared.value)
    return _counters[key]
