"""Vectorised word and shingle hashing over Arrow text columns.

Texts are hashed as UTF-8 bytes. Words are runs of bytes other than 0x20 and 0x09-0x0D, which
are single bytes in UTF-8, so that cutting bytes and cutting code points agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text hashed at once; longer texts are cut at white space and hashed piece by piece.
SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, U64), np.full(n, inverse, U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _hash_piece(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one piece of text, in order."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(SPACE[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, U64)
    size = 1 << max(12, int(len(data)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def _hash_long(word: np.ndarray) -> np.ndarray:
    """The hash of one word of any length, as _hash_piece gives it, SEGMENT bytes at a time."""
    up, _ = _powers(SEGMENT)
    step = pow(_BASE, SEGMENT, 1 << 64)
    total, scale = 0, 1
    for at in range(0, len(word), SEGMENT):
        part = word[at : at + SEGMENT].astype(U64) + U64(1)
        total += scale * int((part * up[: len(part)]).sum(dtype=U64))
        scale = scale * step & (1 << 64) - 1
    return mix(np.array([(total + len(word) * 0xD6E8FEB86659FD93) & (1 << 64) - 1], U64))


def word_hashes(text: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of the words of one text given as UTF-8 bytes."""
    if lower:
        text = LOWER[text]
    if len(text) <= SEGMENT:
        return _hash_piece(text)
    out, at = [], 0
    while at < len(text):
        end = min(at + SEGMENT, len(text))
        if end < len(text):
            cut = np.flatnonzero(SPACE[text[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # one word longer than a piece
                while end < len(text) and not len(cut := np.flatnonzero(SPACE[text[end : end + SEGMENT]])):
                    end += SEGMENT
                end = min(end + int(cut[0]) if len(cut) else end, len(text))
                out.append(_hash_long(text[at:end]))
                at = end
                continue
        out.append(_hash_piece(text[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter.

    Words are chained through the finaliser one after the other, so that no two orders of the same
    words agree but by chance.
    """
    n = len(words)
    if n == 0:
        return words
    width = min(n, k)
    total = np.full(n - width + 1, (width * 0xA0761D6478BD642F) & (2**64 - 1), U64)
    for j in range(width):
        total *= U64(0xE7037ED1A0B428DB)
        total += words[j : n - width + 1 + j]
        total = mix(total)
    out = np.sort(total)
    keep = np.empty(len(out), bool)
    keep[0] = True
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]


def text_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text of a column as UTF-8 bytes; null gives no bytes."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    for i in range(len(column)):
        yield raw[at[i] : at[i + 1]]
