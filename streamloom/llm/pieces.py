"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The model file's pieces and log scores are read from its protobuf; pieces are laid out in a
double-array trie over UTF-8 bytes. No piece holds the white-space marker after another letter
(checked on loading), so that a text falls apart before each run of markers into chunks that are
segmented on their own. Chunks not seen before are matched and segmented many at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.session import ready

MARK = "▁"
#: Chunks that a worker remembers, and the code points that each may have; then it starts anew.
REMEMBERED, REMEMBERED_CHARS = 300_000, 64
#: Bytes up to which chunks are segmented side by side; longer ones go one by one.
SIDE_BY_SIDE = 256
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protobuf message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, i = varint(i)
            value = data[i : i + size]
            i += size
        yield tag >> 3, value


class Trie:
    """A double-array trie: the child of node s by byte b is base[s] + b + 1 if check there is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        size = 1 << 12
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        first = hint = 258  # every byte can reach slots from here
        work = [(0, 0, len(keys), 0)]
        while work:
            node, lo, hi, depth = work.pop()
            if len(keys[lo]) == depth:
                value[node] = values[lo]
                lo += 1
            if lo == hi:
                continue
            children, at = [], lo
            while at < hi:
                b, begin = keys[at][depth], at
                while at < hi and keys[at][depth] == b:
                    at += 1
                children.append((b + 1, begin, at))
            while first < size and used[first]:
                first += 1
            several = len(children) > 1
            place = start = (max(first, hint) if several else first) - children[0][0]
            while True:
                if place + 258 > size:
                    grow = size
                    base, check, value = (np.concatenate([a, np.full(grow, f, np.int32)]) for a, f in ((base, 0), (check, -1), (value, -1)))
                    used.extend(bytes(grow))
                    size += grow
                if not any(used[place + c] for c, _, _ in children):
                    break
                place += 1
            if several and place - start > 64:  # crowded so far: nodes of several children go on from here
                hint = place
            base[node] = place
            for c, begin, end in children:
                used[place + c] = 1
                check[place + c] = node
                work.append((place + c, begin, end, depth + 1))
        self.base, self.check, self.value = base, check, value

    def matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, value) of every key found at the starts, none beyond the end of its chunk."""
        node, at = np.zeros(len(starts), np.int32), starts.copy()
        origin, limit = starts, ends
        found = []
        while len(at):
            inside = at < limit
            node, at, origin, limit = node[inside], at[inside], origin[inside], limit[inside]
            step = self.base[node] + data[at].astype(np.int32) + 1
            good = (step < len(self.check)) & (self.base[node] > 0)
            good[good] = self.check[step[good]] == node[good]
            node, at, origin, limit = step[good], at[good] + 1, origin[good], limit[good]
            value = self.value[node]
            hit = value >= 0
            found.append((origin[hit], at[hit], value[hit]))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Pieces:
    """Pieces, scores and trie of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        text, score, kind = [], [], []
        prefix, squeeze = True, True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                text.append(piece[1].decode())
                score.append(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                kind.append(piece.get(3, NORMAL))
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
                prefix, squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if squeeze:
            raise ValueError("models that remove extra white space are not supported")
        self.text, self.prefix = text, prefix
        self.score = np.array(score, np.float64)
        self.unknown = kind.index(UNKNOWN)
        self.bytes = np.full(256, self.unknown, np.int32)
        for i, (t, k) in enumerate(zip(text, kind, strict=True)):
            if k == BYTE:
                self.bytes[int(t[3:5], 16)] = i
        self.fallback = BYTE in kind
        plain = [i for i, k in enumerate(kind) if k in (NORMAL, USER)]
        if any(MARK in text[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece holds the white-space marker after a letter")
        self.unknown_score = self.score[plain].min() - 10
        self.trie = Trie([text[i].encode() for i in plain], plain)
        self.raw = [bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(MARK, " ").encode() if k in (NORMAL, USER) else b"" for t, k in zip(text, kind, strict=True)]
        self.raw[self.unknown] = " ⁇ ".encode()

    def chunks(self, text: str) -> list[str]:
        """The text cut before each run of white-space markers.

        A chunk of one marker and a word is written as the bare word, any other as it is after
        one more marker.
        """
        if not text:
            return []
        if self.prefix and "  " not in text and MARK not in text and text[0] != " ":
            return text.split(" ")
        text = text.replace(" ", MARK)
        if self.prefix:
            text = MARK + text
        return [c[1:] if c[:1] == MARK and c[1:2] != MARK else MARK + c for c in _CHUNK.findall(text)]

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Pieces of each chunk by the best sum of log scores."""
        raw = [(c[1:] if c[:1] == MARK else MARK + c).encode() for c in chunks]
        out: list[list[int]] = [[]] * len(raw)
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        at = 0
        while at < len(order):
            group, width = [], 0
            while at < len(order) and (not group or (len(group) + 1) * len(raw[order[at]]) <= 1 << 17 and len(raw[order[at]]) <= max(SIDE_BY_SIDE, width)):
                width = len(raw[order[at]])
                group.append(order[at])
                at += 1
            for i, ids in zip(group, self._group([raw[i] for i in group]), strict=True):
                out[i] = ids
        return out

    def _group(self, raw: list[bytes]) -> list[list[int]]:
        sizes = np.array([len(r) for r in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        row = np.repeat(np.arange(len(raw)), sizes)
        first = np.flatnonzero((flat & 0xC0) != 0x80)
        lengths = np.diff(np.concatenate([first, [len(flat)]]))
        start, end, piece = self.trie.matches(flat, first, begin[row[first] + 1])
        single = np.zeros(len(flat), bool)
        of_letter = np.zeros(len(flat), np.int64)
        of_letter[first] = lengths
        single[start[end - start == of_letter[start]]] = True
        lone = ~single[first]
        start = np.concatenate([start, first[lone]])
        end = np.concatenate([end, first[lone] + lengths[lone]])
        piece = np.concatenate([piece, np.full(int(lone.sum()), -1, np.int64)])
        score = np.where(piece < 0, self.unknown_score, self.score[piece])
        r = row[start]
        s, e = start - begin[r], end - begin[r]
        width = int(sizes.max())
        order = np.lexsort((s, e))
        r, s, e, piece, score = r[order], s[order], e[order], piece[order], score[order]
        best = np.full((len(raw), width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((len(raw), width + 1), np.int32)
        used = np.full((len(raw), width + 1), -1, np.int32)
        key = e * (width + 1) + s
        edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            i, a, b = r[lo:hi], s[lo], e[lo]
            sums = best[i, a] + score[lo:hi]
            up = sums > best[i, b]
            i = i[up]
            best[i, b], back[i, b], used[i, b] = sums[up], a, piece[lo:hi][up]
        # Backwards from each end, one piece of every chunk at a time.
        i, b = np.arange(len(raw)), sizes.copy()
        steps = []
        while len(i):
            p, a = used[i, b], back[i, b]
            steps.append((i, a, b, p))
            go = a > 0
            i, b = i[go], a[go]
        i, a, b, p = (np.concatenate(x) for x in zip(*steps, strict=True))
        odd = p < 0
        if self.fallback and odd.any():  # an unknown letter becomes the pieces of its bytes
            times = np.where(odd, b - a, 1)
            k = np.repeat(np.arange(len(i)), times)
            within = np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
            i, a, p = i[k], a[k] + within, np.where(odd[k], self.bytes[flat[begin[i[k]] + a[k] + within]], p[k])
        else:
            p = np.where(odd, self.unknown, p)
        order = np.lexsort((a, i))
        ids, ends = p[order].tolist(), np.cumsum(np.bincount(i, minlength=len(raw))).tolist()
        return [ids[x:y] for x, y in zip([0, *ends], ends, strict=False)]

    def decode(self, ids) -> str:
        """The text of pieces: bytes joined (U+FFFD where they are no UTF-8), markers as spaces."""
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Encoder:
    """Encodes batches of texts, remembering chunks."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, {}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts, offsets)."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        cut = [self.pieces.chunks(t) if t else [] for t in texts]
        fresh = sorted(set().union(*cut).difference(self.known))
        self.known.update(zip(fresh, map(tuple, self.pieces.segment(fresh)), strict=True))
        flat, ends = [], [0]
        for chunks in cut:
            ids = np.fromiter(chain.from_iterable(map(self.known.__getitem__, chunks)), np.int32)
            flat.append(ids)
            ends.append(ends[-1] + len(ids))
        for chunk in fresh:
            if len(chunk) > REMEMBERED_CHARS:
                del self.known[chunk]
        return np.concatenate(flat) if flat else np.empty(0, np.int32), np.array(ends, np.int64)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


_encoders: dict[str, Encoder] = {}


def _encoder(shared, path: str) -> Encoder:
    """One encoder for each worker process and model file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(shared.value)
    return _encoders[path]


def _slices(texts: list[str | None], size: int = 1 << 21) -> Iterator[list[str | None]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "")
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, n_pieces, pieces, restored) for every row.

    pieces are the ids of the best segmentation without begin and end; restored tells whether
    decoding them gives the text back. Null and empty texts have no pieces and are restored. A
    text that itself holds the marker U+2581 decodes with a space there and is not restored.
    Repeated and null ids stay; an empty table gives an empty result; other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(load(path))
    slim = docs.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kept = len(slim.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, path)
        decode = encoder.pieces.decode
        for batch in batches:
            done = 0
            for texts in _slices(batch.column(kept).to_pylist()):
                ids, ends = encoder.encode(texts)
                same = [decode(ids[a:b].tolist()) == t for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True)]
                part = batch.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:kept], pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array(same, pa.bool_())],
                    names=[*part.schema.names[:kept], "n_pieces", "pieces", "restored"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{fields}, n_pieces long, pieces array<int>, restored boolean")


def decode(rows: DataFrame, path: str, pieces_col: str = "pieces", out_col: str = "text") -> DataFrame:
    """rows with the text of their pieces added; null pieces give null."""
    spark = ready(rows.sparkSession)
    shared = spark.sparkContext.broadcast(load(path))

    @F.pandas_udf("string")
    def text_of(column):
        return column.map(lambda ids: None if ids is None else shared.value.decode(ids))

    return rows.withColumn(out_col, text_of(pieces_col))
