"""Approximate nearest neighbours by an inverted multi-index.

Two codebooks quantise the two halves of the vectors; a cell is a pair of centroids. For each
query, cells are met by growing summed distance (a heap over the two sorted lists of centroids)
until they hold enough vectors, and the vectors of those cells are ranked by exact distance.
Crowded cells are cut into blocks, so that one cell costs no task more than a block.

How many vectors are enough is measured on the vectors at hand, whatever their number: a few
queries are answered exactly, over all vectors in blocks, and the least number is taken with which
the index would have found the wanted share of their neighbours. Clustered vectors need a small and
steady number; vectors without any structure need a share of all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.session import ready, stage

#: Vectors that the codebooks are fitted on, about: those of the smallest id hashes.
FIT_ROWS = 20_000
#: Queries that are answered exactly to learn how many vectors must be met, and the share of their neighbours wanted.
TUNED, RECALL = 96, 0.96
#: Centroids of a half at most: a codebook has half the square root of the number of vectors.
CENTROIDS = 256
#: Queries traversed by one task.
TOGETHER = 64
#: Vectors in a block of a cell, about.
BLOCK = 2048
SEED = 11


def usable(vectors: DataFrame, length: int | None = None) -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, not zero, all components finite, and of
    the given length, or else the commonest one (ties: the longest)."""
    v = F.col("embedding").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)"
    )
    if length is not None:
        return good.where(F.size("v") == length)
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return good.where(F.size("v") == sizes[0].d) if sizes else good


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids of the rows of x, the same for the same rows."""
    rng = np.random.default_rng(SEED)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centroids)
        for j in range(len(centroids)):
            mine = x[near == j]
            if len(mine):
                centroids[j] = mine.mean(axis=0)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1) - 2 * x @ centroids.T


def traverse(d1: np.ndarray, d2: np.ndarray, counts: dict[int, int], least: int) -> list[int]:
    """Cells (i * len(d2) + j) by growing d1[i] + d2[j] until they hold `least` vectors."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b = d1[o1], d2[o2]
    heap, out, held, left = [(a[0] + b[0], 0, 0)], [], 0, len(counts)
    while heap and held < least and left:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * len(d2) + int(o2[j])
        if cell in counts:
            out.append(cell)
            held += counts[cell]
            left -= 1
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def pack(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Cell to (first group, groups): small cells share a group of about BLOCK vectors, a crowded
    one has several of its own."""
    out, group, held = {}, 0, 0
    for cell in sorted(counts):
        n = counts[cell]
        if held and held + n > BLOCK:
            group, held = group + 1, 0
        several = -(-n // BLOCK)
        out[cell] = (group, several)
        held += n
        if several > 1:
            group, held = group + several, 0
    return out


def exactly(index: DataFrame, queries: list, k: int) -> DataFrame:
    """(q, cell) of the k nearest of each query (number, id, vector), over all rows (cell, vec_id, v) in blocks."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast((np.array([i for _, i, _ in queries]), np.array([v for *_, v in queries])))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, own, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _vectors(batch.column(2))
            d = np.maximum(distances(x, v), 0)
            d[ids[:, None] == own] = np.inf
            more = (d, np.broadcast_to(own, d.shape), np.broadcast_to(cell, d.shape))
            held = more if held is None else tuple(np.concatenate([a, b], axis=1) for a, b in zip(held, more, strict=True))
            near = np.argsort(held[0], axis=1, kind="stable")[:, :k]
            held = tuple(np.take_along_axis(a, near, axis=1) for a in held)
        if held is not None:
            rows, columns = np.nonzero(np.isfinite(held[0]))
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int64)), *(pa.array(a[rows, columns]) for a in held)], names=["q", "d", "vec_id", "cell"])

    order = Window.partitionBy("q").orderBy("d", "vec_id")
    found = index.select("cell", "vec_id", "v").mapInArrow(best, "q long, d double, vec_id long, cell long")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("q", "cell")


def enough(index: DataFrame, books: tuple, counts: dict[int, int], queries: list, k: int, recall: float) -> int:
    """The number of vectors after which the cells met hold `recall` of the neighbours of the queries."""
    one, two = books
    half = one.shape[1]
    size = np.zeros(len(one) * len(two), np.int64)
    size[list(counts)] = list(counts.values())
    wanted: dict[int, list[int]] = {}
    for r in exactly(index, queries, k).collect():  # at most k cells for each of the TUNED queries
        wanted.setdefault(r.q, []).append(r.cell)
    met = []
    for q, cells in wanted.items():
        v = queries[q][2][None, :]
        order = np.argsort((distances(v[:, :half], one)[0][:, None] + distances(v[:, half:], two)[0]).ravel(), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(size[order])
        met += place[cells].tolist()
    return int(np.quantile(met, recall, method="higher")) if met else 0


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL, centroids: int = CENTROIDS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, itself left out.

    vectors and queries have (vec_id, embedding); score is the Euclidean distance of the original
    vectors in double precision, and ties go to the smaller vec_id. Each query meets as many
    vectors, cell by cell, as hold the share `recall` of the neighbours of TUNED queries, those of
    the smallest id hashes. Repeated ids are separate candidates, but a query's own id never is
    one; of a query given with several vectors the least is asked. Null ids, and vectors that are
    null, zero, of another length or not finite, take no part. Empty tables give an empty result;
    other columns are ignored. The codebooks are fitted on about fit_rows vectors; every vector is
    in the index.
    """
    spark = ready(vectors.sparkSession)
    schema = "query_id long, vec_id long, score double"
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    all_rows = usable(vectors)
    n = all_rows.count()
    if not n:
        return nothing
    picked = min(1.0, fit_rows / n)
    sample = all_rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(picked * (1 << 30))).orderBy("vec_id").select("v").toPandas()["v"]
    x = np.array(sample.tolist()) if len(sample) else np.array([all_rows.orderBy("vec_id").first().v])
    centroids = min(centroids, max(4, int(n**0.5 / 2)))
    half = max(1, x.shape[1] // 2)
    books = kmeans(x[:, :half].copy(), centroids), kmeans(x[:, half:].copy(), centroids) if x.shape[1] > 1 else np.zeros((1, 0))
    shared = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        for batch in batches:
            v = _vectors(batch.column(1))
            cell = nearest(v[:, :half], one) * len(two) + nearest(v[:, half:], two) if len(v) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), *batch.columns], names=["cell", "vec_id", "v"])

    index = stage(all_rows.mapInArrow(assign, "cell long, vec_id long, v array<double>"), "index")
    sizes = {r.cell: r.n for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most centroids**2
    told = spark.sparkContext.broadcast((sizes, pack(sizes)))
    mine = stage(usable(queries, x.shape[1]).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    tuned = mine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TUNED).collect()
    if not tuned:
        return nothing
    wish = max(k + 1, enough(index, books, sizes, [(i, r.vec_id, np.array(r.v)) for i, r in enumerate(tuned)], k, recall))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The group of each vector."""
        groups = told.value[1]
        for batch in batches:
            where = [groups[c] for c in batch.column(0).to_pylist()]
            group = [g + (h % m if m > 1 else 0) for (g, m), h in zip(where, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), batch.column(0), batch.column(2), batch.column(3)], names=["grp", "cell", "vec_id", "v"])

    def probe_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The groups that each query meets, and its cells there."""
        (one, two), (counts, groups) = shared.value, told.value
        for batch in batches:
            v = _vectors(batch.column(1))
            rows, names, cells = [], [], []
            if len(v):
                d1, d2 = distances(v[:, :half], one), distances(v[:, half:], two)
                for i in range(len(v)):
                    mine: dict[int, list[int]] = {}
                    for cell in traverse(d1[i], d2[i], counts, wish):
                        first, several = groups[cell]
                        for g in range(first, first + several):
                            mine.setdefault(g, []).append(cell)
                    for g, inside in mine.items():
                        rows.append(i)
                        names.append(g)
                        cells.append(sorted(inside))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(cells, pa.list_(pa.int64())), batch.column(0).take(take), batch.column(1).take(take)], names=["grp", "cells", "vec_id", "v"]
            )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = max(1, min(-(-mine.count() // TOGETHER), 16 * parts))
    probes = stage(mine.repartition(spread).mapInArrow(probe_queries, "grp long, cells array<long>, vec_id long, v array<double>"), "probes")
    slices = probes.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("slices"))
    held = index.select("cell", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).alias("h"), "vec_id", "v").mapInArrow(place, "grp long, cell long, vec_id long, v array<double>")
    held = held.join(slices.hint("merge"), "grp").select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("head"), "vec_id", F.array("cell").alias("cells"), "v"
    )
    asked = probes.join(slices.hint("merge"), "grp").select(
        "grp", F.pmod(F.xxhash64("vec_id"), "slices").alias("slice"), F.lit(1).alias("head"), "vec_id", "cells", "v"
    )
    met = (
        held.union(asked)
        .repartition(parts, "grp", "slice")
        .sortWithinPartitions("grp", "slice", "head", "vec_id")
        .mapInArrow(_rank(k), schema)
    )
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rank(k: int):
    """The k nearest of each query among its cells' vectors in one group; one group's are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, block = None, [], None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            heads, names, v = batch.column(2).to_pylist(), batch.column(3).to_pylist(), _vectors(batch.column(5))
            offsets, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy()
            out = []
            for i, key in enumerate(keys):
                if key != group:
                    group, held, block = key, [], None
                cells = flat[offsets[i] : offsets[i + 1]]
                if heads[i] == 0:
                    held.append((names[i], cells[0], v[i].copy()))
                    continue
                if not held:
                    continue
                if block is None:
                    block = tuple(np.array(c) for c in zip(*held, strict=True))
                ids, where, rows = block
                at = np.searchsorted(cells, where)
                at[at == len(cells)] = 0
                met = np.flatnonzero((cells[at] == where) & (ids != names[i]))
                score = np.sqrt(((rows[met] - v[i]) ** 2).sum(axis=1))
                top = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1]) if len(score) > k else np.arange(len(score))
                order = top[np.lexsort((ids[met[top]], score[top]))][:k]
                out += [(names[i], int(ids[met[j]]), float(score[j])) for j in order]
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run
