"""Words that a mix takes, where single documents hold large shares of their source."""

import random

from streamloom.llm import mixing

SCHEMA = "doc_id long, source string, size long"


def misses(rows):
    """Source to (relative miss of its target, smallest size)."""
    out = {}
    for r in rows:
        t, got, least = out.get(r.source, (r.target, 0, r["size"]))
        out[r.source] = (t, got + r.copies * r["size"], min(least, r["size"]))
    return {s: (abs(got - t) / t, least / t) for s, (t, got, least) in out.items() if t}


def test_a_fifth_in_one_document(spark):
    rnd = random.Random(2)
    rows, i = [], 0
    for source, n in (("a", 40), ("b", 400), ("c", 3000), ("d", 60), ("e", 1)):
        sizes = [rnd.randint(5, 2000) for _ in range(n)]
        if source != "e":
            sizes.append(sum(sizes) // 4)
        for size in sizes:
            rows.append((i, source, size))
            i += 1
    df = spark.createDataFrame(rows, SCHEMA)
    seen = set()
    for seed in (1, 2, 3):
        taken = mixing.copies(df, seed=seed).collect()
        assert sorted((r.doc_id, r.source, r["size"]) for r in taken) == sorted(rows)
        for source, (miss, least) in misses(taken).items():
            assert source == "e" or miss < 0.002 + least, (seed, source, miss)
        assert all(abs(r.copies - r.target / r.source_size) < 1 for r in taken)
        seen.add(tuple(sorted((r.doc_id, r.copies) for r in taken)))
    assert len(seen) == 3


def test_expected_copies(spark):
    """Over many seeds a document of the tree is taken as often as its rate says."""
    rows = [(i, "ab"[i % 2], 40 + i % 7) for i in range(1400)]
    df = spark.createDataFrame(rows, SCHEMA)
    sums, rate = {}, {}
    for seed in range(8):
        for r in mixing.copies(df, seed=seed).collect():
            sums[r.source, r["size"]] = sums.get((r.source, r["size"]), 0) + r.copies
            rate[r.source] = r.target / r.source_size
    for (source, _), n in sums.items():
        assert abs(n / (8 * 100) - rate[source]) < 0.1


def test_odd_rows(spark):
    rows = [(None, None, None), (None, None, 0), (1, "s", 10), (1, "s", 10), (2, "s", None), (3, "", 0)]
    got = mixing.copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.source, r["size"], r.occ) for r in got if r.doc_id) == [(1, "s", 10, 1), (1, "s", 10, 2), (2, "s", 0, 1), (3, "", 0, 1)]
    assert len(got) == 6 and sum(r.copies * r["size"] for r in got) == 20
    assert mixing.copies(spark.createDataFrame([], SCHEMA)).count() == 0
