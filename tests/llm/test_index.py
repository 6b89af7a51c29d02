"""The multi-index: how much of it a query visits, and exact answers."""

import numpy as np

from streamloom.llm import ann

SCHEMA = "vec_id long, embedding array<double>"


def nearest(x, q, k=10):
    score = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    score[q] = np.inf
    return np.lexsort((np.arange(len(x)), score))[:k]


def searched(spark, x, monkeypatch, step):
    wishes, plain = [], ann.enough
    monkeypatch.setattr(ann, "enough", lambda *a: wishes.append(plain(*a)) or wishes[-1])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = ann.search(table, table.where(f"vec_id % {step} = 0")).collect()
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & set(nearest(x, q).tolist())) for q in range(0, len(x), step))
    return hits / len(got), wishes[0]


def test_clustered_vectors_need_few(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for n in (1500, 6000):
        centres = rng.standard_normal((n // 50, 16)) * 4
        x = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, 16)) * 0.3
        recall, wish = searched(spark, x, monkeypatch, 30)
        assert recall >= 0.9 and wish < 400, (n, recall, wish)


def test_loose_vectors_need_a_share(spark, monkeypatch):
    x = np.random.default_rng(6).standard_normal((3000, 8))
    recall, wish = searched(spark, x, monkeypatch, 50)
    assert recall >= 0.9 and 10 < wish < 1500, (recall, wish)


def test_queries_with_several_vectors(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (1, [5.0, 0.0]), (2, [1.0, 1.0]), (3, [5.0, 1.0]), (4, [0.0, 0.0])], SCHEMA)
    got = ann.search(table, table.where("vec_id = 1"), k=2).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 2, 1.0), (2, 3, 17**0.5)]
    assert ann.search(table, table.where("vec_id = 4")).count() == 0
    other = spark.createDataFrame([(9, [5.0, 1.5]), (10, [1.0]), (None, [1.0, 1.0])], SCHEMA)
    assert [(r.query_id, r.vec_id) for r in ann.search(table, other, k=1).collect()] == [(9, 3)]
