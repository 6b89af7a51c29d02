"""Hashes of words and shingles."""

import random
from itertools import product

import numpy as np
from test_operators import docs

from streamloom.llm import hashing, minhash


def hashes(text):
    return hashing.word_hashes(np.frombuffer(text.encode(), np.uint8))


def test_orders_of_words_differ():
    w = hashes("the and of to a in")
    every = np.concatenate([hashing.shingle_set(w[list(t)], 4) for t in product(range(6), repeat=4)])
    assert len(set(every.tolist())) == 6**4
    assert len(hashing.shingle_set(hashes("the and and the x and the the and"), 4)) == 6


def test_x_y_y_x(spark):
    texts = ["x y y x", "y x x y", "x y y x", "p q q p a q p p q", "q p p q a p q q p"]
    rows = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts), words=4).collect()}
    assert [rows[i].n_shingles for i in range(5)] == [1, 1, 1, 6, 6]
    assert [rows[i].component_id for i in range(5)] == [0, 1, 0, 3, 4]


def test_long_words(monkeypatch):
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choice("abc") for _ in range(rnd.choice([1, 3, 70, 64, 128, 500]))) for _ in range(60)) + "  " + "z" * 300
    want = np.concatenate([hashes(w) for w in text.split()])
    monkeypatch.setattr(hashing, "SEGMENT", 64)
    for t in (text, " " * 200 + text, text + " " * 130):
        assert hashes(t).tolist() == want.tolist()
