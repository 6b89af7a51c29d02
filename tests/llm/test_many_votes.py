"""Fingerprints of very long texts and of rows repeated very often."""

from test_operators import docs

from streamloom.llm import simhash


def test_long_texts(spark):
    texts = ["a " * 5, "a " * 600_000, "b c " * 600_000, "b c b c b c"]
    rows = {r.doc_id: r for r in simhash.fingerprints(docs(spark, texts), ["doc_id"]).collect()}
    assert rows[1].n_terms == 599_996 and rows[1].fp == rows[0].fp
    assert rows[2].n_terms == 1_199_996 and rows[2].fp == rows[3].fp


def test_often_repeated_rows(spark):
    row = docs(spark, ["a b c d e"], ids=[1])
    many = row.crossJoin(spark.range(600_000).select()).unionByName(docs(spark, ["f g h i j"], ids=[2]))
    one = {r.doc_id: r.fp for r in simhash.fingerprints(docs(spark, ["a b c d e", "f g h i j"], ids=[1, 2]), ["doc_id"]).collect()}
    assert {r.doc_id: r.fp for r in simhash.fingerprints(many, ["doc_id"]).collect()} == one
    few = docs(spark, ["a b c d e"] * 1000 + ["f g h i j"] * 600, ids=[1] * 1000 + [2] * 600)
    got = simhash.edited_fingerprints(few).groupBy("doc_id", "fingerprint", "edited_sha256").count().collect()
    plain = {r.doc_id: r for r in simhash.edited_fingerprints(docs(spark, ["a b c d e", "f g h i j"], ids=[1, 2])).collect()}
    assert {(r.doc_id, r.fingerprint, r.edited_sha256, r["count"]) for r in got} == {(i, plain[i].fingerprint, plain[i].edited_sha256, n) for i, n in ((1, 1000), (2, 600))}
