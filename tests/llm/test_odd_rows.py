"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for the operators that other tests don't cover there."""

import pytest
from pyspark.sql import functions as F
from test_operators import docs

from streamloom.llm import language, mixing, pieces, pii, simhash, tokens
from streamloom.llm.queries import BYTE_BPE, PIECES

ODD = [None, "", " \t\n", "a", "a", "x" * 70_000, "word " * 30_000, "é日😀" * 50]


def odd(spark, names=()):
    table = docs(spark, ODD, ids=[1, None, None, 2, 2, 3, 4, 4])
    for n in names:
        table = table.withColumn(n, F.lit("other"))
    return table


def test_tokens(spark):
    rows = tokens.count_tokens(odd(spark, ("n_tokens", "n_bytes", "over_limit")), BYTE_BPE).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_bytes) for r in rows if r.doc_id) == [(False, 1, 0), (False, 2, 1), (False, 2, 1), (False, 3, 70_000), (False, 4, 450), (False, 4, 150_000)]
    assert [r.n_tokens for r in rows if r.doc_id == 2] == [1, 1] and [r.n_tokens for r in rows if r.doc_id == 1] == [0]
    assert tokens.count_tokens(odd(spark).limit(0), BYTE_BPE).count() == 0
    counter = tokens.Counter(*tokens.load(BYTE_BPE))
    counter.count("x" * 5000 + " " + "qz" * 20)
    assert all(len(k) <= tokens.REMEMBERED_CHARS for k in list(counter)[counter.base :])


def test_pieces(spark):
    rows = pieces.encode(odd(spark, ("pieces", "restored")), PIECES).collect()
    assert len(rows) == len(ODD) and all(r.restored for r in rows) and sorted(r.n_pieces for r in rows)[:2] == [0, 0]
    assert pieces.encode(odd(spark).limit(0), PIECES).count() == 0
    encoder = pieces.Encoder(pieces.load(PIECES))
    encoder.encode(["y" * 900 + " word"])
    assert all(len(k) <= pieces.REMEMBERED_CHARS for k in encoder.known)


def test_personal_data(spark):
    rows = pii.find_personal_data(odd(spark, ("spans", "n_email"))).collect()
    assert len(rows) == len(ODD) and all(r.spans == "" and r.n_spans == 0 for r in rows)
    assert pii.find_personal_data(odd(spark).limit(0)).count() == 0


def test_language(spark, monkeypatch):
    rows = language.identify(odd(spark, ("lang_pred", "score")).withColumn("lang", F.lit("zz")), F.col("doc_id").isNotNull()).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows} == {"und", "zz"} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language.fit(docs(spark, ["a", "b"], langs=["x", "y"]))


def test_mixing_and_fingerprints(spark):
    mixed = mixing.mix(odd(spark, ("_size", "copies")).withColumn("source", F.when(F.col("doc_id") > 2, "s")))
    assert mixed.columns[-2:] == ["_size", "copies"] and {(r._size, r.copies) for r in mixed.collect()} == {("other", "other")}
    rows = simhash.edited_fingerprints(odd(spark, ("fp", "k"))).collect()
    assert len(rows) == len(ODD) and sum(r.n_chars for r in rows) == sum(len(t or "") for t in ODD)


def test_clashing_names_in_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    names = ("lang_pred", "Score", "languages", "_id", "_rows", "_zero", "_size", "_m", "_own0_x")
    table = odd(spark, names).withColumn("lang", F.lit("zz"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, table, str(tmp_path))
        assert got.columns == table.columns, name
        rows = got.collect()
        assert rows and all(r[n] == "other" for r in rows for n in names), name
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).count() == len(ODD)
