"""A corpus pipeline of five stages over documents, each calling one operator.

Every stage takes an empty table to an empty one, keeps columns that it doesn't know, whatever their
names, and treats repeated rows and rows without an id as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm import language, minhash, mixing, pieces, pii
from streamloom.llm.names import set_aside
from streamloom.llm.queries import PIECES
from streamloom.session import stage, table

#: Documents whose best language has a smaller share than this are rejected.
LEAST_SHARE = 0.4


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a language that has at least LEAST_SHARE of them.

    Learned from all rows whose lang is not null. Null texts and texts without a letter go, and all
    go if no lang is known; repeated rows, and rows without an id, stay or go by their text.
    """
    docs, back = set_aside(docs, ("lang_pred", "score", "languages"))
    found = language.identify(docs, F.col("lang").isNotNull())
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*back)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, and all without an id.

    Of rows that agree in id and text one is kept, the least by its other columns; an id with
    several texts keeps each of them. Null and empty texts are duplicates of nothing.
    """
    docs, back = set_aside(docs, ("_id", "_rows", "_zero", "_other"))
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_rows"))
    kept = kept.select(F.col("doc_id").alias("_id"), "_rows")
    found = docs.join(kept.hint("shuffle_hash"), docs["doc_id"] == F.col("_id"))
    columns = [f"`{c}`" for c in docs.columns]
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    many = found.where("_rows > 1").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_zero"), *[F.col(f"`{c}`") for c in others])).alias("_other"))
    many = many.select("doc_id", "text", *[F.col("_other")[c].alias(c) for c in others]).select(*columns)
    return found.where("_rows = 1").select(*columns).union(many).union(docs.where("doc_id is null")).select(*back)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars counted anew; null texts stay null."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: up to three times, or not at all.

    A null source is a source like others. Texts without a word count nothing and are taken as often
    as their source's rate says.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document with its id, lang and source; null and empty texts have none."""
    return pieces.encode(docs, PIECES, keep=("lang", "source"))


STAGES = [
    ("language identification", identify),
    ("near-duplicate removal", deduplicate),
    ("personal data", redact),
    ("mixing", mix),
    ("pieces", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
