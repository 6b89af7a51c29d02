"""Languages of documents as mixtures, by expectation-maximisation over letter trigrams.

Each learned language gives every trigram (hashed to 2**16 slots) a smoothed likelihood. A
document's language proportions are those that make its trigrams most likely; the set of its
languages is the one with the best likelihood less 0.5 * ln(trigrams) for each language, sought
among the single languages and, for every m from 2 on, the set of the m languages with the largest
proportions. Expectation-maximisation goes on until the likelihood is within TOLERANCE of the best
one, which its own gradient bounds; the same bound tells which documents need no larger sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from streamloom.session import ready

SLOTS = 1 << 16
#: Rounds of expectation-maximisation between two looks at the bound, and at most.
ROUNDS, MOST_ROUNDS = 8, 400
#: Log likelihood by which the proportions of sets that are compared may fall short.
TOLERANCE = 0.01
SMOOTHING = 0.1
#: Code points of text in one block of documents.
BLOCK = 1 << 19
#: Documents of each language that the model is fitted on, about: those of the smallest id hashes.
FIT_DOCS = 2000
#: Languages that a model may have: its table, 2**18 bytes a language, goes to every executor.
MOST_LANGUAGES = 1024

_letter: np.ndarray | None = None


def _letters(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
    out = _letter[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        out[high] = [chr(c).isalpha() for c in codes[high]]
    return out


def trigrams(text: str) -> np.ndarray:
    """Slots of the trigrams of a text's lower-cased words, a space before and after each word."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters(codes)
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    line = np.where(letter, codes, 32)[keep]
    line = np.concatenate([[32], line, [32] if letter[-1] else []]).astype(np.uint64)
    h = line[:-2] * np.uint64(0x9E3779B97F4A7C15) + line[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + line[2:] * np.uint64(0x165667B19E3779F9)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, slot, n) of a partition."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text and len(slots := trigrams(text)):
                totals.setdefault(lang, np.zeros(SLOTS, np.int64))
                np.add.at(totals[lang], slots, 1)
    for lang, total in totals.items():
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots), pa.array(total[slots])], names=["lang", "slot", "n"])


def fit(rows: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, likelihoods by slot and language) from rows (doc_id, text, lang).

    Fitted on about fit_docs rows of each language, those whose id hashes are smallest; rows with
    null ids, texts or languages are left out, and nothing is learned from an empty table. Sent to the driver are at most 2**16 counts for
    each language; more than MOST_LANGUAGES raise.
    """
    rows = rows.where("doc_id is not null and text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.empty((SLOTS, 0), np.float32)
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{len(sizes)} languages to learn, {MOST_LANGUAGES} at most")
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, fit_docs / n))])
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    found = picked.select("lang", "text").mapInArrow(_counts, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    table = np.full((SLOTS, len(langs)), SMOOTHING, np.float64)
    for k, lang in enumerate(langs):
        mine = found[found["lang"] == lang]
        table[mine["slot"].to_numpy(), k] += mine["n"].to_numpy()
    return langs, (table / table.sum(axis=0)).astype(np.float32)


def mixtures(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(proportions, chosen set, trigrams) of each text, over the columns of table.

    Proportions are zero outside the chosen set and sum to one; both are all zero for texts with
    no letter.
    """
    k = table.shape[1]
    proportions, chosen, totals = np.zeros((len(texts), k)), np.zeros((len(texts), k), bool), np.zeros(len(texts), np.int64)
    slots = [trigrams(t) if t else np.empty(0, np.int64) for t in texts]
    totals[:] = [len(s) for s in slots]
    docs = np.flatnonzero(totals)
    if not len(docs) or not k:
        return proportions, chosen, totals
    flat = np.concatenate([slots[d] for d in docs]) | np.repeat(np.arange(len(docs)) << 16, totals[docs])
    keys, counts = np.unique(flat, return_counts=True)
    owner, like = keys >> 16, table[keys & (SLOTS - 1)]
    counts = counts.astype(np.float32)
    starts = np.searchsorted(owner, np.arange(len(docs)))
    n = totals[docs].astype(np.float32)

    def climb(like, counts, owner, starts, n, mask, pi):
        """(proportions, log likelihood, bound on the best log likelihood) after ROUNDS rounds from pi."""
        for _ in range(ROUNDS):
            w = like * pi[owner]
            s = w.sum(axis=1)
            w *= (counts / s)[:, None]
            pi = np.add.reduceat(w, starts) / n[:, None]
        s = np.maximum((like * pi[owner]).sum(axis=1), 1e-30)
        value = np.add.reduceat(counts * np.log(s), starts)
        slope = np.add.reduceat(like * (counts / s)[:, None], starts)  # the likelihood is concave: this bounds what is left to gain
        return pi, value, value + np.maximum((slope * mask).max(axis=1) - n, 0)

    def settle(which, mask):
        """climb of the documents `which`, gone on with for those that are not within TOLERANCE."""
        pi, value, most = mask / mask.sum(axis=1, keepdims=True), np.zeros(len(which)), np.zeros(len(which))
        left = np.arange(len(which))
        for _ in range(MOST_ROUNDS // ROUNDS):
            rows = np.isin(owner, which[left])
            mine = np.searchsorted(which[left], owner[rows])
            pi[left], value[left], most[left] = climb(exact[rows], counts[rows], mine, np.searchsorted(mine, np.arange(len(left))), n[which[left]], mask[left], pi[left])
            left = left[most[left] - value[left] > TOLERANCE]
            if not len(left):
                break
        return pi, value

    every = np.ones((len(docs), k), np.float32)
    _, _, best_full = climb(like, counts, owner, starts, n, every, every / k)
    alone = np.add.reduceat(counts[:, None] * np.log(like), starts)
    price = 0.5 * np.log(np.maximum(n, 2))
    one = alone.max(axis=1)
    worth = (one - price).astype(np.float64)
    result = np.eye(k)[alone.argmax(axis=1)]
    kept = result > 0
    # A larger set costs at least one price more and gains at most what all languages gain.
    open_docs = np.flatnonzero(best_full - one > price)
    if len(open_docs):
        exact, counts, n = like.astype(np.float64), counts.astype(np.float64), n.astype(np.float64)
        full, best = settle(open_docs, np.ones((len(open_docs), k)))
        ranks, most = np.full((len(docs), k), k), np.zeros(len(docs))
        ranks[open_docs] = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
        most[open_docs] = best + TOLERANCE
    for m in range(2, k + 1):
        open_docs = open_docs[most[open_docs] - m * price[open_docs] > worth[open_docs]] if len(open_docs) else open_docs
        if not len(open_docs):
            break
        mask = (ranks[open_docs] < m).astype(np.float64)
        pi, value = settle(open_docs, mask)
        value = value - m * price[open_docs]
        better = value > worth[open_docs]
        up = open_docs[better]
        worth[up], result[up], kept[up] = value[better], pi[better], mask[better] > 0
    proportions[docs] = result
    chosen[docs] = kept
    return proportions, chosen, totals


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= BLOCK:
            yield part
            part, n = [], 0
    if part:
        yield part


def identify(docs: DataFrame, train: Column, fit_docs: int = FIT_DOCS) -> DataFrame:
    """docs with lang_pred (string), score (double) and languages (string) added.

    train tells which rows may be learned from; their lang is read only there. lang_pred is the
    language of the largest proportion in the chosen set (ties: the first by name), score that
    proportion, and languages lists the set with proportions, largest first. Null texts, texts without a letter,
    and all texts if nothing can be learned, are "und" with score 0. All columns and rows of docs
    stay, among them repeated rows; columns named lang_pred, score or languages are replaced.
    """
    spark = ready(docs.sparkSession)
    langs, table = fit(docs.where(train).select("doc_id", "text", "lang"), fit_docs)
    shared = spark.sparkContext.broadcast(table)
    docs = docs.drop("lang_pred", "score", "languages")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likelihoods = shared.value
        for batch in batches:
            preds, scores, sets = [], [], []
            for part in _blocks([t or "" for t in batch.column(at).to_pylist()]):
                proportions, chosen, totals = mixtures(part, likelihoods)
                for p, c, n in zip(proportions, chosen, totals, strict=True):
                    if not n or not langs:
                        preds.append("und"), scores.append(0.0), sets.append("")
                        continue
                    top = int(p.argmax())
                    order = sorted(np.flatnonzero(c), key=lambda i: (-p[i], i))
                    preds.append(langs[top]), scores.append(min(1.0, float(p[top])))
                    sets.append(",".join(f"{langs[i]}:{p[i]:.3f}" for i in order))
            more = [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "lang_pred", "score", "languages"])

    out = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("languages", StringType())])
    return docs.mapInArrow(run, out)
