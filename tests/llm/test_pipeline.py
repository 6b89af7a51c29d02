"""The stages of the corpus pipeline, each against brute force, with documents without an id and repeated ones."""

import random
from collections import Counter

import corpus_pipeline
from streamloom.llm import mixing, pieces
from streamloom.llm.queries import PIECES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rnd, letters, n):
    return " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(n))


def corpus():
    """Rows of two made-up languages: lone, copied, repeated and without an id; and texts without letters."""
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        letters, lang = (("abcde", "aa"), ("vwxyz", "zz"))[i % 2]
        rows.append((i, sentence(rnd, letters, 40), lang, "st"[i % 3 == 0], 0))
    rows += [(100 + r[0], *r[1:]) for r in rows[:6]]  # exact copies of smaller ids
    rows += [rows[10]] * 3 + [rows[2]] + [rows[60]]  # repeated rows: kept, kept and dropped ids
    rows += [(11, sentence(rnd, "vwxyz", 40), "zz", "t", 0)]  # a second text of an id
    rows += [(None, rows[0][1], "aa", "s", 0), (None, sentence(rnd, "abcde", 40), "aa", None, 0)] * 2
    rows += [(None, "mail a.b@c.de " + sentence(rnd, "abcde", 40), "aa", "s", 0), (70, "12 !", None, "s", 0), (None, "", None, "s", 0)]
    return rows


def counts(df):
    return Counter(map(tuple, df.collect()))


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def alone(rows):
    """Rows left by brute force: one of each repeated row whose id is the least of its near duplicates, and all without an id."""
    known = sorted({r for r in rows if r[0] is not None})
    root = {r[0]: r[0] for r in known}
    sets = [(r[0], shingles(r[1])) for r in known]
    for _ in range(3):
        for i, a in sets:
            for j, b in sets:
                if i == j or (a and b and 100 * len(a & b) >= 80 * len(a | b)):
                    root[i] = root[j] = min(root[i], root[j])
    return Counter(r for r in known if root[r[0]] == r[0]) + Counter(r for r in rows if r[0] is None)


def test_stages(spark, tmp_path):
    rows = corpus()
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path)

    found = counts(stages["language identification"](spark, docs, path))
    assert found == Counter(r for r in rows if any(c.isalpha() for c in r[1]))

    left = stages["near-duplicate removal"](spark, docs, path)
    assert left.columns == docs.columns and counts(left) == alone(rows)
    other = spark.createDataFrame([(1, None, "bb", "s", 0), (1, None, "aa", "t", 0), (1, "", "aa", "s", 0), (None, None, None, None, None)], SCHEMA)
    assert counts(stages["near-duplicate removal"](spark, other, path)) == Counter([(1, None, "aa", "t", 0), (1, "", "aa", "s", 0), (None, None, None, None, None)])
    assert stages["near-duplicate removal"](spark, docs.limit(0), path).count() == 0

    clean = [(i, t.replace("a.b@c.de", "[EMAIL]"), l, s, len(t.replace("a.b@c.de", "[EMAIL]"))) for i, t, l, s, _ in rows]
    assert Counter((*r[:4], len(r[1])) for r in stages["personal data"](spark, docs, path).collect()) == Counter(clean)

    mixed = counts(stages["mixing"](spark, docs, path))
    sized = docs.select("doc_id", "source", mixing.word_count(docs.text).alias("size"))
    taken = mixing.copies(sized).collect()
    assert mixed.total() == sum(r.copies for r in taken) and set(mixed) <= set(rows)
    want = Counter()
    for r in taken:
        want[r.doc_id, r.source, r["size"]] += r.copies
    got = Counter()
    for r, n in mixed.items():
        got[r[0], r[3], len(r[1].split())] += n
    assert got == +want

    encoded = pieces.decode(stages["pieces"](spark, docs, path), PIECES)
    assert Counter((r.doc_id, r.text) for r in encoded.collect()) == Counter(r[:2] for r in rows)


def test_run(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    left = Counter(r[0] for r in alone(rows).elements() if any(c.isalpha() for c in r[1]))
    assert got[None] and set(got) <= set(left) and all(n <= 3 * left[i] for i, n in got.items())
