"""Operators against brute force, and odd inputs: nulls, empty texts, repeats, empty tables, clashing names."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from streamloom.llm import ann, language, minhash, mixing, pieces, pii, simhash, tokens, toolcalls, warc
from streamloom.llm.components import connected_components
from streamloom.llm.queries import BYTE_BPE, PIECES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, u int, rep string, k int"


def docs(spark, texts, langs=None, sources=None, ids=None):
    n = len(texts)
    langs, sources, ids = langs or [None] * n, sources or [None] * n, ids or list(range(n))
    return spark.createDataFrame([(i, t, l, s, len(t or ""), 0, "x", 1) for i, t, l, s in zip(ids, texts, langs, sources, strict=True)], SCHEMA)


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5))) for _ in range(n))


def corpus():
    rnd = random.Random(3)
    out = [None, "", "  \n", "one", "one", "two words", "Two WORDS"]
    for _ in range(12):
        base = words(rnd, 60).split()
        for edits in (0, 0, 1, 2, 3, 5):
            new = list(base)
            for _ in range(edits):
                new[rnd.randrange(len(new))] = words(rnd, 1)
            out.append(" ".join(new))
    return out


def test_near_duplicates(spark):
    texts = corpus()

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for _ in root:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, texts), words=4).collect()}
    assert got == {i: (len(s), root[i], root[i] == i) for i, s in enumerate(sets)}
    assert minhash.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 31)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 30: 30, 31: 30}


def test_language(spark):
    rnd = random.Random(1)
    make = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(n))
    texts = [make("abcde", 40) for _ in range(20)] + [make("vwxyz", 40) for _ in range(20)]
    texts += [make("abcde", 60) + " " + make("vwxyz", 30), "12 !", "", None, make("vwxyz", 3)]
    langs = ["aa"] * 20 + ["zz"] * 20 + [None] * 5
    rows = language.identify(docs(spark, texts, langs), F.lit(True)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == ["aa"] * 20 + ["zz"] * 20 + ["aa", "und", "und", "und", "zz"]
    mixed = dict(x.split(":") for x in rows[40].languages.split(","))
    assert abs(float(mixed["aa"]) - 2 / 3) < 0.05 and abs(rows[40].score - 2 / 3) < 0.05 and rows[41].score == 0
    none = language.identify(docs(spark, texts, langs), F.lit(False))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language.identify(docs(spark, texts).limit(0), F.lit(True)).count() == 0


def test_token_counts(spark):
    path = BYTE_BPE
    library = Tokenizer.from_file(path)
    rnd = random.Random(5)
    alphabet = [*"ab 's\t\n\x1c\x85\xa0é日😀1Ⅷ$_", "<|endoftext|>", "'ll", "  "]
    texts = [None, "", "x" * 5000, words(rnd, 3000)] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 20))) for _ in range(500)]
    got = {r.doc_id: r for r in tokens.count_tokens(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512)


def test_pieces(spark):
    path = PIECES
    model = pieces.load(path)
    score = {t: model.score[i] for i, t in enumerate(model.text) if i > 258}

    def best(text):
        raw = "▁" + text.replace(" ", "▁")
        sums = [0.0]
        for j in range(1, len(raw) + 1):
            sums.append(max(sums[a] + score.get(raw[a:j], model.unknown_score if j - a == 1 else -math.inf) for a in range(max(0, j - 16), j)))
        return sums[-1]

    rnd = random.Random(6)
    texts = [None, "", " ", "a  b", "日本 \n😀\x00", words(rnd, 50)] + ["".join(rnd.choice("the and of\n  é😀日") for _ in range(20)) for _ in range(60)]
    for r in pieces.decode(pieces.encode(docs(spark, texts), path, keep=("rep",)), path).collect():
        t = texts[r.doc_id] or ""
        assert r.restored and r.text == t and r.n_pieces == len(r.pieces) and r.rep == "x"
        unknown = sum(1 for c in t if c not in score and c != " ")
        known = sum(model.score[i] for i in r.pieces if i > 258)
        assert not t or abs(known + unknown * model.unknown_score - best(t)) < 1e-3


def test_personal_data(spark):
    base = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    }

    def good(kind, s):
        d = re.sub(r"[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    rnd = random.Random(8)
    bits = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "+1", " ", ".", "9", "é", "-", "a@b.c@d.e", "..@-.-"]
    texts = [None, "", "0" * 6000 + ".1.1.1"] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    for t in texts:
        want = [(k, m.start(), m.end()) for k, p in base.items() for m in re.finditer(p, t or "") if good(k, m.group())] if len(t or "") < 5000 else None
        if want is not None:
            assert pii.base_spans(t or "") == want
    x, y = pii.labelled_windows(100, 12345)
    weights = pii.train()
    found = pii._viterbi(pii._forward(weights, x, False)[0], weights["T"])
    assert (found == y).mean() > 0.95
    rows = {r.doc_id: r for r in pii.find_personal_data(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert rows[i].base_spans == pii._written(pii.base_spans(t or "")) and set(filter(None, rows[i].base_spans.split(","))) <= set(rows[i].spans.split(","))
    clean = pii.redact(docs(spark, ["mail a.b@c.de now", None, ""])).orderBy("doc_id").collect()
    assert [r.text for r in clean] == ["mail [EMAIL] now", None, ""] and clean[0].n_chars == 16


def test_mixing(spark):
    rnd = random.Random(9)
    sources = [rnd.choice(["a", "b", "c", "d", None]) for _ in range(900)]
    texts = [None if i % 97 == 0 else words(rnd, rnd.randint(0, 30)) for i in range(900)]
    table = docs(spark, texts, sources=sources)
    size = [len((t or "").split()) for t in texts]
    sized = table.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rows = mixing.copies(sized).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.copies(sized).collect()))
    assert {r.doc_id: r["size"] for r in rows} == dict(enumerate(size))
    order = sorted({s for s in sources if s}) + [None]
    totals = {s: sum(n for n, x in zip(size, sources, strict=True) if x == s) for s in order}
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, left = {}, list(order), float(sum(size))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * totals[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * totals[s]
            left -= target[s]
            free.remove(s)
    for s in order:
        mine = [r for r in rows if r.source == s]
        assert abs(mine[0].target - target[s]) < 1e-6 * target[s] and mine[0].source_size == totals[s]
        assert abs(sum(r.copies * r["size"] for r in mine) / target[s] - 1) < 0.01
        assert all(abs(r.copies - target[s] / totals[s]) < 1 and r.copies <= 3 for r in mine)
    tree = mixing.copies(sized, share=1.0).collect()  # no document is outsized: the tree keeps the number of copies, but for the last residuals
    for s in order:
        mine = [r for r in tree if r.source == s]
        classes = len({int(2 * math.log2(r["size"] + 1)) for r in mine})
        assert abs(sum(r.copies for r in mine) - len(mine) * target[s] / totals[s]) <= classes
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns and mixed.count() == sum(r.copies for r in rows)
    same = docs(spark, ["a b"] * 6, sources=["s"] * 6, ids=[1] * 6)
    assert mixing.mix(same).count() == 6 and mixing.mix(same.limit(0)).count() == 0


def test_fingerprints(spark):
    rnd = random.Random(10)
    texts = [words(rnd, rnd.randint(0, 80)) for _ in range(60)] + [None, "", "a b", "a b", "日本語 text é"]
    ids = [None, *range(10, 10 * len(texts), 10)]
    rows = simhash.edited_fingerprints(docs(spark, texts, ids=ids), every=20).collect()
    assert len(rows) == len(texts)
    plain = [t or "" for t in texts]
    for r in rows:
        i = ids.index(r.doc_id)
        t, after = plain[i], plain[(i + 1) % len(plain)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {r.doc_id: r for r in rows}
    assert by[ids[-3]].fingerprint == by[ids[-2]].fingerprint and by[ids[-5]].fingerprint == "0" * 16
    fps = [rnd.getrandbits(64) for _ in range(30)]
    fps += [f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for f in fps] + [fps[0] ^ 0b11111]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {(r.query_fp, r.fp) for r in simhash.within_radius(table, table, 3).collect()}
    assert got == {(a, b) for a, x in zip(signed, fps, strict=True) for b, y in zip(signed, fps, strict=True) if (x ^ y).bit_count() <= 3}
    repeated = docs(spark, ["a b c", "a b c", "d"], ids=[1, 1, 2])
    assert simhash.edited_fingerprints(repeated).count() == 3 and simhash.edited_fingerprints(repeated.limit(0)).count() == 0


def test_archives(spark, monkeypatch):
    long = "long é " * 90_000
    html = ["<p>a</p>", "<p>a</p>", None, "", long, "<p>b</p>", long]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h, "x") for i, h in enumerate(html)] + [(None, None, "<p>c</p>", "y")], "page_id long, url string, html string, chunk string")
    chunks = warc.write_records(pages)
    assert chunks.where("record = '<urn:page:4>'").count() == 3
    raw = b"".join(bytes(r.bytes) for r in chunks.where("record = '<urn:page:4>'").orderBy("chunk").collect())
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(long.encode() + b"\r\n\r\n")
    rows = {r.page_id: r for r in warc.read_records(chunks).collect()}
    for i, h in enumerate(html):
        first = next(j for j, x in enumerate(html) if (x or "") == (h or ""))
        body = (h or "").encode()
        assert (rows[i].payload_bytes, rows[i].payload_digest) == (len(body), warc.base32_digest(hashlib.sha1(body).digest()))
        assert (rows[i].record_type, rows[i].refers_to) == (("response", None) if first == i else ("revisit", first))
    assert rows[None].record_type == "response"
    broken = chunks.withColumn("bytes", F.when(F.col("record") == "<urn:page:5>", F.encode(F.replace(F.decode("bytes", "utf-8"), F.lit("<p>b"), F.lit("<p>z")), "utf-8")).otherwise(F.col("bytes")))
    with pytest.raises(Exception, match="digest"):
        warc.read_records(broken).collect()
    assert warc.read_records(warc.write_records(pages.limit(0))).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 16))
    x[100:400] = x[100]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(2000, None, "x"), (2001, [0.0] * 16, "x"), (2002, [float("nan")] * 16, "x"), (2003, [1.0], "x"), (None, [1.0] * 16, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string")
    got = ann.search(table, table.where("vec_id % 100 = 0"), centroids=16).collect()
    hits = 0
    for q in range(0, 900, 100):
        score = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        score[q] = np.inf
        want = np.lexsort((np.arange(900), score))[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(r.score == score[r.vec_id] for r in mine)
        hits += len({r.vec_id for r in mine} & set(want.tolist()))
    assert hits >= 81 and len(got) == 90
    few = table.where("vec_id in (0, 1, 2)")
    assert ann.search(few, few).count() == 6 and ann.search(few.limit(0), few).count() == 0


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, 1, "a", "f", '{"y": "é\\"", "x": 1}', None), (1, 2, "b", "f", '{"x": 2}', ["a", "gone"]), (1, 3, "c", "f", '{"x": "2"}', ["b"]),
            (1, 4, "d", "f", "[1]", None), (1, 5, "e", "g", "{}", None), (1, 6, "h", "f", '{"y": "z"}', None), (1, 7, "i", "f", '{"x": 1, "q": 0}', None),
            (2, 1, "a", "f", '{"x": 1}', ["b"]), (2, 2, "b", "f", '{"x": 1}', ["a"]), (3, 1, None, "f", '{"x": 1}', None), (4, 1, "a", "f", None, None),
        ],
        "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, 3, "a", "done"), (1, 9, "zz", None)], "conv_id long, turn long, call_id string, content string")
    schemas = spark.createDataFrame([("f", "x", "integer", True), ("f", "y", "string", False)], "name string, field string, kind string, required boolean")
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link(calls, results, schemas).collect()}
    status = {k: r.status for k, r in got.items()}
    assert status == {
        (1, "a"): "ok", (1, "b"): "no_result", (1, "c"): "wrong_kind", (1, "d"): "bad_json", (1, "e"): "no_schema", (1, "h"): "missing_field", (1, "i"): "unknown_field",
        (1, "zz"): "no_call", (2, "a"): "cycle", (2, "b"): "cycle", (3, None): "no_id", (4, "a"): "bad_json",
    }
    assert [got[1, c].level for c in "abc"] == [0, 1, 2]
    assert got[1, "a"].record == '{"arguments":{"x":1,"y":"é\\""},"content":"done","id":"a","name":"f","status":"ok"}'
    assert toolcalls.link(calls.limit(0), results.limit(0), schemas.limit(0)).count() == 0


def test_call_levels(spark):
    rnd = random.Random(11)
    rows = [(1, f"c{i}", [f"c{i - 1}"] if i else None) for i in range(70)]
    for conv in range(2, 14):
        for i in range(12):
            pool = range(i) if conv % 3 else range(12)
            rows.append((conv, f"c{i}", [f"c{rnd.choice(pool)}" for _ in range(rnd.choice([0, 1, 1, 2, 3]))] if pool else None))
    rows += [(None, "a", None), (20, None, ["a"]), (21, "a", ["a"]), (21, "b", ["a"]), (22, "a", [None, "gone"])]
    deps = {(c, i): {d for d in need or () if (c, d) in {r[:2] for r in rows}} for c, i, need in rows if c is not None and i is not None}
    want = {}
    while True:
        fresh = {k: 1 + max((want[k[0], d] for d in need), default=-1) for k, need in deps.items() if k not in want and all((k[0], d) in want for d in need)}
        if not fresh:
            break
        want |= fresh
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>")
    got = [tuple(r) for r in toolcalls.levels(calls).collect()]
    assert len(got) == len(want) and {(c, i): n for c, i, n in got} == want and max(want.values()) == 69
