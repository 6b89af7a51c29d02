"""The network that finds personal data: gradients, path sums, windows, and held-out texts."""

import random
from itertools import product

import numpy as np
import pytest

from streamloom.llm import pii


@pytest.fixture(scope="module")
def weights():
    return pii.train()


def spans_of(tags):
    out, i = [], 0
    while i < len(tags):
        j = i + 1
        if tags[i]:
            while j < len(tags) and tags[j] == tags[i] + 1:
                j += 1
            out.append((pii.KINDS[(tags[i] - 1) // 2], i, j))
        i = j
    return out


def test_gradients():
    p = {k: v.astype(np.float64) for k, v in pii.train(1, 3).items()}
    x, y = pii.labelled_windows(4, 3)
    scores, kept = pii._forward(p, x, True)
    _, d_scores, d_trans = pii._crf(scores, p["T"], y)
    g = pii._backward(p, d_scores, kept) | {"T": d_trans}
    loss = lambda: pii._crf(pii._forward(p, x, False)[0], p["T"], y)[0]
    for name in p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        kept_value = p[name][at]
        p[name][at] = kept_value + 1e-2
        up = loss()
        p[name][at] = kept_value - 1e-2
        down = loss()
        p[name][at] = kept_value
        assert abs((up - down) / 2e-2 - g[name][at]) < 1e-3 * abs(g[name][at]) + 1e-4


def test_paths_by_brute_force(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(pii, "TAGS", 5)
    for trial in range(60):
        scores, trans = rng.standard_normal((4, 5, 6)), rng.standard_normal((5, 5))
        scores[:, 0] += trial % 4
        found = pii._found(scores, trans)
        searched = set(pii._worth_search(scores, trans).tolist())
        for w in range(6):
            value = {path: sum(scores[t, k, w] for t, k in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)) for path in product(range(5), repeat=4)}
            best = max(value, key=value.get)
            total = np.logaddexp.reduce(list(value.values()))
            assert any(best) <= (w in searched)
            assert any(best) == any(f[0] == w for f in found)
            for _, a, b, kind, log_p in (f for f in found if f[0] == w):
                inner = 2 * kind + 2
                assert best[a] in (inner - 1, inner) and all(k == inner for k in best[a + 1 : b + 1])
                same = [v for path, v in value.items() if path[a : b + 1] == best[a : b + 1] and (b == 3 or path[b + 1] != inner)]
                assert abs(np.logaddexp.reduce(same) - total - log_p) < 1e-8


def test_windows_cover_and_reconcile(weights):
    for n in (0, 1, 31, 32, 319, 320, 321, 592, 593, 5000):
        places = pii._windows(n)
        assert sorted({i for a, w in places for i in range(a, min(a + w, n))}) == list(range(n))
        assert all(b - a == pii.WINDOW - pii.OVERLAP for (a, _), (b, _) in zip(places, places[1:], strict=False))
    rnd = random.Random(1)
    mail = "ann.lee (at) post.example.org"
    for at in range(150, 420, 7):  # wherever windows cut it
        text = (("la ment qui " * 60)[: at - 1] + " " + mail + " " + "er en la " * 60)[: 700 + rnd.randint(0, 200)]
        assert [(k, text[a:b]) for k, a, b, p in pii.decoded_spans([text], weights)[0] if p > 0.5] == [("email", mail)], at


def test_held_out_texts(weights):
    """Precision and recall of spans on texts that the network was not trained on."""
    rnd = random.Random(987)
    planted = found = right = beyond = caught = 0
    for _ in range(150):
        text, tags = pii.labelled_text(rnd, 900, 0.12)
        want = set(spans_of(tags))
        ((mine, added),) = pii.all_spans([text], weights)
        fresh = {s for s in want if all(s[2] <= a or b <= s[1] for _, a, b in mine)}
        planted, found, right = planted + len(want), found + len(added), right + len(want & set(added))
        beyond, caught = beyond + len(fresh), caught + len(fresh & set(added))
    print("planted", planted, "beyond the patterns", beyond, "added", found, "right", right)
    assert right / found > 0.9 and caught / beyond > 0.75
    clean = [pii.labelled_text(rnd, 900, 0.0)[0] for _ in range(150)]
    extra = sum(len(added) for _, added in pii.all_spans(clean, weights))
    print("added to", sum(map(len, clean)), "code points without personal data:", extra)
    assert extra <= 5


def test_beyond_patterns(spark, weights):
    texts = [
        "Write to ann.lee [at] example [dot] org today.", "The host 10[.]0[.]3[.]77 was seen.", "Card 4539.1488.0343.6467 was used.", "Call (555) 123-4567 or 0049 30 1234567 now.",
        "Version 1.2.3 of 2024-01-15 cost 1,200,300 in 1999-2004 (see pp. 120-135).", None, "", "mail a.b@c.de now",
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    seen = {i: [(s.split(":")[0], texts[i][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in filter(None, rows[i].spans.split(","))] for i in rows}
    assert [seen[0], seen[1], seen[2]] == [[("email", "ann.lee [at] example [dot] org")], [("ip", "10[.]0[.]3[.]77")], [("card", "4539.1488.0343.6467")]]
    assert [k for k, _ in seen[3]] == ["phone", "phone"] and seen[4] == [] and rows[4].base_spans == ""
    assert seen[7] == [("email", "a.b@c.de")] and rows[7].n_spans == 1 and rows[5].spans == rows[6].spans == "" and rows[0].base_spans == ""
    assert pii.find_personal_data(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "Write to [EMAIL] today." and clean[4] == texts[4] and clean[5] is None
