"""Near duplicates where one id has several texts."""

import random

from test_operators import docs, words

from streamloom.llm import minhash


def test_ids_of_several_texts(spark):
    rnd = random.Random(12)

    def near(text):
        new = text.split()
        new[30] = words(rnd, 1)
        return " ".join(new)

    a, b, c, d, e, f = (words(rnd, 80) for _ in range(6))
    # 2 copies 1 by one text, and its other text is near 3 and 4; 6 has two texts, 7 and 8 each near one; 9 is repeated.
    rows = [(1, a), (2, a), (2, b), (3, near(b)), (4, near(b)), (4, near(b)), (5, c), (6, d), (6, e), (7, near(d)), (8, near(e)), (9, f), (9, f), (10, near(f))]
    rows += [(11, c), (11, ""), (12, None), (12, "one"), (13, "one"), (None, a), (None, b)]
    ids, texts = (list(x) for x in zip(*rows, strict=True))

    sets = [(i, {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()) for i, w in ((i, (t or "").split()) for i, t in rows)]
    root = {i: i for i in ids if i is not None}
    for _ in rows:
        for i, x in sets:
            for j, y in sets:
                if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                    root[i] = root[j] = min(root[i], root[j])
    got = sorted(minhash.near_duplicates(docs(spark, texts, ids=ids), words=4).select("doc_id", "n_shingles", "component_id", "kept").collect(), key=str)
    want = sorted(((i, len(s), root.get(i), i is None or root[i] == i) for i, s in sets), key=str)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert root[2] == root[3] == root[4] == 1 and root[8] == root[7] == 6
