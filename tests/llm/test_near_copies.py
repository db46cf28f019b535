"""The pipeline's near-dedup against brute-force Jaccard."""

import random

import pytest

from pixelmill.llm import near_copies

SCHEMA = "doc_id long, text string, n int, node string"


def brute(rows, size=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if root[a] != root[b] and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    best = {}
    for (i, t), r in zip(rows, root, strict=True):
        best[r] = min(best.get(r, (1 << 63, None)), (i, t or ""))
    return sorted(best.values())


def kept(spark, rows):
    out = near_copies.one_of_each(spark.createDataFrame([(i, t, 7, "own") for i, t in rows], SCHEMA))
    assert out.columns == ["doc_id", "text", "n", "node"]
    got = out.collect()
    assert all((r.n, r.node) == (7, "own") for r in got)
    return sorted((r.doc_id, r.text or "") for r in got)


def changed(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("known", [4096, 0])
def test_no_link_is_lost(spark, monkeypatch, known):
    monkeypatch.setattr(near_copies, "SAMPLE", known)
    rng = random.Random(4)
    bases = [[f"w{rng.randrange(3000)}" for _ in range(n)] for n in (1, 3, 5, 6, 9, 12, 40, 60, 60, 100, 300, 900)]
    texts = [changed(rng, b, rng.randint(0, 1 + len(b) // 30)) for b in bases for _ in range(12)]
    texts += [changed(rng, bases[7], rng.randint(0, 3)) for _ in range(60)]  # one large group
    texts += [" ".join(bases[8][: rng.randint(40, 60)]) for _ in range(20)]
    texts += [" ".join([*(f"line{k}" for k in range(20)), *(f"u{rng.random()}" for _ in range(rng.randint(2, 30)))]) for _ in range(40)]  # one common line
    texts += [None, "", " \n", texts[3].upper(), texts[100].replace(" ", "  ")]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert kept(spark, rows) == brute(rows)


def test_near_copies_beyond_two_bits_leave_one(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = [(5, changed(rng, base, 3)), (3, " ".join(base)), (9, "other words altogether in this text"), (3, "one more text under a used id")]
    assert kept(spark, rows) == sorted([rows[1], rows[2], rows[3]])
    assert near_copies.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0
