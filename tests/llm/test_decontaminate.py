"""FM-index search and the contamination rule against brute force."""

import hashlib
import random
import re

import numpy as np

from pixelmill.llm.decontaminate import FMIndex, decontaminate, suffix_array

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, n_words string", "item_id long, text string, items string"


def brute(docs, items, window=13):
    windows = {}
    for name, text, *_ in items:
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add("null" if name is None else str(name))
    out = {}
    for name, text, *_ in docs:
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        hit, found = [False] * len(w), set()
        for p, owners in windows.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit[i : i + len(p)] = [True] * len(p)
                    found |= owners
        out[name] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    return out


def test_suffix_array_and_search():
    rng = np.random.default_rng(1)
    text = np.concatenate([[0], rng.integers(0, 4, 500), [1, 2, 3] * 30, [0]]).astype(np.int64)
    order = suffix_array(text)
    zeros = int((text == 0).sum())
    ranked = np.where(text == 0, np.cumsum(text == 0) - 1, text + zeros).tolist()
    assert order.tolist() == sorted(range(len(text)), key=lambda i: ranked[i:])
    index = FMIndex(text, 5)
    phrases = rng.integers(1, 5, (60, 4))
    sizes = rng.integers(1, 5, 60)
    low, high = index.search(phrases, sizes)
    for p, n, a, b in zip(phrases, sizes, low, high, strict=True):
        want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontaminate_is_exact(spark):
    rng = random.Random(4)
    vocabulary = [rng.choice(["The", "of", "Ähn", "x1", "né", "o'clock"]) + str(rng.randint(0, 12)) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(14, 40)), "x") for i in range(12)] + [(50, say(5), "x"), (51, "?!", "x"), (52, None, "x"), (None, say(13), "x"), (10, "The", "x")]
    items.append((53, items[0][1], "x"))
    docs = []
    for i in range(60):
        parts = [say(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").upper().split() if rng.random() < 0.3 else (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 13))
            parts.append(rng.choice([" ", ", ", "\n"]).join(w[a:]))
        docs.append((i, " -- ".join(parts), "y"))
    docs += [(100, None, "y"), (101, "", "y"), (102, " ".join([items[1][1]] * 400), "y"), (None, items[2][1], "y")]
    for size in (8 << 20, 300):
        found = decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_bytes=size).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found} == brute(docs, items)
    text = {d[0]: (d[1] or "").encode() for d in docs}
    for r in found:
        assert sum(len(WORD.findall(text[r.doc_id][s.first : s.end].lower())) for s in r.spans) == r.n_hit


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], ITEMS)
    assert [tuple(r)[:4] for r in decontaminate(docs, items).collect()] == [(1, 2, 0, 0)]
    assert decontaminate(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_long_words_are_compared_whole(spark):
    """Words that differ only in their middle, in blocks that a polynomial hash of the bytes can't tell apart, aren't each other."""
    bits = [0]
    while len(bits) < 2048:
        bits += [1 - b for b in bits]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    long = ["q" * 8 + x + "z" * 8 for x in (one, two)]
    items = [(1, long[0], "x"), (2, "é" * 30_000, "x")]
    docs = [(1, long[0], "y"), (2, long[1], "y"), (3, long[0].upper(), "y"), (4, "é" * 30_000, "y"), (5, "é" * 29_999, "y"), (6, "w " * 100_000 + long[0], "y")]
    found = decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found} == brute(docs, items)
    assert [r.n_hit for r in sorted(found, key=lambda r: r.doc_id)] == [1, 0, 1, 1, 0, 1]
