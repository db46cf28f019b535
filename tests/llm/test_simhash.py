"""Fingerprints, pigeonring links and components against brute force."""

import random

import numpy as np
import xxhash

from pixelmill.llm import simhash
from pixelmill.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)] + [(1000, 1000 + i) for i in range(200)]
    nodes = {x for p in links if p[0] != p[1] for x in p}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute_components(nodes, [p for p in links if p[0] != p[1]])


def test_links_lose_nothing(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:60]:
        for _ in range(6):
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(24)}  # one large bucket
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    values = np.array(sorted(fps), np.uint64)
    near = [(i, int(j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2) if i < j]
    found = simhash.links(spark.createDataFrame([(f, i) for i, f in rows], "fp long, rep long")).collect()
    want = brute_components(range(len(values)), near)
    assert brute_components(range(len(values)), [tuple(r) for r in found]) == want
    assert len(found) < 16 * len(values)


def test_documents(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))
    texts = [say(rng.randint(1, 300)) for _ in range(60)]
    texts += [t.upper() for t in texts[:5]] + [t.replace(" ", "\n", 3) + " end" for t in texts[:20]] + ["", None, " \t", "one", "one two", "one two", texts[0] * 200]
    rows = [(i + 3, t, "k") for i, t in enumerate(texts)]
    got = simhash.simhash_dedup(spark.createDataFrame([*rows, (None, texts[0], "k")], "doc_id long, text string, fp string")).collect()
    fps = {i: brute_fingerprint(t) for i, t, _ in rows}
    want = brute_components(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}
    assert [r.component_id for r in got if r.doc_id is None] == [3]
    assert simhash.simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
