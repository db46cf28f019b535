"""Both window operators against brute force, with planted repeats and defined cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from pixelmill.llm.substring_dedup import substring_dedup
from pixelmill.llm.suffix_dedup import deep_shallow, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, _id string, block int"


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(14, 90))) for _ in range(4)]
    texts = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 120)))]
        for p in passages:
            if rng.random() < 0.4:
                cut = rng.randint(0, len(p) // 3)
                parts.append(p[cut : len(p) - rng.randint(0, len(p) // 3)])
                parts.append(" ".join(word() for _ in range(rng.randint(0, 30))))
        texts.append(rng.choice([" ", "  ", "\n", "\t "]).join(parts))
    texts += [texts[3], texts[3], None, "", "   ", "ab " * 400, "x" * 500, "ab " * 300, "one two", "😀" * 120 + texts[5]]
    rows = [(i, t, "en", "clash", 7) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def brute_bytes(rows, length):
    seen = defaultdict(int)
    for _, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] += 1
    out = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, length):
    first = {}
    split = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for i, t, *_ in rows}
    for i, w in split.items():
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < i:
                gone[s : s + length] = [True] * length
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 4096), (2, 1)])
def test_suffix_dedup_is_exact(spark, seed, hot):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(spark.createDataFrame(rows, SCHEMA), 200, 16, hot).collect()}
    assert got == brute_bytes(rows, 200)
    assert sum(x[1] for x in got.values()) > 2000


@pytest.mark.parametrize(("seed", "hot"), [(1, 4096), (2, 1)])
def test_substring_dedup_is_exact(spark, seed, hot):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(spark.createDataFrame(rows, SCHEMA), 13, 16, hot).collect()}
    assert got == brute_words(rows, 13)
    assert sum(x[1] for x in got.values()) > 500


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup(none).count() == 0 and substring_dedup(none).count() == 0
    text = " ".join(f"w{i}" for i in range(80))
    rows = spark.createDataFrame([(None, text), (4, text), (4, text)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_removed) for r in substring_dedup(rows).collect()) == [(False, 0), (False, 0), (True, 80)]
    assert sorted((r.doc_id is None, r.n_removed) for r in suffix_dedup(rows).collect()) == [(False, len(text)), (False, len(text)), (True, len(text))]


def test_deep_shallow_sorts_suffixes():
    rng = np.random.default_rng(5)
    raw = np.concatenate([rng.integers(97, 99, 3000).astype(np.uint8), np.full(600, 97, np.uint8), np.zeros(80, np.uint8)])
    raw[1500:1800] = raw[100:400]
    starts = np.arange(3600)
    group = rng.integers(0, 3, 3600)
    order, place = deep_shallow(raw, starts, group, 72, shallow=16)
    text = raw.tobytes()
    keys = [(int(group[i]), text[starts[i] : starts[i] + 72]) for i in order.tolist()]
    assert [k[0] for k in keys] == sorted(k[0] for k in keys)
    for g in range(3):
        mine = [k[1] for k in keys if k[0] == g]
        assert mine == sorted(mine)
    for i in range(1, 3600):
        assert (place[i] == place[i - 1]) == (keys[i] == keys[i - 1])


def test_long_texts_shared_ids_and_ties(spark):
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(40_000))
    rows = [(None, long, "en", "c", 1), (None, long[:90_000], "en", "c", 1), (5, "x " + long[100_000:], "en", "c", 1), (5, "other words " * 3, "en", "c", 1)]
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA), 200, 4, 64).collect()
    size = {len(t): len(t) for _, t, *_ in rows}
    assert {r.n_bytes: r.n_bytes - r.n_removed for r in got} == {len(long): 10_000, 90_000: 0, len(long) - 99_998: 2, 36: 36} and len(got) == len(size)
    words = substring_dedup(spark.createDataFrame(rows, SCHEMA), 13, 4, 64).collect()
    assert sum(r.n_words for r in words) == sum(len(t.split()) for _, t, *_ in rows)
    assert all(r.n_removed == 0 for r in words if r.doc_id == 5) and any(r.n_removed > 20_000 for r in words if r.doc_id is None)
