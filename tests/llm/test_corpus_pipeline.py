"""The corpus pipeline, stage by stage, against brute force on the stage's own input."""

import hashlib
import re

import public_tokenizers
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from pixelmill.llm import pii

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def near_groups(texts):
    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def luhn(number):
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def entities(text):
    """Matches of a text, without long numbers that aren't cards."""
    card = regex.compile(pii.PATTERNS["card"])
    return [m[0] for m in regex.finditer(pii.PATTERN, text) if not card.fullmatch(m[0]) or luhn(m[0])]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
            seen.append({r.doc_id: r.text for r in docs.collect()})
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    start, good, single, clean, private = seen
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect() if r.doc_id in start}
    assert sum((i in good) == (q == 1) for i, q in labels.items()) >= 0.97 * len(labels) and all(good[i] == start[i] for i in good)
    groups = near_groups(good)
    assert single == {i: t for i, t in good.items() if groups[i] == i}
    grams = set()
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = words(r.text)
        assert len(w) >= 13
        grams |= {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    dirty = set()
    for i, t in single.items():
        w = words(t)
        hit = {p for s in range(len(w) - 12) if tuple(w[s : s + 13]) in grams for p in range(s, s + 13)}
        if hit and 20 * len(hit) >= len(w):
            dirty.add(i)
    assert clean == {i: t for i, t in single.items() if i not in dirty} and dirty
    assert set(private) == set(clean)
    for i, t in clean.items():
        old, new = entities(t), entities(private[i])
        assert len(old) == len(new) and not set(old) & set(new)
        if not old:
            assert private[i] == t
        elif not any(regex.fullmatch(pii.PATTERNS["name"], x) for x in old):
            for x, y in zip(old, new, strict=True):
                t = t.replace(x, y)
            assert t == private[i]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: hashlib.sha256(",".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for i, t in private.items()}
    assert {r.doc_id: r.ids_sha256 for r in docs.collect()} == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect())) == sorted(map(tuple, docs.collect()))
