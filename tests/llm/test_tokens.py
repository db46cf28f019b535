"""Own BPE, decoding and prefix counts against the public library."""

import hashlib
import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pixelmill.llm import token_counts as counting
from pixelmill.llm.bpe import Encoder, encode_decode, encoded, read_vocabulary
from pixelmill.llm.token_counts import PrefixCounts, prefix_counts, token_counts, truncated

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return read_vocabulary(PATH)


def texts(seed, n):
    rng = random.Random(seed)
    pool = ["the", " of", "  ", "\n", "\t", "'re", "'s", "'", "don't", "12", " 345", "é", "ñandú", "ß", "日本", "😀", "!!", " ##", "<|endoftext|>", " ", " ", "\x1c", "\x85", "a" * 40, "ing" * 9, "thndation", " Ähn", "İ", "́", "²", "Ⅷ"]
    out = ["", " ", "   ", "'", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "a" * 3000, "!" * 500, " " * 300]
    while len(out) < n:
        out.append("".join(rng.choice(pool) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF)])) for _ in range(rng.randint(1, 60))))
    return out


def test_ids_are_the_librarys(library, vocabulary):
    encoder, found = Encoder(vocabulary), texts(1, 1500)
    for text, want in zip(found, library.encode_batch(found, add_special_tokens=False), strict=True):
        assert encoder.encode(text) == want.ids, text
        assert encoder.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_every_character_is_split_like_the_library(library, vocabulary):
    encoder = Encoder(vocabulary)
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    found = ["".join(f"a{c} {c}1{c}  {c}!" for c in points[i : i + 50]) for i in range(0, 0x30000, 50)]
    bad = [t for t, want in zip(found, library.encode_batch(found, add_special_tokens=False), strict=True) if encoder.encode(t) != want.ids]
    assert len(bad) == 0, [hex(ord(c)) for t in bad[:20] for c in set(t) if ord(c) > 127 and encoder.encode(f"a{c} {c}1{c}  {c}!") != library.encode(f"a{c} {c}1{c}  {c}!", add_special_tokens=False).ids][:40]


def test_prefix_counts_are_the_librarys(library, vocabulary):
    counts = PrefixCounts(vocabulary)
    for text in texts(2, 300):
        if len(text) > 400:
            text = text[:150]
        want = [len(x.ids) for x in library.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]
        assert counts.prefixes(text) == want, text
        assert counts.count(text) == want[-1]
        for budget in (0, 3, 7, 20):
            cut = counts.truncated(text, budget)
            assert want[len(cut)] <= budget and all(n > budget for n in want[len(cut) + 1 :])


def test_prefix_tables_as_dataframes(spark, library):
    found = [*texts(4, 30), None, "don't  \n we'll\n\nthey've <|endoftext|> x<|endo", "lorem ipsum " * 20000]
    rows = spark.createDataFrame([(i, t, 3) for i, t in enumerate(found)], "doc_id long, text string, counts int")
    for r in prefix_counts(rows).collect():
        text = found[r.doc_id] or ""
        assert len(r.counts) == len(text) + 1
        for i in {0, 1, len(text) // 3, len(text) - 1, len(text), *range(min(len(text), 40))}:
            if 0 <= i <= min(3000, len(text)) or i == len(text):
                assert r.counts[i] == len(library.encode(text[:i], add_special_tokens=False).ids), (text[:i], i)
    for r in truncated(rows, 50).collect():
        text = found[r.doc_id] or ""
        whole = len(library.encode(text, add_special_tokens=False).ids)
        assert text.startswith(r.text) and r.n_tokens == len(library.encode(r.text, add_special_tokens=False).ids) <= 50 and r.whole == (whole <= 50)
    assert prefix_counts(rows.limit(0)).count() == truncated(rows.limit(0), 5).count() == 0
    assert [r.text for r in truncated(rows.where("doc_id = 31"), -1).collect()] == [""]


def test_queries_handle_nulls_and_long_texts(spark, library):
    found = [*texts(3, 40), None, "lorem ipsum " * 40000]
    rows = spark.createDataFrame([(i if i != 5 else None, t, 3) for i, t in enumerate(found)], "doc_id long, text string, n_tokens int")
    want = {}
    for i, t in enumerate(found):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i if i != 5 else None] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_decode(rows).collect()} == want
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(rows).collect()} == {i if i != 5 else None: (len((t or "").encode()), want[i if i != 5 else None][0], want[i if i != 5 else None][0] > 512) for i, t in enumerate(found)}
    assert {r.doc_id: len(r.ids) for r in encoded(rows).collect()} == {k: v[0] for k, v in want.items()}
    none = rows.limit(0)
    assert encode_decode(none).count() == token_counts(none).count() == 0


def test_words_used_lately_outlive_a_full_cache(library, vocabulary, monkeypatch):
    monkeypatch.setattr(counting, "CACHE", 80)
    counts, reckoned, real = PrefixCounts(vocabulary), [], PrefixCounts.of_words
    monkeypatch.setattr(counts, "of_words", lambda words: real(counts, [reckoned.append(w) or w for w in words]))
    for k in range(12):
        counts.learn({" the", " stammering", *(f" rare{k}x{i}" for i in range(30))})
    assert reckoned.count(b" the") == reckoned.count(b" stammering") == 1
    assert len(counts.known) + len(counts.older) <= 2 * (80 // 4 + 33)
    for w in (" the", " stammering", " rare3x7", " rare11x29"):
        assert counts.count(w) == len(library.encode(w, add_special_tokens=False).ids)


def test_sorted_words_share_what_they_begin_with(library, vocabulary):
    counts = PrefixCounts(vocabulary)
    words = sorted({w for t in texts(7, 300) for w in counts.base.words(t) if w not in counts.base.added and len(w) < 200})
    want = [[len(x.ids) for x in library.encode_batch([w[:i] for i in range(1, len(w) + 1)], add_special_tokens=False)] for w in words]
    for w, found, n in zip(words, counts.of_words(map(str.encode, words)), want, strict=True):
        assert list(found) == counts.of_word(w.encode())
        assert found[-1] == n[-1], w
