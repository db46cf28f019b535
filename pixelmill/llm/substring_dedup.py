"""Removal of repeated word windows, counted exactly in super-k-mer buckets.

Consecutive windows whose minimiser is the same word gram travel as one packed
string (their words joined by a space) to that minimiser's bucket, where the windows
are cut out, sorted and judged (``blocks``). The first document keeps a passage.

Defined cases: null texts have no words; a null doc_id sorts after all others and
stays null in the result; rows that share a doc_id never remove from one another,
as only a smaller doc_id counts; an empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixelmill.llm.blocks import judged
from pixelmill.llm.common import NO_ID, mixed, sliding_least

GRAM = 4  # words hashed for a minimiser
LOW = np.uint64(0xFFFFFFFF)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE):
    """First and last+1 byte of each word, and the number of words before each document."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[: len(data)] = ~space[data]
    opens = inside[:-1].astype(bool)
    opens[1:] &= inside[:-2] == 0
    starts = at[:-1][at[:-1] < len(data)]
    opens[starts] = inside[starts] > 0
    closes = inside[:-1].astype(bool) & (inside[1:] == 0)
    ends = at[1:][at[1:] > at[:-1]] - 1
    closes[ends] = inside[ends] > 0
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return first, last, np.searchsorted(first, at)


def joined_words(data: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Words with one space after each, and where each begins; one entry more for the end."""
    size = last - first
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.full(begin[-1], 0x20, np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    text[begin[word] + inside] = data[first[word] + inside]
    return text, begin, word, inside


def word_hashes(text, begin, word, inside) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(word):
        return np.zeros(len(begin) - 1, np.uint64)
    powers = np.ones(int(inside.max()) + 1, np.uint64)
    np.cumprod(np.full(len(powers) - 1, 0x9E3779B97F4A7C15, np.uint64), out=powers[1:])
    term = (text[begin[word] + inside].astype(np.uint64) + np.uint64(1)) * powers[inside]
    heads = np.flatnonzero(inside == 0)
    return mixed(np.add.reduceat(term, heads))


class _View:
    """Minimiser runs over the words of a block; windows are named by their first word."""

    def __init__(self, data, at, length):
        first, last, self.before = words_of(data, at)
        text, self.begin, word, inside = joined_words(data, first, last)
        self.text, self.letters, self.length, self.n = text.tobytes(), text, length, len(first)
        empty = np.zeros(0, np.int64)
        self.key, self.start, self.count = empty.astype(np.uint64), empty, empty
        if self.n < length:
            return
        h, wide = word_hashes(text, self.begin, word, inside), length - GRAM + 1
        gram = h[: self.n - GRAM + 1].copy()
        for i in range(1, GRAM):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + h[i : self.n - GRAM + 1 + i]
        gram = mixed(gram)
        least = sliding_least((gram & ~LOW) | np.arange(len(gram), dtype=np.uint64), wide) & LOW
        fits = np.zeros(self.n + 1, np.int32)
        long = np.flatnonzero(np.diff(self.before) >= length)
        np.add.at(fits, self.before[long], 1)
        np.add.at(fits, self.before[long + 1] - length + 1, -1)
        fits = np.cumsum(fits)[: len(least)] > 0
        new, closes = fits.copy(), fits.copy()
        new[1:] &= ~(fits[:-1] & (least[1:] == least[:-1]))
        closes[:-1] &= ~(fits[1:] & (least[1:] == least[:-1]))
        self.start = np.flatnonzero(new)
        self.count = np.flatnonzero(closes) - self.start + 1
        self.key = gram[least[self.start].astype(np.int64)]

    def doc_of(self, start):
        return np.searchsorted(self.before, start, side="right") - 1

    def span(self, start, count):
        return self.begin[start], self.begin[start + count - 1 + self.length] - 1


class Earlier:
    """Rule for ``blocks.judged``: what matters of a window is the smallest doc_id that has it."""

    def __init__(self, length: int):
        self.length = length

    def view(self, data, at):
        return _View(data, at, self.length)

    def keys(self, view, ids):
        mine = ids[view.doc_of(view.start)]
        order = np.lexsort((mine, view.key))
        key, mine = view.key[order], mine[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(key)) - 1 if len(key) else heads
        return key[heads], ends - heads + 1, mine[heads] != mine[ends]

    def cut(self, view, split):
        """Single windows, under a hash of all their words."""
        count = view.count[split]
        start = np.repeat(view.start[split], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        one = np.ones(len(start), np.int64)
        lo, hi = view.span(start, one)
        key = np.fromiter((int.from_bytes(hashlib.blake2b(view.text[a:b], digest_size=8).digest()) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)), np.uint64, len(lo))
        return key, start, one

    def summed(self, piece, ids, n):
        """The smallest and the greatest doc_id of each piece in a block."""
        least, most = np.full(n, NO_ID, np.int64), np.full(n, -NO_ID - 1, np.int64)
        np.minimum.at(least, piece, ids)
        np.maximum.at(most, piece, ids)
        return least, most

    def judge(self, key, strings, count, low, high):
        least: dict[bytes, int] = {}
        for text, doc in zip(strings, low.tolist(), strict=True):
            if doc < least.get(text, NO_ID + 1):
                least[text] = doc
        length, windows, spans = self.length, [], {}
        for text, doc in least.items():
            words = text.split(b" ")
            mine = [b" ".join(words[i : i + length]) for i in range(len(words) - length + 1)]
            spans[text] = mine
            windows.extend((w, doc) for w in mine)
        windows.sort()
        first: dict[bytes, int] = {}
        for window, doc in windows:
            first.setdefault(window, doc)
        told = {text: np.array([first[w] for w in mine], np.int64) for text, mine in spans.items()}
        for i, (text, last) in enumerate(zip(strings, high.tolist(), strict=True)):
            if told[text].min() < last:
                yield i, told[text].tobytes()

    def nothing(self):
        return self._table([], [], [], [], [])

    def _table(self, ids, words, removed, sha, kept):
        return pa.table({"doc_id": pa.array([None if x == NO_ID else x for x in ids], pa.int64()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.string())})

    def finish(self, ids, data, at, starts, count, verdict):
        first, last, before = words_of(data, at)
        letters, begin, _, _ = joined_words(data, first, last)
        change = np.zeros(len(first) + self.length + 1, np.int32)
        for places, found in zip(starts, verdict, strict=True):
            least = np.frombuffer(found, np.int64)
            for s, doc in zip(places.tolist(), ids[np.searchsorted(before, places, side="right") - 1].tolist(), strict=True):
                hit = s + np.flatnonzero(least < doc)
                change[hit] += 1
                change[hit + self.length] -= 1
        gone = np.cumsum(change[: len(first)]) > 0
        kept = np.repeat(~gone, np.diff(begin))
        left = letters[kept].tobytes()
        lost = np.concatenate([[0], np.cumsum(gone, dtype=np.int64)])
        upto = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[begin[before]]
        parts = [left[a : max(a, b - 1)] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        return self._table(ids.tolist(), np.diff(before), np.diff(lost[before]), [hashlib.sha256(x).hexdigest() for x in parts], [x.decode() for x in parts])


def substring_dedup(docs: DataFrame, length: int = 13, blocks: int | None = None, hot_runs: int = 4096) -> DataFrame:
    """Remove each word under a window of ``length`` words that also starts in a document with a smaller doc_id.

    Gives doc_id, n_words, n_removed, kept_sha256 and kept (words joined by a space).
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} words or more")
    return judged(docs, Earlier(length), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", blocks, hot_runs)


def op3(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
