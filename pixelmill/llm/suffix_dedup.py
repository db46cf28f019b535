"""Removal of long repeated byte strings by a sparse suffix array.

Suffixes are sorted deep-shallow: multikey quicksort by eight-byte characters down to
a shallow depth, then blind tries order the groups whose common prefix is longer.
Verdicts are read from the sorted order. Sorting is done per minimiser bucket
(``blocks``), so only suffixes that can share ``length`` bytes ever meet; equal packed
strings of a bucket are sorted once, weighted by how often they occur.

Defined cases: a null text counts as empty; texts shorter than ``length`` keep all;
a null doc_id stays null in the result; repeated rows count as separate documents,
so each removes the other's windows; an empty table gives an empty result; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.blocks import judged
from pixelmill.llm.common import NO_ID, mixed, sliding_least

GRAM = 32  # bytes hashed for a minimiser
PIECE = 16  # windows in a piece under a hot minimiser
LOW = np.uint64(0xFFFFFFFF)


def deep_shallow(buffer: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int, shallow: int = 32):
    """Order suffixes of ``buffer`` by their first ``length`` bytes within each group.

    Gives the order and, along it, the place of the first suffix that equals each one
    over ``length`` bytes. ``buffer`` needs ``length`` + 8 bytes after the last start.
    All groups are sorted side by side, so that each step is one pass over arrays.
    """
    words = np.ndarray((len(buffer) - 7,), ">u8", np.ascontiguousarray(buffer), 0, (1,))
    depths = np.array([*range(0, length - 8, 8), length - 8])
    order = np.argsort(group, kind="stable")
    same = group[order]
    head = np.concatenate([[True], same[1:] != same[:-1]]) if len(same) else np.zeros(0, bool)
    place = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0)) if len(order) else order
    at = _open(np.arange(len(order)), place)
    deep = _multikey_quicksort(words, starts, depths, order, place, at, int(np.searchsorted(depths, min(shallow, length - 8))))
    _blind_tries(words, starts, depths, order, place, deep)
    return order, place


def _open(at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Those of the places ``at`` whose group has more than one suffix."""
    p = place[at]
    more = np.zeros(len(p), bool)
    more[1:] = p[1:] == p[:-1]
    more[:-1] |= more[1:]
    return at[more]


def _regroup(place: np.ndarray, at: np.ndarray, changed: np.ndarray) -> None:
    place[at] = at[np.maximum.accumulate(np.where(changed, np.arange(len(at)), 0))]


def _multikey_quicksort(words, starts, depths, order, place, at, shallow: int) -> np.ndarray:
    """Sort the groups at ``at`` down to ``depths[shallow]``; gives the places that are still open there.

    Every round splits each open group into three by its middle suffix's word: less,
    equal and greater. Equal ones go on at the next word.
    """
    level, deep = np.zeros(len(order), np.int64), []
    while len(at):
        ready = level[at] >= shallow
        if ready.any():
            deep.append(at[ready])
            at = at[~ready]
            continue
        w, p = words[starts[order[at]] + depths[level[at]]].astype(np.uint64), place[at]
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        size = np.diff(np.append(first, len(at)))
        pivot = np.repeat(w[first + size // 2], size)
        part = np.repeat(3 * np.arange(len(first)), size) + (w >= pivot) + (w > pivot)
        by = np.argsort(part, kind="stable")
        order[at], part = order[at][by], part[by]
        level[at] = level[at][by] + (part % 3 == 1)
        _regroup(place, at, np.concatenate([[True], part[1:] != part[:-1]]))
        at = _open(at, place)
    return np.sort(np.concatenate(deep)) if deep else at


def _blind_tries(words, starts, depths, order, place, at) -> None:
    """Order each open group by a blind trie of its suffixes.

    A trie keeps branching words only. Its spine is the group's first suffix; each
    other suffix is compared with the spine once, which gives the node where it leaves
    and the word that it leaves by. Suffixes that leave a node by one word are a
    subtrie, whose spine is the first of them, and so on until every leaf holds equal
    suffixes. In order, a spine's lesser branches come deepest last, then the spine
    with what equals it, then the greater ones deepest first.
    """
    while len(at):
        p = place[at]
        mine, spine = starts[order[at]], starts[order[p]]
        node, word, side = np.full(len(at), len(depths)), np.zeros(len(at), np.uint64), np.zeros(len(at), np.int8)
        along = np.arange(len(at))
        for j, depth in enumerate(depths.tolist()):
            a, b = words[mine[along] + depth], words[spine[along] + depth]
            off = np.flatnonzero(a != b)
            if len(off):
                leaf = along[off]
                node[leaf], word[leaf], side[leaf] = j, a[off].astype(np.uint64), np.where(a[off] < b[off], -1, 1)
                along = np.delete(along, off)
            if not len(along):
                break
        by = np.lexsort((word, np.where(side < 0, node, -node), side, p))
        order[at] = order[at][by]
        node, word, side = node[by], word[by], side[by]
        _regroup(place, at, np.concatenate([[True], (p[1:] != p[:-1]) | (side[1:] != side[:-1]) | (node[1:] != node[:-1]) | (word[1:] != word[:-1])]))
        at = _open(at[side != 0], place)


class _View:
    """Minimiser runs over the bytes of a block; windows are named by their first byte."""

    def __init__(self, data, at, length):
        self.at, self.length, self.text = at, length, data.tobytes()
        n, wide = len(data), length - GRAM + 1
        empty = np.zeros(0, np.int64)
        self.key, self.start, self.count, self.data = empty.astype(np.uint64), empty, empty, data
        if n < length:
            return
        h, base, size = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
        while size < GRAM:
            h = h[: len(h) - size] * np.uint64(base) + h[size:]
            base, size = base * base & 0xFFFFFFFFFFFFFFFF, size * 2
        h = mixed(h)
        least = sliding_least((h & ~LOW) | np.arange(len(h), dtype=np.uint64), wide) & LOW
        fits = np.zeros(n + 1, np.int32)
        long = np.flatnonzero(np.diff(at) >= length)
        np.add.at(fits, at[long], 1)
        np.add.at(fits, at[long + 1] - length + 1, -1)
        fits = np.cumsum(fits)[: len(least)] > 0
        new = fits.copy()
        new[1:] &= ~(fits[:-1] & (least[1:] == least[:-1]))
        self.start = np.flatnonzero(new)
        closes = fits.copy()
        closes[:-1] &= ~(fits[1:] & (least[1:] == least[:-1]))
        self.count = np.flatnonzero(closes) - self.start + 1
        self.least = least
        self.key = h[least[self.start].astype(np.int64)]

    def doc_of(self, start):
        return np.searchsorted(self.at, start, side="right") - 1

    def span(self, start, count):
        return start, start + count - 1 + self.length


class Repeats:
    """Rule for ``blocks.judged``: a window is repeated if its bytes start anywhere else."""

    def __init__(self, length: int):
        self.length = length

    def view(self, data, at):
        return _View(data, at, self.length)

    def keys(self, view, ids):
        key, runs = np.unique(view.key, return_counts=True)
        return key, runs, runs > 1

    def cut(self, view, split):
        """Pieces of at most PIECE windows at fixed distances from the minimiser, under the bytes all of them hold."""
        start, count = view.start[split], view.count[split]
        low = view.least[start].astype(np.int64)
        far, near = low - start, low - (start + count - 1)
        runs = far // PIECE - near // PIECE + 1
        which = np.repeat(np.arange(len(split)), runs)
        step = far[which] // PIECE - (np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs))
        begin = np.maximum(start[which], low[which] - (step * PIECE + PIECE - 1))
        end = np.minimum(start[which] + count[which] - 1, low[which] - step * PIECE)
        lo, hi = low[which] - step * PIECE, low[which] - step * PIECE - PIECE + 1 + self.length
        key = np.fromiter((int.from_bytes(hashlib.blake2b(view.text[a:b], digest_size=8, salt=j.to_bytes(2, "big")).digest()) for a, b, j in zip(lo.tolist(), hi.tolist(), step.tolist(), strict=True)), np.uint64, len(lo))
        return key, begin, end - begin + 1

    def summed(self, piece, ids, n):
        """How often each piece occurs in a block, 2 standing for more."""
        weight = np.minimum(np.bincount(piece, minlength=n), 2).astype(np.int64)
        return weight, weight

    def judge(self, key, strings, count, weight, _):
        """Verdicts read from the sorted order: a window is repeated if the suffixes that equal it weigh 2 or more.

        Equal packed strings are sorted once, with their occurrences as weight.
        """
        seen: dict[bytes, int] = {}
        which = np.fromiter((seen.setdefault(x, len(seen)) for x in strings), np.int64, len(strings))
        total = np.bincount(which, weight, len(seen))
        first = np.zeros(len(seen), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        group = np.unique(key[first], return_inverse=True)[1]
        several = np.flatnonzero(np.bincount(group, total)[group] > 1)
        distinct = list(seen)
        at = np.concatenate([[0], np.cumsum([len(x) for x in distinct], dtype=np.int64)])
        buffer = np.frombuffer(b"".join(distinct) + bytes(self.length + 8), np.uint8)
        windows = count[first][several]
        owner = np.repeat(several, windows)
        starts = at[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        order, place = deep_shallow(buffer, starts, group[owner], self.length)
        together = np.bincount(place, total[owner[order]], len(order) + 1)
        again = np.zeros(len(owner), bool)
        again[order] = together[place] > 1
        upto = np.zeros(len(seen) + 1, np.int64)
        upto[several + 1] = windows
        upto = np.cumsum(upto)
        for i, w in enumerate(which.tolist()):
            if (mine := again[upto[w] : upto[w + 1]]).any():
                yield i, np.packbits(mine).tobytes()

    def nothing(self):
        return self._table([], [], [], [], [], [])

    def _table(self, ids, size, removed, spans, sha, kept):
        return pa.table({"doc_id": pa.array([None if x == NO_ID else x for x in ids], pa.int64()), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary())})

    def finish(self, ids, data, at, starts, count, verdict):
        n = len(data)
        again = np.zeros(n + 1, bool)
        for places, c, bits in zip(starts, count, verdict, strict=True):
            mine = np.unpackbits(np.frombuffer(bits, np.uint8), count=c).astype(bool)
            for s in places.tolist():
                again[s : s + c] |= mine
        sums = np.concatenate([[0], np.cumsum(again[:n], dtype=np.int64)])
        place = np.arange(n)
        gone = sums[place + 1] > sums[np.maximum(place + 1 - self.length, 0)]
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        opens[at[:-1][at[:-1] < n]] = gone[at[:-1][at[:-1] < n]]
        lost, opened = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (gone, opens))
        kept = data[~gone].tobytes()
        upto = at - lost[at]
        parts = [kept[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        return self._table(ids.tolist(), np.diff(at), np.diff(lost[at]), np.diff(opened[at]), [hashlib.sha256(x).hexdigest() for x in parts], parts)


def suffix_dedup(docs: DataFrame, length: int = 200, blocks: int | None = None, hot_runs: int = 4096) -> DataFrame:
    """Remove each byte under a ``length``-byte string that also starts anywhere else.

    Gives doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining
    bytes, which may cut a character in two).
    """
    if length < 64:
        raise ValueError("length must be 64 bytes or more")
    return judged(docs, Repeats(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", blocks, hot_runs)


def op1(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select("doc_id", F.col("n_bytes"), "n_removed", "n_spans", "kept_sha256")
