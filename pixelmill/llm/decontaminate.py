"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of documents. All its words are indexed: each becomes a symbol, and
a separator ends each document. A word is one of a test phrase if its bytes are; hashes
only find the candidates, and number the words that no phrase has. The suffix array gives the Burrows-Wheeler transform; a
wavelet matrix over it answers ranks; phrases are found by backward search, all at
once; positions are located by walking back to sampled suffixes; the hit words of a
document are merged into removal spans.

Phrases come to the driver in blocks of bounded size, each broadcast on its own; a
worker holds one block at a time, and reads a block again for each batch of shards.

Defined cases: a null text has no words; an item without words has no window; a null
item_id is listed as "null"; items that share a text or an id count once per id; a
null doc_id stays null; other columns are ignored; empty tables give no hits; words and
texts of any length are compared whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import bounded, by_bytes, filtered, string_parts
from pixelmill.llm.substring_dedup import joined_words, word_hashes, words_of

SHARD, SLICE = 2 << 20, 1 << 20
LETTER = np.zeros(256, bool)
LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of a text that ends in 0, each 0 counting as a symbol of its own (smaller where earlier)."""
    n, zeros = len(symbols), symbols == 0
    rank = symbols.astype(np.int64) + int(zeros.sum())
    rank[zeros] = np.arange(zeros.sum())
    order = np.argsort(rank, kind="stable")

    def place_of(key):
        return np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(len(key)), 0))

    place = place_of(rank[order])
    rank[order] = place
    step, active = 1, np.arange(n)
    while True:
        p = place[active]
        more = np.zeros(len(p), bool)
        more[1:] = p[1:] == p[:-1]
        more[:-1] |= more[1:]
        active = active[more]
        if not len(active):
            return order
        p, key = place[active], rank[order[active] + step]
        by = np.lexsort((key, p))
        order[active], key = order[active][by], key[by]
        changed = np.concatenate([[True], (p[1:] != p[:-1]) | (key[1:] != key[:-1])])
        place[active] = active[np.maximum.accumulate(np.where(changed, np.arange(len(active)), 0))]
        rank[order[active]] = place[active]
        step *= 2


class FMIndex:
    """Backward search over integer symbols; 0 separates and is never matched."""

    def __init__(self, symbols: np.ndarray, rate: int = 16):
        self.n = len(symbols)
        order = suffix_array(symbols)
        self.bwt = symbols[order - 1]
        top = int(symbols.max(initial=0)) + 1
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top))])
        self.levels = max(1, top.bit_length())
        self.ones, self.zeros = [], []
        row = self.bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        kept = (order % rate == 0) | (self.bwt == 0)
        self.sampled, self.sample = kept, order[kept]
        self.nth = np.cumsum(kept) - 1

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first ``at`` of the transform."""
        left = np.zeros(len(at), np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones, bit = self.ones[k], (symbol >> level) & 1
            a, b = ones[at].astype(np.int64), ones[left].astype(np.int64)
            at = np.where(bit == 1, self.zeros[k] + a, at - a)
            left = np.where(bit == 1, self.zeros[k] + b, left - b)
        return at - left

    def search(self, phrases: np.ndarray, sizes: np.ndarray):
        """First and last+1 row of the suffixes that begin with each phrase."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        top = len(self.less) - 1
        for step in range(int(sizes.max(initial=0))):
            live = np.flatnonzero((step < sizes) & (high > low))
            if not len(live):
                break
            symbol = phrases[live, sizes[live] - 1 - step]
            known = symbol < top
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live], high[live] = (self.less[symbol] + self.rank(symbol, x[live]) for x in (low, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to the nearest sampled one."""
        rows, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows[open_]]
            at = open_[done]
            found[at] = self.sample[self.nth[rows[at]]] + steps[at]
            open_ = open_[~done]
            symbol = self.bwt[rows[open_]]
            rows[open_] = self.less[symbol] + self.rank(symbol, rows[open_])
            steps[open_] += 1
        return found


class Phrases:
    """The distinct word windows of a block of items, ready for the workers."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for name, text in items:
            data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            first, last, _ = words_of(data, np.array([0, len(data)]), ~LETTER)
            words = [data[a:b].tobytes() for a, b in zip(first, last, strict=True)]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[i : i + window]), set()).add(name)
        self.owners = [sorted(x) for x in owners.values()]
        words = sorted({w for p in owners for w in p})
        number = {w: i + 1 for i, w in enumerate(words)}
        self.sizes = np.array([len(p) for p in owners], np.int64)
        self.phrases = np.zeros((len(owners), int(self.sizes.max(initial=1))), np.int64)
        for k, p in enumerate(owners):
            self.phrases[k, : len(p)] = [number[w] for w in p]
        text = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words], dtype=np.int64)])
        word = np.repeat(np.arange(len(words)), np.diff(begin) - 1)
        inside = np.arange(len(word)) - np.repeat(begin[:-1] - np.arange(len(words)), np.diff(begin) - 1)
        hashes = word_hashes(text, begin, word, inside)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.size = np.diff(begin)[self.order] - 1
        self.begin, self.text = begin[:-1][self.order], text

    def symbols(self, hashes, text, begin) -> np.ndarray:
        """The number of each word, 0 where no phrase has it; candidates by hash are compared byte by byte."""
        out = np.zeros(len(hashes), np.int64)
        if not len(self.hashes) or not len(hashes):
            return out
        at = np.searchsorted(self.hashes, hashes)
        size, open_ = np.diff(begin) - 1, np.flatnonzero(at < len(self.hashes))
        while len(open_):  # phrase words that share a hash are tried one after another
            open_ = open_[self.hashes[at[open_]] == hashes[open_]]
            alike = open_[self.size[at[open_]] == size[open_]]
            same = alike[_equal(text, begin[alike], self.text, self.begin[at[alike]], size[alike])]
            out[same] = self.order[at[same]] + 1
            open_ = open_[out[open_] == 0]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.hashes)]
        return out


def _equal(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the words of ``a`` and ``b`` at these places, of these sizes, have the same bytes."""
    same, grown, begin = np.ones(len(size), bool), np.cumsum(size), 0
    while begin < len(size):
        end = max(begin + 1, int(np.searchsorted(grown, (grown[begin - 1] if begin else 0) + SLICE, side="right")))
        part = size[begin:end]
        word = np.repeat(np.arange(begin, end), part)
        inside = np.arange(len(word)) - np.repeat(np.cumsum(part) - part, part)
        same[word[a[at_a[word] + inside] != b[at_b[word] + inside]]] = False
        begin = end
    return same


def hits(phrases: Phrases, symbols: np.ndarray, hashes: np.ndarray, before: np.ndarray):
    """Words hit by any phrase, and which phrase occurs in which document (as pairs)."""
    none = np.zeros(0, np.int64)
    hit = np.zeros(len(symbols) + 1, np.int32)
    if not len(phrases.sizes) or not symbols.any():
        return hit[:-1] > 0, none, none
    symbols, top, other = symbols.copy(), int(symbols.max()), np.flatnonzero(symbols == 0)
    symbols[other] = top + 1 + np.unique(hashes[other], return_inverse=True)[1]
    word = np.insert(np.arange(len(symbols)), before[1:], -1)
    index = FMIndex(np.where(word < 0, 0, symbols[word]))
    low, high = index.search(np.where(phrases.phrases <= top, phrases.phrases, len(index.less)), phrases.sizes)
    found = np.flatnonzero(high > low)
    many = high[found] - low[found]
    which = np.repeat(found, many)
    rows = np.repeat(low[found], many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    start = word[index.locate(rows)]
    np.add.at(hit, start, 1)
    np.add.at(hit, start + phrases.sizes[which], -1)
    where = np.searchsorted(before, start, side="right") - 1
    pairs = np.unique(np.stack([where, which], 1), axis=0) if len(which) else np.zeros((0, 2), np.int64)
    return np.cumsum(hit[:-1]) > 0, pairs[:, 0], pairs[:, 1]


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<first:long,end:long>>"


def phrase_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """Broadcasts of the items' windows, in blocks of about ``block_bytes`` of text."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("phrase")).where("length(phrase) > 0")
    size = items.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    number = F.pmod(F.xxhash64("item", "phrase"), F.lit(max(blocks, 1)))
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(Phrases([(r.item, r.phrase) for r in items.where(number == b).toLocalIterator()], window)) for b in range(blocks)]


def released(block) -> None:
    """Let a worker's copy of a broadcast go, where it can be read again from its file."""
    if getattr(block, "_path", None) is not None:
        block.__dict__.pop("_value", None)


def judge(batch, shared: list):
    """Word bounds of a shard's texts, which of the words are hit, and the items of each document."""
    raw, at = string_parts(batch.column("text"))
    data = LOWER[raw]
    first, last, before = words_of(data, at, ~LETTER)
    text, begin, word, inside = joined_words(data, first, last)
    hashes = word_hashes(text, begin, word, inside)
    hit, items = np.zeros(len(first), bool), [set() for _ in range(batch.num_rows)]
    for block in shared:
        phrases = block.value
        more, where, which = hits(phrases, phrases.symbols(hashes, text, begin), hashes, before)
        hit |= more
        for d, p in zip(where.tolist(), which.tolist(), strict=True):
            items[d].update(phrases.owners[p])
        if len(shared) > 1:
            released(block)
    return at, first, last, before, hit, items


def verdicts(before: np.ndarray, hit: np.ndarray, share: float):
    """Words and hit words of each document, and whether it is contaminated."""
    sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
    n_words, n_hit = np.diff(before), np.diff(sums[before])
    return n_words, n_hit, (n_hit > 0) & (n_hit >= share * n_words - 1e-9)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't contaminated; each row is judged by its own text, without a shuffle."""
    shared = phrase_blocks(benchmark, window, block_bytes)

    def run(batches):
        for batch in by_bytes(batches, "text", SHARD):
            _, _, _, before, hit, _ = judge(batch, shared)
            yield batch.filter(pa.array(~verdicts(before, hit, share)[2]))

    return filtered(docs, run)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05, block_bytes: int = 8 << 20) -> DataFrame:
    """Judge every document by the benchmark word windows it holds.

    Gives doc_id, n_words, n_hit, n_items, items_sha256, contaminated (hit words are
    at least ``share`` of all), items, and spans (byte ranges of the removal spans).
    """
    shared = phrase_blocks(benchmark, window, block_bytes)

    def run(batches):
        for batch in by_bytes(batches, "text", SHARD):
            at, first, last, before, hit, items = judge(batch, shared)
            n_words, n_hit, over = verdicts(before, hit, share)
            spans = [[] for _ in items]
            for d in np.flatnonzero(n_hit).tolist():
                a, b = before[d], before[d + 1]
                on = np.concatenate([[False], hit[a:b], [False]])
                edges = np.flatnonzero(on[1:] != on[:-1]) + a
                spans[d] = [{"first": int(first[x] - at[d]), "end": int(last[y - 1] - at[d])} for x, y in zip(edges[::2], edges[1::2], strict=True)]
            names = [sorted(x) for x in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), pa.array(over), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
            )

    return bounded(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def op2(spark, sf_dir) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
