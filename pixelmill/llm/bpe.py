"""Byte-level BPE encoding and decoding by a pair occurrence index.

The distinct words (pre-tokens) of a slice of documents are encoded together: every
adjacent pair of symbols is mapped to all its positions in the slice, the active pair
of lowest rank is applied at its positions from left to right, and the lists of the
pairs that come into being are extended, until no pair has a rank. A word's ids are
kept in a bounded cache, so a document's ids are those of its words end to end.

The vocabulary file is the public ``byte_bpe_50k.json`` unless another path is given;
it is read on the driver and broadcast (its size is fixed by the vocabulary).

Defined cases: a null text counts as empty and has no tokens; a null doc_id stays
null; repeated rows and other columns make no difference; strings of added tokens
inside a text are those tokens, as is the library's default; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from pixelmill.llm.common import bounded, by_bytes, worker_store

# The public pre-tokenizer pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 500_000  # words, some 300 bytes each with their ids; the cache is emptied beyond
CACHE_BYTES = 32 << 20  # and beyond so many bytes of words
SLICE = 4 << 20


def byte_letters() -> dict[str, int]:
    """The vocabulary's letter for each byte: itself where printable, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return letters


def read_vocabulary(path: str) -> dict:
    """Token bytes by id, merge ranks by pair of ids, and added tokens, of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    letters = byte_letters()
    vocab = found["model"]["vocab"]
    size = max([*vocab.values(), *(x["id"] for x in found["added_tokens"])]) + 1
    tokens: list[bytes] = [b""] * size
    for text, i in vocab.items():
        tokens[i] = bytes(letters[c] for c in text)
    merges = {}
    for rank, pair in enumerate(found["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
    added = {x["content"]: x["id"] for x in found["added_tokens"]}
    for text, i in added.items():
        tokens[i] = text.encode()
    single = [0] * 256
    for letter, b in letters.items():
        single[b] = vocab[letter]
    return {"tokens": tokens, "merges": merges, "added": added, "single": single}


def encode_words(words: list[bytes], merges: dict, single: list[int]) -> list[list[int]]:
    """The ids of each word, by the pair occurrence index over all of them."""
    symbols: list[int] = []
    ends = []
    for w in words:
        symbols.extend(map(single.__getitem__, w))
        symbols.append(-1)
        ends.append(len(symbols))
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    index: dict[tuple[int, int], list[int]] = {}
    for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
        if pair in merges:
            index.setdefault(pair, []).append(i)
    ranks = [(merges[pair][0], pair) for pair in index]
    heapq.heapify(ranks)
    while ranks:
        _, pair = heapq.heappop(ranks)
        left, right = pair
        made, fresh = merges[pair][1], {}
        for i in sorted(index.pop(pair)):
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            k = after[j]
            symbols[i], symbols[j] = made, -2
            after[i] = k
            if k < n:
                before[k] = i
                if (new := (made, symbols[k])) in merges:
                    fresh.setdefault(new, []).append(i)
            h = before[i]
            if h >= 0 and (new := (symbols[h], made)) in merges:
                fresh.setdefault(new, []).append(h)
        for new, at in fresh.items():
            if new in index:
                index[new].extend(at)
            else:
                index[new] = at
                heapq.heappush(ranks, (merges[new][0], new))
    out, start = [], 0
    for end in ends:
        out.append([s for s in symbols[start : end - 1] if s >= 0])
        start = end
    return out


class Encoder:
    """Encodes texts with a word cache; one per Python worker."""

    def __init__(self, vocabulary: dict):
        import regex

        self.tokens, self.merges, self.single, self.added = (vocabulary[k] for k in ("tokens", "merges", "single", "added"))
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.ids: dict[str, tuple[int, bytes, bytes]] = {}
        self.held = 0

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text; strings of added tokens stand as they are."""
        if self.split and any(map(text.__contains__, self.added)):
            return list(chain.from_iterable([part] if k % 2 else self.find(part) for k, part in enumerate(self.split(text))))
        return self.find(text)

    def learn(self, texts: list[list[str]]) -> None:
        """Put all words of a slice into the cache: number of ids, ids as text, their bytes."""
        new = {w for words in texts for w in set(words)} - self.ids.keys()
        if len(self.ids) + len(new) > CACHE or self.held > CACHE_BYTES:
            self.ids.clear()
            self.held = 0
            new = {w for words in texts for w in set(words)}
        self.held += sum(map(len, new))
        for w in self.added.keys() & new:
            self.ids[w] = (1, b"%d" % self.added[w], w.encode())
            new.discard(w)
        new = list(new)
        for w, ids in zip(new, encode_words([w.encode() for w in new], self.merges, self.single), strict=True):
            self.ids[w] = (len(ids), ",".join(map(str, ids)).encode(), b"".join([self.tokens[i] for i in ids]))

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        self.learn([words])
        return [int(i) for w in words for i in self.ids[w][1].split(b",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


def vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def worker_encoder(shared, key: str) -> Encoder:
    store = worker_store()
    if key not in store:
        store[key] = Encoder(shared.value)
    return store[key]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Gives doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the decoded text).
    """
    path = vocabulary_path(path)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        encoder = worker_encoder(shared, f"bpe:{path}")
        for batch in by_bytes(batches, "text", SLICE):
            texts = [encoder.words(t) if t else [] for t in batch.column("text").to_pylist()]
            encoder.learn(texts)
            get = encoder.ids.__getitem__
            count, ids, decoded = [], [], []
            for words in texts:
                found = list(map(get, words))
                n, sent, back = zip(*found, strict=True) if found else ((), (), ())
                count.append(sum(n))
                ids.append(hashlib.sha256(b",".join(sent)).hexdigest())
                decoded.append(hashlib.sha256(b"".join(back).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(count, pa.int64()), pa.array(ids), pa.array(decoded)], schema=SCHEMA)

    return bounded(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The ids themselves: doc_id, ids array<int>."""
    path = vocabulary_path(path)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        encoder = worker_encoder(shared, f"bpe:{path}")
        for batch in by_bytes(batches, "text", SLICE):
            ids = [encoder.encode(t) if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return bounded(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def op5(spark, sf_dir) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
