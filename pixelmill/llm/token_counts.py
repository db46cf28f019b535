"""Exact token counts at every prefix of a text, by dynamic programming.

For a word w (a pre-token) let c[j] be the number of tokens of its first j bytes.
Byte-pair encoding has exactly one last token t for each prefix: the vocabulary entry
that ends there and stands unchanged beside the last token of the prefix before it.
So c[j] = c[j - len(t)] + 1, and one pass over the word stores the counts of all its
prefixes. A text's counts are those of its words, added up, so a budget or a
truncation is answered from the stored counts without encoding again. The new words of
a slice of documents are taken in sorted order, where each starts with what it shares
with the word before it, so a shared prefix is reckoned once. Words used lately stay
known: when the younger of two caches is full it takes the place of the older one.

Cutting a text may change how its end is split into words, in three ways that are known
beforehand: a prefix that ends in white space ends in one word of all of it; half a
contraction is an apostrophe and a letter; part of an added token is plain text. So
the counts at all prefixes take one pass over the text.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); strings of added
tokens count as one token; a null doc_id stays null; repeated rows and other columns
make no difference; a budget under 0 keeps nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from pixelmill.llm.bpe import SLICE, Encoder, encode_words, read_vocabulary, vocabulary_path
from pixelmill.llm.common import bounded, by_bytes, worker_store

CACHE = 1_000_000  # pairs of tokens; a quarter as many words in each of two caches
CACHE_BYTES = 4 << 20  # bytes of the words whose tables are kept in each of them, 1 byte for each or 8 in long words
CONTRACTION = ("'re", "'ve", "'ll")  # fixed values: those of the pre-tokenizer that a cut can halve


class PrefixCounts:
    """Prefix tables of words, kept in a bounded cache; one per Python worker."""

    def __init__(self, vocabulary: dict):
        import regex

        self.base = Encoder(vocabulary)
        added = set(vocabulary["added"].values())
        self.ids = {t: i for i, t in enumerate(vocabulary["tokens"]) if t and i not in added}
        self.rank = {pair: rank for pair, (rank, _) in self.base.merges.items()}
        self.made = {rank: made for rank, made in self.base.merges.values()}
        self.none = len(self.made) + max(self.made, default=0)  # above all ranks
        self.beside: dict[bytes, dict[bytes, bool]] = {}
        self.pairs = 0
        self.known: dict[str, bytes | list[int]] = {}
        self.older: dict[str, bytes | list[int]] = {}
        self.held = 0
        self.blank = regex.compile(r"\s+").finditer
        # a token that its own encoding splits up can't be a last token
        whole = encode_words(list(self.ids), self.base.merges, self.base.single)
        self.tokens = {t: t for t, ids in zip(self.ids, whole, strict=True) if len(ids) == 1}
        sizes: dict[bytes, set[int]] = {}
        for t in self.tokens:
            if len(t) > 2:
                sizes.setdefault(t[-3:], set()).add(len(t))
        # lengths of the tokens that may end in these three bytes, longest first
        self.sizes = {end: (*sorted(found, reverse=True), 2, 1) for end, found in sizes.items()}

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens side by side are their own encoding: no merge reaches over the edge between them."""
        symbols = list(map(self.base.single.__getitem__, left + right))
        edge, rank, none = len(left), self.rank.get, self.none
        ranks = [rank(pair, none) for pair in zip(symbols, symbols[1:], strict=False)]
        while (least := min(ranks)) < none:
            k = ranks.index(least)
            if k == edge - 1:
                return False
            edge -= k < edge
            symbols[k : k + 2] = [self.made[least]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank((symbols[k], symbols[k + 1]), none)
            if k:
                ranks[k - 1] = rank((symbols[k - 1], symbols[k]), none)
        return symbols == [self.ids[left], self.ids[right]]

    def of_words(self, words):
        """Of each word the number of tokens of its first 0, 1, ... bytes; sorted words share what is reckoned."""
        count, near, before = [0], [{}], b""  # near: of the last token of a prefix, the tokens tried beside it
        token_of, sizes_of = self.tokens.get, self.sizes.get
        for word in words:
            same = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                same += 1
            del count[same + 1 :], near[same + 1 :]
            if self.pairs > CACHE:
                self.beside, self.pairs = {}, 0
            for j in range(same + 1, len(word) + 1):
                for size in sizes_of(word[j - 3 : j], (2, 1)) if j > 2 else (2, 1):
                    i = j - size
                    if i < 0 or (token := token_of(word[i:j])) is None:
                        continue
                    if i:
                        tried, left = near[i]
                        fits = tried.get(token)
                        if fits is None:
                            fits = tried[token] = self.fits(left, token)
                            self.pairs += 1
                        if not fits:
                            continue
                    count.append(count[i] + 1)
                    found = self.beside.get(token)
                    if found is None:
                        found = self.beside[token] = {}
                    near.append((found, token))
                    break
                else:
                    raise ValueError(f"no token ends at byte {j} of {word!r}")
            before = word
            yield bytes(count) if count[-1] < 256 else list(count)

    def of_word(self, word: bytes) -> list[int]:
        """Number of tokens of the first 0, 1, ... bytes of a word."""
        return list(next(self.of_words([word])))

    def learn(self, words: set[str]) -> None:
        """Put the tables of all ``words`` into the younger cache."""
        if len(self.known) > CACHE // 4 or self.held > CACHE_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
        known, new = self.known, []
        for w in words - known.keys():
            if w in self.base.added:
                known[w] = b"\0\1"
            elif (found := self.older.get(w)) is not None:
                known[w] = found
                self.held += len(found)
            else:
                new.append(w)
        new.sort()  # UTF-8 has the order of code points
        for w, found in zip(new, self.of_words(map(str.encode, new)), strict=True):
            known[w] = found
            self.held += len(found)

    def table(self, word: str) -> bytes | list[int]:
        found = self.known.get(word)
        if found is None:
            self.learn({word})
            found = self.known[word]
        return found

    def count(self, text: str) -> int:
        return sum(self.table(w)[-1] for w in self.base.words(text))

    def steps(self, text: str):
        """Token counts of text[:1], text[:2], ... text[:len(text)], each with a number that no longer prefix falls below."""
        base, before = 0, ""  # tokens up to the last plain part, and that part
        parts = self.base.split(text) if self.base.split else [text]
        for k, part in enumerate(parts):
            if k % 2:
                for i in range(1, len(part)):
                    yield base + self.count(before + part[:i]), base
                base += self.count(before) + 1
                yield base, base
                continue
            before, upto = part, 0  # tokens of the whole words before the present one
            floor = last = base  # tokens before the word before the last, and before the last: all that a cut leaves alone
            blanks = {m.start(): m.group() for m in self.blank(part)}
            run = None  # table of the white space that the present one goes on with, its first byte, tokens before it
            at = 0
            for w in self.base.find(part):
                table, size = self.table(w), 0
                for i, c in enumerate(w, 1):
                    if at in blanks:
                        run = self.table(blanks[at]), 0, upto
                        ends = at + len(blanks[at])
                    at += 1
                    wide = len(c.encode())
                    size += wide
                    if run is not None and at <= ends:
                        run = run[0], run[1] + wide, run[2]
                        yield base + run[2] + run[0][run[1]], floor
                    elif i == 2 and w in CONTRACTION:
                        yield base + upto + self.table(w[0])[-1] + self.table(w[1])[-1], floor
                    else:
                        yield base + upto + table[size], floor
                floor, last = last, base + upto
                upto += table[-1]

    def prefixes(self, text: str) -> list[int]:
        """Token counts of text[:0], text[:1], ... text[:len(text)]."""
        return [0, *(n for n, _ in self.steps(text))]

    def fitting(self, text: str, budget: int) -> int:
        """Length of the longest prefix of at most ``budget`` tokens; reads on only while one can still fit."""
        best = 0
        for i, (n, least) in enumerate(self.steps(text), 1):
            if n <= budget:
                best = i
            elif least > budget:
                break
        return best

    def truncated(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        return text[: self.fitting(text, budget)]


def _mapped(docs: DataFrame, body, schema: str, path: str | None) -> DataFrame:
    """``body`` of the worker's tables and each slice of (doc_id, text); it gives the columns of ``schema``."""
    path = vocabulary_path(path)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        store, key = worker_store(), f"counts:{path}"
        if key not in store:
            store[key] = PrefixCounts(shared.value)
        for batch in by_bytes(batches, "text", SLICE):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *body(store[key], texts)], names=names)

    return bounded(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def token_counts(docs: DataFrame, limit: int = 512, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every whole text."""

    def body(counts, texts):
        words = [counts.base.words(text) for text in texts]
        counts.learn(set().union(*words))
        known = counts.known.__getitem__
        tokens = [sum([found[-1] for found in map(known, part)]) for part in words]
        size = [len(text.encode()) for text in texts]
        return pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())

    return _mapped(docs, body, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", path)


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and counts: the tokens of each prefix of the text, by its number of characters from 0."""
    return _mapped(docs, lambda counts, texts: [pa.array([counts.prefixes(t) for t in texts], pa.list_(pa.int32()))], "doc_id long, counts array<int>", path)


def truncated(docs: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """doc_id, text (its longest prefix of at most ``budget`` tokens), n_tokens (of that prefix) and whole (nothing was cut)."""

    def body(counts, texts):
        kept = [counts.truncated(t, budget) for t in texts]
        return pa.array(kept, pa.string()), pa.array([counts.count(t) for t in kept], pa.int64()), pa.array([a == b for a, b in zip(kept, texts, strict=True)], pa.bool_())

    return _mapped(docs, body, "doc_id long, text string, n_tokens long, whole boolean", path)


def op6(spark, sf_dir) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
