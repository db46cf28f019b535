"""Near copies by SimHash and the Jaccard similarity of word shingles, with no link left to chance.

Two texts link if their sets of 5-word shingles have a Jaccard similarity of 4/5 or
more. Candidates come first from ``simhash``: fingerprints of the sets, the pigeonring
filter and the Hamming check. A bit budget can't stand for the rule alone (near copies
differ in a dozen bits and more, where unrelated texts begin to meet), so a prefix
filter gives the rest, and with it no link is lost: with any one order of all shingles,
two linked sets share a shingle among the first n - ceil(4n/5) + 1 of each. Shingles
that are frequent come last: those of all texts are counted in BINS bins by their hash,
and the fuller bin comes later; the counts only decide how many candidates there are.
Every candidate, wherever it comes from, is judged by its whole sets, unless
a bound says before that they can't link: with the shingles counted in classes by their
hash, two sets share no more than the lesser counts add up to. CLASSES classes settle
most pairs; those that are left are settled by a class for every other shingle. Inside
large buckets a signature settles most before they are sent: a bit for each of 256
classes, odd or even, as every shingle that only one of two sets has turns one bit.

Equal sets are one node. Nodes that share a prefix shingle are compared by size and
place first. Large buckets send pairs with a few leaders, and, after these are judged,
only pairs of different groups, so that a bucket of one group costs nothing more.

Defined cases: words are those of ``fingerprint``; a text of one to four words is one
shingle; null, empty and blank texts are near copies of each other and of nothing else;
shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import bounded, by_bytes, cut, drop_cut, in_blocks, mixed, partitions, release, summed, tidy, with_id
from pixelmill.llm.components import components
from pixelmill.llm.simhash import SEED, links, majority, rows_of

LEAST = 4, 5  # the similarity from which texts link, as a fraction
BINS = 1 << 20  # bins that the shingles of all texts are counted in
MOST_COUNT = (1 << 32) - 1
SAMPLE = None  # texts that are counted, for tests of other orders; None for all
SMALL, LEADERS = 8, 4  # nodes up to which a bucket sends all pairs at once; leaders of a larger one
BLOCK = 1 << 18  # rows that a bucket step sends at a time
SLICE = 1 << 20
CLASSES, MOST_CLASSES = 64, 4096  # classes that shingles are counted in
FULL = 255  # the count that stands for more
SIGNED = ("s0", "s1", "s2", "s3")
MOST_BROADCAST = 1_000_000  # keys of wanted texts, 16 bytes each; for more of them all texts are joined by a shuffle


def shingles(text: bytes, size: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    n = max(1, len(hashed) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(hashed))):
        out = mixed(out + hashed[k : k + n]) + np.uint64(k + 1)
    return np.unique(out)


def _bin(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(BINS - 1)).astype(np.int64)


def _prefix(found: np.ndarray, common: np.ndarray, least) -> np.ndarray:
    """The shingles of a set that a linked set must share one of, in the order of all shingles."""
    p, q = least
    if not len(found):
        return found
    return found[np.lexsort((found, common[_bin(found)]))][: len(found) - -(-p * len(found) // q) + 1]


def _common(docs: DataFrame, size: int) -> np.ndarray:
    """How many shingles of all texts are in each bin."""

    def run(batches):
        total = np.zeros(BINS, np.int64)
        for batch in by_bytes(batches, "text", SLICE):
            found = [shingles((t or "").encode(), size) for t in batch.column("text").to_pylist()]
            total += np.bincount(_bin(np.concatenate(found)), minlength=BINS)
        if total.any():
            yield from in_blocks(0, np.minimum(total, MOST_COUNT).astype(np.uint32))

    texts = bounded(docs).select(F.col("text").cast("string").alias("text"))
    if SAMPLE is not None:
        texts = texts.limit(SAMPLE)
    total = summed(texts.mapInArrow(run, "k long, part long, v binary"), np.uint32)
    return np.minimum(total, MOST_COUNT).astype(np.uint32) if len(total) else np.zeros(BINS, np.uint32)


def _counts(found: np.ndarray, classes: int) -> bytes:
    """How many shingles of a set are in each class, a power of two of them."""
    return np.minimum(np.bincount((found % np.uint64(classes)).astype(np.int64), minlength=classes), FULL).astype(np.uint8).tobytes()


def _signature(found: np.ndarray) -> np.ndarray:
    """Whether each of 256 classes has an odd number of a set's shingles, as four numbers."""
    odd = np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _shared_at_most(a: bytes, b: bytes) -> int:
    """A bound on how many shingles two sets share, from their counts; more than any set has where a count is full."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if max(x.max(), y.max()) == FULL:
        return 1 << 40
    least = min(len(x), len(y))
    x, y = (v.reshape(-1, least).sum(axis=0, dtype=np.int64) for v in (x, y))
    return int(np.minimum(x, y).sum())


def _sets(docs: DataFrame, sha, common, size: int, least) -> DataFrame:
    """(_id, _sha, node, fp, n, s0 to s3, counts, fine, prefix) of every row."""

    def run(batches):
        for batch in by_bytes(batches, "text", SLICE):
            found = [shingles((t or "").encode(), size) for t in batch.column("text").to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found], np.uint64).view(np.int64)
            fp = np.array([majority(x) if len(x) else 0 for x in found], np.uint64).view(np.int64)
            counts, fine = (pa.array([_counts(x, c or max(CLASSES, min(MOST_CLASSES, 1 << (len(x) // 2).bit_length()))) for x in found], pa.binary()) for c in (CLASSES, 0))
            prefix = pa.array([_prefix(x, common, least).view(np.int64) for x in found], pa.list_(pa.int64()))
            signed = map(pa.array, np.array([_signature(x) for x in found], np.int64).reshape(-1, 4).T.copy())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_sha"), pa.array(node), pa.array(fp), pa.array([len(x) for x in found], pa.int32()), *signed, counts, fine, prefix], names=["_id", "_sha", "node", "fp", "n", *SIGNED, "counts", "fine", "prefix"])

    return with_id(bounded(docs)).select("_id", sha.alias("_sha"), F.col("text").cast("string").alias("text")).mapInArrow(run, "_id long, _sha string, node long, fp long, n int, s0 long, s1 long, s2 long, s3 long, counts binary, fine binary, prefix array<long>")


def _buckets(table: DataFrame, body, names: str) -> DataFrame:
    """``body`` of each bucket of ``table`` (h, n, node, pos, ...) with several rows, which it gets as arrays, smallest n first."""
    dealt = table.repartition(partitions(table.sparkSession), "h").sortWithinPartitions("h", "n", "node")
    fields = [x.split()[0] for x in names.split(", ")]

    def closed(columns, heads):
        ends, found, held = np.append(heads[1:], len(columns[0])), [], 0
        for g in np.flatnonzero(ends - heads > 1).tolist():
            for out in body(*(x[heads[g] : ends[g]] for x in columns)):
                found.append(out)
                held += len(out[0])
                if held > BLOCK or len(found) >= 4096:
                    yield packed(found)
                    found, held = [], 0
        if found:
            yield packed(found)

    def packed(found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=fields)

    def run(batches):
        rest = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            h = columns[0]
            if not len(h):
                continue
            heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            yield from closed([x[: heads[-1]] for x in columns], heads[:-1])
            rest = [x[heads[-1] :] for x in columns]
            release()
        if rest is not None:
            yield from closed(rest, np.zeros(1, np.int64))

    return dealt.mapInArrow(run, names)


def _fits(n, pos, i, j, least) -> np.ndarray:
    """Whether sets of these sizes can link if the shingle at these places is their first common one."""
    p, q = least
    most = np.minimum(n[i] - pos[i], n[j] - pos[j])
    return (p + q) * most >= p * (n[i] + n[j])


def _possible(pairs: DataFrame, nodes: DataFrame, least) -> DataFrame:
    """The pairs (a, b) whose sets may link by the counts of their classes (nodes: node, n, counts)."""
    p, q = least
    one, two = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("counts").alias(f"c{x}")) for x in "ab")

    def run(batches):
        for batch in batches:
            most = np.array([_shared_at_most(a, b) for a, b in zip(batch.column("ca").to_pylist(), batch.column("cb").to_pylist(), strict=True)], np.int64)
            n = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(most * (p + q) >= n * p))
            release()

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def _judged(pairs: DataFrame, sets: DataFrame, least) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, s) link."""
    p, q = least
    one, two = (sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(one, "a").join(two, "b").where(both * (p + q) >= (F.size("sa") + F.size("sb")) * p).select("a", "b")


def _fingerprinted(nodes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of ``nodes`` (node, fp): those of one fingerprint with the least of them, and what ``simhash`` links."""
    distinct = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    same = nodes.join(distinct, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    return same.unionByName(links(distinct).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def one_of_each(docs: DataFrame, size: int = 5, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row of ``docs``, with all its columns, of each group of near copies.

    Groups are what chains of links reach. The row with the smallest doc_id stays (null
    last, then by a digest of the text), as in ``simhash.one_of_each``.
    """
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    found = _sets(docs, sha, _common(docs, size), size, least)
    nodes = cut(found.groupBy("node").agg(F.min(F.struct("_id", "_sha")).alias("first"), F.first("fp").alias("fp"), *[F.first(x).alias(x) for x in ("n", *SIGNED, "counts", "fine", "prefix")]))
    places = nodes.select(F.posexplode("prefix").alias("pos", "h"), "n", "node").select("h", "n", "node", "pos")

    def with_size(h, *more):
        yield h, *more, np.full(len(h), len(h), np.int32)

    shared = cut(_buckets(places, with_size, "h long, n int, node long, pos int, m int"))
    whole, spark = nodes, docs.sparkSession
    nodes = cut(whole.drop("prefix"))
    drop_cut(whole)
    del found, places, whole
    tidy(spark)

    def first_pairs(h, n, node, pos):
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        if len(n) <= SMALL:
            i, j = np.triu_indices(len(n), 1)
        else:
            leaders = np.argsort(mixed(node.view(np.uint64)))[:LEADERS]
            i, j = np.repeat(leaders, len(n)), np.tile(np.arange(len(n)), len(leaders))
        on = (i != j) & _fits(n, pos, i, j, least)
        a, b = node[i[on]], node[j[on]]
        yield np.minimum(a, b), np.maximum(a, b)

    def other_pairs(h, n, node, pos, root, *signed):
        p, q = least
        n, pos, signed = n.astype(np.int64), pos.astype(np.int64), np.stack(signed, axis=1).view(np.uint64)
        roots, which, many = np.unique(root, return_inverse=True, return_counts=True)
        main = which == np.argmax(many)  # of the largest group, which needs no pairs of its own
        begin = np.searchsorted(n, -(-n * p // q), side="left")  # smaller and larger sets link with none
        end = np.searchsorted(n, n * q // p, side="right")
        for k in np.flatnonzero(~main).tolist():
            j = np.arange(begin[k], end[k])
            j = j[(root[j] != root[k]) & (main[j] | (j > k))]
            j = j[_fits(n, pos, k, j, least)]
            apart = np.bitwise_count(signed[j] ^ signed[k]).sum(axis=1, dtype=np.int64)
            j = j[apart * (p + q) <= (q - p) * (n[j] + n[k])]
            if len(j):
                yield np.minimum(node[j], node[k]), np.maximum(node[j], node[k])

    def judged(pairs, first: bool):
        pairs = rough = pairs.distinct()
        if first:
            pairs = rough = cut(_possible(pairs, nodes.select("node", "n", "counts"), least))
        pairs = cut(_possible(pairs, nodes.select("node", "n", F.col("fine").alias("counts")), least))
        drop_cut(rough)
        tidy(spark)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "first.*"), "node")

        def run(batches):
            for batch in by_bytes(batches, "text", SLICE):
                s = [shingles((t or "").encode(), size).view(np.int64) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(s, pa.list_(pa.int64()))], names=["node", "s"])

        texts = with_id(bounded(docs)).select("_id", sha.alias("_sha"), F.col("text").cast("string").alias("text"))
        key = F.xxhash64("_id", "_sha").alias("_key")
        wanted = cut(wanted)
        if wanted.count() <= MOST_BROADCAST:  # the join by (_id, _sha) then moves little else than wanted texts
            texts = texts.select("*", key).join(F.broadcast(wanted.select(key).distinct()), "_key", "left_semi").drop("_key")
        sets = cut(texts.join(wanted, ["_id", "_sha"]).dropDuplicates(["node"]).select("node", "text").mapInArrow(run, "node long, s array<long>"))
        linked = cut(_judged(pairs, sets, least))
        for done in (sets, pairs, wanted):
            drop_cut(done)
        tidy(spark)
        return linked

    pair = "a long, b long"
    found_links = judged(_buckets(shared.drop("m"), first_pairs, pair).unionByName(_fingerprinted(nodes.select("node", "fp"))), True)
    named = cut(components(found_links))
    grouped = nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("root"), *SIGNED)
    rooted = shared.where(F.col("m") > SMALL).join(grouped, "node").select("h", "n", "node", "pos", "root", *SIGNED)
    named = components(found_links.unionByName(judged(_buckets(rooted, other_pairs, pair), False)))
    chosen = nodes.join(named, "node", "left").groupBy(F.coalesce("component", "node").alias("root")).agg(F.min("first").alias("first")).select("first.*")
    return rows_of(docs, sha, chosen)
