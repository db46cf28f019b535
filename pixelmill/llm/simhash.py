"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint's 64 bits are a ring of 8 segments. If two fingerprints differ in at
most 2 bits, some chain of consecutive segments keeps, at each of its lengths l, at
most l * 2/8 differences: its first three segments agree, and at most one bit differs
in the first seven. So the next two or the two after agree as well, and distinct
fingerprints meet in buckets of 40 agreeing bits, 16 per fingerprint, each bucket for
the chains that start at one segment. Inside a bucket candidates are pruned by the
budgets of the chain's lengths, one after another, and only those that keep all of
them get the full Hamming check; what a bucket prunes meets again where its own chain
starts. Small buckets compare all pairs; larger ones look up the neighbours of each
fingerprint, by the differences that keep the chain. A bucket sends a spanning star of
each group, never its pairs.

Defined cases: null, empty and blank texts have fingerprint zero and link like any
other; a null doc_id sorts last and stays null in the result; rows that share a
doc_id, or have none, are each judged by their own text;
repeated rows stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import NO_ID, bounded, by_bytes, cut, partitions, with_id
from pixelmill.llm.components import components

SEGMENTS, BITS, MOST = 8, 8, 2
SEED = 42
DENSE = 256  # fingerprints up to which a bucket compares all pairs
SLICE = 4 << 20


def fingerprint(text: bytes, size: int = 3) -> int:
    """The bits set in over half the hashes of a text's word shingles."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return hashed(line, SEED)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return majority(np.array([hashed(line[a : b - 1], SEED) for a, b in zip(starts, starts[size:], strict=False)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of some hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 3, sha=None) -> DataFrame:
    """(_id, fp): the fingerprint of every whole text as a signed 64-bit number; with ``sha``, that column as _sha."""
    more = [] if sha is None else ["_sha"]

    def run(batches):
        for batch in by_bytes(batches, "text", SLICE):
            found = np.array([fingerprint((t or "").encode(), size) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found.view(np.int64)), *[batch.column(n) for n in more]], names=["_id", "fp", *more])

    kept = [] if sha is None else [sha.alias("_sha")]
    return with_id(bounded(docs)).select("_id", F.col("text").cast("string").alias("text"), *kept).mapInArrow(run, "_id long, fp long" + "".join(f", {n} string" for n in more))


def chained(apart: np.ndarray, start: int, most: int = MOST) -> np.ndarray:
    """Which differences (as places in ``apart``) keep the budgets of the chain from segment ``start`` at lengths 1 to 7."""
    turn = start * BITS
    turned = apart if not turn else (apart << np.uint64(turn)) | (apart >> np.uint64(64 - turn))
    kept = np.arange(len(apart))
    for length in range(1, SEGMENTS):
        part = turned[kept] >> np.uint64(64 - length * BITS)
        kept = kept[np.bitwise_count(part).astype(np.int64) * SEGMENTS <= most * length]
    return kept


def candidates(fp: np.ndarray, start: int):
    """Pairs of places (i, j) of a bucket whose difference keeps the chain from segment ``start``."""
    n = len(fp)
    if n <= DENSE:
        i, j = np.triu_indices(n, 1)
        kept = chained(fp[i] ^ fp[j], start)
        return i[kept], j[kept]
    order = np.argsort(fp)
    ranked = fp[order]
    free = int(np.bitwise_or.reduce(ranked ^ ranked[0]))
    bits = [np.uint64(1 << b) for b in range(64) if free >> b & 1]
    masks = np.array([*bits, *(a | b for k, a in enumerate(bits) for b in bits[:k])], np.uint64)
    left, right = [], []
    for mask in masks[chained(masks, start)]:
        other = ranked ^ mask
        at = np.minimum(np.searchsorted(ranked, other), n - 1)
        ok = np.flatnonzero((ranked[at] == other) & (other > ranked))
        left.append(order[ok])
        right.append(order[at[ok]])
    return np.concatenate(left), np.concatenate(right)


def _linked(fp: np.ndarray, start: int) -> np.ndarray:
    """Group number of each fingerprint of a bucket (the place of its group's first)."""
    group = np.arange(len(fp))
    i, j = candidates(fp, start)
    near = np.bitwise_count(fp[i] ^ fp[j]) <= MOST
    i, j = i[near], j[near]
    while len(i):
        low = np.minimum(group[i], group[j])
        new = group.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == group).all():
            break
        group = new
    return group


def links(distinct: DataFrame) -> DataFrame:
    """Spanning links (a, b) between the representatives of distinct fingerprints (fp, rep)."""
    keys = []
    for start in range(SEGMENTS):
        turned = F.col("fp") if not start else F.shiftleft("fp", start * BITS).bitwiseOR(F.shiftrightunsigned("fp", 64 - start * BITS))
        head = F.shiftrightunsigned(turned, 40)
        for half, shift in ((0, 24), (1, 8)):
            tail = F.shiftrightunsigned(turned, shift).bitwiseAND(F.lit(0xFFFF))
            keys.append(F.lit((2 * start + half) << 40).bitwiseOR(F.shiftleft(head, 16).bitwiseOR(tail)))
    dealt = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp", "rep").repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def bucket(start, fp, rep):
        group = _linked(fp, start)
        least = np.full(len(fp), NO_ID, np.int64)
        np.minimum.at(least, group, rep)
        other = least[group] != rep
        return rep[other], least[group][other]

    def run(batches):
        rest = None
        for batch in batches:
            key, fp, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if rest is not None:
                key, fp, rep = (np.concatenate(x) for x in zip(rest, (key, fp, rep), strict=True))
            if not len(key):
                continue
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            last = heads[-1]
            yield from closed(key[:last], fp[:last], rep[:last], heads[:-1])
            rest = key[last:], fp[last:], rep[last:]
        if rest is not None:
            yield from closed(*rest, np.zeros(1, np.int64))

    def closed(key, fp, rep, heads):
        ends = np.append(heads[1:], len(key))
        several = np.flatnonzero(ends - heads > 1)
        pairs = several[ends[several] - heads[several] == 2]
        at, starts = heads[pairs], key[heads] >> 41
        apart = fp[at].view(np.uint64) ^ fp[at + 1].view(np.uint64)
        found = [(rep[:0], rep[:0])]
        for start in range(SEGMENTS):
            mine = np.flatnonzero(starts[pairs] == start)
            mine = mine[chained(apart[mine], start)]
            mine = at[mine[np.bitwise_count(apart[mine]) <= MOST]]
            found.append((rep[mine], rep[mine + 1]))
        for g in several[ends[several] - heads[several] > 2].tolist():
            part = slice(heads[g], ends[g])
            found.append(bucket(int(starts[g]), fp[part].view(np.uint64), rep[part]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _classes(found: DataFrame) -> DataFrame:
    """(fp, root, component) of every distinct fingerprint of ``found`` (_id, fp).

    Fingerprints are the nodes, as several of them may share a doc_id or have none;
    root names a group, and component is its smallest doc_id.
    """
    distinct = cut(found.groupBy("fp").agg(F.min("_id").alias("rep")))
    named = components(links(distinct.select("fp", F.col("fp").alias("rep"))))
    rooted = cut(distinct.join(named, distinct.fp == named.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    return rooted.select("fp", "root").join(least, "root")


def simhash_dedup(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links of 2 bits or fewer)."""
    found = cut(fingerprints(docs, size))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.join(_classes(found), "fp").select(null("_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), null("component").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 3) -> DataFrame:
    """One row of ``docs``, with all its columns, of each group of near-duplicates.

    The row with the smallest doc_id stays (null last, then by a digest of the text), so
    groups are told apart by their texts even where rows share a doc_id or have none;
    null-id rows whose texts aren't near each other all stay.
    """
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    found = cut(fingerprints(docs, size, sha))
    # a text's digest settles its fingerprint, so (_id, _sha) names equal rows of one group
    chosen = found.join(_classes(found), "fp").groupBy("root").agg(F.min(F.struct("_id", "_sha")).alias("first")).select("first.*")
    return rows_of(docs, sha, chosen)


def rows_of(docs: DataFrame, sha, chosen: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of ``chosen`` (_id, _sha), where ``sha`` is the digest of the text."""
    names = docs.columns
    marked = with_id(docs.select(*[F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)], sha.alias("_sha"), F.col("doc_id")))
    kept = marked.join(chosen, ["_id", "_sha"], "left_semi").dropDuplicates(["_id", "_sha"])
    return kept.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])


def op9(spark, sf_dir) -> DataFrame:
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
