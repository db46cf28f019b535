"""Exact verdicts on every fixed-length window of a corpus, by minimiser buckets.

Both duplicate removers ask, of every window of a text, where else its content
starts. Windows of equal content have the same minimiser (the least hash of their
short grams, leftmost on ties), so consecutive windows that share one travel as a
single packed string to the bucket of that minimiser:

1. documents are dealt once by a hash of id and text into blocks of a few megabytes;
   that exchange is used again by every later step;
2. each block sends one row for each of its distinct minimisers; a window function
   tells which of them occur again, in any block, and which are hot;
3. each block sends its distinct packed strings under those minimisers, one row each
   however many of its documents hold them, with the places of their occurrences;
   strings under a hot minimiser are cut into smaller pieces dealt by the content that
   all windows of a piece share;
4. a bucket judges the windows exactly and sends verdicts to the places;
5. each block applies the verdicts to its documents.

Rows grow in proportion to the text, whatever the number of partitions. No step
broadcasts or collects documents, and every step is a plain shuffle that Spark can
recompute when an executor is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.common import bounded, partitions, string_parts, with_id

BLOCK = 4 << 20  # bytes of text in a block, where there are more of it than partitions need
CHUNK = 4 << 20  # bytes of packed strings judged at a time; a minimiser's strings stay together

KEYS = pa.schema([("block", pa.int32()), ("key", pa.int64()), ("runs", pa.int64()), ("several", pa.bool_())])
STRINGS = pa.schema([("key", pa.int64()), ("block", pa.int32()), ("packed", pa.binary()), ("count", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("starts", pa.binary())])
ANSWERS = pa.schema([("block", pa.int32()), ("count", pa.int32()), ("starts", pa.binary()), ("verdict", pa.binary())])
TYPES = {pa.int32(): "int", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {TYPES[f.type]}" for f in schema)


def _documents(found: pa.Table):
    """Ids, bytes and offsets of a block's rows in an order that recomputing doesn't change."""
    found = found.sort_by([("_id", "ascending"), ("text", "ascending")])
    data, at = string_parts(found.column("text"))
    return found.column("_id").to_numpy(), data, at


def _pieces(rule, ids, data, at, keys, hot):
    """Distinct packed strings of a block whose minimiser occurs again: (key, string, count, low, high, starts) of each."""
    view = rule.view(data, at)
    order = np.argsort(keys)
    keys, hot = keys[order], hot[order]
    where = np.minimum(np.searchsorted(keys, view.key), max(len(keys) - 1, 0))
    again = keys[where] == view.key if len(keys) else np.zeros(len(view.key), bool)
    plain = np.flatnonzero(again & ~hot[where]) if len(keys) else np.zeros(0, np.int64)
    split = np.flatnonzero(again & hot[where]) if len(keys) else np.zeros(0, np.int64)
    key, start, count = view.key[plain], view.start[plain], view.count[plain]
    if len(split):
        more = rule.cut(view, split)
        key, start, count = (np.concatenate(x) for x in zip((key, start, count), more, strict=True))
    lo, hi = view.span(start, count)
    text, seen = view.text, {}
    piece = np.fromiter((seen.setdefault(text[a:b], len(seen)) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)), np.int64, len(lo))
    order = np.argsort(piece, kind="stable")
    ends = np.cumsum(np.bincount(piece, minlength=len(seen)))
    first = order[ends - np.bincount(piece, minlength=len(seen))]
    low, high = rule.summed(piece, ids[view.doc_of(start)], len(seen))
    places = start[order].astype(np.int32).tobytes()
    starts = [places[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(seen) else []
    return key[first], list(seen), count[first], low, high, starts


def judged(docs: DataFrame, rule, schema: str, blocks: int | None = None, hot_runs: int = 4096) -> DataFrame:
    """``rule.finish`` applied to every block of ``docs`` (doc_id, text) with the verdicts on its windows.

    blocks: how many blocks documents are dealt into; unless given, 4 per shuffle
    partition or as many as hold BLOCK bytes each, whichever is more. hot_runs: a
    minimiser with more packed strings than this is cut finer.
    """
    many = partitions(docs.sparkSession)
    rows = with_id(bounded(docs)).select("_id", F.col("text").cast("string").alias("text"))
    if blocks is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(4 * many, -(-size // BLOCK))
    source = rows.withColumn("block", F.pmod(F.xxhash64("_id", "text"), F.lit(blocks)).cast("int")).repartition(many, "block")

    def keys_of(block: pa.Table) -> pa.Table:
        ids, data, at = _documents(block)
        key, runs, several = rule.keys(rule.view(data, at), ids)
        name = np.full(len(key), block.column("block")[0].as_py(), np.int32)
        return pa.table([name, key.view(np.int64), runs.astype(np.int64), several.astype(bool)], schema=KEYS)

    def strings_of(block: pa.Table, again: pa.Table) -> pa.Table:
        if not block.num_rows or not again.num_rows:
            return STRINGS.empty_table()
        keys, hot = again.column("key").to_numpy().view(np.uint64), again.column("hot").to_numpy(zero_copy_only=False)
        key, strings, count, low, high, starts = _pieces(rule, *_documents(block), keys, hot)
        name = np.full(len(key), block.column("block")[0].as_py(), np.int32)
        return pa.table([key.view(np.int64), name, pa.array(strings, pa.binary()), count.astype(np.int32), low, high, pa.array(starts, pa.binary())], schema=STRINGS)

    def told(found: pa.Table):
        key, count, low, high = (found.column(c).to_numpy() for c in ("key", "count", "low", "high"))
        verdicts = list(rule.judge(key.view(np.uint64), found.column("packed").to_pylist(), count.astype(np.int64), low, high))
        if verdicts:
            kept = found.select(["block", "count", "starts"]).take(pa.array([i for i, _ in verdicts], pa.int64()))
            yield from kept.append_column("verdict", pa.array([v for _, v in verdicts], pa.binary())).cast(ANSWERS).to_batches(max_chunksize=10_000)

    def verdicts_of(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < CHUNK:
                continue
            found = pa.Table.from_batches(held)
            key = found.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last minimiser may go on in the next batch
            if whole:
                yield from told(found.slice(0, whole))
            held = found.slice(whole).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held) if whole else 0
        if held:
            yield from told(pa.Table.from_batches(held))

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return rule.nothing()
        starts = [np.frombuffer(x, np.int32) for x in answers.column("starts").to_pylist()]
        return rule.finish(*_documents(block), starts, answers.column("count").to_pylist(), answers.column("verdict").to_pylist())

    of_key = Window.partitionBy("key")  # at most a row for each block
    keys = source.groupBy("block").applyInArrow(keys_of, _ddl(KEYS)).repartition(many, "key")
    keys = keys.select("block", "key", F.count("*").over(of_key).alias("n"), F.sum("runs").over(of_key).alias("total"), F.max("several").over(of_key).alias("several"))
    again = keys.where("n > 1 or several").select("block", "key", (F.col("total") > hot_runs).alias("hot")).repartition(many, "block")
    strings = source.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(strings_of, _ddl(STRINGS))
    verdicts = strings.repartition(many, "key").sortWithinPartitions("key").mapInArrow(verdicts_of, _ddl(ANSWERS)).repartition(many, "block")
    return source.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(finish, schema)
