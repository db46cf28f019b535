"""Quality classifier by Bradley-Terry pairwise ranking.

Document scores are linear in features of the whole text: what its words are (single
words and pairs, hashed into BUCKETS shares) and how it looks (surface measures). They
are learnt from preference pairs (a document labelled 1 over one labelled 0): the
probability that the first wins is the logistic of the difference of scores, so the
weights minimise the logistic loss on feature differences. The threshold is a quantile
of the scores of the labelled rows, the one that separates them best; a score is the
logistic of a document's distance from it.

Scale, weights and threshold come from every labelled row outside the held-out third.
Their features are written once, dealt by a hash of doc_id into groups of about GROUP
rows, and all pairs of a group are preferences. Each round of Newton's method is one
pass over the groups, whose slopes and curvatures are summed by the executors; what
reaches the driver is as large as the model, whatever the number of labels. Where a
class is too rare for FEW of its rows a group, each of them is dealt to several groups.

Defined cases: null and empty texts have all features zero and get a score like any
other; a null doc_id is never a labelled row and isn't held out; labels other than 0
and 1 are ignored, and so is a doc_id that is labelled both; of rows that share a
labelled doc_id one is learnt from (the least by its features); without rows of both
labels every score is 0.5; repeated rows get equal scores; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.common import bounded, by_bytes, cut, drop_cut, filtered, in_blocks, mixed, partitions, release, string_parts, summed, tidy
from pixelmill.llm.substring_dedup import joined_words, word_hashes, words_of

SLICE = 1 << 20  # of text, whose words take some fifty times as much while they are hashed
ROWS = 512  # texts whose features are held at a time
BUCKETS = 512  # hashed shares of words and word pairs
WIDE = 20 + BUCKETS  # numbers of a row: surface measures, then shares
GROUP, FEW = 1024, 32  # labelled rows that are compared with each other; the least of the rarer class among them
GROUPS = 8  # groups of a task, which sends one sum
MOST_BROADCAST = 1_000_000  # labels sent to all workers, 12 bytes each; for more of them texts are joined by a shuffle
LEXICAL = 0.1  # weight of a share beside a surface measure, each scaled to its own spread
RUN = re.compile(r"([!#$%&*|.?=~_^-])\1+")
NAMES = ("length", "word", "long_words", "upper", "title", "punctuation", "symbols", "digits", "bars", "exclaims", "runs", "distinct", "most_common", "repeats", "line", "line_repeats", "unclosed", "sentence", "letters", "white")


def surface(text: str) -> list[float]:
    """Surface features of a whole text, most of them shares between 0 and 1."""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    white = sum(map(text.count, " \n\t\r"))
    digits = sum(map(text.count, "0123456789"))
    other = max(0, size - letters - white - digits)
    symbols = sum(map(text.count, "#$%&*@^~|<>{}[]\\=+_"))
    ends = sum(map(text.count, ".?!"))
    return [
        np.log1p(n) / 10,
        min(letters / n, 20) / 20,
        sum(len(w) > 12 for w in words) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        other / size,
        symbols / size,
        digits / size,
        text.count("|") / n,
        text.count("!") / n,
        len(RUN.findall(text)) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        min(n / len(lines), 200) / 200,
        1 - len(set(lines)) / len(lines),
        sum(not x.rstrip().endswith((".", "!", "?", '"', ":")) for x in lines) / len(lines),
        min(n / (ends + 1), 100) / 100,
        letters / size,
        white / size,
    ]


def lexical(column) -> np.ndarray:
    """Root shares of hashed words and word pairs of each text (A-Z lower-cased), BUCKETS of them."""
    raw, at = string_parts(column)
    data = np.where((raw >= 0x41) & (raw <= 0x5A), raw + 32, raw).astype(np.uint8)
    first, last, before = words_of(data, at)
    h = word_hashes(*joined_words(data, first, last))
    doc = np.repeat(np.arange(len(at) - 1), np.diff(before))
    pair = doc[1:] == doc[:-1]
    two = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[pair] if len(h) else h
    place = np.concatenate([doc, doc[1:][pair]]) * BUCKETS + (np.concatenate([h, two]) % np.uint64(BUCKETS)).astype(np.int64)
    found = np.bincount(place, minlength=(len(at) - 1) * BUCKETS).reshape(-1, BUCKETS)
    return np.sqrt(found / np.maximum(found.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def features(column) -> np.ndarray:
    """Features of each text of a string column: surface measures, then hashed shares."""
    looks = np.array([surface(t or "") for t in column.to_pylist()], np.float32).reshape(-1, len(NAMES))
    return np.concatenate([looks, lexical(column)], axis=1)


def scaled(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((x - model["centre"]) / model["spread"], -8, 8)
    z[:, len(NAMES) :] *= LEXICAL
    return z


def scored(batch, model: dict) -> np.ndarray:
    """Distance of each text's score from the threshold."""
    column = batch.column("text")
    parts = [scaled(features(column.slice(i, ROWS)), model) @ model["weights"] for i in range(0, len(column), ROWS)]
    return np.concatenate(parts).astype(float) - model["threshold"]


def fit_pairs(groups: DataFrame, model: dict, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights of the Bradley-Terry model over all pairs of each of ``groups``, by Newton's method.

    The loss is the mean over pairs of log(1 + exp(-difference of scores)), plus half
    the ridge times the square of the weights. A step that doesn't lower it is halved.
    """
    upper = np.triu_indices(WIDE)

    def terms(good, bad, w):  # number of pairs, loss, slope and curvature of a group
        apart = (good @ w)[:, None] - bad @ w
        p = 1 / (1 + np.exp(np.clip(apart, -40, 40)))
        one, two, curve = good.astype(np.float32), bad.astype(np.float32), (p * (1 - p)).astype(np.float32)
        cross = one.T @ (curve @ two)
        bend = one.T @ (one * curve.sum(axis=1)[:, None]) + two.T @ (two * curve.sum(axis=0)[:, None]) - cross - cross.T
        return np.concatenate([[p.size, np.logaddexp(0, -apart).sum()], p.sum(axis=1) @ good - p.sum(axis=0) @ bad, bend[upper]])

    def over(w):
        return _over_groups(groups, lambda good, bad: terms(scaled(good, model).astype(float), scaled(bad, model).astype(float), w))

    w, step, share, last = np.zeros(WIDE), np.zeros(WIDE), 1.0, np.inf
    for _ in range(rounds):
        found = over(w + share * step)
        n, now = found[0], found[1] / found[0] + ridge / 2 * np.sum((w + share * step) ** 2)
        if now > last and share > 1e-4:
            share /= 2
            continue
        w, last, share = w + share * step, now, 1.0
        curve = np.zeros((WIDE, WIDE))
        curve[upper] = found[2 + WIDE :] / n
        curve = curve + np.triu(curve, 1).T + ridge * np.eye(WIDE)
        step = np.linalg.solve(curve, found[2 : 2 + WIDE] / n - ridge * w)
        if np.abs(step).max() < 1e-5:
            return w + step
    return w


def _over_groups(groups: DataFrame, body) -> np.ndarray:
    """The sum over ``groups`` of what ``body`` makes of the rows of each, those labelled 1 and those labelled 0."""

    def run(batches):
        part, total = None, None
        for batch in batches:
            for g, good, bad in zip(*(batch.column(n).to_pylist() for n in ("g", "good", "bad")), strict=True):
                found = body(*(np.frombuffer(x, np.float32).reshape(-1, WIDE) for x in (good, bad)))
                part, total = (g, found) if total is None else (min(part, g), total + found)
            release()
        if total is not None:
            yield from in_blocks(part, total)

    return summed(groups.mapInArrow(run, "k long, part long, v binary"), np.float64)


def _groups(docs: DataFrame, named: DataFrame) -> tuple[DataFrame | None, np.ndarray]:
    """(g, good, bad): the features of all labelled rows (named: doc_id, quality) by group; and how often a row of each label is in it."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    counts = {r.quality: r["count"] for r in named.join(known, "doc_id", "left_semi").groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None, np.zeros(2)
    many = -(-sum(counts.values()) // GROUP)
    copies = [min(many, max(1, -(-FEW * many // counts[q]))) for q in (0, 1)]

    def run(batches):
        for batch in by_bytes(batches, "text", SLICE):
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                found = [x.tobytes() for x in features(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(found, pa.binary())], names=["doc_id", "quality", "x"])

    def packed(g, found):
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), *(pa.array([b"".join(found[q])], pa.binary()) for q in (1, 0))], names=["g", "good", "bad"])

    def pack(batches):
        at, found = None, ([], [])
        for batch in batches:
            for g, q, x in zip(*(batch.column(n).to_pylist() for n in ("g", "quality", "x")), strict=True):
                if g != at:
                    if at is not None:
                        yield packed(at, found)
                    at, found = g, ([], [])
                found[q].append(x)
        if at is not None:
            yield packed(at, found)

    texts = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(_learnt())
    named = F.broadcast(named) if sum(counts.values()) <= MOST_BROADCAST else named.hint("merge")
    rows = texts.join(named, "doc_id").select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, x binary").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    turns = F.when(F.col("quality") == 1, F.sequence(F.lit(0), F.lit(copies[1] - 1))).otherwise(F.sequence(F.lit(0), F.lit(copies[0] - 1)))
    dealt = rows.select("*", F.explode(turns).alias("turn")).select(F.pmod(F.pmod(F.xxhash64("doc_id"), F.lit(many)) + F.col("turn"), F.lit(many)).alias("g"), "doc_id", "quality", "x")
    dealt = dealt.repartition(partitions(docs.sparkSession), "g").sortWithinPartitions("g", "doc_id").select("g", "quality", "x")
    groups = cut(dealt.mapInArrow(pack, "g long, good binary, bad binary"))
    fewer = groups.coalesce(-(-many // GROUPS))
    fewer._written_at = groups._written_at
    return fewer, np.array(copies)


def _learnt():
    """Whether a doc_id is outside the held-out third; not for null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def _threshold(groups: DataFrame, model: dict) -> float:
    """The middle between the score that separates the labels best, as the last to be rejected, and the next one."""

    def run(batches):
        for batch in batches:
            for name, q in (("good", 1), ("bad", 0)):
                for x in batch.column(name).to_pylist():
                    s = (scaled(np.frombuffer(x, np.float32).reshape(-1, WIDE), model) @ model["weights"]).astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), q)), pa.array(np.full(len(s), 1 - q))], names=["score", "good", "bad"])

    each = cut(groups.mapInArrow(run, "score double, good long, bad long").groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).withColumn("bin", F.floor(F.col("score") * 1024)))
    bins = each.groupBy("bin").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    whole = bins.agg(F.sum("g").alias("g"), F.sum("b").alias("b")).first()
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # of as many rows as bins, however many scores
    bins = bins.select("bin", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in "gb"])
    within = Window.partitionBy("bin").orderBy("score")
    good, bad = (F.col(x) + F.sum(y).over(within) for x, y in (("g", "good"), ("b", "bad")))
    right = (bad / whole.b - good / whole.g).alias("right")
    last = each.join(bins, "bin").select("score", right).orderBy(F.desc("right"), "score").first().score
    after = each.where(F.col("score") > last).agg(F.min("score").alias("s")).first().s
    drop_cut(each)
    return (last + (last if after is None else after)) / 2


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Scale, weights and threshold from all labelled rows outside the held-out third."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    named = named.where("doc_id is not null and quality in (0, 1)").where(_learnt())
    named = named.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").select("doc_id", "quality")
    groups, copies = _groups(docs, named)
    if groups is None:
        return {"centre": np.zeros(WIDE, np.float32), "spread": np.ones(WIDE, np.float32), "weights": np.zeros(WIDE, np.float32), "threshold": 0.0}

    def moments(good, bad):
        both = [(x.astype(float), 1 / n) for x, n in ((bad, copies[0]), (good, copies[1]))]
        return sum(np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]) * share for x, share in both)

    found = _over_groups(groups, moments)
    centre = found[1 : 1 + WIDE] / found[0]
    spread = np.sqrt(np.maximum(found[1 + WIDE :] / found[0] - centre**2, 0))
    model = {"centre": centre.astype(np.float32), "spread": (spread + 1e-6).astype(np.float32)}
    model["weights"] = fit_pairs(groups, model).astype(np.float32)
    model["threshold"] = _threshold(groups, model)
    drop_cut(groups)
    tidy(docs.sparkSession)
    return model


def score_with(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""

    def run(batches):
        for batch in by_bytes(batches, "text", SLICE):
            s = scored(batch, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(s, -500, 500))))], names=["doc_id", "score"])

    found = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_with(docs, fit(docs, labels))


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model accepts."""

    def run(batches):
        for batch in by_bytes(batches, "text", SLICE):
            yield batch.filter(pa.array(scored(batch, model) >= 0))

    return filtered(docs, run)


def op8(spark, sf_dir) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
