"""Models and counts that come from all rows, not from some of them."""

import random
import zlib

import numpy as np
import pytest

from pixelmill.llm import near_copies, quality
from pixelmill.llm.common import cut


def features(rows):
    import pyarrow as pa

    return quality.features(pa.array([t for _, t, _ in rows], pa.string()))


def learnt(rows):
    return [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]


def test_labels_beyond_the_first_8000_of_a_class_are_learnt(spark):
    late = "if(row_number() over (partition by q order by xxhash64(id), id) > 8000, if(q = 1, 'alpha words', 'beta words'), 'same words')"
    ids = spark.range(26_000).where("crc32(cast(cast(id as string) as binary)) % 3 <> 1").selectExpr("id", "cast(id % 2 as int) q").selectExpr("id doc_id", f"{late} text", "q quality")
    rows = cut(ids)
    assert rows.where("text <> 'same words'").count() > 500
    model = quality.fit(rows.select("doc_id", "text"), rows.select("doc_id", "quality"))
    odd = spark.createDataFrame([(1, "alpha words"), (2, "beta words")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in quality.score_with(odd, model).collect()} == {1: 1, 2: 0}


@pytest.mark.parametrize("rare", [2, 40])
@pytest.mark.parametrize("most", [1_000_000, 0])
def test_fit_is_that_of_all_rows(spark, monkeypatch, rare, most):
    monkeypatch.setattr(quality, "GROUP", 64)
    monkeypatch.setattr(quality, "FEW", 4)
    monkeypatch.setattr(quality, "GROUPS", 2)
    monkeypatch.setattr(quality, "MOST_BROADCAST", most)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(("#ab", "cd!", "ef") if i % rare else ("good", "Fine", "cd!")) for _ in range(rng.randint(3, 30))), int(i % rare != 0)) for i in range(700)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows] + [(5000, "no label")], "doc_id long, text string"), spark.createDataFrame([(i, q) for i, _, q in rows] + [(6000, 1), (None, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    used = learnt(rows)
    x, y = features(used).astype(float), np.array([q for *_, q in used])
    assert np.allclose(model["centre"], x.mean(axis=0), atol=1e-6) and np.allclose(model["spread"], x.std(axis=0) + 1e-6, atol=1e-5)
    groups, copies = quality._groups(docs, labels.where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"))
    dealt = [tuple(np.frombuffer(b, np.float32).reshape(-1, quality.WIDE) for b in (r.good, r.bad)) for r in groups.collect()]
    assert sorted(v.tobytes() for d in dealt for v in d[1]) == sorted(v.astype(np.float32).tobytes() for v in x[y == 0] for _ in range(copies[0]))
    assert sorted(v.tobytes() for d in dealt for v in d[0]) == sorted(v.astype(np.float32).tobytes() for v in x[y == 1] for _ in range(copies[1]))
    assert copies[1] == 1 and (copies[0] > 1) == (rare == 40)

    slope, n, w = -1e-3 * model["weights"].astype(float), 0, model["weights"].astype(float)
    both = [tuple(quality.scaled(v, model).astype(float) for v in d) for d in dealt]
    pairs = sum(len(a) * len(b) for a, b in both)
    for a, b in both:
        p = 1 / (1 + np.exp((a @ w)[:, None] - b @ w))
        slope, n = slope + (p.sum(axis=1) @ a - p.sum(axis=0) @ b) / pairs, n + p.size
    assert np.abs(slope).max() < 1e-5 and n == pairs

    s = (quality.scaled(x.astype(np.float32), model) @ model["weights"]).astype(float)
    right = lambda t: ((s < t) & (y == 0)).sum() / (y == 0).sum() - ((s < t) & (y == 1)).sum() / (y == 1).sum()
    assert right(model["threshold"]) >= max(map(right, s)) - 1e-9


def test_shingles_of_all_texts_are_counted(spark):
    texts = [f"one common line of seven words w{i} x{i}" for i in range(6000)] + [None, ""]
    want = np.zeros(near_copies.BINS, np.int64)
    for t in texts:
        np.add.at(want, near_copies._bin(near_copies.shingles((t or "").encode(), 5)), 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = near_copies._common(docs, 5)
    assert (got == want).all() and got.max() >= 6000
    assert not near_copies._common(docs.limit(0), 5).any()


def test_no_link_is_lost_with_all_counted(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join([*base[:k], f"new{rng.random()}", *base[k + 1 :]]) for k in range(0, 80, 4)] + [f"other text number {k} of many" for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == [0, *range(20, 50)]
