"""Embedding links against brute force."""

import math
import random

import numpy as np

from pixelmill.llm.embedding_dedup import Cells, boxes, compared, embedding_dedup, near_cells, pairs_of_groups, placed, principal_axes

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, v int"


def brute(rows, least=0.93):
    ok = {i: (label, np.array(v, np.float32).astype(float)) for i, v, label, *_ in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    root, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in ok.items():
        for j, (b, y) in ok.items():
            if i < j and a == b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (links[i], find(i), find(i) == i) for i in root}


def test_links_are_whole(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0

    def add(v, label):
        nonlocal n
        rows.append((n, v, label, "x", 1))
        n += 1

    for label in (0, 0, 0, 1, 2):
        for _ in range(25):
            base = rng.normal(size=12)
            for _ in range(rng.integers(1, 6)):
                add((base + rng.normal(size=12) * rng.choice([0.0, 0.05, 0.2, 0.35])).tolist(), label)
    for _ in range(40):
        add([1.0] * 12, 0)
    add([2.0] * 12, 0)
    add([0.0, -0.0] + [1.0] * 10, 0)
    add([-0.0, 0.0] + [1.0] * 10, 0)
    for v in (None, [], [0.0] * 12, [math.nan] * 12, [math.inf] + [1.0] * 11, [None] + [1.0] * 11, [1.0] * 3, [1.0] * 3):
        add(v, 0)
    add([1.0] * 12, None)
    random.Random(2).shuffle(rows)
    for group in (16, 2048):
        got = embedding_dedup(spark.createDataFrame(rows, SCHEMA), group=group).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows)
    assert embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    none = embedding_dedup(spark.createDataFrame([(None, [1.0, 2.0], 1), (5, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id is None, r.n_links, r.component_id) for r in none) == [(False, 1, 5), (True, 1, 5)]


def test_tiles_find_all_links():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(80, 40))
    rows = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.1, 0.2, 0.3, 0.4)] * 2)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = unit @ unit.T >= 0.93
    np.fill_diagonal(want, False)
    links, root = compared(rows, np.arange(len(rows)), np.ones(len(rows), np.int64), len(rows), True, principal_axes(rows), 0.93)
    assert (links == want.sum(axis=1)).all()
    a, b = compared(rows, np.arange(len(rows)), np.ones(len(rows), np.int64), 300, False, principal_axes(rows), 0.93)
    assert (a == np.concatenate([want[:300, 300:].sum(axis=1), want[300:, :300].sum(axis=1)])).all()
    assert (root <= np.arange(len(rows))).all() and (b <= np.arange(len(rows))).all()


def test_vectors_of_one_id_are_told_apart(spark):
    rows = [(None, [1.0, 0.0], 0), (None, [0.0, 1.0], 0), (None, [1.0, 0.0], 1), (7, [1.0, 0.01], 0), (9, [3.0, 0.0], 1), (9, [0.0, 1.0], 2), (4, [0.0, 2.0], 2)]
    got = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    seen = sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr)
    assert seen == sorted([(None, 1, 7), (None, 0, None), (None, 1, 9), (7, 1, 7), (9, 1, 9), (9, 1, 4), (4, 1, 4)], key=repr)


def test_far_cells_are_never_paired(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(6)
    rows = [(i, (centres[i % 6] + rng.normal(size=6) * 0.05).tolist(), 1) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(table, group=32).collect()} == brute(rows)
    points = placed(table.selectExpr("label", "vec_id node", "1L n", "embedding v"), {6: Cells(np.array([r[1] for r in rows]))})
    cells = boxes(points, 32).count()
    assert cells > 12 and near_cells(boxes(points, 32), 0.93).count() < cells * cells / 3
    groups = boxes(points, 32).agg({"groups": "sum"}).first()[0]
    assert pairs_of_groups(points, 0.93, 32).count() < 600 * groups / 3


def test_components_of_any_size(spark):
    rows = [(i, [a * s, b * s], 1) for i, (a, b, s) in enumerate([(1.0, 0.1, 1e300), (1.0, 0.1, 1e-300), (1.0, 0.12, 1.0), (0.0, 1.0, 1e308)])]
    got = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (3, 0, 3)]
