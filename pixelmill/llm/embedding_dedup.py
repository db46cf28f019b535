"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors of a label are joined first. Unit vectors are turned onto the principal
axes (a rotation, so products stay); the leading ones cut space into cells, the more
the more vectors a label has, and the box around each cell's vectors is known exactly.
Two cells whose boxes lie so far apart that no cosine can reach the threshold are never
brought together; every other pair of cells is compared, a pair of groups of evenly
dealt vectors at a time. There, vectors are sorted by the first axis and cut into
tiles. A pair of tiles adds up leading dimensions block by block; the product of the
suffix norms bounds what the rest can add, and the tile or pair is left as soon as it
can't reach the threshold. Survivors are judged by the cosine of the original vectors
in double precision.

Axes and cells only decide how early a comparison stops, so they come from a bounded
sample (``sample`` vectors at most); a dimension count that it lacks has one cell and
is compared unturned. Where a label's vectors have no leading directions, boxes overlap
and the work grows with the square of the label. A task sends each vector's number of
links and a spanning star, never its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without label, link with nothing; vectors of different lengths
don't link; a null vec_id sorts last and stays null; equal vectors link; repeated
rows count as different vectors; vectors that share a vec_id or have none are told
apart; components of any finite size are fine, as vectors are scaled by a power of two
before they are multiplied; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from pixelmill.llm.common import NO_ID, bounded, cut, drop_cut, with_id
from pixelmill.llm.components import components

TILE = 256
STEPS = (8, 16, 32)  # leading dimensions after which a bound is taken
SLACK = 1e-9
LEAD, DEPTH = 8, 10  # leading axes that cells are cut along, and how often space is halved at most


def balanced(rows: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that its largest component lies between 1/2 and 1."""
    _, exponent = np.frexp(np.abs(rows).max(axis=1))
    return np.ldexp(rows, -exponent[:, None])


def principal_axes(rows: np.ndarray) -> np.ndarray:
    """Orthogonal axes of unit vectors, by falling variance."""
    rows = balanced(rows)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(unit.T @ unit)
    return axes[:, ::-1]


class Cells:
    """Halvings of space along the leading axes: cell numbers of DEPTH bits, of which the first k name the cells of k halvings."""

    def __init__(self, rows: np.ndarray):
        self.axes = principal_axes(rows)[:, :LEAD]
        turned = self.turned(rows)
        self.axis, self.cut = np.zeros(1 << DEPTH, np.int64), np.zeros(1 << DEPTH)
        inside = np.ones(len(rows), np.int64)  # number of each row's node, 1 at the root
        for node in range(1, 1 << DEPTH):
            mine = turned[inside == node]
            if len(mine) > 1:
                self.axis[node] = np.argmax(mine.std(axis=0))
                self.cut[node] = np.median(mine[:, self.axis[node]])
            on = np.flatnonzero(inside == node)
            inside[on] = 2 * node + (turned[on, self.axis[node]] > self.cut[node])

    def turned(self, rows: np.ndarray) -> np.ndarray:
        rows = balanced(rows)
        return rows / np.linalg.norm(rows, axis=1, keepdims=True) @ self.axes

    def of(self, turned: np.ndarray) -> np.ndarray:
        node, row = np.ones(len(turned), np.int64), np.arange(len(turned))
        for _ in range(DEPTH):
            node = 2 * node + (turned[row, self.axis[node]] > self.cut[node])
        return node - (1 << DEPTH)


class Tiles:
    """Vectors of one side, turned, sorted by their first axis and cut into tiles."""

    def __init__(self, rows: np.ndarray, axes: np.ndarray | None):
        rows = balanced(rows)
        self.rows, self.norm = rows, np.linalg.norm(rows, axis=1)
        unit = rows / self.norm[:, None]
        turned = unit if axes is None else unit @ axes
        order = np.argsort(turned[:, 0], kind="stable")
        self.turned, self.tiles = turned, [order[i : i + TILE] for i in range(0, len(order), TILE)]
        squares = np.cumsum(turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.rest = {d: np.sqrt(squares[:, d]) for d in STEPS if d < rows.shape[1]}


def near(a: Tiles, i: np.ndarray, b: Tiles, j: np.ndarray, least: float) -> np.ndarray:
    """Whether the cosine of each pair of the tiles ``i`` and ``j`` reaches ``least``."""
    x, y = a.turned[i], b.turned[j]
    gap = max(0.0, x[0, 0] - y[-1, 0], y[0, 0] - x[-1, 0])
    out = np.zeros((len(i), len(j)), bool)
    if gap * gap > 2 - 2 * least + SLACK:
        return out
    total, done = np.zeros((len(i), len(j))), 0
    for step in (*a.rest, x.shape[1]):
        total += x[:, done:step] @ y[:, done:step].T
        done = step
        if step < x.shape[1]:
            alive = total + np.outer(a.rest[step][i], b.rest[step][j]) >= least - SLACK
            if not alive.any():
                return out
            if alive.mean() < 0.02:
                p, q = np.nonzero(alive)
                rest = total[p, q] + np.einsum("nd,nd->n", x[p, step:], y[q, step:])
                total = np.full(total.shape, -2.0)
                total[p, q] = rest
                break
    p, q = np.nonzero(total >= least - SLACK)
    exact = np.einsum("nd,nd->n", a.rows[i[p]], b.rows[j[q]]) / (a.norm[i[p]] * b.norm[j[q]])
    out[p, q] = exact >= least
    return out


def compared(rows: np.ndarray, ids: np.ndarray, weight: np.ndarray, split: int, within: bool, axes, least: float):
    """Number of links of each vector and the smallest id of its group, over one pair of groups.

    The first ``split`` rows are one group, the rest the other; ``within`` compares the
    first with itself instead.
    """
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a = Tiles(rows[:split], axes)
    b = a if within else Tiles(rows[split:], axes)
    shift = 0 if within else split
    for m, i in enumerate(a.tiles):
        for j in b.tiles[m:] if within else b.tiles:
            found = near(a, i, b, j, least)
            if within and i is j:
                np.fill_diagonal(found, False)
            if not found.any():
                continue
            links[i] += found @ weight[j + shift]
            if i is not j:
                links[j + shift] += found.T @ weight[i]
            low, far = np.arange(len(i)), len(i) + len(j)
            while True:  # smallest row of each group of this pair of tiles
                across = np.where(found, low[:, None], far).min(axis=0)
                new = np.minimum(low, np.where(found, across[None, :], far).min(axis=1))
                if (new == low).all():
                    break
                low = new
            for p in np.flatnonzero(low != np.arange(len(i))).tolist():
                u, v = find(i[p]), find(i[low[p]])
                root[max(u, v)] = min(u, v)
            for q in np.flatnonzero(across < far).tolist():
                u, v = find(j[q] + shift), find(i[across[q]])
                root[max(u, v)] = min(u, v)
    top = np.array([find(x) for x in range(len(ids))])
    best = np.full(len(ids), NO_ID, np.int64)
    np.minimum.at(best, top, ids)
    return links, best[top]


def _node(salt: int):
    """A number for each pair of label and vector."""
    return F.xxhash64(F.lit(salt), "label", "v")


def _salt(distinct: DataFrame) -> int:
    """The first salt with which no two rows of ``distinct`` get one number."""
    for salt in count():
        if distinct.groupBy(_node(salt).alias("node")).count().where("count > 1").isEmpty():
            return salt


def placed(distinct: DataFrame, cells: dict) -> DataFrame:
    """(label, d, node, n, v, path, t) of ``distinct`` (label, node, n, v): its number of dimensions, cell and leading coordinates."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("d").to_numpy()
            path, t = np.zeros(len(size), np.int64), np.zeros((len(size), LEAD))
            for d in np.unique(size).tolist():
                if d in cells:
                    on = np.flatnonzero(size == d)
                    turned = cells[d].turned(np.array(batch.column("v").take(pa.array(on)).flatten(), np.float64).reshape(-1, d))
                    path[on] = cells[d].of(turned)
                    t[on, : turned.shape[1]] = turned
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(path), pa.array(list(t), pa.list_(pa.float64()))], names=[*batch.schema.names, "path", "t"])

    sized = bounded(distinct).select("label", F.size("v").alias("d"), "node", "n", "v")
    return sized.mapInArrow(run, f"label {distinct.schema['label'].dataType.simpleString()}, d int, node long, n long, v {distinct.schema['v'].dataType.simpleString()}, path long, t array<double>")


def boxes(points: DataFrame, group: int) -> DataFrame:
    """(label, d, cell, depth, groups, low, high): the cells of each label, about ``group`` vectors each, and their boxes."""
    keys = ["label", "d"]
    depth = F.least(F.lit(DEPTH), F.greatest(F.lit(0), F.floor(F.log2(F.count("*") / group)))).cast("int")
    sized = points.join(points.groupBy(*keys).agg(depth.alias("depth")), keys)
    cell = F.expr(f"shiftright(path, {DEPTH} - depth)")
    ends = [f(F.col("t")[k]).alias(f"{n}{k}") for n, f in (("low", F.min), ("high", F.max)) for k in range(LEAD)]
    found = sized.groupBy(*keys, cell.alias("cell"), "depth").agg(F.ceil(F.count("*") / group).cast("int").alias("groups"), *ends)
    return found.select(*keys, "cell", "depth", "groups", *[F.array(*[f"{n}{k}" for k in range(LEAD)]).alias(n) for n in ("low", "high")])


def near_cells(found: DataFrame, threshold: float) -> DataFrame:
    """(label, d, cell, depth, groups, other, others): each cell with those whose boxes are near enough, itself included.

    ``others`` is the number of groups of the other cell. A label has 2**DEPTH cells at most.
    """
    keys = ["label", "d"]
    other = found.select(*keys, F.col("cell").alias("other"), F.col("groups").alias("others"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    gap = F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("_low", "_high"), lambda a, b: F.greatest(F.lit(0.0), a["low"] - b["_high"], b["_low"] - a["high"]))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
    return found.join(other, keys).where(apart <= 2 - 2 * threshold + SLACK).select(*keys, "cell", "depth", "groups", "other", "others")


def pairs_of_groups(points: DataFrame, threshold: float, group: int) -> DataFrame:
    """(label, d, a, b, second, node, n, v): every vector for each pair of groups (a, b) that its group is one of."""
    keys = ["label", "d"]
    near = near_cells(boxes(points, group), threshold)
    partners = near.groupBy(*keys, "cell", "depth", "groups").agg(F.collect_list(F.struct("other", "others")).alias("partners"))  # 2**DEPTH at most
    depths = near.select(*keys, "depth").distinct()
    dealt = points.drop("t").join(depths, keys).withColumn("cell", F.expr(f"shiftright(path, {DEPTH} - depth)")).drop("path", "depth").join(partners.drop("depth"), [*keys, "cell"])
    mine = F.struct("cell", F.pmod("node", F.col("groups")).cast("int").alias("g"))
    others = F.flatten(F.transform("partners", lambda p: F.transform(F.sequence(F.lit(0), p["others"] - 1), lambda o: F.struct(p["other"].alias("cell"), o.alias("g")))))
    sides = dealt.select(*keys, "node", "n", "v", mine.alias("mine"), F.explode(others).alias("o"))
    return sides.select(*keys, F.least("mine", "o").alias("a"), F.greatest("mine", "o").alias("b"), (F.col("mine") > F.col("o")).alias("second"), "node", "n", "v")


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, group: int = 2048, sample: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding, label)."""
    of = "float" if vectors.schema["embedding"].dataType.elementType == FloatType() else "double"
    values = F.transform(F.col("embedding").cast(f"array<{of}>"), lambda x: x + F.lit(0.0).cast(of))  # no negative zero
    rows = with_id(vectors, "vec_id").select("_id", F.col("label").alias("label"), values.alias("v"))
    ok = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.coalesce(ok & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.select("_id", "label", "v", ok.alias("ok"))
    distinct = cut(rows.where("ok").groupBy("label", "v").agg(F.min("_id").alias("rep"), F.count("*").alias("n")))
    node = _node(_salt(distinct))
    distinct = distinct.withColumn("node", node)
    cells = {}
    for r in distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect():
        cells.setdefault(len(r.v), []).append(r.v)
    axes = {d: principal_axes(np.array(x, np.float64)) for d, x in cells.items()}
    cells = {d: Cells(np.array(x, np.float64)) for d, x in cells.items()}
    points = cut(placed(distinct, cells))
    sides = pairs_of_groups(points, threshold, group)
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def task(part: pa.Table) -> pa.Table:
        second = part.column("second").to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((part.column("node").to_numpy(), second))
        ids, weight = part.column("node").to_numpy()[order], part.column("n").to_numpy()[order]
        matrix = np.stack(part.column("v").to_pandas().to_numpy()).astype(np.float64)[order]
        within = part.column("a")[0].as_py() == part.column("b")[0].as_py()
        links, root = compared(matrix, ids, weight, len(ids) if within else int((~second).sum()), within, axes.get(matrix.shape[1]), threshold)
        on = links > 0
        return pa.Table.from_arrays([pa.array(x[on]) for x in (ids, links, root)], schema=schema)

    found = cut(sides.groupBy("label", "d", "a", "b").applyInArrow(task, "node long, links long, root long"))
    named = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    drop_cut(points)
    classes = distinct.select("node", "n", "rep").join(counts, "node", "left").join(named, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    least = classes.groupBy("root").agg(F.min("rep").alias("component"))
    classes = classes.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    linked = rows.where("ok").select("_id", node.alias("node")).join(classes, "node").select("_id", "links", "component")
    alone = rows.where("not ok").select("_id", F.lit(0).cast("long").alias("links"), F.col("_id").alias("component"))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return linked.unionByName(alone).select(null("_id").alias("vec_id"), F.col("links").alias("n_links"), null("component").alias("component_id"), (F.col("_id") == F.col("component")).alias("kept"))


def op10(spark, sf_dir) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
