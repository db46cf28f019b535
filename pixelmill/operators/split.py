"""Manifest, stratified split, and the pool of reference images."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelmill.functions.params import DEFAULT, Params


def stem(path: Column) -> Column:
    """Last part of a path without its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def with_class_ids(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Adds both class numbers and drops rows of other classes."""
    pairs = [x for name, (two, four) in params.classes.items() for x in (F.lit(name), F.struct(F.lit(two).alias("two"), F.lit(four).alias("four")))]
    return df.withColumn("_ids", F.create_map(*pairs)[F.col("class_name")]).where("_ids is not null").withColumns({"class_id_binary": F.col("_ids.two"), "class_id_4way": F.col("_ids.four")}).drop("_ids")


# What the size rule needs, on numbers and on columns; both round halves to even.
ON_NUMBERS = (round, max, lambda on, a, b: a if on else b)
ON_COLUMNS = (lambda x: F.bround(x).cast("int"), lambda a, b: F.greatest(F.lit(a), b), lambda on, a, b: F.when(on, a).otherwise(b))


def sizes(n, params: Params = DEFAULT, on=ON_COLUMNS):
    """Numbers of training and validation rows of a class of n; the rest, one at least from three rows on, are test rows."""
    nearest, larger, choose = on
    train = choose(n == 1, 1, larger(1, nearest(n * params.train)))
    val = choose(n == 1, 0, nearest(n * params.val))
    return train, choose((n >= 3) & (n - train - val < 1), larger(0, val - 1), val)


def split(df: DataFrame, key: str = "image_id", by: str = "class_name", params: Params = DEFAULT) -> DataFrame:
    """Adds ``split``; the order inside a class is that of a seeded hash of the key.

    Rows are ranked inside slices of that order, by the hash's first digits, and slices
    (4096 of a class at most) by their counts, so no task holds a whole class.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat(F.lit(f"{params.seed}:"), F.col(key).cast("string")))).withColumn("_slice", F.substring("_hash", 1, 3))
    counts = hashed.groupBy(by, "_slice").agg(F.count("*").alias("_in"))
    before = W.partitionBy(by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = counts.select(by, "_slice", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"), F.sum("_in").over(W.partitionBy(by)).alias("_n"))
    ranked = hashed.withColumn("_r", F.row_number().over(W.partitionBy(by, "_slice").orderBy("_hash", key))).join(F.broadcast(slices), [by, "_slice"])
    train, val = sizes(F.col("_n"), params)
    place = F.col("_before") + F.col("_r")
    return ranked.select(*df.columns, F.when(place <= train, "train").when(place <= train + val, "val").otherwise("test").alias("split"))


def by_parts(items: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Items (path, class) by class, then by the parts of their paths, folder by folder."""
    return sorted(items, key=lambda item: (item[1], item[0].split("/")))


def split_compatible(items: list[tuple[str, str]], params: Params = DEFAULT) -> dict[str, str]:
    """Membership by one seeded generator shared over classes, in the order of ``items`` (path, class)."""
    rng, members = random.Random(params.seed), {}
    for path, name in items:
        members.setdefault(name, []).append(path)
    found = {}
    for paths in members.values():
        train, val = sizes(len(paths), params, ON_NUMBERS)
        rng.shuffle(paths)
        found.update(zip(paths, ["train"] * train + ["val"] * val + ["test"] * (len(paths) - train - val), strict=True))
    return found


def split_counts(df: DataFrame) -> DataFrame:
    """Rows per class and split, zero where there are none."""
    return df.groupBy("class_name").pivot("split", ["train", "val", "test"]).count().na.fill(0)


def reference_pool(df: DataFrame) -> DataFrame:
    """The first that has rows of: benign training, benign, training, all rows."""
    benign, train = F.col("class_name") == "Benign", F.col("split") == "train"
    rank = F.when(benign & train, 1).when(benign, 2).when(train, 3).otherwise(4)
    best = df.select(F.min(rank).alias("_best"))
    return df.withColumn("pool", rank).join(F.broadcast(best), F.col("pool") == F.col("_best")).drop("_best")


def reference_sample(pool: DataFrame, key: str = "image_id", params: Params = DEFAULT) -> DataFrame:
    order = F.md5(F.concat(F.lit(f"{params.seed}:"), F.col(key).cast("string")))
    return pool.orderBy(order, key).limit(params.reference_images)
