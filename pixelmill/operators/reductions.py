"""Histogram, threshold and texture reductions over (image, pixels) rows.

Each shuffles at most one row per image and grey level (or pair of levels): counts are
summed before they move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(pixels: DataFrame, key, level: str = "g") -> DataFrame:
    """(key, level, n) of a table with one row per pixel."""
    return pixels.groupBy(*key, level).agg(F.count("*").alias("n"))


def otsu(counts: DataFrame, key, level: str = "g") -> DataFrame:
    """(key, threshold): the lowest level with the greatest variance between classes."""
    by = W.partitionBy(*key)
    upto = by.orderBy(level).rowsBetween(W.unboundedPreceding, 0)
    n, mass = F.col("n").cast("double"), F.col("n").cast("double") * F.col(level)
    sums = counts.select(*key, level, F.sum(n).over(upto).alias("w0"), F.sum(mass).over(upto).alias("m0"), F.sum(n).over(by).alias("w"), F.sum(mass).over(by).alias("m"))
    apart = F.col("m0") * F.col("w") - F.col("m") * F.col("w0")
    between = F.when((F.col("w0") > 0) & (F.col("w0") < F.col("w")), apart * apart / (F.col("w0") * (F.col("w") - F.col("w0")))).otherwise(F.lit(0.0))
    best = sums.select(*key, F.struct(between.alias("b"), (-F.col(level)).alias("low")).alias("best"))
    return best.groupBy(*key).agg((-F.max("best")["low"]).cast("int").alias("threshold"))


def pairs(images: DataFrame, key, gray: str, width) -> DataFrame:
    """(key, i, j, n): symmetric counts of horizontally adjacent levels of array images."""
    g, w = F.col(gray), F.lit(width) if isinstance(width, int) else width
    places = F.filter(F.sequence(F.lit(0), F.size(g) - 2), lambda p: (p % w) < w - 1)
    both = F.flatten(F.transform(places, lambda p: F.array(F.struct(g[p].alias("i"), g[p + 1].alias("j")), F.struct(g[p + 1].alias("i"), g[p].alias("j")))))
    return images.select(*key, F.explode(both).alias("p")).groupBy(*key, F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.count("*").alias("n"))


def glcm(counts: DataFrame, key) -> DataFrame:
    """(key, i, j, p): co-occurrences as shares."""
    return counts.select(*key, "i", "j", (F.col("n").cast("double") / F.sum(F.col("n").cast("double")).over(W.partitionBy(*key))).alias("p"))


def texture(counts: DataFrame, key) -> DataFrame:
    """Contrast, energy, homogeneity and correlation, from counts in one aggregation."""
    n, i, j = (F.col(c).cast("double") for c in ("n", "i", "j"))
    d = i - j
    sums = counts.groupBy(*key).agg(F.sum(n).alias("t"), F.sum(n * d * d).alias("c"), F.sum(n * n).alias("e"), F.sum(n / (1 + d * d)).alias("h"), F.sum(n * i).alias("m"), F.sum(n * i * i).alias("q"), F.sum(n * i * j).alias("x"))
    mean = F.col("m") / F.col("t")
    variance = F.col("q") / F.col("t") - mean * mean
    correlation = F.when(variance < 1e-15, F.lit(1.0)).otherwise((F.col("x") / F.col("t") - mean * mean) / variance)
    return sums.select(*key, (F.col("c") / F.col("t")).alias("glcm_contrast"), (F.sqrt("e") / F.col("t")).alias("glcm_energy"), (F.col("h") / F.col("t")).alias("glcm_homogeneity"), correlation.alias("glcm_correlation"))
