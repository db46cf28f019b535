"""Table adapters: rows of the test tables as small images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.operators import arrays as A

SIDE = 8
FRAME = A.Frame(SIDE, SIDE)  # plain numbers until a query uses them


def gray_images(spark, sf_dir) -> DataFrame:
    """(image_id, label, class_name, r, v, g): each embedding as an 8x8 image, brought to 0..1 and to bytes."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "label", F.col("embedding").cast("array<double>").alias("r"))
    name = F.element_at(F.array(*map(F.lit, ("Benign", "Early", "Pre", "Pro"))), F.col("label") % 4 + 1)
    return raw.select("image_id", "label", name.alias("class_name"), "r", A.unit_range(F.col("r")).alias("v")).withColumn("g", A.bytes_of(F.col("v")))


def colour_images(spark, sf_dir) -> DataFrame:
    """(image_id, red, green, blue): three consecutive byte images as the channels of one."""
    one = lambda k: F.max(F.when(F.col("image_id") % 3 == k, F.col("g")))
    return gray_images(spark, sf_dir).groupBy(F.expr("image_id div 3").alias("id3")).agg(one(0).alias("red"), one(1).alias("green"), one(2).alias("blue")).where("red is not null and green is not null and blue is not null").withColumnRenamed("id3", "image_id")


def pixels(df: DataFrame, column, name: str = "value", keep=("image_id",)) -> DataFrame:
    """One row per pixel: (image_id, y, x, value)."""
    return df.select(*keep, F.posexplode(column).alias("_place", name)).select(*keep, F.floor(F.col("_place") / SIDE).cast("int").alias("y"), (F.col("_place") % SIDE).cast("int").alias("x"), name)
