"""The image pipeline: scan, split, fit the stain reference, transform, feature rows.

Two passes over the pixels: one that averages colour statistics over at most
``reference_images`` images, one that computes layers and numbers. The second is
written once, so that features and layers don't run the kernels again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions import kernels as K
from pixelmill.functions.params import COLOUR, DEFAULT, FEATURES, LAYERS, MANIFEST, MORPHOLOGY, TEXTURE, Params
from pixelmill.operators import split as S
from pixelmill.sources.images import decoded, discover, rgb_of

NUMBERS = (*MORPHOLOGY, *TEXTURE, *COLOUR)
CARRIED = ("orig_path", "class_name", "class_id_binary", "class_id_4way")  # of the manifest, through the kernels
OUT = LAYERS + ", orig_path string, class_name string, class_id_binary int, class_id_4way int, error string, " + ", ".join(f"{n} double" for n in NUMBERS)
MOST_BROADCAST = 100_000  # manifest rows; a larger manifest is joined by a shuffle
FEW = "16"  # images per Arrow batch: a row holds megabytes


def manifest(spark, root: str, params: Params = DEFAULT, compatible: bool = False) -> DataFrame:
    """One row per image file, those included that can't be decoded.

    compatible: split by one seeded generator over the sorted list, on the driver (names
    only), as published splits were; otherwise by a hash, without collecting anything.
    """
    found = S.with_class_ids(discover(spark, root, params), params)
    if compatible:
        items = S.by_parts([tuple(r) for r in found.select("orig_path", "class_name").collect()])
        table = spark.createDataFrame(list(S.split_compatible(items, params).items()), "orig_path string, split string")
        found = found.join(table, "orig_path")
    else:
        found = S.split(found, "orig_path", params=params)
    return found.select(*[c.split()[0] for c in MANIFEST.split(", ")])


def duplicates(table: DataFrame) -> DataFrame:
    """Names that more than one file of a split has; outputs named by them would overwrite each other."""
    return table.groupBy("split", "image_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("orig_path")).alias("paths")).where("n > 1")


def fit_reference(images: DataFrame):
    """Mean of the images' Lab means and of their deviations; undecodable ones are passed over."""
    import pandas as pd

    def run(frames):
        for f in frames:
            rows = [np.concatenate(K.lab_stats(rgb_of(*r))).tolist() for r in zip(f["data"], f["height"], f["width"], f["channels"], strict=True)]
            yield pd.DataFrame(rows, columns=list("abcdef"))

    stats = images.where("height > 0").select("data", "height", "width", "channels").mapInPandas(run, ", ".join(f"{c} double" for c in "abcdef"))
    row = stats.agg(*[F.avg(c).alias(c) for c in "abcdef"], F.count("*").alias("n")).first()
    if not row.n:
        raise ValueError("no reference image can be decoded")
    return tuple(row[:3]), tuple(row[3:6])


def transformed(images: DataFrame, reference, params: Params = DEFAULT) -> DataFrame:
    """Layers, numbers or an error for each image."""
    import pandas as pd

    names = [c.split()[0] for c in OUT.split(", ")]

    def run(frames):
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                try:
                    if r["height"] is None or not r["height"] > 0:
                        raise ValueError(f"can't decode {r['orig_path']}")
                    layers, numbers = K.layers_and_features(rgb_of(r["data"], int(r["height"]), int(r["width"]), int(r["channels"])), params, reference)
                    rows.append((r["image_id"], r["split"], r["height"], r["width"], layers["rgb"].tobytes(), *[layers[k].ravel().tolist() for k in ("apc", "log", "canny", "nucleus_mask", "cell_mask")], *[r[c] for c in CARRIED], None, *numbers))
                except Exception as e:  # whatever fails, fails for this image alone
                    rows.append((r["image_id"], r["split"], 0, 0, None, *[None] * 5, *[r[c] for c in CARRIED], f"{type(e).__name__}: {e}", *[None] * len(NUMBERS)))
            yield pd.DataFrame(rows, columns=names)

    return images.select("image_id", *CARRIED, "split", "height", "width", "channels", "data").mapInPandas(run, OUT)


def run(spark, root: str, out: str, params: Params = DEFAULT, compatible: bool = False, dry: bool = False) -> dict:
    """Run the pipeline into ``out``; gives its tables and a status: 0 well, 1 no input, 3 some failed."""
    table = manifest(spark, root, params, compatible)
    counts = S.split_counts(table)
    if table.isEmpty():
        return {"status": 1, "manifest": table, "counts": counts}
    table.orderBy("class_name", F.split("orig_path", "/")).coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{out}/manifest")
    if dry:
        return {"status": 0, "manifest": table, "counts": counts}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", FEW)
    try:
        clean = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        # a few paths, no more than the parameter says; only these are read and decoded here
        chosen = [r.orig_path for r in S.reference_sample(S.reference_pool(table), "orig_path", params).select("orig_path").collect()]
        reference = fit_reference(decoded(spark, chosen))
        names = table.withColumn("_key", clean("orig_path"))
        names = F.broadcast(names) if names.count() <= MOST_BROADCAST else names
        images = decoded(spark, root).withColumn("_key", clean("orig_path")).drop("orig_path").join(names, "_key")
        transformed(images, reference, params).write.mode("overwrite").partitionBy("split").parquet(f"{out}/transformed")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    done = spark.read.schema(OUT).parquet(f"{out}/transformed")
    good = done.where("error is null")
    features = good.select(*[c.split()[0] for c in FEATURES.split(", ")])
    features.write.mode("overwrite").parquet(f"{out}/features")
    missed = table.join(done.select("orig_path"), "orig_path", "left_anti").select("image_id", "split", "orig_path", F.lit("not read").alias("error"))
    errors = done.where("error is not null").select("image_id", "split", "orig_path", "error").unionByName(missed)
    failed = not errors.isEmpty()
    return {"status": 3 if failed else 0, "manifest": table, "counts": counts, "features": spark.read.parquet(f"{out}/features"), "layers": good.select(*[c.split()[0] for c in LAYERS.split(", ")]), "errors": errors, "duplicates": duplicates(table), "reference": reference}


def diagnosed(rgb: np.ndarray, params: Params = DEFAULT) -> dict:
    """Mean and deviation of an image raw, stain-normalised to itself, and denoised in three ways."""
    hds = lambda n: np.stack([(K.hds(rgb[..., c] / 255.0, n, *params.hds[1:]) * 255).astype(np.uint8) for c in range(3)], -1)
    made = {"raw": rgb, "stain": K.stain_normalised(rgb, *K.lab_stats(rgb)), "bilateral": K.bilateral(rgb, *params.bilateral), "hds20": hds(20), "hds200": hds(200)}
    return {k: (float(v.mean()), float(v.std())) for k, v in made.items()}
