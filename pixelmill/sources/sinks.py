"""Tables and pictures of a run. Pictures are written by the tasks that hold the rows."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions.kernels import unit_range
from pixelmill.functions.params import LAYERS
from pixelmill.operators.edges import inferno
from pixelmill.sources.images import png

NAMES = ("rgb", "apc", "log", "canny", "nucleus_mask", "cell_mask")


def write_layers(layers: DataFrame, path: str) -> None:
    layers.write.mode("overwrite").partitionBy("split").parquet(path)


def read_layers(spark, path: str) -> DataFrame:
    return spark.read.schema(LAYERS).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("nanValue", "NaN").csv(path)


def arrays_of(row) -> dict[str, np.ndarray]:
    """The six arrays of a layer row, in their shapes and types."""
    shape = (row["height"], row["width"])
    types = {"apc": np.float32, "log": np.float32, "canny": bool, "nucleus_mask": bool, "cell_mask": bool}
    return {"rgb": np.frombuffer(row["rgb"], np.uint8).reshape(*shape, 3), **{n: np.array(row[n], t).reshape(shape) for n, t in types.items()}}


def _named(layers: DataFrame, make) -> DataFrame:
    """(name, content) of the files that ``make`` gives for each layer row."""
    import pandas as pd

    def run(frames):
        for f in frames:
            files = [x for row in f.to_dict("records") for x in make(row)]
            yield pd.DataFrame(files, columns=["name", "content"])

    return layers.mapInPandas(run, "name string, content binary")


def npz_files(layers: DataFrame) -> DataFrame:
    """Compressed array files, one per image, as (name, content)."""

    def make(row):
        out = io.BytesIO()
        np.savez_compressed(out, **arrays_of(row))
        return [(f"{row['split']}/{row['image_id']}.npz", out.getvalue())]

    return _named(layers, make)


def read_npz(spark, path: str) -> DataFrame:
    """Layer rows of array files in folders named by split."""
    import pandas as pd

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path)

    def run(frames):
        for f in frames:
            rows = []
            for where, content in zip(f["path"], f["content"], strict=True):
                a = np.load(io.BytesIO(content))
                split, name = where.split("/")[-2:]
                h, w = a["apc"].shape
                rows.append((name[:-4], split, h, w, a["rgb"].tobytes(), *[a[n].ravel().tolist() for n in NAMES[1:]]))
            yield pd.DataFrame(rows, columns=["image_id", "split", "height", "width", *NAMES])

    return files.select("path", "content").mapInPandas(run, LAYERS)


def layer_pictures(layers: DataFrame) -> DataFrame:
    """Six pictures per image as (name, content): responses coloured, masks black and white."""

    def make(row):
        found = arrays_of(row)
        for k, n in enumerate(NAMES, 1):
            a = found[n]
            yield f"{row['split']}/{row['image_id']}_{k}_{n.split('_')[0]}.png", png(inferno(unit_range(a)) if a.dtype == np.float32 else a)

    return _named(layers, make)


def previews(layers: DataFrame) -> DataFrame:
    """One strip of all six layers per image, as (name, content)."""

    def make(row):
        shown = []
        for a in arrays_of(row).values():
            a = inferno(unit_range(a)) if a.dtype == np.float32 else np.where(a, 255, 0).astype(np.uint8) if a.dtype == bool else a
            shown.append(a if a.ndim == 3 else np.repeat(a[..., None], 3, axis=2))
        return [(f"{row['split']}/{row['image_id']}.png", png(np.concatenate(shown, axis=1)))]

    return _named(layers, make)


def write_files(files: DataFrame, root: str) -> None:
    """Write (name, content) rows below ``root``, a folder that all executors share."""

    def put(rows):
        import pathlib

        for r in rows:
            to = pathlib.Path(root) / r["name"]
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(r["content"])

    files.foreachPartition(put)


def run_record(spark, params, outputs: dict) -> DataFrame:
    """One row with the parameters and outputs of a run."""
    return spark.createDataFrame([(repr(params), {k: str(v) for k, v in outputs.items()})], "params string, outputs map<string,string>").withColumn("at", F.current_timestamp())
