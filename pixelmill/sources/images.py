"""Image files as DataFrames, and images as PNG files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions.params import DEFAULT, Params
from pixelmill.operators import split as S


def discover(spark, root: str, params: Params = DEFAULT, content: bool = False) -> DataFrame:
    """(image_id, orig_path, class_name, length) of the files below the class folders of ``root``.

    The class is the first folder below the root, case and all; suffixes are compared in
    small letters. Only file names and sizes are read unless ``content`` is asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    path = F.regexp_replace("path", "^file:/+", "file:/")
    below = F.substring(path, F.lit(len(base.replace("file:///", "file:/")) + 2), F.length(path))
    found = files.withColumn("_below", below).withColumn("class_name", F.when(F.instr("_below", "/") > 0, F.substring_index("_below", "/", 1)))
    found = found.where(F.col("class_name").isin(*params.classes) & S.suffix(F.col("path")).isin(*params.suffixes))
    kept = ["class_name", "length", *(["content"] if content else [])]
    return found.select(S.stem(F.col("path")).alias("image_id"), F.col("path").alias("orig_path"), *kept)


def decoded(spark, root: str | list[str]) -> DataFrame:
    """Images below a folder, or of a list of files: (orig_path, height, width, channels, data) by Spark's own reader, bytes in BGR order; what can't be decoded has height -1."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(root)
    return images.select(F.col("image.origin").alias("orig_path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def file_info(files: DataFrame) -> DataFrame:
    """A line on each decoded file: name, size, type."""
    return files.withColumn("info", F.format_string("%s %dx%d %s %.1f KB", "image_id", "width", "height", F.upper(F.replace(S.suffix(F.col("orig_path")), F.lit("."), F.lit(""))), F.col("length") / 1024))


def channels_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """An image with the channels that its file has: gray (one), RGB, or RGB with alpha."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return a[..., 0] if channels == 1 else np.ascontiguousarray(a[..., [2, 1, 0, *range(3, channels)]])


def rgb_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else np.ascontiguousarray(a[..., 2::-1])


def png(image: np.ndarray) -> bytes:
    """An 8-bit gray or RGB image as a PNG file."""
    a = image.astype(np.uint8)
    a = np.where(image, 255, 0).astype(np.uint8) if image.dtype == bool else a
    rows = np.concatenate([np.zeros((a.shape[0], 1), np.uint8), a.reshape(a.shape[0], -1)], axis=1)
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")
