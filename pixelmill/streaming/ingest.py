"""Incremental ingestion: the same kernels over a stream of image files.

Files already seen are remembered by the checkpoint, so a new run handles new files
only. The rows need no state of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions.params import DEFAULT, Params
from pixelmill.operators import split as S

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark, root: str, params: Params = DEFAULT) -> DataFrame:
    """(image_id, orig_path, length, content) of new image files below ``root``."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(root)
    return files.where(S.suffix(F.col("path")).isin(*params.suffixes)).select(S.stem(F.col("path")).alias("image_id"), F.col("path").alias("orig_path"), "length", "content")


def ingest(spark, root: str, out: str, checkpoint: str, params: Params = DEFAULT):
    """Append the new files' rows to a table, once each; returns the finished query."""
    query = stream_files(spark, root, params).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
