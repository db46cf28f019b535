"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 4 << 20
BLOCK = 1 << 14  # numbers of a sum that travel in one row
NO_ID = (1 << 63) - 1  # stands for a null id inside the operators; sorts last


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    store = worker_store()
    if "shared" not in store:
        store["shared"] = "file://" + tempfile.mkdtemp(prefix="pixelmill-")
    return store["shared"]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pixelmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    worker_store().setdefault("written", []).append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def drop_cut(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df`` once nothing reads it any more."""
    path = getattr(df, "_written_at", None)
    if path:
        _delete(df.sparkSession, path)
        worker_store()["written"] = [p for p in written() if p != path]


def written() -> list[str]:
    """What this driver's ``cut`` has written so far."""
    return list(worker_store().get("written", []))


def sweep(spark: SparkSession, since: list[str], keep: DataFrame) -> None:
    """Delete what ``cut`` wrote after ``since``, except ``keep``; nothing lazy may read it any more."""
    kept = getattr(keep, "_written_at", None)
    for path in set(written()) - set(since) - {kept}:
        _delete(spark, path)
    worker_store()["written"] = [p for p in written() if p in since or p == kept]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more, and executors give back the memory of ended steps."""
    gc.collect()
    spark._jvm.System.gc()
    shrink(spark)


def shrink(spark: SparkSession) -> None:
    """Have the executors collect garbage, by as many small tasks as they run at once; no result depends on where these land.

    An executor's heap grows with what passes through it and is kept by the machine between
    steps, as are buffers outside the heap and the code of ended queries; a full collection
    gives them back, so that they don't add up from stage to stage.
    """
    if spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() > 1:  # the driver is one; alone it has collected already
        slots = spark.sparkContext.defaultParallelism
        spark.range(0, slots, 1, slots).selectExpr("reflect('java.lang.System', 'gc') gone").collect()


def worker_store() -> dict:
    """A dictionary that lives as long as this Python process."""
    name = "_pixelmill_worker_store"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].found = {}
    return sys.modules[name].found


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of the session held to BATCH bytes, so long texts don't add up to large ones.

    The bound is only ever lowered. It has to stay, as Spark reads it when it plans the
    job; it changes how rows are batched and no result.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > BATCH:
        conf.set(name, str(BATCH))
    return df


def places(df: DataFrame) -> list:
    """The columns of ``df`` by place, c0 onwards, whatever their names; ``text`` as a string under its own name."""
    return [F.col("`text`").cast("string").alias("text") if n == "text" else F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(df.columns)]


def renamed(df: DataFrame, names: list[str]) -> list:
    """The columns that ``places`` made, under their own ``names`` again."""
    return [F.col("text") if n == "text" else F.col(f"c{k}").alias(n) for k, n in enumerate(names)]


def filtered(docs: DataFrame, run) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``run`` lets through; it gets batches with a string column ``text``."""
    kept = bounded(docs).select(*places(docs))
    return kept.mapInArrow(run, kept.schema).select(*renamed(kept, docs.columns))


def string_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and the offsets of its rows; null counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if offsets is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def by_bytes(batches, column: str, most: int):
    """Cut record batches so that each holds about ``most`` bytes of ``column``, never splitting a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = string_parts(batch.column(batch.schema.names.index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(at, at[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
        release()


def release() -> None:
    """Give memory that this worker has let go of back to the machine, so that it isn't held between slices and stages."""
    pa.default_memory_pool().release_unused()
    store = worker_store()
    if "trim" not in store:
        store["trim"] = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if store["trim"]:
        store["trim"](0)


def in_blocks(part: int, values: np.ndarray):
    """``values`` of one task as the rows (k, part, v) that ``summed`` adds up."""
    for k in range(0, len(values), BLOCK):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part], pa.int64()), pa.array([values[k : k + BLOCK].tobytes()], pa.binary())], names=["k", "part", "v"])


def summed(parts: DataFrame, dtype) -> np.ndarray:
    """The sum of what tasks sent by ``in_blocks``, added block by block in the order of ``part``; only the sum reaches the driver."""
    wide = np.int64 if np.issubdtype(dtype, np.integer) else np.float64

    def run(batches):
        at, total = None, None
        for batch in batches:
            for k, v in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if k != at and total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])
                found = np.frombuffer(v, dtype).astype(wide)
                at, total = k, found if k != at else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])

    rows = bounded(parts).repartition("k").sortWithinPartitions("k", "part").mapInArrow(run, "k long, v binary").collect()
    return np.frombuffer(b"".join(r.v for r in sorted(rows, key=lambda r: r.k)), wide)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of the public SplitMix64 generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` consecutive entries; as many results as full windows."""
    n, have = len(x), 1
    if n < width:
        return x[:0]
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: n - width + 1], x[rest : rest + n - width + 1]) if rest else x[: n - width + 1]


def with_id(df: DataFrame, column: str = "doc_id") -> DataFrame:
    return df.withColumn("_id", F.coalesce(F.col(column).cast("long"), F.lit(NO_ID)))
