"""Shared plumbing: the shared folder, Arrow batches as Python values, ragged arrays."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType


_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only in a local session that names none (tests) is a folder of this machine
    taken, and then set for the session's checkpoints too; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lakeweave-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, which ``clean`` removes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(table: DataFrame) -> None:
    """Remove what ``materialize`` wrote for a table that nothing reads any more."""
    for path in [p for p in _MADE if any(p.rsplit("/", 1)[1] in f.split("/") for f in table.inputFiles()[:1])]:
        _MADE.remove(path)
        _remove(table.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Remove all that this process has written to the shared folder; results not yet read can't be read after it."""
    while _MADE:
        _remove(spark, _MADE.pop())


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = workspace(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return a worker's unused memory to the system, as the worker goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@functools.lru_cache(maxsize=1)
def _trim():
    """The C library's own way to do so, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, by which rows are dealt alike however often they are read."""
    flat = [f.name for f in df.schema if not _has_map(f.dataType)]
    return F.xxhash64(*[F.col(f"`{c.replace('`', '``')}`") for c in flat]) if flat else F.lit(0).cast("long")


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, MapType | VariantType) or isinstance(kind, StructType) and any(_has_map(f.dataType) for f in kind)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cached(df: DataFrame) -> DataFrame:
    """``df`` kept by the executors once it has been made, for tables that are small beside the input.

    What a lost executor kept is made again from its lineage, which is why only
    tables whose rows don't depend on the order of their input are kept this way.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return column(batch, name).to_pylist()


def bytes_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column(batch, name).cast(pa.binary()).to_pylist()


def numbers_of(batch: pa.RecordBatch, name: str, dtype: str = "int64") -> np.ndarray:
    """A numeric column, with nulls as 0."""
    import pyarrow.compute as pc

    return pc.fill_null(column(batch, name), 0).to_numpy(zero_copy_only=False).astype(dtype)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def slices(batch: pa.RecordBatch, text: str, most_bytes: int):
    """``batch`` in runs of rows of about ``most_bytes`` of text, so that memory stays bounded."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most_bytes
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[s : s + n]`` for each start and length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, flat.dtype)
    at = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - at, lengths) + np.arange(total)]


def exclusive(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


@functools.lru_cache(maxsize=1)
def lower_ascii() -> bytes:
    """A table for bytes.translate that lower-cases A-Z only."""
    return bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
