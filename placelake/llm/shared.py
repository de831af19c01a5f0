"""What the operators of this subpackage share: the cluster's shared folder and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from placelake.llm import bytehash as bh

CHUNK_BYTES = 1 << 20
"""Bytes of text that one vectorised step handles at once; a longer text is handled alone and whole."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="placelake-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/placelake-{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: as safe as a checkpoint, but smaller and columnar."""
    path = new_folder(df.sparkSession, name)
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_counted(df: DataFrame, name: str, count: Column) -> tuple[DataFrame, int]:
    """``write_table``, and the aggregate ``count`` of all rows, which is taken while they are written; 0 if it is null."""
    seen = Observation()
    table = write_table(df.observe(seen, count.alias("n")), name)
    return table, seen.get["n"] or 0


def release(*tables: DataFrame) -> None:
    """Remove tables of ``write_table`` that no later step reads, and the shuffles of steps that are done.

    What was made of the tables must be written already, so that a lost executor never asks for them again. Spark removes
    shuffles only after a garbage collection on the driver, which has little garbage of its own; so one is asked for.
    """
    for table in tables:
        jvm, spark = table.sparkSession._jvm, table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/placelake-" in folder:  # never a table that isn't ours
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        jvm.System.gc()


def byte_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows, without copying; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of ``column`` each; a row is never cut."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def binary_column(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of ``data`` cut at ``offsets``."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)]).cast(pa.binary())


SAMPLED = 60
"""Rows per range, at most, by which bounds of ranges are found on the driver."""
_FRONT = 16


def _key(batch: pa.RecordBatch, keys: tuple[str, ...], place: tuple[str, str]) -> list[pa.Array]:
    """The columns ``keys``, and a hash of ``place``, so that rows of one key lie in no order in which a few texts can stand together."""
    a, b = (batch.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in place)
    return [*(batch.column(k) for k in keys), pa.array(bh.mix(bh.mix(a) + b).view(np.int64))]


def bounds_of(few: DataFrame, make: Callable, schema: str, keys: tuple[str, ...], place: tuple[str, str], ranges: int) -> list[tuple]:
    """Keys that cut what ``make`` makes of a sample, ``few``, into at most ``ranges`` about equal parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in make(batches):
            yield pa.RecordBatch.from_arrays(_key(batch, keys, place), [*keys, "salt"])

    rows = few.mapInArrow(run, ", ".join(c for c in schema.split(", ") if c.split()[0] in keys) + ", salt long").select(*keys, "salt")
    chosen = rows.orderBy(F.xxhash64(*keys, "salt")).limit(SAMPLED * ranges).collect()
    chosen = sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in chosen)
    return sorted({chosen[len(chosen) * i // ranges] for i in range(1, ranges)}) if chosen else []


def _front(column: pa.Array) -> np.ndarray:
    """Numbers, or the first bytes of binary values, in an order that never goes against that of the values."""
    if not pa.types.is_binary(column.type):
        return column.to_numpy(zero_copy_only=False)
    data, offsets = byte_arrays(column)
    step = np.arange(_FRONT)
    front = np.concatenate([data, np.zeros(_FRONT, np.uint8)])[offsets[:-1, None] + step]
    front[step >= np.diff(offsets)[:, None]] = 0
    return front.view(f"S{_FRONT}").ravel()


def range_of(bounds: list[tuple], columns: list[pa.Array]) -> np.ndarray:
    """How many of ``bounds`` lie before each row. Few rows begin as a bound does; those are compared whole."""
    edge, front = _front(pa.array([b[0] for b in bounds], columns[0].type)), _front(columns[0])
    at = np.searchsorted(edge, front, "left")
    odd = np.flatnonzero(at < np.searchsorted(edge, front, "right"))
    if len(odd):
        take = pa.array(odd)
        at[odd] = [bisect_left(bounds, row) for row in zip(*(c.take(take).to_pylist() for c in columns), strict=True)]
    return at


def in_ranges(rows: DataFrame, make: Callable, schema: str, keys: tuple[str, ...], place: tuple[str, str], bounds: list[tuple]) -> DataFrame:
    """What ``make`` makes of the batches of ``rows``, range-partitioned over the cluster at ``bounds`` and sorted by ``keys``; ``place`` parts the rows of a frequent key.

    ``repartitionByRange`` would make everything twice, first for its own sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in make(batches):
            part = range_of(bounds, _key(batch, keys, place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], [*batch.schema.names, "part"])

    return rows.mapInArrow(run, f"{schema}, part int").repartitionById(len(bounds) + 1, "part").drop("part").sortWithinPartitions(*keys)
