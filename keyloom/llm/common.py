"""Helpers the operators share: Arrow annotation, shared-folder tables, column selection."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one call of a Python operator sees at most (a longer text comes alone).
BATCH_BYTES = 1_000_000

#: ASCII white space as the word rules of the operators define it.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is named, a local session (tests) gets a temporary one; a cluster, whose
    executors could not read that, gets an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="keyloom-"))
    return spark.sparkContext.getCheckpointDir()


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts the lineage.

    The table outlives lost executors. It goes with ``discard`` or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/keyloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later step reads."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            _remove(table.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may have ended before this exit hook
        pass


_held: dict = {}


def hold(key, build: Callable):
    """The model of ``key`` in this worker. One is held at a time, as stages share the workers."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def settle(keep_model: bool = False) -> None:
    """Return what a task took: the worker lives on for tasks of other stages."""
    if not keep_model:
        _held.clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows in this session, as whole texts cross. Called by the registered queries
    and the pipeline, which own their session; operators leave settings alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def pieces(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts have about BATCH_BYTES together."""
    ends = np.cumsum(np.nan_to_num(sizes.to_numpy(zero_copy_only=False).astype(float)))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0.0
        stop = max(start + 1, int(np.searchsorted(ends, done + BATCH_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def annotate(
    df: DataFrame,
    keep: list[str],
    text: str | Column,
    make: Callable[[], Callable[[list], dict]],
    result: str,
) -> DataFrame:
    """``keep`` columns and, beside them, what Python finds in each text.

    ``make()`` runs once in each task and returns a function from a list of
    texts (None for null) to columns, by the names of the DDL ``result``.
    The kept columns cross Python untouched, so that no join is needed.
    """
    place = keep.index(text) if isinstance(text, str) and text in keep else None  # then the text crosses once, among the kept columns
    text = F.col(text) if isinstance(text, str) else text
    inner = df.select(F.struct(*[df[c] for c in keep]).alias("k"), (text if place is None else F.lit(None).cast("string")).alias("t"))
    kept = inner.schema["k"].dataType.simpleString()
    kind = _arrow_types(result)  # parsed here: workers have no session

    def texts_of(batch):
        return batch.column(1) if place is None else batch.column(0).field(place)

    def run(batches):
        work = make()
        for batch in batches:
            for part in pieces(batch, pc.binary_length(texts_of(batch))):
                found = work(texts_of(part).to_pylist())
                arrays = [pa.array(found[n], type=kind[n]) for n in kind]
                out = pa.StructArray.from_arrays(arrays, names=list(kind))
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=["k", "r"])
        settle(keep_model=True)

    names = [f.name for f in _fields(result)]
    return (
        inner.mapInArrow(run, f"k {kept}, r struct<{_struct(result)}>")
        .select(*[F.col("k").getField(c).alias(c) for c in keep], *[F.col("r").getField(n).alias(n) for n in names])
    )


def _fields(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fields


def _struct(ddl: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in _fields(ddl))


def _arrow_types(ddl: str) -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return {f.name: to_arrow_type(f.dataType) for f in _fields(ddl)}


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` would also change letters beyond ASCII."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; looks at no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows
