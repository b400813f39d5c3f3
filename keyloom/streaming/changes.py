"""Change streams: registration, consumption in commit order, acknowledgement, watches.

A stream is a half-open key range with a name. A source is any streaming DataFrame of mutations
(version, seq, kind, key, end, value); the checkpoint of a query is its cursor. Delivery is at
least once; ``apply_changes`` makes it once by (version, seq).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Registry:
    """Named streams over key ranges. Registering a name again with its own range changes nothing; with another raises."""

    def __init__(self) -> None:
        self._streams: dict[str, tuple[int, object, object, int]] = {}
        self._next = 0

    def register(self, name: str, begin, end, min_version: int = 0) -> int:
        if not begin < end:
            raise ValueError("a stream needs a range that is not empty")
        if name in self._streams:
            known = self._streams[name]
            if known[1:3] != (begin, end):
                raise ValueError(f"{name} has another range")
            return known[0]
        self._streams[name] = (self._next, begin, end, min_version)
        self._next += 1
        return self._next - 1

    def remove(self, name: str) -> None:
        self._streams.pop(name, None)

    def acknowledge(self, name: str, version: int) -> None:
        """Versions up to ``version`` are no longer kept for the stream."""
        i, b, e, v = self._streams[name]
        self._streams[name] = (i, b, e, max(v, version))

    def resume(self, name: str, version: int) -> int:
        """The first version to read; a cursor older than what is kept raises."""
        if version < self._streams[name][3]:
            raise ValueError("the cursor is too old")
        return version + 1

    def table(self, spark: SparkSession, kind: str = "bigint") -> DataFrame:
        rows = [(n, i, b, e, v) for n, (i, b, e, v) in sorted(self._streams.items())]
        return spark.createDataFrame(rows, f"name string, stream_id bigint, begin {kind}, end {kind}, min_version bigint")


def touches(begin: Column, end: Column) -> Column:
    """Whether a mutation touches [begin, end): its key is inside, or its cleared range overlaps."""
    return F.when(F.col("kind") == "clear_range", (F.col("key") < end) & (F.col("end") > begin)).otherwise((F.col("key") >= begin) & (F.col("key") < end))


def clipped(mutations: DataFrame, begin: Column, end: Column) -> DataFrame:
    """Mutations of a range; cleared ranges are cut to it."""
    rows = mutations.where(touches(begin, end))
    ranged = F.col("kind") == "clear_range"
    return rows.withColumns({"key": F.when(ranged, F.greatest("key", begin)).otherwise(F.col("key")), "end": F.when(ranged, F.least("end", end)).otherwise(F.col("end"))})


def route(mutations: DataFrame, streams: DataFrame) -> DataFrame:
    """Every mutation once for each stream whose range it touches, clipped. The registry is metadata: a row for each stream."""
    s = streams.select("stream_id", F.col("begin").alias("_b"), F.col("end").alias("_e"))
    joined = mutations.join(s, touches(F.col("_b"), F.col("_e")))
    ranged = F.col("kind") == "clear_range"
    return joined.withColumns(
        {"key": F.when(ranged, F.greatest("key", "_b")).otherwise(F.col("key")), "end": F.when(ranged, F.least("end", "_e")).otherwise(F.col("end"))}
    ).drop("_b", "_e")


def consume(stream: DataFrame, begin, end, deliver: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Starts a query that hands the mutations of a range, in commit order, to ``deliver`` batch by batch."""
    rows = clipped(stream, F.lit(begin), F.lit(end))
    writer = rows.writeStream.foreachBatch(lambda df, i: deliver(df.orderBy("version", "seq"), i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def apply_changes(batch: DataFrame, target: str, applied: str) -> None:
    """Appends the mutations of a batch that ``target`` does not hold yet; a batch that comes again adds nothing.

    ``applied`` names the folder where one file of the last version and place of each batch is kept.
    """
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(["version", "seq"])
    try:
        last = spark.read.schema("version bigint, seq bigint").parquet(applied).agg(F.max(F.struct("version", "seq")).alias("m")).first()["m"]
    except Exception as e:  # the first batch: nothing has been applied
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    if last is not None:
        v, q = F.lit(last["version"]), F.lit(last["seq"])
        fresh = fresh.where((F.col("version") > v) | ((F.col("version") == v) & (F.col("seq") > q)))
    fresh.write.mode("append").parquet(target)
    fresh.agg(F.max(F.struct("version", "seq")).alias("m")).where("m is not null").select("m.version", "m.seq").write.mode("append").parquet(applied)


def replicate(stream: DataFrame, begin, end, target: str, applied: str, checkpoint: str) -> None:
    """Copies the mutations of a range that have come so far to ``target``; called again it goes on behind the last one."""
    consume(stream, begin, end, lambda df, i: apply_changes(df, target, applied), checkpoint).awaitTermination()


def acknowledge(acks: DataFrame, path: str) -> None:
    """Appends (name, version) to the table of acknowledgements, which outlives the reader that wrote them."""
    acks.select("name", F.col("version").cast("bigint").alias("version")).write.mode("append").parquet(path)


def acknowledged(spark: SparkSession, path: str) -> DataFrame:
    """(name, min_version): what is no longer kept for each stream."""
    return spark.read.parquet(path).groupBy("name").agg(F.max("version").alias("min_version"))


def resume(cursors: DataFrame, kept: DataFrame) -> DataFrame:
    """Cursors (name, cursor) with ``status`` (ok, or too_old where the stream keeps later versions only) and the ``first_version`` to read."""
    ok = F.col("cursor") >= F.coalesce("min_version", F.lit(0))
    joined = cursors.join(kept, "name", "left").withColumn("status", F.when(ok, "ok").otherwise("too_old"))
    return joined.withColumn("first_version", F.when(ok, F.col("cursor") + 1)).drop("min_version")


def pack_replies(sizes: list[tuple[int, int]], limit: int) -> list[list[int]]:
    """Versions packed into replies of at most ``limit`` bytes; a version is never split, a larger one is alone."""
    out: list[list[int]] = []
    held = 0
    for version, size in sizes:
        if out and held + size <= limit:
            out[-1].append(version)
            held += size
        else:
            out.append([version])
            held = size
    return out


def reply_numbers(sizes: np.ndarray, limit: int) -> np.ndarray:
    """The number of the reply that ``pack_replies`` puts each version in; a few bytes are held for each, and each reply is found by one search."""
    sums = np.zeros(len(sizes) + 1, "int64")
    np.cumsum(sizes, out=sums[1:])
    at, fresh = 0, np.zeros(len(sizes), "int64")
    found = memoryview(sums)
    while at < len(sizes):
        fresh[at] = at > 0
        at = max(at + 1, bisect_right(found, found[at] + limit, lo=at + 1) - 1)
    return np.cumsum(fresh, out=fresh)


def replies(mutations: DataFrame, stream: str, size: Column, limit: int) -> DataFrame:
    """(stream, version, reply): the reply of each version, packed for every stream."""
    sizes = mutations.groupBy(stream, "version").agg(F.sum(size).alias("size"))
    kind = mutations.schema[stream].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("version")
        sizes = table["size"].fill_null(0).to_numpy()
        return pa.table({stream: table[stream], "version": table["version"], "reply": reply_numbers(sizes, limit)})

    return sizes.groupBy(stream).applyInArrow(run, f"`{stream}` {kind}, version bigint, reply bigint")


def watch(stream: DataFrame, key_kind: str = "bigint") -> DataFrame:
    """(key, version, old_value, value) whenever a key's value differs from the last one seen; A, B, A inside one batch is told change by change."""

    def run(key, batches, state: GroupState):
        old = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["version", "seq"])
        out = []
        for v, value, kind in zip(rows["version"], rows["value"], rows["kind"], strict=True):
            new = None if kind == "clear" or pd.isna(value) else value
            if new != old:
                out.append((key[0], v, old, new))
                old = new
        state.update((old,))
        yield pd.DataFrame(out, columns=["key", "version", "old_value", "value"])

    return stream.groupBy("key").applyInPandasWithState(
        run, f"key {key_kind}, version bigint, old_value string, value string", "value string", "append", GroupStateTimeout.NoTimeout
    )


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums in event-time windows with a watermark for late rows."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *by, "n")
