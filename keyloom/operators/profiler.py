"""Workload profiles: top keys and ranges, buckets of equal load, states at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.joins import asof
from keyloom.operators.stats import by_shard


def profile_filter(events: DataFrame, kinds: list[str] | None = None, start=None, end=None) -> DataFrame:
    rows = events if kinds is None else events.where(F.col("type").isin(kinds))
    rows = rows if start is None else rows.where(F.col("start_ts") >= F.lit(start))
    return rows if end is None else rows.where(F.col("start_ts") < F.lit(end))


def top_k(events: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` most frequent; equally frequent ones in their own order."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by).limit(k)


def write_buckets(pairs: list[tuple], count: int) -> list[tuple]:
    """(first key, last key, n) of buckets that close when they reach total // count; ``pairs`` are sorted (key, n)."""
    goal = max(1, sum(n for _, n in pairs) // max(1, count))
    out, first, held = [], None, 0
    for key, n in pairs:
        first = key if first is None else first
        held += n
        if held >= goal:
            out.append((first, key, held))
            first, held = None, 0
    if first is not None:
        out.append((first, pairs[-1][0], held))
    return out


def read_buckets(ranges: list[tuple], count: int) -> list[tuple]:
    """(begin, end, opened, total) of buckets over (begin, end) ranges: one closes at the first border, begin or end, behind which its openings are total // count or more.

    ``total`` also counts ranges that were open when the bucket began.
    """
    if not ranges:
        return []
    goal = max(1, len(ranges) // max(1, count))
    borders: dict = {}
    for b, e in ranges:
        borders.setdefault(b, [0, 0])[0] += 1
        borders.setdefault(e, [0, 0])[1] += 1
    out, begin, opened, carried, live = [], None, 0, 0, 0
    for key in sorted(borders):
        ups, downs = borders[key]
        live -= downs
        if begin is not None and opened >= goal:
            out.append((begin, key, opened, opened + carried))
            begin, opened, carried = None, 0, live
        opened += ups
        live += ups
        if begin is None and opened + carried:
            begin = key
    if begin is not None:
        out.append((begin, max(borders), opened, opened + carried))
    return out


def bucket_writes(counts: DataFrame, buckets: int, shard: str = "shard") -> DataFrame:
    """Write buckets of every shard from (shard, key, n)."""
    kind, name = counts.schema["key"].dataType.simpleString(), counts.schema[shard].dataType.simpleString()

    def run(which, pdf):
        got = write_buckets(sorted(zip(pdf["key"], pdf["n"], strict=True)), buckets)
        return pd.DataFrame([(which, i, *g) for i, g in enumerate(got)], columns=[shard, "bucket", "first_key", "last_key", "n"])

    return by_shard(counts, shard, run, f"`{shard}` {name}, bucket bigint, first_key {kind}, last_key {kind}, n bigint")


def bucket_reads(ranges: DataFrame, buckets: int, shard: str = "shard") -> DataFrame:
    """Read buckets of every shard from (shard, begin, end)."""
    kind, name = ranges.schema["begin"].dataType.simpleString(), ranges.schema[shard].dataType.simpleString()

    def run(which, pdf):
        got = read_buckets(list(zip(pdf["begin"], pdf["end"], strict=True)), buckets)
        return pd.DataFrame([(which, i, *g) for i, g in enumerate(got)], columns=[shard, "bucket", "begin", "end", "opened", "total"])

    return by_shard(ranges, shard, run, f"`{shard}` {name}, bucket bigint, begin {kind}, end {kind}, opened bigint, total bigint")


def shards_of(ranges: DataFrame, shards: DataFrame) -> DataFrame:
    """Ranges with the number of shards (begin, end, address) they touch and the addresses. The shard map is metadata, a row for each shard."""
    s = shards.select(F.col("begin").alias("_b"), F.col("end").alias("_e"), "address")
    hit = ranges.join(s, (F.col("begin") < F.col("_e")) & (F.col("_b") < F.col("end")))
    return hit.groupBy("begin", "end").agg(F.count(F.lit(1)).alias("shards"), F.array_sort(F.collect_set("address")).alias("addresses"))


def reassemble(chunks: DataFrame, txn: str = "txn", part: str = "part", parts: str = "parts", payload: str = "payload") -> DataFrame:
    """Chunked records put together in order; records that lack a chunk are left out."""
    lists = chunks.groupBy(txn, parts).agg(F.array_sort(F.collect_set(F.struct(part, payload))).alias("x"))
    return lists.where(F.size("x") == F.col(parts)).select(txn, F.array_join(F.transform("x", lambda e: e[payload]), "").alias(payload))


def state_at_times(times: DataFrame, events: DataFrame, by: list[str], columns: list[str], at: str = "ts") -> DataFrame:
    """For every time the last event of its group up to then."""
    return asof(times, events, at, columns, by)


def group_sums(df: DataFrame, by: Column, size: Column, k: int) -> DataFrame:
    """The ``k`` groups of the largest sums, such as allocation stacks."""
    return df.groupBy(by.alias("stack")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size")).orderBy(F.desc("size"), "stack").limit(k)
