"""Point reads, key selectors and range reads over any ordered key column."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.keys import next_prefix
from keyloom.operators.ordered import between, position, running_sum


@dataclass(frozen=True)
class KeySelector:
    """The last key below ``key`` (or up to it, with ``or_equal``), moved on by ``offset`` keys."""

    key: Any
    or_equal: bool
    offset: int

    def __add__(self, n: int) -> KeySelector:
        return replace(self, offset=self.offset + n)

    def __sub__(self, n: int) -> KeySelector:
        return self + -n

    @classmethod
    def last_less_than(cls, key) -> KeySelector:
        return cls(key, False, 0)

    @classmethod
    def last_less_or_equal(cls, key) -> KeySelector:
        return cls(key, True, 0)

    @classmethod
    def first_greater_than(cls, key) -> KeySelector:
        return cls(key, True, 1)

    @classmethod
    def first_greater_or_equal(cls, key) -> KeySelector:
        return cls(key, False, 1)


def get(kv: DataFrame, key, column: str = "key") -> DataFrame:
    """The pair of a key, or no row."""
    return kv.where(F.col(column) == F.lit(key))


def resolve(kv: DataFrame, selector: KeySelector, column: str = "key", first=None, last=None) -> DataFrame:
    """One row with the selected key; ``first`` and ``last`` where the selector runs off either end.

    An offset of n reads n keys next to the anchor (a top-n of each partition), never the whole order.
    """
    c = F.col(column)
    if selector.offset > 0:
        side = c > F.lit(selector.key) if selector.or_equal else c >= F.lit(selector.key)
        ordered, skip, beyond, pick = kv.where(side).select(column).distinct().orderBy(c), selector.offset - 1, last, F.min(c)
    else:
        side = c <= F.lit(selector.key) if selector.or_equal else c < F.lit(selector.key)
        ordered, skip, beyond, pick = kv.where(side).select(column).distinct().orderBy(c.desc()), -selector.offset, first, F.max(c)
    if not skip:
        return kv.where(side).agg(F.coalesce(pick, F.lit(beyond)).alias(column))
    return ordered.limit(skip + 1).offset(skip).agg(F.coalesce(F.min(c), F.lit(beyond)).alias(column))


def get_range(kv: DataFrame, begin=None, end=None, limit: int = 0, reverse: bool = False, column: str = "key", mode: str | None = None) -> DataFrame:
    """Pairs of [begin, end) in order; selectors are resolved first. ``mode`` (a batching hint) has no effect on a distributed scan."""
    begin, end = (_value(kv, x, column) for x in (begin, end))
    rows = kv.where(between(F.col(column), begin, end))
    rows = rows.orderBy(F.col(column).desc() if reverse else F.col(column))
    return rows.limit(limit) if limit else rows


def _value(kv: DataFrame, bound, column: str):
    return resolve(kv, bound, column).first()[0] if isinstance(bound, KeySelector) else bound


def get_range_stream(kv: DataFrame, begin=None, end=None, column: str = "key") -> DataFrame:
    """Pairs of a range in no order, one stream for each partition."""
    return kv.where(between(F.col(column), begin, end))


def get_range_startswith(kv: DataFrame, prefix: bytes | str, column: str = "key") -> DataFrame:
    """Pairs whose key starts with a prefix, as a range so that file statistics prune."""
    if isinstance(prefix, str):
        end = prefix[:-1] + chr(ord(prefix[-1]) + 1) if prefix else None
        return kv.where(between(F.col(column), prefix, end))
    return kv.where(between(F.col(column), prefix, next_prefix(prefix) if prefix else None))


def get_range_bytes(kv: DataFrame, size: Column, target: int, column: str = "key") -> DataFrame:
    """Pairs from the first on until ``target`` bytes are reached; the pair that reaches it is the last."""
    summed = running_sum(kv.withColumn("_size", size.cast("bigint")), column, "_size", "_sum")
    return summed.where(F.col("_sum") - F.col("_size") < target).drop("_size", "_sum")


def segments(kv: DataFrame, rows: int, column: str = "key") -> DataFrame:
    """Pairs with the number of the batch that a reader of ``rows`` at a time gets them in."""
    return position(kv, column, "_n").withColumn("segment", F.floor((F.col("_n") - 1) / rows)).drop("_n")


def boundary_keys(shards: DataFrame, begin=None, end=None) -> DataFrame:
    """Start keys of the shards in a range."""
    return shards.where(between(F.col("begin"), begin, end)).select(F.col("begin").alias("key")).orderBy("key")
