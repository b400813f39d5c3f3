"""Byte samples, size estimates, split points, hot ranges, sketches and smoothers.

Greedy rules restart at every border they set, so no window can express them. They
run over the byte sample of one shard at a time (groupBy shard, applyInPandas), which is
bounded by the shard size; shards run in parallel.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.buckets import sketch_bucket, sketch_value
from keyloom.operators.ordered import between

# Fixed values of the byte sample: overhead of a key, bytes that one sampled byte stands for.
SAMPLE_OVERHEAD = 100
SAMPLE_UNIT = 250


def byte_sample(kv: DataFrame, key: Column, size: Column) -> DataFrame:
    """Pairs whose key hash falls under p = clamp(size / (key + overhead) / unit), with sampled_size = size / p.

    The hash is crc32 of the key, so a pair is in the sample or not wherever it is read.
    """
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), size / (F.octet_length(key) + SAMPLE_OVERHEAD) / SAMPLE_UNIT))
    rows = kv.withColumn("probability", p).where(F.crc32(key) / F.lit(float(1 << 32)) < F.col("probability"))
    return rows.withColumn("sampled_size", F.floor(size / F.col("probability")).cast("bigint"))


def range_size(sample: DataFrame, begin=None, end=None, key: str = "key", size: str = "sampled_size") -> DataFrame:
    return sample.where(between(F.col(key), begin, end)).agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


class Order:
    """Sorted (key, size) pairs with sums over ranges and the key at a sum."""

    def __init__(self, pairs):
        pairs = sorted(pairs)
        self.keys = [k for k, _ in pairs]
        self.sums = [0, *accumulate(s for _, s in pairs)]

    @classmethod
    def of(cls, keys, sizes) -> Order:
        """The order of two columns of whole numbers: 8 bytes for a key and 8 for its sum, where pairs are objects."""
        keys, sizes = np.asarray(keys), np.asarray(sizes)
        if keys.dtype.kind not in "iu" or sizes.dtype.kind not in "iu":
            return cls(zip(keys.tolist(), sizes.tolist(), strict=True))
        by_key = np.argsort(keys, kind="stable")
        order = cls(())
        order.keys = memoryview(keys[by_key])  # gives Python's numbers
        sums = np.zeros(len(keys) + 1, "int64")
        np.cumsum(sizes[by_key], out=sums[1:])
        order.sums = memoryview(sums)
        return order

    def below(self, key) -> int:
        return self.sums[bisect_left(self.keys, key)]

    def between(self, begin, end) -> int:
        return self.below(end) - self.below(begin)

    def beyond(self, total: int) -> int:
        """Index of the first key whose inclusive sum is over ``total``."""
        return bisect_right(self.sums, total) - 1


def split_points(order: Order, begin, end, chunk: int, limit: int | None = None) -> list:
    """Keys that cut [begin, end) into chunks: each is the first with over ``chunk`` between the last cut and its own end."""
    out: list = []
    at = begin
    while limit is None or len(out) < limit:
        i = order.beyond(order.below(at) + chunk)
        if i < len(order.keys) and order.keys[i] == at:
            i += 1
        if i >= len(order.keys) or order.keys[i] >= end:
            break
        at = order.keys[i]
        out.append(at)
    return out


def hot_ranges(sizes: Order, reads: Order, begin, end, ratio: float, chunk: int) -> list[tuple]:
    """Stretches (begin, end, bytes, read) whose reads for each byte are over ``ratio``; neighbours are merged."""
    total = sizes.between(begin, end)
    if total <= 0:
        return []
    if total <= chunk:
        read = reads.between(begin, end)
        return [(begin, end, total, read)] if read > ratio * total else []
    stop = bisect_left(sizes.keys, end)  # no chunk goes on beyond the first sampled key at or behind the end
    out: list[tuple] = []
    at = begin
    while True:
        i = sizes.beyond(sizes.below(at) + chunk)
        if i < len(sizes.keys) and sizes.keys[i] == at:
            i += 1
        i = min(i, stop) if i < len(sizes.keys) else i
        if i >= len(sizes.keys) or sizes.keys[i] <= at:
            break
        to = sizes.keys[i]
        size, read = sizes.between(at, to), reads.between(at, to)
        if read > ratio * max(chunk, size):
            if out and out[-1][1] == at:
                b, _, s, r = out.pop()
                out.append((b, to, s + size, r + read))
            else:
                out.append((at, to, size, read))
        at = to
    return out


def equal_divide(reads: Order, begin, end, chunks: int) -> list[tuple]:
    """[begin, end) in at most ``chunks`` pieces of about equal reads."""
    total = reads.between(begin, end)
    step = max(1, math.ceil(total / chunks))
    cuts = split_points(reads, begin, end, step)
    return list(zip([begin, *cuts], [*cuts, end], strict=True))[:chunks]


def by_shard(sample: DataFrame, shard: str, run, schema: str) -> DataFrame:
    """``run(shard, rows)`` for each shard's sample."""
    return sample.groupBy(shard).applyInPandas(lambda pdf: run(pdf[shard].iloc[0], pdf), schema)


def shard_split_points(sample: DataFrame, chunk: int, shard: str = "shard", key: str = "key", size: str = "size", limit: int | None = None) -> DataFrame:
    """(shard, n, key): the split points of every shard, over its own first and last keys."""
    kind = sample.schema[key].dataType.simpleString()
    name = sample.schema[shard].dataType.simpleString()

    def run(which, pdf):
        order = Order.of(pdf[key], pdf[size].astype("int64"))
        end = order.keys[-1]
        cuts = split_points(order, order.keys[0], end, chunk, limit)
        return pd.DataFrame({shard: [which] * len(cuts), "n": range(len(cuts)), "key": cuts})

    return by_shard(sample, shard, run, f"`{shard}` {name}, n bigint, key {kind}")


def balanced_piece(left: int, limit: int) -> float:
    """What the next piece holds, of what is ``left``: under the limit, and less as less is left."""
    return left / (left / limit + 0.5)


def split_metrics(order: Order, rates: Order, begin, end, size_limit: int, rate_limit: int, min_size: int) -> list:
    """Cuts of [begin, end) into pieces near the size and the rate limit, each by what is left, none under ``min_size``; the nearer limit cuts (no jitter)."""
    cuts: list = []
    at = begin
    while order.between(at, end) >= 2 * min_size:
        size, rate = order.between(at, end), rates.between(at, end)
        to = end
        if size > balanced_piece(size, size_limit):
            to = position_at(order, at, end, balanced_piece(size, size_limit))
        to = max(to, position_at(order, at, end, min_size))
        if rate and rate > balanced_piece(rate, rate_limit):
            to = min(to, position_at(rates, at, end, balanced_piece(rate, rate_limit)))
        if to >= end or to <= at:
            break
        cuts.append(to)
        at = to
    return cuts


def merge_shards(shards: list[tuple], start: int, limit: int, most: int | None = None) -> tuple | None:
    """(begin, end, size) that small shard number ``start`` of neighbours (begin, end, size) becomes: those behind it are taken in while
    the sum keeps the limit and there are at most ``most`` shards, then those before it. None if there is nothing to take in."""
    begin, end, size = shards[start]
    taken = 1
    for side in (shards[start + 1 :], shards[:start][::-1]):
        for b, e, s in side:
            if size + s > limit or (most is not None and taken >= most) or (b != end and e != begin):
                break
            begin, end, size, taken = min(begin, b), max(end, e), size + s, taken + 1
    return (begin, end, size) if taken > 1 else None


def merge_small(shards: list[tuple], limit: int, small: int, most: int | None = None) -> list[tuple]:
    """All shards after each one under ``small`` was merged with its neighbours, from the first on."""
    out = list(shards)
    i = 0
    while i < len(out):
        merged = merge_shards(out, i, limit, most) if out[i][2] < small else None
        if merged:
            inside = [k for k, (b, e, _) in enumerate(out) if merged[0] <= b and e <= merged[1]]
            out[inside[0] : inside[-1] + 1] = [merged]
            i = inside[0]
        i += 1
    return out


def position_at(order: Order, begin, end, offset: int, front: bool = True):
    """The key with ``offset`` bytes before it from the front, or behind it from the back."""
    goal = order.below(begin) + offset if front else order.below(end) - offset
    i = order.beyond(goal)
    k = order.keys[i] if i < len(order.keys) else end
    return min(max(k, begin), end)


# ---- quantile sketches ------------------------------------------------------------


def sketch(df: DataFrame, value: str, error: float, by: list[str] = ()) -> DataFrame:
    """(by, bucket, n): counts of samples by bucket; null bucket for samples that count as zero."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, sketch_bucket(F.col(value), error).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """Bucket-wise sums; all must have one error."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def sketch_percentile(sketches: DataFrame, share: float, error: float, by: list[str] = ()) -> DataFrame:
    """The value of the bucket that holds the sample of rank floor(share * (n - 1)). A sketch has few buckets, whatever its samples."""
    order = Window.partitionBy(*by).orderBy(F.col("bucket").asc_nulls_first())
    whole = Window.partitionBy(*by)
    rows = sketches.withColumn("_up", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(whole))
    rows = rows.where(F.col("_up") > F.floor(F.lit(share) * (F.col("_all") - 1)))
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(sketch_value(F.col("bucket"), error))
    return rows.groupBy(*by).agg(F.min(value).alias("value"))


def sketch_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence (bits) of two sketches; buckets that one of them lacks are skipped in its term."""
    pa = a.crossJoin(F.broadcast(a.agg(F.sum("n").alias("t")))).select("bucket", (F.col("n") / F.col("t")).alias("p"))
    pb = b.crossJoin(F.broadcast(b.agg(F.sum("n").alias("t")))).select("bucket", (F.col("n") / F.col("t")).alias("q"))
    both = pa.withColumnRenamed("bucket", "x").join(pb, F.col("x").eqNullSafe(F.col("bucket")), "full")
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    m = (p + q) / 2
    term = lambda v: F.when(v > 0, v * F.log2(v / m)).otherwise(F.lit(0.0))
    return both.agg((F.sum(term(p)) / 2 + F.sum(term(q)) / 2).alias("divergence"))


# ---- smoothers ---------------------------------------------------------------------


def smooth(df: DataFrame, by: list[str], time: str, delta: str, folding: float) -> DataFrame:
    """(by, total, smooth_total, smooth_rate) after the last change: an exponential estimate with e-folding time ``folding`` (seconds).

    The estimate moves towards the total by 1 - exp(-dt / folding) between changes; changes of one
    instant are summed, so their order does not matter.
    """
    at = df.groupBy(*by, F.col(time).alias("_t")).agg(F.sum(delta).alias("_d"))
    lists = at.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("_t").alias("t"), F.col("_d").cast("double").alias("d")))).alias("x"))
    zero = F.struct(F.col("x")[0]["t"].alias("t"), F.lit(0.0).alias("total"), F.lit(0.0).alias("estimate"))

    def step(s, e):
        gone = (e["t"] - s["t"]).cast("double")
        moved = s["estimate"] + (s["total"] - s["estimate"]) * (1 - F.exp(-gone / folding))
        return F.struct(e["t"].alias("t"), (s["total"] + e["d"]).alias("total"), moved.alias("estimate"))

    out = lists.select(*by, F.aggregate("x", zero, step).alias("s"))
    return out.select(*by, F.col("s.total").alias("total"), F.col("s.estimate").alias("smooth_total"), ((F.col("s.total") - F.col("s.estimate")) / folding).alias("smooth_rate"))


def holt_smooth(df: DataFrame, by: list[str], time: str, value: str, level: float, trend: float) -> DataFrame:
    """(by, level, trend) of double exponential smoothing with shares ``level`` and ``trend`` of the newest sample."""
    lists = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v")))).alias("x"))
    zero = F.struct(F.col("x")[0]["v"].alias("l"), F.lit(0.0).alias("b"))

    def step(s, e):
        new = e["v"] * level + (s["l"] + s["b"]) * (1 - level)
        return F.struct(new.alias("l"), ((new - s["l"]) * trend + s["b"] * (1 - trend)).alias("b"))

    out = lists.select(*by, F.aggregate(F.slice("x", F.lit(2), F.greatest(F.lit(1), F.size("x"))), zero, step).alias("s"))
    return out.select(*by, F.col("s.l").alias("level"), F.col("s.b").alias("trend"))


def busiest(df: DataFrame, interval: Column, tag: Column, cost: Column, top: int, least: float) -> DataFrame:
    """The ``top`` tags of each interval by cost, of those at or over ``least``, with their share of the interval's cost."""
    sums = df.groupBy(interval.alias("interval"), tag.alias("tag")).agg(F.sum(cost).alias("cost"))
    own = Window.partitionBy("interval")
    ranked = sums.withColumn("share", F.col("cost") / F.sum("cost").over(own)).where(F.col("cost") >= least)
    ranked = ranked.withColumn("rank", F.row_number().over(own.orderBy(F.desc("cost"), "tag")))
    return ranked.where(F.col("rank") <= top)


def transient(df: DataFrame, by: list[str], seconds: str, size: str, keep: int) -> DataFrame:
    """Rows with the sum over the last ``keep`` seconds of their group: samples expire as they age."""
    frame = Window.partitionBy(*by).orderBy(seconds).rangeBetween(-(keep - 1), 0)
    return df.withColumn("live", F.sum(size).over(frame))


def first_outside(df: DataFrame, by: list[str], order: list[str], change: str, low: float, high: float) -> DataFrame:
    """The first row of each group at which the running sum leaves [low, high]."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("total", F.sum(change).over(frame)).where((F.col("total") < low) | (F.col("total") > high))
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(*by, "_f.*")
