"""Running values over one global order, without sending all rows to one task.

Rows are cut into ranges of the order at sampled borders, twice as many as shuffle partitions (MOST at most). Null keys come first.
Windows run inside the ranges, and one row of totals for each range carries over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 512
SAMPLE = 8192


def borders(df: DataFrame, key: str, ranges: int | None = None) -> list:
    """Keys that cut the order into about equal parts, from a sample drawn by hash of at most SAMPLE rows."""
    ranges = ranges or min(MOST, 2 * max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    drawn = df.select(F.col(key).alias("k")).where("k is not null").orderBy(F.xxhash64("k"), "k").limit(SAMPLE).collect()
    keys = sorted({bytes(r["k"]) if isinstance(r["k"], bytearray) else r["k"] for r in drawn if r["k"] == r["k"]})  # NaN, the greatest, is in the last range
    step = max(1, len(keys) // ranges)
    return keys[step::step][: ranges - 1]


def range_of(key: Column, cuts: list) -> Column:
    """Number of cuts up to the key, by a balanced tree of comparisons; 0 for null, which windows order first."""
    return F.when(key.isNull(), F.lit(0)).otherwise(_tree(key, cuts))


def _tree(key: Column, cuts: list) -> Column:
    if not cuts:
        return F.lit(0)
    mid = len(cuts) // 2
    low, high = _tree(key, cuts[:mid]), _tree(key, cuts[mid + 1 :]) + F.lit(mid + 1)
    return F.when(key < F.lit(cuts[mid]), low).otherwise(high)


def running_sum(df: DataFrame, key: str, value: str | Column, out: str, *ties: str) -> DataFrame:
    """``df`` with the inclusive sum of ``value`` over all rows up to the present one, in the order of ``key`` and ``ties``."""
    cuts = borders(df, key)
    value = F.col(value) if isinstance(value, str) else value
    rows = df.withColumn("_r", range_of(F.col(key), cuts)).withColumn("_v", value)
    totals = rows.groupBy("_r").agg(F.sum("_v").alias("_t"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select(F.col("_r").alias("_q"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_r").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_s", F.sum("_v").over(order)).join(F.broadcast(totals), F.col("_r") == F.col("_q"))
    return summed.withColumn(out, F.col("_s") + F.col("_before")).drop("_r", "_v", "_s", "_q", "_before")


def running_max(df: DataFrame, key: str, value: str, out: str, *ties: str) -> DataFrame:
    """``df`` with the greatest ``value`` of all rows up to the present one."""
    rows = df.withColumn("_r", range_of(F.col(key), borders(df, key)))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    tops = rows.groupBy("_r").agg(F.max(value).alias("_t")).select(F.col("_r").alias("_q"), F.max("_t").over(before).alias("_before"))
    order = Window.partitionBy("_r").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_m", F.max(value).over(order)).join(F.broadcast(tops), F.col("_r") == F.col("_q"))
    return found.withColumn(out, F.greatest("_m", "_before")).drop("_r", "_m", "_q", "_before")


def position(df: DataFrame, key: str, out: str, *ties: str) -> DataFrame:
    """``df`` with the row's number in the global order, from 1."""
    return running_sum(df, key, F.lit(1).cast("bigint"), out, *ties)


def previous(df: DataFrame, key: str, columns: dict[str, str], *ties: str) -> DataFrame:
    """``df`` with the values that ``columns`` (source -> new name) have in the row before, in one global order."""
    cuts = borders(df, key)
    rows = df.withColumn("_r", range_of(F.col(key), cuts))
    order = Window.partitionBy("_r").orderBy(key, *ties)
    last = rows.groupBy("_r").agg(F.max(F.struct(key, *ties, *[F.col(c).alias(f"_{n}") for c, n in columns.items()])).alias("_last"))
    last = last.select(F.col("_r").alias("_q"), F.lag("_last").over(Window.orderBy("_r")).alias("_p"))
    rows = rows.withColumn("_n", F.row_number().over(order))
    for c, n in columns.items():
        rows = rows.withColumn(f"_in_{n}", F.lag(c).over(order))
    rows = rows.join(F.broadcast(last), F.col("_r") == F.col("_q"), "left")
    for n in columns.values():
        rows = rows.withColumn(n, F.when(F.col("_n") == 1, F.col("_p").getField(f"_{n}")).otherwise(F.col(f"_in_{n}"))).drop(f"_in_{n}")
    return rows.drop("_r", "_q", "_p", "_n")


def between(key: Column, begin=None, end=None) -> Column:
    """begin <= key < end; None is unbounded."""
    tests = [key >= F.lit(begin)] * (begin is not None) + [key < F.lit(end)] * (end is not None)
    return reduce(lambda a, b: a & b, tests, F.lit(True))
