"""Index-mapped reads, nearest-key joins and interval joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators.ordered import borders, range_of


def mapper_columns(template: list[str], key: list[Column], value: list[Column]) -> tuple[list[Column], bool]:
    """Columns of a mapped key from a template of literals, ``{K[i]}``, ``{V[i]}`` and a last ``{...}``; doubled braces are literal.

    Returns the columns and whether the template asks for a range.
    """
    out: list[Column] = []
    for n, part in enumerate(template):
        if part == "{...}":
            if n != len(template) - 1:
                raise ValueError("{...} stands last only")
            return out, True
        m = re.fullmatch(r"\{([KV])\[(\d+)\]\}", part)
        if m:
            source = key if m[1] == "K" else value
            if int(m[2]) >= len(source):
                raise IndexError(f"{part}: there are {len(source)} elements")
            out.append(source[int(m[2])])
        elif re.search(r"[{}]", part.replace("{{", "").replace("}}", "")):
            raise ValueError(f"{part!r} is no element of a mapper")
        else:
            out.append(F.lit(part.replace("{{", "{").replace("}}", "}")))
    return out, False


def mapped_range(index: DataFrame, records: DataFrame, mapped: list[Column], record_key: list[str], many: bool = False, sort: list[str] | None = None) -> DataFrame:
    """Every index row with the record its mapped key names, or with the ordered records of that key prefix.

    A left outer equi-join: index rows without a record stay, with nulls or an empty list.
    """
    names = [f"_m{i}" for i in range(len(mapped))]
    left = index.withColumns(dict(zip(names, mapped, strict=True)))
    if not many:
        right = records.select("*", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(record_key)])
        on = [F.col(n) == F.col(f"_k{i}") for i, n in enumerate(names)]
        return left.join(right, on, "left").drop(*names, *[f"_k{i}" for i in range(len(record_key))])
    rest = sort or [c for c in records.columns if c not in record_key]
    lists = records.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(record_key)]).agg(
        F.array_sort(F.collect_list(F.struct(*rest, *[c for c in records.columns if c not in record_key and c not in rest]))).alias("records")
    )
    on = [F.col(n) == F.col(f"_k{i}") for i, n in enumerate(names)]
    joined = left.join(lists, on, "left").drop(*names, *[f"_k{i}" for i in range(len(record_key))])
    return joined.withColumn("records", F.coalesce("records", F.array()))


def asof(left: DataFrame, right: DataFrame, on: str, columns: list[str], by: list[str] = (), direction: str = "<=") -> DataFrame:
    """``left`` with ``columns`` of the nearest ``right`` row below (<, <=) or above (>, >=) its ``on``.

    The different keys of ``left`` and all of ``right`` are put in one order and the last right row seen is carried on; rows of ``left``
    get it by their key, so that neither equal keys nor wide rows are sorted. Groups of ``by`` are independent.
    Without ``by`` the order is cut into ranges, and one row for each range tells what it carries on. A null key meets nothing.
    """
    back, equal = direction[0] == "<", direction.endswith("=")
    side = 0 if equal == back else 1  # of right rows among equal keys: before left ones if equal keys count backwards
    groups = [f"_g{i}" for i in range(len(by))]
    grouped = [F.col(c).alias(g) for c, g in zip(by, groups, strict=True)]
    asked = left.select(*grouped, F.col(on).alias("_o")).where("_o is not null").distinct()
    known = right.where(F.col(on).isNotNull()).select(*grouped, F.col(on).alias("_o"), F.lit(side).alias("_s"), F.struct(*columns).alias("_v"))
    none = F.lit(None).cast(known.schema["_v"].dataType)
    both = asked.select(*groups, "_o", F.lit(1 - side).alias("_s"), none.alias("_v")).unionByName(known)
    keys = groups
    if not by:  # one order of all rows, cut into ranges
        both = both.withColumn("_r", range_of(F.col("_o"), borders(both, "_o")))
        keys = ["_r"]
    way = F.asc if back else F.desc  # a frame that ends at the row is kept up; one that begins there is read again for each row
    frame = Window.partitionBy(*keys).orderBy(way("_o"), way("_s")).rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last("_v", ignorenulls=True).over(frame)
    got = both.withColumn("_c", carried).where(F.col("_s") == 1 - side)
    if not by:  # what the ranges before or behind carry in: one row for each range
        pick = F.max_by if back else F.min_by
        ends = both.groupBy("_r").agg(pick("_v", F.when(F.col("_v").isNotNull(), F.col("_o"))).alias("_e"))
        over = F.last("_e", ignorenulls=True).over(Window.orderBy(way("_r")).rowsBetween(Window.unboundedPreceding, -1))
        got = got.join(F.broadcast(ends.select(F.col("_r").alias("_q"), over.alias("_in"))), F.col("_r") == F.col("_q"), "left")
        got = got.withColumn("_c", F.coalesce("_c", "_in"))
    rows = left.select(F.struct("*").alias("_l"), *[F.col(c).alias(f"_l{g}") for c, g in zip(by, groups, strict=True)], F.col(on).alias("_k"))
    match = F.col("_k") == F.col("_o")
    for g in groups:
        match = match & F.col(f"_l{g}").eqNullSafe(F.col(g))
    joined = rows.join(got.select(*groups, "_o", "_c"), match, "left")
    return joined.select("_l.*", *[F.col("_c").getField(c).alias(c) for c in columns])


def counted_below(left: DataFrame, right: DataFrame, value: tuple[str, str], by: tuple[str, str]) -> DataFrame:
    """``left`` with ``n``, the number of ``right`` rows of its group whose value is less than its own; rows with none are left out.

    ``value`` and ``by`` name the columns of both sides. This is what a join on left.value > right.value counts, without its pairs: counts of
    equal right values are summed along the order of each group, which is cut into ranges.
    """
    a = left.select(F.struct("*").alias("_l"), F.col(by[0]).alias("_g"), F.col(value[0]).alias("_o"), F.lit(0).alias("_s"), F.lit(0).cast("bigint").alias("_n"))
    b = right.groupBy(F.col(by[1]).alias("_g"), F.col(value[1]).alias("_o")).agg(F.count(F.lit(1)).alias("_n"))
    b = b.select(F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), "_g", "_o", F.lit(1).alias("_s"), "_n")
    both = a.union(b).where("_g is not null and _o is not null")  # equal values stand behind the left ones, as they are not less
    both = both.withColumn("_r", range_of(F.col("_o"), borders(both, "_o")))
    totals = both.groupBy("_g", "_r").agg(F.sum("_n").alias("_t"))
    before = F.sum("_t").over(Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    totals = totals.select(F.col("_g").alias("_h"), F.col("_r").alias("_q"), F.coalesce(before, F.lit(0)).alias("_before"))
    order = Window.partitionBy("_g", "_r").orderBy("_o", "_s").rowsBetween(Window.unboundedPreceding, 0)
    summed = both.withColumn("_m", F.sum("_n").over(order)).where("_s = 0")
    summed = summed.join(totals, (F.col("_g") == F.col("_h")) & (F.col("_r") == F.col("_q")))
    return summed.select("_l.*", (F.col("_m") + F.col("_before")).alias("n")).where("n > 0")


def overlapping(a: DataFrame, b: DataFrame, width: int | None = None, by: list[str] = ()) -> DataFrame:
    """Pairs of intervals (a.begin, a.end) and (b.begin, b.end) that share a point.

    With ``width`` (of integer keys) intervals are cut into cells and joined on the cell, so that nothing but
    neighbours is compared; a pair is reported in the cell where the later one begins. An empty interval lies in the cell
    of its begin, and shares a point with what holds that inside.
    """
    x = a.select(F.struct("*").alias("a"))
    y = b.select(F.struct("*").alias("b"))
    meet = (F.col("a.begin") < F.col("b.end")) & (F.col("b.begin") < F.col("a.end"))
    for c in by:
        meet = meet & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    if not width:
        return x.join(y, meet)

    def cells(s: str) -> Column:
        first = F.floor(F.col(f"{s}.begin") / width)
        return F.explode(F.when(F.col(f"{s}.end").isNotNull(), F.sequence(first, F.greatest(first, F.floor((F.col(f"{s}.end") - 1) / width)))))

    x, y = x.withColumn("_x", cells("a")), y.withColumn("_y", cells("b"))
    here = F.floor(F.greatest("a.begin", "b.begin") / width) == F.col("_x")
    return x.join(y, (F.col("_x") == F.col("_y")) & meet & here).drop("_x", "_y")


def timestamp_to_version(queries: DataFrame, marks: DataFrame, rate: int = 1_000_000) -> DataFrame:
    """``queries`` (ts) with the version that the last mark (ts, version) before gives, carried on at ``rate`` a second."""
    got = asof(queries, marks.withColumn("mark_ts", F.col("ts")), "ts", ["mark_ts", "version"])
    got = got.withColumn("_g", F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("mark_ts").cast("timestamp")))
    return got.withColumn("version", F.col("version") + _scaled("_g", rate, 1_000_000)).drop("mark_ts", "_g")


def version_to_timestamp(queries: DataFrame, marks: DataFrame, rate: int = 1_000_000) -> DataFrame:
    """The inverse: ``queries`` (version) with ts."""
    got = asof(queries, marks.withColumn("mark", F.col("version")), "version", ["mark", "ts"])
    got = got.withColumn("_g", F.col("version") - F.col("mark"))
    return got.withColumn("ts", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + _scaled("_g", 1_000_000, rate))).drop("mark", "_g")


def _scaled(column: str, times: int, over: int) -> Column:
    """floor(column * times / over) in whole numbers; the product of the whole column, which may not fit, is not made."""
    rest = F.pmod(F.col(column), F.lit(over))
    return (F.expr(f"(`{column}` - pmod(`{column}`, {over})) div {over}")) * times + F.floor((rest * times).cast("decimal(38,0)") / over).cast("bigint")


def compare_replicas(a: DataFrame, b: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """One row: keys that match, differ, or are in one replica only."""
    left = a.select(*key, F.struct(*value).alias("x"))
    right = b.select(*key, F.struct(*value).alias("y"))
    both = left.join(right, key, "full")
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return both.agg(
        count(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("x").eqNullSafe(F.col("y"))).alias("matching"),
        count(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.col("x").eqNullSafe(F.col("y"))).alias("mismatched"),
        count(F.col("y").isNull()).alias("only_current"),
        count(F.col("x").isNull()).alias("only_reference"),
    )
