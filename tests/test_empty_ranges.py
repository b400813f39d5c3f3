"""Empty ranges, which larger tables hold, and keys behind the last range of a map."""

from keyloom.operators import joins


def test_an_empty_interval_meets_what_holds_it(spark):
    x = spark.createDataFrame([(1, 0, 40), (2, 20, 20), (3, 16, 16)], "id int, begin int, end int")
    got = sorted((r["a"]["id"], r["b"]["id"]) for r in joins.overlapping(x, x, width=16).collect())
    plain = sorted((r["a"]["id"], r["b"]["id"]) for r in joins.overlapping(x, x).collect())
    assert got == plain == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)]


def test_keys_outside_the_shard_map_have_no_address(spark):
    from keyloom.plans import reads

    tables = {
        "orders": spark.createDataFrame([(0, "a"), (999, "b"), (1000, "c"), (2000, "d"), (-1, "e")], "o_orderkey bigint, o_orderpriority string"),
        "nation": spark.createDataFrame([(0, "x"), (1, "y")], "n_nationkey int, n_name string"),
    }
    got = sorted(tuple(r) for r in reads.get_addresses_for_key(tables.__getitem__).collect())
    assert got == [(0, "x"), (999, "x"), (1000, "y")]


def test_unions_keep_empty_ranges_where_asked(spark):
    from keyloom.operators import intervals

    df = spark.createDataFrame([(1, 5), (3, 3), (7, 7), (9, 9), (9, 11)], "begin int, end int")
    assert sorted(tuple(r) for r in intervals.union_of(df, empty=True).select("begin", "end").collect()) == [(1, 5), (7, 7), (9, 11)]
    assert sorted(tuple(r) for r in intervals.union_of(df).select("begin", "end").collect()) == [(1, 5), (9, 11)]
    assert intervals.canonical(df, empty=True).count() == 6


def test_range_queries_keep_events_of_value_zero(spark):
    from keyloom.plans import writes

    rows = [(1, 100, 0.0), (1, 4000, 0.0), (2, 2500, 0.0), (2, 3000, 1.5)]
    table = lambda name: spark.createDataFrame(rows, "user_id bigint, event_id bigint, value double")
    all_rows = [(1, 100, 100), (1, 4000, 4000), (2, 2500, 2500), (2, 3000, 3002)]
    assert sorted(tuple(r) for r in writes.write_range_union(table).select("user_id", "begin", "end").collect()) == all_rows
    borders = sorted((u, k, i) for u, b, e in all_rows for k, i in ((b, 1), (e, 0)))
    assert sorted(tuple(r) for r in writes.conflict_canonical(table).select("user_id", "key", "inside").collect()) == borders


def test_what_lies_outside_a_hole_stays_even_if_empty(spark):
    from keyloom.operators import intervals
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 1), (5, 5), (10, 10), (15, 15), (2, 30), (20, 20), (21, 21), (5, 25)], "begin int, end int")
    got = sorted(tuple(r) for r in intervals.subtract(df, F.lit(10), F.lit(20)).collect())
    assert got == [(1, 1), (2, 10), (5, 5), (5, 10), (20, 25), (20, 30), (21, 21)]
