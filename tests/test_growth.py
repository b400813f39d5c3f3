"""Plans whose work or memory must not grow faster than their input."""

import random

from pyspark.sql import functions as F

from keyloom.operators import intervals, joins


def test_nearest_rows_above_are_found_without_reading_what_follows(spark):
    df = spark.createDataFrame([(1, 2)], "k bigint, v bigint")
    for direction in ("<", ">"):
        plan = joins.asof(df, df, "k", ["v"], direction=direction)._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "unboundedfollowing" not in plan.lower()


def test_equal_keys_are_one_row_of_the_order(spark):
    left = spark.createDataFrame([(i % 3, i) for i in range(30)] + [(None, -1)], "k bigint, i bigint")
    right = spark.createDataFrame([(1, 10), (2, 20)], "k bigint, v bigint")
    got = joins.asof(left, right, "k", ["v"])
    assert sorted((r["k"], r["v"]) for r in got.collect() if r["k"] is not None) == sorted((i % 3, {0: None, 1: 10, 2: 20}[i % 3]) for i in range(30))
    assert got.count() == 31
    assert "keys=[_o#" in got._jdf.queryExecution().executedPlan().toString()


def test_counts_below_match_all_pairs(spark):
    rng = random.Random(3)
    value = lambda: rng.choice([None, float("nan"), -0.0, 0.0, *[rng.randint(-9, 9) / 2 for _ in range(6)]])
    left = [(i, rng.choice([None, 0, 1, 2]), value()) for i in range(80)]
    right = [(i, rng.choice([None, 0, 1, 2]), value()) for i in range(300)]
    a = spark.createDataFrame(left, "id int, g int, v double")
    b = spark.createDataFrame(right, "i int, h int, w double")
    got = joins.counted_below(a, b, ("v", "w"), ("g", "h"))
    pairs = a.join(b, (F.col("g") == F.col("h")) & (F.col("v") > F.col("w"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(tuple(r) for r in got.select("id", "n").collect()) == sorted(tuple(r) for r in pairs.collect())


def test_the_theta_join_makes_no_pairs(spark):
    from keyloom.plans import catalog

    text = catalog.queries()["theta_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "s_acctbal" in text and "> c_acctbal" not in text and "NestedLoop" not in text


def test_no_sketch_for_each_distinct_id(spark):
    from keyloom.plans import writes

    df = spark.createDataFrame([(i, t) for i in range(50) for t in ("a", None)] + [(0, "a")], "event_id bigint, event_type string")
    got = writes.approx_count_distinct(lambda name: df)
    assert sorted(((tuple(r)) for r in got.collect()), key=repr) == [("a", 50, True, True), (None, 50, True, True)]
    for node in got._jdf.queryExecution().executedPlan().toString().split("\n"):
        assert not ("event_id" in node.split("functions=")[0] and "approx_count_distinct" in node)


def test_ordered_folds_stream_through_a_task(spark):
    from keyloom.operators import folds

    rng = random.Random(8)
    log = [(k, i, rng.choice(["add", "xor", "set", "clear", "compare_and_clear"]), bytearray(rng.choices(range(3), k=2))) for i in range(400) for k in [rng.choice([None, 1, 2, 3, 4])]]
    df = spark.createDataFrame(log, "k int, i int, kind string, operand binary")
    got = folds.ordered_fold(df, ["k"], ["i"])
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
    want = {k: folds.fold([(m, bytes(o)) for q, _, m, o in log if q == k]) for k in (None, 1, 2, 3, 4)}
    assert {r["k"]: bytes(r["value"]) for r in got.collect()} == {k: v for k, v in want.items() if v is not None}


def test_compact_orders_tell_what_pairs_tell():
    from keyloom.operators import stats

    rng = random.Random(5)
    keys = [rng.randint(0, 200) for _ in range(300)]
    sizes = [rng.randint(0, 50) for _ in keys]
    a, b = stats.Order.of(keys, sizes), stats.Order(zip(keys, sizes, strict=True))
    assert isinstance(a.keys, memoryview) and isinstance(a.sums, memoryview) and list(a.keys) == b.keys
    assert stats.split_points(a, 0, 201, 300) == stats.split_points(b, 0, 201, 300)
    assert stats.hot_ranges(a, a, 0, 201, 0.5, 300) == stats.hot_ranges(b, b, 0, 201, 0.5, 300)
    assert stats.equal_divide(a, 0, 201, 7) == stats.equal_divide(b, 0, 201, 7)
    assert stats.split_metrics(a, a, 0, 201, 500, 400, 100) == stats.split_metrics(b, b, 0, 201, 500, 400, 100)
    assert [stats.position_at(a, 0, 201, n) for n in range(0, 9000, 77)] == [stats.position_at(b, 0, 201, n) for n in range(0, 9000, 77)]
    assert list(stats.Order.of(["b", "a"], [1, 2]).keys) == ["a", "b"]


def test_reply_numbers_match_packed_replies():
    import numpy as np

    from keyloom.streaming.changes import pack_replies, reply_numbers

    rng = random.Random(6)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 3, 9, 30]) for _ in range(rng.randint(0, 25))]
        packed = pack_replies(list(enumerate(sizes)), 10)
        assert list(reply_numbers(np.array(sizes, "int64"), 10)) == [i for i, own in enumerate(packed) for _ in own]


def test_blocks_are_decoded_one_at_a_time(spark):
    from keyloom.sources import backup

    pairs = [(f"{i:05}".encode(), b"v" * 40) for i in range(500)]
    content = backup.encode_range(pairs, pairs[0][0], b"~", 1024)
    files = spark.createDataFrame([("f", content), ("f", content)], "path string, content binary")
    got = backup.range_pairs(files, 1024)
    assert sorted((bytes(r["key"]), bytes(r["value"])) for r in got.collect()) == sorted(pairs * 2)
    log = spark.createDataFrame([("g", backup.encode_log([(1, i, 0, b"k", b"v") for i in range(100)], 256))], "path string, content binary")
    assert backup.log_rows(log, 256).count() == 100
    for df in (got, backup.log_rows(log, 256)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "MapInPandas" not in plan


def shuffled(spark, column):
    """The sum of a figure of all stages so far."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), none)
    return sum(getattr(stages.apply(i), column)() for i in range(stages.size()))


def test_painting_shuffles_in_proportion_to_writes(spark):
    n, before = 2000, shuffled(spark, "shuffleWriteRecords")
    df = spark.range(n).select((F.col("id") % 7).alias("m"), (F.col("id") * 37).alias("begin"), (F.col("id") * 37 + 450 + F.col("id") % 60).alias("end"), F.col("id").cast("string").alias("value"), F.col("id").alias("version"))
    assert intervals.paint(df, "version", ["m"]).count() > n
    assert shuffled(spark, "shuffleWriteRecords") - before < 3 * n


def test_texts_without_a_likely_pair_are_not_shuffled(spark):
    from keyloom.llm import jaccard

    def run(letters):
        rng = random.Random(4)
        word = lambda: f"{rng.getrandbits(4 * letters):0{letters}x}"
        rows = []
        for i in range(40):  # two thirds alike: they share signatures
            own = [word() for _ in range(1000)]
            rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:800] + [word() for _ in range(200)]))]
        rows += [(100, rows[0][1] + " " + word())]
        before = shuffled(spark, "shuffleWriteBytes")
        got = jaccard.link_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: 0 if i == 100 else i for i, _ in rows}
        return shuffled(spark, "shuffleWriteBytes") - before, sum(len(t) for _, t in rows)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        (few, short), (many, long) = run(8), run(80)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert many - few < 0.1 * (long - short)


def test_painting_over_chunks_matches_all_pairs(spark):
    rng = random.Random(12)
    place = lambda: rng.choice([None, -(1 << 14), 0, (1 << 14) - 1, 1 << 14, 1 << 15, *[rng.randint(-60_000, 250_000) for _ in range(30)]])
    writes = []
    for i in range(400):
        begin = place()
        end = rng.choice([place(), begin, None if begin is None else begin + rng.randint(0, 900)])
        writes.append((rng.choice([None, 1, 2, 3]), begin, end, rng.choice([None, "a", "b", "c"]), rng.choice([None, i, i])))
    writes += [(4, 0, 100_000, "x", None), (5, 7, 7, "x", 1), (6, 1 << 14, 1 << 15, "x", 1)]
    want = []
    for m in range(1, 7):
        own = [w for w in writes if w[0] == m]
        keys = sorted({k for w in own for k in w[1:3] if k is not None})
        for begin, end in zip(keys, keys[1:], strict=False):
            over = [w for w in own if None not in w[1:3] and w[1] <= begin and end <= w[2]]
            if over:
                last = max(over, key=lambda w: -1 if w[4] is None else w[4])
                want.append((m, begin, end, last[3] if last[4] is not None else None))
    df = spark.createDataFrame(writes, "m int, begin bigint, end bigint, value string, version int").repartition(3)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in intervals.paint(df, "version", ["m"]).collect()), key=key) == sorted(want, key=key)
    text = lambda c: F.when(F.col(c).isNotNull(), F.lpad((F.col(c) + 100_000).cast("string"), 7, "0")).alias(c)
    named = intervals.paint(df.select("m", text("begin"), text("end"), "value", "version"), "version", ["m"])
    assert sorted(((r["m"], int(r["begin"]) - 100_000, int(r["end"]) - 100_000, r["value"]) for r in named.collect()), key=key) == sorted(want, key=key)
    one = df.where("m = 1").drop("m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # chunks go on in the next batch
    try:
        assert sorted(((1, *r) for r in intervals.paint(one, "version").collect()), key=key) == sorted((w for w in want if w[0] == 1), key=key)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
