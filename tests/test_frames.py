"""Operators over small DataFrames, files and streams, against plain Python."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keyloom.functions import keys
from keyloom.functions.buckets import interleave, log2_bucket, unlace
from keyloom.functions.keys import from_little_endian, little_endian, strinc
from keyloom.functions.tuples import pack, packed_bytes, packed_double, packed_long, packed_string
from keyloom.operators import folds, intervals, joins, layers, scans, stats
from keyloom.operators.ordered import position, previous, running_sum
from keyloom.operators.scans import KeySelector as K
from keyloom.sources import backup, bulk, dump
from keyloom.streaming import changes


def test_packed_columns(spark):
    numbers = [0, 1, -1, 255, 256, -255, -256, 1 << 40, -(1 << 40), (1 << 63) - 1, -(1 << 63), -5551212]
    got = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", packed_long(F.col("n")).alias("k")).collect()
    assert all(bytes(r["k"]) == pack((r["n"],)) for r in got)
    words = ["", "a", "é\x00x", "\x00", None]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", packed_string(F.col("w")).alias("k"), packed_bytes(F.encode("w", "UTF-8")).alias("b")).collect()
    assert all(bytes(r["k"]) == pack((r["w"],)) and bytes(r["b"]) == pack((None if r["w"] is None else r["w"].encode(),)) for r in got)
    got = spark.createDataFrame([(x,) for x in (0.0, -0.0, 1.5, -2.5)], "x double").select("x", packed_double("x").alias("k")).collect()
    assert all(bytes(r["k"]) == pack((r["x"],)) for r in got)


def test_byte_columns(spark):
    df = spark.createDataFrame([(1,), (-2,), (1 << 40,)], "n bigint").select("n", little_endian(F.col("n")).alias("b"))
    assert all(bytes(r["b"]) == (r["n"] % (1 << 64)).to_bytes(8, "little") for r in df.collect())
    assert [r[0] for r in df.select(from_little_endian(F.col("b"))).collect()] == [1, -2, 1 << 40]
    keys = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a\xff"),), (bytearray(b"\x0f\xff"),)], "k binary")
    assert [bytes(r[0]) for r in keys.select(strinc(F.col("k"))).collect()] == [b"b", b"b", b"\x10"]


def test_selectors_match_a_sorted_list(spark):
    keys = sorted(random.Random(1).sample(range(200), 40))
    kv = spark.createDataFrame([(k, str(k)) for k in keys], "key bigint, value string")
    rng = random.Random(2)
    for _ in range(12):
        s = K(rng.randrange(200), rng.random() < 0.5, rng.randint(-4, 5))
        at = sum(k <= s.key if s.or_equal else k < s.key for k in keys) - 1 + s.offset
        want = -1 if at < 0 else 999 if at >= len(keys) else keys[at]
        assert scans.resolve(kv, s, first=-1, last=999).first()[0] == want
    assert [r["key"] for r in scans.get_range(kv, 20, K.last_less_than(150), limit=3, reverse=True).collect()] == [k for k in keys if 20 <= k < max(x for x in keys if x < 150)][::-1][:3]


def test_global_orders(spark):
    rng = random.Random(3)
    data = [(k, rng.randint(1, 9)) for k in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(data, "k bigint, v bigint")
    data.sort()
    want, total = {}, 0
    for k, v in data:
        total += v
        want[k] = total
    assert {r["k"]: r["s"] for r in running_sum(df, "k", "v", "s").collect()} == want
    assert [r["n"] for r in position(df, "k", "n").orderBy("k").collect()] == list(range(1, 701))
    got = {r["k"]: r["p"] for r in previous(df, "k", {"v": "p"}).collect()}
    assert got == {k: (data[i - 1][1] if i else None) for i, (k, _) in enumerate(data)}


def test_mapper_templates(spark):
    cols, many = joins.mapper_columns(["r", "{{x}}", "{K[1]}", "{...}"], [F.lit(1), F.lit(2)], [])
    assert many and spark.range(1).select(*cols).first() == ("r", "{x}", 2)
    for bad in (["{...}", "a"], ["{K[5"], ["{Q[1]}"]):
        with pytest.raises(ValueError):
            joins.mapper_columns(bad, [F.lit(1)], [])
    with pytest.raises(IndexError):
        joins.mapper_columns(["{V[0]}"], [F.lit(1)], [])


def test_interval_maps(spark):
    spans = [("a", "c"), ("e", "g"), ("i", "k"), ("b", "j")]
    df = spark.createDataFrame(spans, "begin string, end string")
    got = {(r["begin"], r["end"]): r["count"] for r in intervals.overlap_counts(df).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 2, ("c", "e"): 1, ("e", "g"): 2, ("g", "i"): 1, ("i", "j"): 2, ("j", "k"): 1}
    twice = spark.createDataFrame([("a", "b")] * 2, "begin string, end string")
    assert [tuple(r) for r in intervals.overlap_counts(twice).collect()] == [("a", "b", 2)]
    reads = spark.createDataFrame([("foo", "foo\x00"), ("bar/", "bar0")], "begin string, end string")
    assert {(r["key"], r["inside"]) for r in intervals.canonical(reads).collect()} == {("bar/", 1), ("bar0", 0), ("foo", 1), ("foo\x00", 0)}
    m = spark.createDataFrame([(0, "x"), (5, "y"), (9, "x")], "key int, value string")
    assert sorted(tuple(r) for r in intervals.set_range_coalescing(m, 3, 9, "x").collect()) == [(0, "x")]


def test_painted_ranges_match_cells(spark):
    rng = random.Random(5)
    writes = [(b, b + rng.randint(1, 9), f"v{i % 3}", i) for i, b in enumerate(rng.choices(range(40), k=15))]
    cells = {}
    for b, e, v, _ in writes:
        cells.update(dict.fromkeys(range(b, e), v))
    df = spark.createDataFrame(writes, "begin int, end int, value string, version int")
    got = {k: r["value"] for r in intervals.paint(df, "version").collect() for k in range(r["begin"], r["end"])}
    assert got == cells
    named = df.select(F.format_string("k%02d", "begin").alias("begin"), F.format_string("k%02d", "end").alias("end"), "value", "version")
    got = {k: r["value"] for r in intervals.paint(named, "version").collect() for k in range(int(r["begin"][1:]), int(r["end"][1:]))}
    assert got == cells
    assert intervals.paint(df.limit(0), "version").count() == 0
    below = df.select((F.col("begin") - 25).alias("begin"), (F.col("end") - 25).alias("end"), "value", "version")
    got = {k + 25: r["value"] for r in intervals.paint(below, "version").collect() for k in range(r["begin"], r["end"])}
    assert got == cells


def test_shortest_keys_between(spark):
    pairs = [(b"a", b"b"), (b"ab", b"abc"), (b"abc", b"abd"), (b"", b"xyz"), (b"a\xff", b"b\x00\x01"), (b"ab", b"ab")]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in pairs], "a binary, b binary")
    got = [bytes(r[0]) for r in df.select(keys.key_between(F.col("a"), F.col("b"))).collect()]
    assert got == [b"b", b"abc", b"abd", b"x", b"b", b"ab"]
    assert bytes(df.limit(1).select(keys.key_between(F.lit(b"abc1"), F.lit(b"abc2x"), limit=3)).first()[0]) == b"abc2x"


def test_vector_ends(spark):
    v = spark.createDataFrame([(0, "a"), (4, "e")], "index int, value string")
    assert [tuple(r) for r in layers.element_at(v, -2, "-").collect()] == [(3, "-")]
    assert layers.element_at(v, -6, "-").count() == layers.element_at(v, 5, "-").count() == 0
    once = layers.pop(v, "-")
    assert sorted(tuple(r) for r in once.collect()) == [(0, "a"), (3, "-")]
    assert sorted(tuple(r) for r in layers.pop(once, "-").collect()) == [(0, "a"), (2, "-")]
    assert layers.pop(v.limit(0), "-").count() == 0


def test_sets_and_bags(spark):
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "x int")
    assert sorted(tuple(r) for r in layers.set_contains(df(1, 1, None), df(1, 2, None)).collect() if r["x"] is not None) == [(1, True), (2, False)]
    least, rest = layers.set_pop(df(5, 3, 4))
    assert [r[0] for r in least.collect()] == [3] and sorted(r[0] for r in rest.collect()) == [4, 5]
    assert layers.set_pop(df(5).limit(0))[0].count() == 0
    assert sorted(r[0] for r in layers.bag_difference(df(1, 1, 2), df(1)).collect()) == [1, 2]


def test_overlaps_in_cells_match_all_pairs(spark):
    rng = random.Random(6)
    make = lambda: [(i, b, b + rng.randint(1, 30)) for i, b in enumerate(rng.choices(range(300), k=60))]
    a, b = make(), make()
    x, y = (spark.createDataFrame(s, "id int, begin int, end int") for s in (a, b))
    got = sorted((r["a"]["id"], r["b"]["id"]) for r in joins.overlapping(x, y, width=16).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] < q[2] and q[1] < p[2])


def test_ordered_fold_matches_plain_fold(spark):
    rng = random.Random(7)
    kinds = ["add", "xor", "set", "clear", "append_if_fits", "compare_and_clear", "max", "byte_min"]
    log = [(rng.randrange(5), i, rng.choice(kinds), bytes(rng.choices(range(3), k=rng.randint(1, 3)))) for i in range(150)]
    df = spark.createDataFrame([(k, i, m, bytearray(o)) for k, i, m, o in log], "key int, seq int, kind string, operand binary")
    want = {k: folds.fold([(m, o) for q, _, m, o in log if q == k]) for k in range(5)}
    got = {r["key"]: bytes(r["value"]) for r in folds.ordered_fold(df, ["key"], ["seq"]).collect()}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_sketch_is_within_its_error(spark):
    rng = random.Random(8)
    values = sorted(rng.lognormvariate(2, 1) for _ in range(3000))
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for share in (0.1, 0.5, 0.99):
        got = stats.sketch_percentile(stats.sketch(df, "v", 0.02), share, 0.02).first()["value"]
        want = values[int(share * (len(values) - 1))]
        assert abs(got - want) <= 0.021 * want
    same = stats.sketch_divergence(stats.sketch(df, "v", 0.1), stats.sketch(df, "v", 0.1)).first()[0]
    assert abs(same) < 1e-12


def test_scalar_buckets(spark):
    df = spark.range(0, 1000).select("id", log2_bucket(F.col("id")).alias("b"), interleave(F.col("id"), F.col("id") * 3, 16).alias("z"))
    for r in df.select("*", unlace(F.col("z"), True, 16).alias("x"), unlace(F.col("z"), False, 16).alias("y")).collect():
        assert r["b"] == max(0, r["id"].bit_length() - 1) and (r["x"], r["y"]) == (r["id"], 3 * r["id"])


def test_vectors_fill_trailing_slots(spark):
    v = spark.createDataFrame([(1, "b"), (3, "d")], "index int, value string")
    assert [r["value"] for r in layers.dense(v, F.lit(6), "-").orderBy("index").collect()] == ["-", "b", "-", "d", "-", "-"]


def test_directories(spark):
    d = layers.Directory.empty(spark).create(["a", "b"], layer="x").create(["c"])
    assert d.exists(["a"]) and d.open(["a", "b"], "x").first()["layer"] == "x"
    d = d.move(["a", "b"], ["c", "b"])
    assert [r["name"] for r in d.list(["c"]).collect()] == ["b"] and not d.exists(["a", "b"])
    assert d.nodes.select("prefix").distinct().count() == d.nodes.count()
    for bad in (lambda: d.create(["c"]), lambda: d.move(["c"], ["c", "q"]), lambda: d.open(["c", "b"], "other")):
        with pytest.raises(ValueError):
            bad()
    for lost in (lambda: d.open(["zz"]), lambda: d.remove(["zz"]), lambda: d.move(["zz"], ["y"])):
        with pytest.raises(KeyError):
            lost()
    assert d.remove(["c"]).nodes.count() == 1 and d.remove_if_exists(["zz"]).nodes.count() == 3


def test_bulk_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,1\nc,,2\n")
    rows = bulk.read_csv(spark, str(tmp_path / "x.csv"))
    assert sorted(r["cells"] for r in rows.collect()) == [["a", "b", "1"], ["c", "", "2"]]
    skipped = bulk.to_kvp(bulk.read_csv(spark, str(tmp_path / "x.csv"), skip_empty=True))
    assert sorted((r["key"], r["value"]) for r in skipped.collect()) == [(["a", "b"], "1"), (["c"], "2")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.json").write_text(json.dumps({"a": [1, {"b": "x"}]}, indent=1))
    bulk.json_to_doc(spark, str(tmp_path / "j"), str(tmp_path / "docs"))
    leaves = spark.read.parquet(str(tmp_path / "docs"))
    assert json.loads(layers.assemble_documents(leaves).first()["text"]) == {"a": [1, {"b": "x"}]}
    data = bytes(range(256)) * 100
    (tmp_path / "blob").write_bytes(data)
    chunks = bulk.read_blob(spark, str(tmp_path / "blob")).orderBy("offset").collect()
    assert b"".join(bytes(r["chunk"]) for r in chunks) == data and len(chunks) == 3


def test_backup_files(spark, tmp_path):
    pairs = [(b"k%04d" % i, b"v%d" % i) for i in range(300)]
    (tmp_path / "r").write_bytes(backup.encode_range(pairs, b"", b"\xff", 512))
    got = backup.read_range(spark, str(tmp_path / "r"), 512).orderBy("key").collect()
    assert [(bytes(r["key"]), bytes(r["value"])) for r in got] == pairs
    log = [(v, s, 0, b"k%d" % v, b"x") for v in range(40) for s in range(3)]
    for part in range(2):
        (tmp_path / f"log{part}").write_bytes(backup.encode_log([m for m in log if m[0] % 2 == part], 300))
    merged = backup.convert_logs(backup.read_log(spark, str(tmp_path / "log*"), 300)).orderBy("version").collect()
    assert [(r["version"], len(r["mutations"]), r["continuous"]) for r in merged] == [(v, 3, True) for v in range(40)]


def test_dumps(spark, tmp_path):
    kv = spark.range(1000).select(F.col("id").alias("key"), F.col("id").cast("string").alias("value"))
    manifest = dump.dump(kv, str(tmp_path / "d"), 4, version=9)
    assert manifest.agg(F.sum("pairs")).first()[0] == 1000
    back = dump.load(spark, str(tmp_path / "d"), 100, 200)
    assert back.count() == 100
    merged = dump.load_into(kv.where("key < 150"), back, 100, 200)
    assert merged.count() == 200 and not dump.verify(kv.where("key < 200"), merged).count()
    kv.where("key < 5").write.mode("append").parquet(str(tmp_path / "d" / "data"))
    bad = spark.read.parquet(str(tmp_path / "d" / "manifest")).withColumn("checksum", F.lit(1).cast("bigint"))
    bad.write.mode("overwrite").parquet(str(tmp_path / "d" / "other"))
    import shutil

    shutil.rmtree(tmp_path / "d" / "manifest")
    (tmp_path / "d" / "other").rename(tmp_path / "d" / "manifest")
    with pytest.raises(ValueError):
        dump.load(spark, str(tmp_path / "d"))


MUTATIONS = "version bigint, seq bigint, kind string, key bigint, end bigint, value string"


def _log(spark, path, rows):
    spark.createDataFrame(rows, MUTATIONS).coalesce(1).write.mode("append").parquet(str(path))


def test_change_stream_delivers_in_order_and_once(spark, tmp_path):
    rng = random.Random(9)
    rows = [(v, 0, "clear_range", k, k + 30, None) if v % 5 == 0 else (v, 0, "set", k, None, f"v{v}") for v in range(60) for k in [rng.randrange(100)]]
    _log(spark, tmp_path / "in", rows[:30])
    stream = lambda: spark.readStream.schema(MUTATIONS).parquet(str(tmp_path / "in"))
    seen = []

    def deliver(df, i):
        seen.extend(tuple(r) for r in df.collect())
        for _ in range(2):  # a batch may come again
            changes.apply_changes(df, str(tmp_path / "out"), str(tmp_path / "applied"))

    for part in (None, rows[30:]):
        if part:
            _log(spark, tmp_path / "in", part)
        changes.consume(stream(), 20, 60, deliver, str(tmp_path / "cp")).awaitTermination(120)
    want = [(v, s, m, max(k, 20), min(e, 60), x) if m == "clear_range" else (v, s, m, k, e, x) for v, s, m, k, e, x in rows if (k < 60 and e > 20 if m == "clear_range" else 20 <= k < 60)]
    assert seen == want
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want)


def test_watch_stream(spark, tmp_path):
    rows = [(v, 0, "clear" if x is None else "set", k, None, x) for v, (k, x) in enumerate([(1, "a"), (1, "a"), (2, "b"), (1, None), (1, "c"), (2, "b")])]
    _log(spark, tmp_path / "in", rows)
    stream = spark.readStream.schema(MUTATIONS).parquet(str(tmp_path / "in"))
    q = changes.watch(stream).writeStream.format("memory").queryName("watched").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = defaultdict(list)
    for r in spark.sql("select * from watched order by version").collect():
        got[r["key"]].append((r["old_value"], r["value"]))
    assert dict(got) == {1: [(None, "a"), ("a", None), (None, "c")], 2: [(None, "b")]}


def test_entry_and_catalogue(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nearest_rows_without_groups_are_found_across_ranges(spark):
    import random

    from keyloom.operators import joins

    rng = random.Random(1)
    right = [(rng.randint(0, 500), i) for i in range(300)] + [(None, -1)]
    left = [(rng.randint(-5, 520), i) for i in range(300)] + [(None, -2)]
    r = spark.createDataFrame(right, "k bigint, v bigint").groupBy("k").agg({"v": "max"}).withColumnRenamed("max(v)", "v")
    best = {}
    for k, v in right:
        best[k] = max(v, best.get(k, v))
    keys = sorted(k for k in best if k is not None)
    tests = {"<": lambda k, x: x < k, "<=": lambda k, x: x <= k, ">": lambda k, x: x > k, ">=": lambda k, x: x >= k}
    for direction, ok in tests.items():
        got = joins.asof(spark.createDataFrame(left, "k bigint, i bigint"), r, "k", ["v"], direction=direction).collect()
        for row in got:
            fits = [x for x in keys if row["k"] is not None and ok(row["k"], x)]
            assert row["v"] == (best[(max if direction[0] == "<" else min)(fits)] if fits else None)
        assert len(got) == len(left)
    assert joins.asof(spark.createDataFrame(left, "k bigint, i bigint"), r.limit(0), "k", ["v"]).where("v is not null").count() == 0


def test_versions_of_times_years_behind_the_last_mark(spark):
    import datetime as dt

    from keyloom.operators import joins

    marks = spark.createDataFrame([(dt.datetime(2004, 1, 1), 7)], "ts timestamp_ntz, version bigint")
    times = [dt.datetime(2024, 6, 1, 0, 0, 0, 123457), dt.datetime(2003, 1, 1), dt.datetime(2004, 1, 1)]
    got = {r["ts"]: r["version"] for r in joins.timestamp_to_version(spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz"), marks, rate=3_000_000).collect()}
    gone = (times[0] - dt.datetime(2004, 1, 1)) // dt.timedelta(microseconds=1)
    assert got == {times[0]: 7 + gone * 3, times[1]: None, times[2]: 7}
    back = joins.version_to_timestamp(spark.createDataFrame([(7 + gone * 3 + 2,)], "version bigint"), marks, rate=3_000_000).collect()
    assert back[0]["ts"].replace(tzinfo=None) == times[0]
