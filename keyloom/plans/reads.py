"""Scans, selectors, index reads and joins."""

from pyspark.sql import functions as F

from keyloom.functions.tuples import Subspace, packed, packed_long, packed_string, tuple_range
from keyloom.operators import joins, layers, ordered, profiler, scans, versions
from keyloom.operators.scans import KeySelector as K
from keyloom.plans.registry import EVENT_LOG, ORDERS_KV, SHARD_MAP, TYPE_MAP, USER_SPANS, event_log, orders_kv, query, shard_map, type_map, user_spans


@query(f"select key, value from {ORDERS_KV} where key = 70")
def get(t):
    return scans.get(orders_kv(t), 70)


@query(f"select coalesce(max(key), -1) as key from {ORDERS_KV} where key <= 100")
def get_key(t):
    return scans.resolve(orders_kv(t), K(100, True, 0), first=-1, last=1 << 62)


@query(f"select max(key) as key from {ORDERS_KV} where key < 100")
def last_less_than(t):
    return scans.resolve(orders_kv(t), K.last_less_than(100))


@query(f"select max(key) as key from {ORDERS_KV} where key <= 101")
def last_less_or_equal(t):
    return scans.resolve(orders_kv(t), K.last_less_or_equal(101))


@query(f"select min(key) as key from {ORDERS_KV} where key > 100")
def first_greater_than(t):
    return scans.resolve(orders_kv(t), K.first_greater_than(100))


@query(f"select min(key) as key from {ORDERS_KV} where key >= 100")
def first_greater_or_equal(t):
    return scans.resolve(orders_kv(t), K.first_greater_or_equal(100))


@query(f"select key from {ORDERS_KV} where key >= 100 order by key limit 1 offset 7")
def selector_offset(t):
    return scans.resolve(orders_kv(t), K.first_greater_or_equal(100) + 7)


@query(f"select coalesce(max(key), -1) as key from (select key from {ORDERS_KV} where key < 5 order by key desc limit 1 offset 9)")
def selector_clamp(t):
    return scans.resolve(orders_kv(t), K.last_less_than(5) - 9, first=-1, last=1 << 62)


@query(f"select key, value from {ORDERS_KV} where key >= 1000 and key < 3000")
def get_range(t):
    return scans.get_range(orders_kv(t), 1000, 3000)


@query(f"select key, value from {ORDERS_KV} where key > (select min(key) from {ORDERS_KV} where key >= 100) and key < 500", name="get_range_selectors")
def get_range_selectors(t):
    return scans.get_range(orders_kv(t), K.first_greater_or_equal(100) + 1, 500)


@query(f"select key, value from {ORDERS_KV} where key >= 1000 order by key limit 25")
def get_range_limit(t):
    return scans.get_range(orders_kv(t), 1000, limit=25)


@query(f"select key, value from {ORDERS_KV} where key < 5000 order by key desc limit 25")
def get_range_reverse(t):
    return scans.get_range(orders_kv(t), end=5000, limit=25, reverse=True)


@query(f"select key, value from (select *, sum(length(value) + 8) over (order by key) - length(value) - 8 as before from {ORDERS_KV}) where before < 4096")
def get_range_byte_limit(t):
    return scans.get_range_bytes(orders_kv(t), F.octet_length("value") + 8, 4096)


@query("select p_name, p_partkey from part where p_type like 'STANDARD%'")
def get_range_startswith(t):
    return scans.get_range_startswith(t("part"), "STANDARD", "p_type").select("p_name", "p_partkey")


@query(f"select key, value from {ORDERS_KV} where key >= 50 and key < 250", name="slice")
def slice_(t):
    return scans.get_range(orders_kv(t), 50, 250, reverse=True)


@query(f"select count(*) as pairs, sum(key) as keys from {ORDERS_KV} where key >= 10 and key < 50000")
def get_range_stream(t):
    return scans.get_range_stream(orders_kv(t), 10, 50000).agg(F.count(F.lit(1)).alias("pairs"), F.sum("key").cast("decimal(38,0)").alias("keys"))


@query(f"select segment, min(key) as first_key, max(key) as last_key, count(*) as pairs from (select key, (row_number() over (order by key) - 1) // 100 as segment from {ORDERS_KV}) group by 1")
def segmented_range(t):
    cut = scans.segments(orders_kv(t), 100)
    return cut.groupBy("segment").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("pairs"))


@query(f"select key, arg_max(value, version) as value from {EVENT_LOG} where version <= 5000 group by key having arg_max(kind, version) = 'set'")
def read_version_asof(t):
    return versions.state_at(event_log(t), 5000)


@query(f"select key, address from {ORDERS_KV} o join {SHARD_MAP} s on key >= s.\"begin\" and key < s.\"end\"")
def get_addresses_for_key(t):
    keys = orders_kv(t).select(F.col("key").alias("begin"), (F.col("key") + 1).alias("end"))
    return joins.overlapping(keys, shard_map(t), width=1000).select(F.col("a.begin").alias("key"), "b.address")


@query(f"select \"begin\" as key from {SHARD_MAP} where \"begin\" >= 3000 and \"begin\" < 12000")
def get_boundary_keys(t):
    return scans.boundary_keys(shard_map(t), 3000, 12000)


@query("select 'orders' as name, count(*) as pairs from orders union all select 'events', count(*) from events union all select 'part', count(*) from part")
def special_key_scan(t):
    tables = [t(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("pairs")) for n in ("orders", "events", "part")]
    return tables[0].union(tables[1]).union(tables[2])


@query("select count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_orderkey >= 100 and o_orderkey < 900")
def range_predicate(t):
    rows = t("orders").where((F.col("o_orderkey") >= 100) & (F.col("o_orderkey") < 900))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3")
def tuple_prefix_range(t):
    begin, end = tuple_range(("BUILDING", 3))
    keyed = t("customer").withColumn("k", packed((F.col("c_mktsegment"), "string"), (F.col("c_nationkey"), "long"), (F.col("c_custkey"), "long")))
    return keyed.where(F.col("k").between(F.lit(begin), F.lit(end))).select("c_custkey", "c_name")


@query("select event_id, value from events where value > 50 and event_type = 'purchase'")
def value_filter(t):
    return t("events").where("value > 50 and event_type = 'purchase'").select("event_id", "value")


@query("select distinct c_nationkey, c_mktsegment from customer")
def projection(t):
    return t("customer").select("c_nationkey", "c_mktsegment").distinct()


@query("select n_name, count(c_custkey) as customers, round(coalesce(sum(c_acctbal), 0), 2) as balance from nation left join customer on n_nationkey = c_nationkey group by 1")
def mapped_range_get(t):
    """Nation index -> customer records by a mapper template -> sums."""
    customers = t("customer").select(F.lit("customer").alias("space"), "c_custkey", "c_name", "c_acctbal")
    index = t("nation").select("n_nationkey", "n_name").join(t("customer").select("c_nationkey", F.col("c_custkey").alias("pk")), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    mapped, _ = joins.mapper_columns(["customer", "{K[2]}"], [F.col("n_name"), F.col("c_nationkey"), F.col("pk")], [])
    read = joins.mapped_range(index, customers, mapped, ["space", "c_custkey"])
    return read.groupBy("n_name").agg(F.count("c_custkey").alias("customers"), F.round(F.coalesce(F.sum("c_acctbal"), F.lit(0.0)), 2).alias("balance"))


@query("select c_custkey, c_nationkey, coalesce(count(o_orderkey), 0) as n_orders, coalesce(string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey), '') as order_keys from customer left join orders on c_custkey = o_custkey group by 1, 2")
def mapped_range_scan(t):
    index = t("customer").select("c_nationkey", "c_custkey")
    mapped, many = joins.mapper_columns(["{K[1]}", "{...}"], [F.col("c_nationkey"), F.col("c_custkey")], [])
    read = joins.mapped_range(index, t("orders").select("o_custkey", "o_orderkey"), mapped, ["o_custkey"], many, ["o_orderkey"])
    keys = F.transform("records", lambda r: r["o_orderkey"].cast("string"))
    return read.select("c_custkey", "c_nationkey", F.size("records").cast("bigint").alias("n_orders"), F.array_join(keys, ",").alias("order_keys"))


@query("select c_custkey, c_name, c_acctbal from customer where c_nationkey = 7")
def secondary_index(t):
    index = t("customer").select("c_nationkey", F.col("c_custkey").alias("id")).where("c_nationkey = 7")
    return joins.mapped_range(index, t("customer").select("c_custkey", "c_name", "c_acctbal"), [F.col("id")], ["c_custkey"]).select("c_custkey", "c_name", "c_acctbal")


@query("select c_mktsegment, c_custkey, c_name from customer where c_mktsegment = 'MACHINERY'")
def covering_index(t):
    return t("customer").select("c_mktsegment", "c_custkey", "c_name").where("c_mktsegment = 'MACHINERY'")


@query("select distinct c_custkey from customer join orders on c_custkey = o_custkey where o_orderstatus = 'F'")
def er_relationship(t):
    return t("customer").select("c_custkey").join(t("orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


EDGES = "(select distinct o_custkey as src, l_suppkey as dst from orders join lineitem on o_orderkey = l_orderkey)"


def edges(t):
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


@query(f"select src as node, count(*) as degree, string_agg(cast(dst as varchar), ',' order by dst) as neighbours from {EDGES} group by 1")
def graph_neighbors(t):
    n = layers.neighbours(edges(t))
    return n.select("node", F.size("neighbours").cast("bigint").alias("degree"), F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query(f"select dst as node, count(*) as degree from {EDGES} group by 1")
def graph_in_neighbors(t):
    n = layers.neighbours(edges(t), "dst", "src")
    return n.select("node", F.size("neighbours").cast("bigint").alias("degree"))


MARKS = "(select min(ts) as ts, event_id // 100 as version from events group by 2)"


@query(f"select o_orderkey, max(version) as version from orders left join {MARKS} m on m.ts <= o_orderdate + interval 9 year group by 1")
def asof_seek(t):
    marks = t("events").groupBy(F.floor(F.col("event_id") / 100).alias("version")).agg(F.min("ts").alias("ts"))
    marks = marks.groupBy("ts").agg(F.max("version").alias("version"))
    top = marks.select("ts", "version")
    # the greatest version of any earlier mark: the order of versions is not the order of times
    top = ordered.running_max(top, "ts", "version", "version")
    probe = t("orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 9 years")).alias("ts"))
    return joins.asof(probe, top, "ts", ["version"]).select("o_orderkey", "version")


@query(
    "with e as (select event_id, user_id * 7 as k from events) select event_id, n.c_custkey as next_key, l.c_custkey as last_key "
    "from e asof left join customer n on n.c_custkey > e.k asof left join customer l on l.c_custkey < e.k"
)
def asof_seek_both(t):
    probe = t("events").select("event_id", (F.col("user_id") * 7).alias("k"))
    keys = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("next_key"), F.col("c_custkey").alias("last_key"))
    up = joins.asof(probe, keys.select("k", "next_key"), "k", ["next_key"], direction=">")
    return joins.asof(up, keys.select("k", "last_key"), "k", ["last_key"], direction="<").select("event_id", "next_key", "last_key")


@query(
    "with m as (select ts, event_id * 1000 as version from events where event_type = 'signup'), q as (select event_id, ts from events) "
    "select event_id, m.version + (epoch_us(q.ts) - epoch_us(m.ts)) as version from q asof left join m on q.ts >= m.ts"
)
def timestamp_to_version(t):
    marks = t("events").where("event_type = 'signup'").select("ts", (F.col("event_id") * 1000).alias("version"))
    probe = t("events").select("event_id", "ts")
    return joins.timestamp_to_version(probe, marks).select("event_id", "version")


@query(
    "with m as (select ts, event_id * 1000 as version from events where event_type = 'signup'), q as (select event_id, event_id * 1000 + 77 as version from events) "
    "select event_id, epoch_us(m.ts) + (q.version - m.version) as micros from q asof left join m on q.version >= m.version"
)
def version_to_timestamp(t):
    marks = t("events").where("event_type = 'signup'").select("ts", (F.col("event_id") * 1000).alias("version"))
    probe = t("events").select("event_id", (F.col("event_id") * 1000 + 77).alias("version"))
    return joins.version_to_timestamp(probe, marks).select("event_id", F.unix_micros("ts").alias("micros"))


@query(f"select a.user_id as user_a, count(*) as n from {USER_SPANS} a join {USER_SPANS} b on a.\"begin\" < b.\"end\" and b.\"begin\" < a.\"end\" and a.user_id = b.user_id and a.\"begin\" < b.\"begin\" group by 1")
def interval_overlap(t):
    pairs = joins.overlapping(user_spans(t), user_spans(t), width=512, by=["user_id"]).where("a.begin < b.begin")
    return pairs.groupBy(F.col("a.user_id").alias("user_a")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select o_orderkey, value from orders asof left join (select user_id, key, value from {TYPE_MAP} where user_id = 3) m on o_orderkey >= m.key")
def point_in_range(t):
    from keyloom.operators.intervals import contains

    points = t("orders").select(F.col("o_orderkey").alias("key"))
    return contains(points, type_map(t).where("user_id = 3").select("key", "value")).select(F.col("key").alias("o_orderkey"), "value")


@query(
    "with a as (select o_orderkey as k, o_orderstatus as v from orders where o_orderkey % 7 <> 0), b as (select o_orderkey as k, case when o_orderkey % 11 = 0 then 'X' else o_orderstatus end as v from orders where o_orderkey % 5 <> 0) "
    "select cast(count(*) filter (where a.k is not null and b.k is not null and a.v = b.v) as bigint) as matching, cast(count(*) filter (where a.k is not null and b.k is not null and a.v <> b.v) as bigint) as mismatched, "
    "cast(count(*) filter (where b.k is null) as bigint) as only_current, cast(count(*) filter (where a.k is null) as bigint) as only_reference from a full join b on a.k = b.k"
)
def consistency_compare(t):
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    other = o.where("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 11 == 0, "X").otherwise(F.col("v")))
    return joins.compare_replicas(o.where("k % 7 <> 0"), other, ["k"], ["v"])


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def anti_join(t):
    return t("customer").join(t("orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select s_suppkey, count(*) as n from supplier join customer on s_acctbal > c_acctbal and s_nationkey = c_nationkey group by 1")
def theta_join(t):
    counted = joins.counted_below(t("supplier"), t("customer"), ("s_acctbal", "c_acctbal"), ("s_nationkey", "c_nationkey"))
    return counted.groupBy("s_suppkey").agg(F.sum("n").alias("n"))


# ---- tuples ----------------------------------------------------------------------

_PACK_INT = "case when {x} = 0 then '14' else upper(printf('%02x', 20 + length(h) // 2)) || h end"


@query(
    "select c_custkey, '02' || hex(encode(c_mktsegment)) || '00' || case when c_custkey = 0 then '14' else upper(printf('%02x', 20 + length(h) // 2)) || h end as packed "
    "from (select *, case when length(printf('%x', c_custkey)) % 2 = 1 then upper('0' || printf('%x', c_custkey)) else upper(printf('%x', c_custkey)) end as h from customer)"
)
def tuple_pack(t):
    c = t("customer")
    return c.select("c_custkey", F.hex(F.concat(packed_string(F.col("c_mktsegment")), packed_long(F.col("c_custkey")))).alias("packed"))


@query("select row_number() over (order by n_name, n_nationkey) as n, n_name from nation")
def tuple_sort(t):
    from keyloom.operators.ordered import position

    keyed = t("nation").withColumn("k", packed((F.col("n_name"), "string"), (F.col("n_nationkey"), "long")))
    return position(keyed, "k", "n").select("n", "n_name")


@query("select count(*) as n from nation where n_regionkey = 2")
def subspace_contains(t):
    space = Subspace(("nation",))
    keyed = t("nation").withColumn("k", space.packed((F.col("n_regionkey"), "long"), (F.col("n_nationkey"), "long")))
    return keyed.where(space[2].holds(F.col("k"))).agg(F.count(F.lit(1)).alias("n"))


# ---- profiles ----------------------------------------------------------------------


@query("select event_id, user_id from events where event_type in ('view', 'click') and ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12'")
def profile_filter(t):
    e = t("events").withColumnsRenamed({"event_type": "type", "ts": "start_ts"})
    start, end = F.timestamp_micros(F.lit(1704844800000000)), F.timestamp_micros(F.lit(1705017600000000))
    rows = profiler.profile_filter(e, ["view", "click"]).where((F.col("start_ts") >= start) & (F.col("start_ts") < end))
    return rows.select("event_id", "user_id")


@query("select user_id, count(*) as n from events where event_type in ('view', 'click') group by 1 order by n desc, user_id limit 10")
def top_k_reads(t):
    return profiler.top_k(t("events").where("event_type in ('view', 'click')"), ["user_id"], 10)


@query("select user_id, count(*) as n from events where event_type in ('purchase', 'signup') group by 1 order by n desc, user_id limit 10")
def top_k_writes(t):
    return profiler.top_k(t("events").where("event_type in ('purchase', 'signup')"), ["user_id"], 10)


@query()
def read_range_buckets(t):
    rows = user_spans(t).withColumnRenamed("user_id", "shard")
    return profiler.bucket_reads(rows, 5)


@query()
def write_range_buckets(t):
    counts = t("events").groupBy(F.col("event_type").alias("shard"), F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return profiler.bucket_writes(counts, 8)


@query(f"select r.\"begin\", r.\"end\", count(*) as shards, string_agg(distinct address, ',' order by address) as addresses from {USER_SPANS} r join {SHARD_MAP} s on r.\"begin\" < s.\"end\" and s.\"begin\" < r.\"end\" group by 1, 2")
def shard_lookup(t):
    got = profiler.shards_of(user_spans(t).select("begin", "end"), shard_map(t))
    return got.withColumn("addresses", F.array_join("addresses", ","))


@query("select a.event_id as commit_id, b.event_id as debug_id from events a join events b on a.user_id = b.user_id and a.event_type = 'purchase' and b.event_type = 'signup' and b.event_id > a.event_id and b.event_id < a.event_id + 200")
def commit_debug(t):
    e = t("events")
    a = e.where("event_type = 'purchase'").select(F.col("event_id").alias("commit_id"), "user_id")
    b = e.where("event_type = 'signup'").select(F.col("event_id").alias("debug_id"), F.col("user_id").alias("u"))
    return a.join(b, (F.col("user_id") == F.col("u")) & (F.col("debug_id") > F.col("commit_id")) & (F.col("debug_id") < F.col("commit_id") + 200)).select("commit_id", "debug_id")


@query("with q as (select event_id as probe, user_id, ts from events where event_type = 'error'), c as (select user_id, ts, event_id from events where event_type = 'click' qualify row_number() over (partition by user_id, ts order by event_id desc) = 1) select probe, c.event_id as state from q asof left join c on q.user_id = c.user_id and q.ts >= c.ts")
def trace_replay(t):
    e = t("events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("state"))
    probes = e.where("event_type = 'error'").select(F.col("event_id").alias("probe"), "user_id", "ts")
    return profiler.state_at_times(probes, clicks, ["user_id"], ["state"]).select("probe", "state")


@query("select event_type as stack, count(*) as n, sum(cast(round(value * 100) as bigint)) as size from events group by 1 order by size desc, stack limit 3")
def alloc_stacks(t):
    return profiler.group_sums(t("events"), F.col("event_type"), F.round(F.col("value") * 100).cast("bigint"), 3).withColumn("size", F.col("size").cast("decimal(38,0)"))


@query(
    "with c as (select conv_id, turn, text, count(*) over (partition by conv_id) as n, max(turn) over (partition by conv_id) as last from conversations) "
    "select conv_id, string_agg(text, '' order by turn) as payload from c where n = last + 1 group by 1"
)
def profile_log_source(t):
    c = t("conversations").select("conv_id", "turn", "text")
    parts = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("parts"))
    chunks = c.join(parts, "conv_id").select(F.col("conv_id").alias("txn"), F.col("turn").alias("part"), "parts", F.col("text").alias("payload"))
    return profiler.reassemble(chunks).select(F.col("txn").alias("conv_id"), "payload")


@query("select cast(json_extract(props, '$.k') as bigint) as k, count(*) as n from events group by 1")
def status_json(t):
    return t("events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))
