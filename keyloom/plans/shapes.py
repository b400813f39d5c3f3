"""Statistics, sketches and data layers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from keyloom.functions import buckets
from keyloom.operators import layers, stats
from keyloom.operators.ordered import position, running_sum
from keyloom.plans.registry import query

# ---- samples and estimates -----------------------------------------------------------

SAMPLE = (
    "(select doc_id, length(encode(text)) as size, least(1.0, length(encode(text)) / (length(cast(doc_id as varchar)) + 100) / 250.0) as p, "
    "cast(('0x' || substr(md5(cast(doc_id as varchar)), 1, 8)) as bigint) / 4294967296.0 as h from documents)"
)


@query()
def byte_sample(t):
    d = t("documents").select(F.encode(F.col("doc_id").cast("string"), "UTF-8").alias("key"), F.octet_length("text").alias("size"))
    return stats.byte_sample(d, F.col("key"), F.col("size")).select(F.decode("key", "UTF-8").alias("key"), "size", "sampled_size")


@query("select cast(sum(n_chars) as bigint) as bytes from documents where doc_id >= 100 and doc_id < 700")
def estimated_range_size(t):
    return stats.range_size(t("documents"), 100, 700, "doc_id", "n_chars")


def _order_sample(t):
    o = t("orders")
    return o.select((F.col("o_custkey") % 8).alias("shard"), F.col("o_orderkey").alias("key"), F.length("o_orderpriority").cast("bigint").alias("size"))


ORDER_SUMS = (
    "with recursive s as (select o_custkey % 8 as shard, o_orderkey as key, length(o_orderpriority) as size, sum(length(o_orderpriority)) over (partition by o_custkey % 8 order by o_orderkey) as upto from orders), "
    "e as (select shard, min(key) as low, max(key) as high, sum(size) as total from s group by 1), "
)
#: The next cut is the first key whose sum is over a chunk more than what lies before the last one.
NEXT_CUT = (
    "select c.shard, c.n + 1, min(x.key) from c join e on e.shard = c.shard join s a on a.shard = c.shard and a.key = c.key join s x on x.shard = c.shard and x.key > c.key "
    "and x.upto > a.upto - a.size + {chunk} where x.key < e.high + {end} group by c.shard, c.n"
)


@query(ORDER_SUMS + f"c as (select shard, -1 as n, low as key from e union all {NEXT_CUT.format(chunk=900, end=0)}) select shard, n, key from c where n >= 0")
def range_split_points(t):
    return stats.shard_split_points(_order_sample(t), 900)


@query()
def split_metrics(t):
    def run(which, pdf):
        import pandas as pd

        order = stats.Order.of(pdf["key"], pdf["size"])
        rates = stats.Order.of(pdf["key"], 1 + pdf["key"] % 3)
        cuts = stats.split_metrics(order, rates, order.keys[0], order.keys[-1] + 1, 2000, 400, 300)
        return pd.DataFrame({"shard": [which] * len(cuts), "key": cuts})

    return stats.by_shard(_order_sample(t), "shard", run, "shard bigint, key bigint")


@query(
    ORDER_SUMS + "f as (select shard, min(key) as front from s where upto > 1000 group by 1), "
    "b as (select s.shard, min(s.key) as back from s join e on e.shard = s.shard join s l on l.shard = e.shard and l.key = e.high where s.upto > l.upto - l.size - 1000 group by 1) "
    "select e.shard, least(greatest(coalesce(front, high), low), high) as front, least(greatest(coalesce(back, high), low), high) as back from e left join f on f.shard = e.shard left join b on b.shard = e.shard"
)
def split_estimate(t):
    def run(which, pdf):
        import pandas as pd

        order = stats.Order.of(pdf["key"], pdf["size"])
        ends = order.keys[0], order.keys[-1]
        return pd.DataFrame({"shard": [which], "front": [stats.position_at(order, *ends, 1000)], "back": [stats.position_at(order, *ends, 1000, False)]})

    return stats.by_shard(_order_sample(t), "shard", run, "shard bigint, front bigint, back bigint")


@query()
def read_hot_ranges(t):
    def run(which, pdf):
        import pandas as pd

        sizes = stats.Order.of(pdf["key"], pdf["size"])
        reads = stats.Order.of(pdf["key"], pdf["size"].where(pdf["key"] % 1000 >= 200, pdf["size"] * 9))
        got = stats.hot_ranges(sizes, reads, sizes.keys[0], sizes.keys[-1] + 1, 2.0, 300)
        return pd.DataFrame([(which, *g) for g in got], columns=["shard", "begin", "end", "bytes", "read"])

    return stats.by_shard(_order_sample(t), "shard", run, "shard bigint, begin bigint, end bigint, bytes bigint, read bigint")


@query(
    ORDER_SUMS + f"c as (select shard, 0 as n, low as key from e union all {NEXT_CUT.format(chunk='cast(ceil(e.total / 7.0) as bigint)', end=1)}), "
    "r as (select c.shard, c.n, c.key as low, coalesce(lead(c.key) over (partition by c.shard order by c.n), e.high + 1) as high from c join e on e.shard = c.shard) "
    "select r.shard, low as \"begin\", high as \"end\", cast((select sum(size) from s where s.shard = r.shard and s.key >= r.low and s.key < r.high) as bigint) as read from r where n < 7"
)
def read_hot_equal_divide(t):
    def run(which, pdf):
        import pandas as pd

        reads = stats.Order.of(pdf["key"], pdf["size"])
        got = stats.equal_divide(reads, reads.keys[0], reads.keys[-1] + 1, 7)
        return pd.DataFrame([(which, *g, reads.between(*g)) for g in got], columns=["shard", "begin", "end", "read"])

    return stats.by_shard(_order_sample(t), "shard", run, "shard bigint, begin bigint, end bigint, read bigint")


@query()
def shard_split(t):
    loads = t("lineitem").select(F.col("l_suppkey").alias("shard"), F.col("l_orderkey").alias("key"), F.lit(1).cast("bigint").alias("size"))
    return stats.shard_split_points(loads, 150)


@query()
def shard_merge(t):
    shards = t("orders").groupBy((F.col("o_custkey") % 4).alias("group"), F.floor(F.col("o_orderkey") / 512).alias("s")).agg(F.count(F.lit(1)).alias("size"))

    def run(which, pdf):
        import pandas as pd

        own = [(s * 512, (s + 1) * 512, n) for s, n in sorted(zip(pdf["s"], pdf["size"], strict=True))]
        return pd.DataFrame([(which, *m) for m in stats.merge_small(own, 600, 120)], columns=["group", "begin", "end", "size"])

    return stats.by_shard(shards, "group", run, "group bigint, begin bigint, end bigint, size bigint")


@query("select o_orderkey as key, cast(sum(length(o_orderpriority)) over (order by o_orderkey) as bigint) as sum_to, row_number() over (order by o_orderkey) as rank from orders")
def indexed_set(t):
    o = t("orders").select(F.col("o_orderkey").alias("key"), F.length("o_orderpriority").cast("bigint").alias("n"))
    summed = running_sum(o, "key", "n", "sum_to")
    return position(summed, "key", "rank").select("key", "sum_to", "rank")


@query("select cast(ceil(ln(value) / ln(cast(1.1 as double) / 0.9)) as int) as bucket, count(*) as n from events group by 1")
def ddsketch(t):
    return stats.sketch(t("events"), "value", 0.1)


@query("select cast(ceil(ln(value) / ln(cast(1.1 as double) / 0.9)) as int) as bucket, count(*) as n from events group by 1")
def ddsketch_merge(t):
    parts = stats.sketch(t("events"), "value", 0.1, ["event_type"])
    return stats.merge_sketches(parts)


@query(
    "with s as (select event_type, ceil(ln(value) / ln(cast(1.1 as double) / 0.9)) as bucket, count(*) as n from events group by 1, 2), "
    "c as (select *, sum(n) over (partition by event_type order by bucket) as up, sum(n) over (partition by event_type) as total from s) "
    "select event_type, round(min(2 * power(cast(1.1 as double) / 0.9, bucket) / (1 + cast(1.1 as double) / 0.9)), 6) as value from c where up > floor(0.9 * (total - 1)) group by 1"
)
def ddsketch_percentile(t):
    got = stats.sketch_percentile(stats.sketch(t("events"), "value", 0.1, ["event_type"]), 0.9, 0.1, ["event_type"])
    return got.select("event_type", F.round("value", 6).alias("value"))


@query("select event_type, count(*) as n, round(avg(value), 4) as mean, min(value) as low, max(value) as high from events group by 1")
def ddsketch_mean_min_max(t):
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@query(
    "with s as (select event_type, ceil(ln(value) / ln(cast(1.1 as double) / 0.9)) as b, count(*) as n from events where event_type in ('view', 'click') group by 1, 2), "
    "p as (select b, n / sum(n) over () as p from s where event_type = 'view'), q as (select b, n / sum(n) over () as q from s where event_type = 'click'), "
    "j as (select coalesce(p, 0) as p, coalesce(q, 0) as q from p full join q on p.b = q.b) "
    "select round(sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end) / 2 + sum(case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2, 8) as divergence from j"
)
def sketch_compare(t):
    e = t("events")
    got = stats.sketch_divergence(stats.sketch(e.where("event_type = 'view'"), "value", 0.1), stats.sketch(e.where("event_type = 'click'"), "value", 0.1))
    return got.select(F.round("divergence", 8).alias("divergence"))


@query("select case when cast(round(value * 100) as bigint) > 0 then cast(floor(log2(cast(round(value * 100) as bigint))) as int) else 0 end as bucket, count(*) as n from events group by 1")
def histogram_log2(t):
    return t("events").groupBy(buckets.log2_bucket(F.round(F.col("value") * 100)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("select cast(floor(l_discount / 0.04 + 1e-9) as int) as bucket, count(*) as n from lineitem group by 1")
def histogram_percent(t):
    return t("lineitem").groupBy(buckets.percent_bucket(F.col("l_discount")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("select cast(case when l_quantity < 5 then 0 when l_quantity >= 45 then 31 else floor((l_quantity - 5) * 31 / 40) end as int) as bucket, count(*) as n from lineitem group by 1")
def histogram_linear(t):
    return t("lineitem").groupBy(buckets.linear_bucket(F.col("l_quantity"), 5, 45).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query()
def smoother(t):
    e = t("events").select("event_type", F.col("event_id").alias("t"), F.round(F.col("value") * 100).cast("bigint").alias("d"))
    got = stats.smooth(e, ["event_type"], "t", "d", 500.0)
    return got.select("event_type", "total", F.round("smooth_total", 4).alias("smooth_total"), F.round("smooth_rate", 6).alias("smooth_rate"))


@query(
    "with v as (select event_type, list(value order by event_id) as x from events group by 1), "
    "f as (select event_type, list_reduce(list_transform(x, lambda y: [y, 0.0]), lambda s, y: "
    "[0.3 * y[1] + 0.7 * (s[1] + s[2]), 0.1 * (0.3 * y[1] + 0.7 * (s[1] + s[2]) - s[1]) + 0.9 * s[2]]) as z from v) "
    "select event_type, round(z[1], 6) as level, round(z[2], 6) as trend from f"
)
def holt_smoother(t):
    got = stats.holt_smooth(t("events"), ["event_type"], "event_id", "value", 0.3, 0.1)
    return got.select("event_type", F.round("level", 6).alias("level"), F.round("trend", 6).alias("trend"))


@query("select event_type, date_trunc('hour', ts) as hour, arg_min(value, event_id) as first_value, arg_max(value, event_id) as last_value from events group by 1, 2")
def metric_time_series(t):
    e = t("events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour"))
    return e.agg(F.min_by("value", "event_id").alias("first_value"), F.max_by("value", "event_id").alias("last_value"))


@query("select event_type, round(exp(avg(ln(1 + abs(value)))) - 1, 6) as geomean from events group by 1")
def geomean(t):
    return t("events").groupBy("event_type").agg(F.round(buckets.geometric_mean(F.col("value")), 6).alias("geomean"))


@query("select user_id, event_id, sum(cast(round(value * 100) as bigint)) over (partition by user_id order by event_id range between 499 preceding and current row)::bigint as live from events")
def transient_sample(t):
    e = t("events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("size"))
    return stats.transient(e, ["user_id"], "event_id", "size", 500).select("user_id", "event_id", "live")


@query(
    "with r as (select user_id, event_id, cast(sum(case when event_type = 'error' then -30 else 10 end) over (partition by user_id order by event_id) as bigint) as total from events) "
    "select user_id, min(event_id) as event_id, arg_min(total, event_id) as total from r where total < -50 or total > 100 group by 1"
)
def wait_metrics(t):
    e = t("events").select("user_id", "event_id", F.when(F.col("event_type") == "error", -30).otherwise(10).cast("bigint").alias("d"))
    return stats.first_outside(e, ["user_id"], ["event_id"], "d", -50, 100).select("user_id", "event_id", "total")


# ---- sets, queues ---------------------------------------------------------------

A = "(select distinct o_custkey as x from orders where o_orderstatus = 'F')"
B = "(select c_custkey as x from customer where c_acctbal > 3000)"


def _a(t):
    return t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("x")).distinct()


def _b(t):
    return t("customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("x"))


@query(f"select x from {A} union select x from {B}")
def set_union(t):
    return layers.set_union(_a(t), _b(t))


@query(f"select x from {A} intersect select x from {B}")
def set_intersection(t):
    return layers.set_intersection(_a(t), _b(t))


@query(f"select x from {A} except select x from {B}")
def set_difference(t):
    return layers.set_difference(_a(t), _b(t))


@query(f"(select x from {A} except select x from {B}) union all (select x from {B} except select x from {A})")
def set_symmetric_difference(t):
    return layers.set_symmetric_difference(_a(t), _b(t))


@query(f"select not exists (select x from {A} except select c_custkey from customer) as is_subset")
def set_issubset(t):
    return layers.is_subset(_a(t), t("customer").select(F.col("c_custkey").alias("x")))


@query(f"select count(*) as length from {A}")
def set_length(t):
    return _a(t).agg(F.count(F.lit(1)).alias("length"))


@query(f"select min(x) as x from {A} where x > 77")
def set_first_greater(t):
    from keyloom.operators.scans import KeySelector, resolve

    return resolve(_a(t), KeySelector.first_greater_than(77), "x")


@query(f"select x from {A} where x not in (4, 7) union select unnest([2, 3])")
def set_update(t):
    return layers.set_add(layers.set_discard(_a(t), 4, 7), 2, 3)


@query(f"select c_custkey as x, c_custkey in (select x from {A}) as contains from customer")
def set_contains(t):
    return layers.set_contains(_a(t), t("customer").select(F.col("c_custkey").alias("x")))


@query("select o_custkey, o_orderkey from (select distinct o_custkey, o_orderkey from orders) qualify row_number() over (partition by o_custkey order by o_orderkey) > 1")
def set_pop(t):
    return layers.set_pop(t("orders").select("o_custkey", "o_orderkey").distinct(), ["o_custkey"])[1]


BAG_A = "(select c_nationkey as x from customer)"
BAG_B = "(select s_nationkey as x from supplier)"


def _bags(t):
    return t("customer").select(F.col("c_nationkey").alias("x")), t("supplier").select(F.col("s_nationkey").alias("x"))


@query(f"select x from {BAG_A} union all select x from {BAG_B}")
def bag_union(t):
    return layers.bag_union(*_bags(t))


@query(f"select x from {BAG_A} intersect all select x from {BAG_B}")
def bag_intersection(t):
    return layers.bag_intersection(*_bags(t))


@query(f"select x from {BAG_A} except all select x from {BAG_B}")
def bag_difference(t):
    return layers.bag_difference(*_bags(t))


@query("select n_nationkey, n_name from nation order by n_name limit 5")
def sort(t):
    return t("nation").select("n_nationkey", "n_name").orderBy("n_name").limit(5)


@query("select o_orderpriority, min(o_orderkey) as o_orderkey from orders group by 1")
def priority_queue(t):
    q = t("orders").select("o_orderpriority", "o_orderkey")
    return layers.pop_priority(q, ["o_orderkey"], ["o_orderpriority"]).select("o_orderpriority", "o_orderkey")


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) <= 2")
def queue(t):
    return layers.dequeue(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 2, ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("select max(o_orderkey) + 1 as next_index from orders")
def queue_last_index(t):
    return layers.next_index(t("orders"), "o_orderkey")


@query("select c_custkey, rank() over (partition by c_nationkey order by c_acctbal) as rank from customer")
def ranked_set(t):
    return t("customer").select("c_custkey", F.rank().over(Window.partitionBy("c_nationkey").orderBy("c_acctbal")).cast("bigint").alias("rank"))


@query("select c_custkey, round(sum(c_acctbal) over (partition by c_nationkey order by c_custkey), 2) as metric from customer")
def treap_metric(t):
    return t("customer").select("c_custkey", F.round(F.sum("c_acctbal").over(Window.partitionBy("c_nationkey").orderBy("c_custkey").rowsBetween(Window.unboundedPreceding, 0)), 2).alias("metric"))


# ---- tables, vectors, documents, blobs -------------------------------------------------


@query("select c_custkey as row, 'c_name' as \"column\", c_name as value from customer union all select c_custkey, 'c_mktsegment', c_mktsegment from customer")
def table_cells(t):
    return layers.to_cells(t("customer"), "c_custkey", ["c_name", "c_mktsegment"])


@query("select c_custkey as row, c_name, c_mktsegment from customer")
def table_get_row(t):
    cells = layers.to_cells(t("customer"), "c_custkey", ["c_name", "c_mktsegment"])
    return layers.to_rows(cells, ["c_name", "c_mktsegment"])


@query("select c_custkey as row, c_mktsegment as value from customer")
def table_get_col(t):
    return layers.to_cells(t("customer"), "c_custkey", ["c_name", "c_mktsegment"]).where("column = 'c_mktsegment'").select("row", "value")


@query("select c_custkey as row, 'c_mktsegment' as \"column\", case when c_custkey % 10 = 1 then 'NEW' else c_mktsegment end as value from customer where c_custkey % 10 <> 2")
def table_set_cell(t):
    cells = layers.to_cells(t("customer"), "c_custkey", ["c_mktsegment"])
    new = cells.where("row % 10 in (1, 2)").withColumn("value", F.when(F.col("row") % 10 == 1, "NEW"))
    return layers.set_cells(cells, new)


@query("select i as \"index\", coalesce(v, 0) as value from generate_series(0, (select max(event_id) from events where event_type = 'error')) g(i) left join (select event_id, cast(round(value * 100) as bigint) as v from events where event_type = 'error') on i = event_id")
def vector_get_range(t):
    v = t("events").where("event_type = 'error'").select(F.col("event_id").alias("index"), F.round(F.col("value") * 100).cast("bigint").alias("value"))
    return layers.dense(v, F.max("index") + 1, 0)


@query("select case when event_id = 7 then 14 when event_id = 14 then 7 else event_id end as \"index\", user_id as value from events where event_id < 2000")
def vector_swap_resize(t):
    v = t("events").select(F.col("event_id").alias("index"), F.col("user_id").alias("value"))
    return layers.resize(layers.swap(v, 7, 14), 2000).select(F.col("index").cast("bigint").alias("index"), "value")


ROOMS = "(select user_id, event_id // 50 as \"index\", max(event_id) as value from events group by 1, 2)"


def _rooms(t):
    """A sparse vector for each user."""
    e = t("events").select("user_id", F.floor(F.col("event_id") / 50).alias("index"), "event_id")
    return e.groupBy("user_id", "index").agg(F.max("event_id").alias("value"))


@query(
    f"with v as {ROOMS}, s as (select user_id, max(\"index\") + 1 as n from v group by 1), w as (select user_id, n, unnest([0, n - 1, n - 3]) as \"index\", unnest(['front', 'back', 'third']) as place from s) "
    "select w.user_id, place, coalesce(v.value, -1) as value from w left join v on v.user_id = w.user_id and v.\"index\" = w.\"index\" where w.\"index\" >= 0"
)
def vector_ends(t):
    v = _rooms(t)
    places = {"front": 0, "back": -1, "third": -3}
    got = [layers.element_at(v, i, -1, ["user_id"]).select("user_id", F.lit(name).alias("place"), "value") for name, i in places.items()]
    return got[0].unionByName(got[1]).unionByName(got[2])


@query(f"with v as {ROOMS} select user_id, \"index\", value from v union all select user_id, max(\"index\") + 1, count(*) from v group by 1")
def vector_push(t):
    v = _rooms(t)
    return layers.push(v, v.groupBy("user_id").agg(F.count(F.lit(1)).alias("value")), ["user_id"])


@query(
    f"with v as {ROOMS}, s as (select user_id, max(\"index\") as m from v group by 1) select v.* from v join s using (user_id) where \"index\" < m "
    "union all select user_id, m - 1, -1 from s where m > 0 and not exists (select 1 from v where v.user_id = s.user_id and v.\"index\" = s.m - 1)"
)
def vector_pop(t):
    return layers.pop(_rooms(t), -1, ["user_id"])


@query("select event_id as \"index\", user_id as value from events where event_id in (3, 5, 70)")
def array_get(t):
    return t("events").where(F.col("event_id").isin(3, 5, 70)).select(F.col("event_id").alias("index"), F.col("user_id").alias("value"))


@query("select event_id as doc_id, '[\"k\"]' as path, json_extract_string(props, '$.k') as value from events")
def document_insert(t):
    return layers.explode_documents(t("events"), "event_id", "props")


@query("select event_id as doc_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def document_get(t):
    leaves = layers.explode_documents(t("events"), "event_id", "props")
    return layers.assemble_documents(leaves).select("doc_id", F.get_json_object("text", "$.k").cast("bigint").alias("k"))


@query("select event_id as doc_id, json_extract_string(props, '$.k') as value from events")
def document_get_subdoc(t):
    leaves = layers.explode_documents(t("events"), "event_id", "props")
    return layers.subdocument(leaves, ["k"]).select("doc_id", "value")


@query("select doc_id as id, o as \"offset\", substr(text, o + 1, 1000) as chunk from documents, lateral (select unnest(generate_series(0, length(text) - 1, 1000))::int as o) where length(text) > 0")
def blob_write(t):
    return layers.to_chunks(t("documents"), "doc_id", "text", 1000)


@query("select doc_id as id, text as data from documents where length(text) > 0")
def blob_read(t):
    return layers.from_chunks(layers.to_chunks(t("documents"), "doc_id", "text", 1000))


@query("select 'current' as pointer, count(*) as pairs from customer where c_acctbal > 0")
def indirection_workspace(t):
    pairs = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    tree = layers.Directory.empty(pairs.sparkSession).create(["app", "current"])
    prefix = tree.open(["app", "current"]).first()["prefix"]
    old = pairs.select(F.lit(prefix).cast("bigint").alias("prefix"), "key", "value")
    tree, contents = layers.publish(tree, old, ["app", "current"], pairs.where("value > 0"))
    return layers.read_through(tree, contents, ["app", "current"]).agg(F.count(F.lit(1)).alias("pairs")).select(F.lit("current").alias("pointer"), "pairs")


@query("select p_partkey from part where p_size between 5 and 20 and cast(floor(p_retailprice) as int) between 950 and 1400")
def spatial_zorder(t):
    p = t("part").select("p_partkey", F.col("p_size").alias("x"), F.col("p_retailprice").cast("int").alias("y"))
    p = p.withColumn("z", buckets.interleave(F.col("x"), F.col("y"), 16))
    return layers.in_rectangle(p, "z", "x", "y", (5, 950), (20, 1400)).select("p_partkey")


@query("select o_orderkey as row, case when o_orderkey % 9 = 0 then 'new' else o_orderstatus end as value from orders")
def compressed_column(t):
    rows = t("orders").select(F.col("o_orderkey").alias("row"), F.col("o_orderstatus").alias("value"))
    fresh = rows.where("row % 9 = 0").withColumn("value", F.lit("new"))
    return layers.merged_column(layers.pack_column(rows, 64), fresh)


@query("select o_orderkey as row, case when o_orderkey % 9 = 0 then 'new' else o_orderstatus end as value from orders where o_orderkey % 12 <> 0")
def compressed_column_delete(t):
    rows = t("orders").select(F.col("o_orderkey").alias("row"), F.col("o_orderstatus").alias("value"))
    fresh = rows.where("row % 9 = 0").withColumn("value", F.lit("new"))
    return layers.delete_rows(layers.pack_column(rows, 64), fresh, rows.where("row % 12 = 0"))


@query("select user_id as inbox, event_id as message, rank from (select s.user_id, m.event_id, row_number() over (partition by s.user_id order by m.event_id desc) as rank from (select distinct user_id, event_type from events where event_type = 'signup') s join events m on m.event_type = s.event_type) where rank <= 10")
def pubsub_inbox(t):
    e = t("events")
    subs = e.where("event_type = 'signup'").select(F.col("user_id").alias("inbox"), F.col("event_type").alias("feed"))
    posts = e.select(F.col("event_type").alias("feed"), F.col("event_id").alias("message"))
    return layers.inbox_messages(subs, posts, 10).select("inbox", "message", F.col("rank").cast("bigint").alias("rank"))


@query("select event_type as feed, event_id as message from events qualify row_number() over (partition by event_type order by event_id desc) <= 10")
def pubsub_feed(t):
    posts = t("events").select(F.col("event_type").alias("feed"), F.col("event_id").alias("message"))
    return layers.feed_messages(posts, 10).select("feed", "message")


@query("select n_name as name from nation where n_regionkey = 1")
def directory_list(t):
    regions = t("region").select(F.array(F.lit("world"), F.col("r_regionkey").cast("string")).alias("path"), F.col("r_regionkey").cast("bigint").alias("prefix"))
    nations = t("nation").select(F.array(F.lit("world"), F.col("n_regionkey").cast("string"), F.col("n_name")).alias("path"), (F.col("n_nationkey") + 100).cast("bigint").alias("prefix"))
    nodes = regions.union(nations).select("path", "prefix", F.lit("").alias("layer"), F.lit(False).alias("is_partition"))
    tree = layers.Directory(nodes).create(["world"], prefix=1000).move(["world", "1"], ["world", "new"])
    return tree.list(["world", "new"])


@query("select '/world/' || n_regionkey || '/' || n_name as path from nation where n_regionkey <> 2 union all select '/world/' || r_regionkey from region where r_regionkey <> 2 union all select unnest(['/world', '/other', '/other/depth', '/other/depth/leaf'])")
def directory_tree(t):
    regions = t("region").select(F.array(F.lit("world"), F.col("r_regionkey").cast("string")).alias("path"), F.col("r_regionkey").cast("bigint").alias("prefix"))
    nations = t("nation").select(F.array(F.lit("world"), F.col("n_regionkey").cast("string"), F.col("n_name")).alias("path"), (F.col("n_nationkey") + 100).cast("bigint").alias("prefix"))
    nodes = regions.union(nations).select("path", "prefix", F.lit("").alias("layer"), F.lit(False).alias("is_partition"))
    tree = layers.Directory(nodes).create_or_open(["world"]).create(["other", "depth", "leaf"]).remove(["world", "2"]).remove_if_exists(["nowhere"])
    return tree.nodes.select(F.concat(F.lit("/"), F.array_join("path", "/")).alias("path"))


@query("select count(*) as n, count(distinct c_custkey) as prefixes from customer")
def hca_allocate(t):
    got = layers.allocate(t("customer").select("c_custkey"))
    return got.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("prefix").alias("prefixes"))
