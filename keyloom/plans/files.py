"""Files, dumps and streams that a query writes and reads again."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from keyloom.functions.keys import key_between
from keyloom.operators import versions
from keyloom.operators.layers import assemble_documents
from keyloom.plans.registry import EVENT_LOG, ORDERS_KV, event_log, orders_kv, query
from keyloom.sources import backup, bulk, dump
from keyloom.sources.scratch import scratch
from keyloom.streaming import changes

BLOCK = 1 << 16


@query("select c_custkey || '/' || c_mktsegment as key, c_name as value from customer")
def csv_to_kvp(t):
    rows = t("customer").select("c_custkey", "c_mktsegment", "c_name")
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    rows.write.csv(f"{path}/csv")
    bulk.csv_to_kvp(spark, f"{path}/csv", f"{path}/kvp")
    return spark.read.parquet(f"{path}/kvp").select(F.array_join("key", "/").alias("key"), "value")


@query("select n_nationkey as id, n_name as name from nation")
def json_to_doc(t):
    docs = t("nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.struct(F.col("n_name").alias("text")).alias("name"))).alias("value"))
    spark, path = docs.sparkSession, scratch(docs.sparkSession)
    docs.write.option("maxRecordsPerFile", 1).text(f"{path}/json")
    bulk.json_to_doc(spark, f"{path}/json", f"{path}/doc")
    text = assemble_documents(spark.read.parquet(f"{path}/doc"))
    return text.select(F.get_json_object("text", "$.id").cast("int").alias("id"), F.get_json_object("text", "$.name.text").alias("name"))


@query("select o as \"offset\", substr(repeat(n_name, 3000) || chr(10), o + 1, 10240) as chunk from nation, lateral (select unnest(generate_series(0, length(n_name) * 3000, 10240))::int as o)")
def blob_to_blob(t):
    blobs = t("nation").select(F.repeat("n_name", 3000).alias("value"))
    spark, path = blobs.sparkSession, scratch(blobs.sparkSession)
    blobs.write.option("maxRecordsPerFile", 1).text(f"{path}/files")
    bulk.blob_to_blob(spark, f"{path}/files", f"{path}/blobs")
    return spark.read.parquet(f"{path}/blobs").select("offset", F.decode("chunk", "UTF-8").alias("chunk"))


@query("select lpad(cast(o_orderkey as varchar), 12, '0') as key, o_orderpriority as value from orders")
def backup_range_file(t):
    kv = orders_kv(t).select(
        F.floor(F.col("key") / 4096).alias("part"), F.encode(F.lpad(F.col("key").cast("string"), 12, "0"), "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value")
    )
    got = backup.range_pairs(backup.range_files(kv, "part", BLOCK), BLOCK)
    return got.select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


def _log(t):
    kind = F.when(F.col("event_type") == "error", backup.CLEAR_RANGE).otherwise(backup.SET)
    return t("events").select(
        F.floor(F.col("event_id") / 4096).alias("part"), F.floor(F.col("event_id") / 10).alias("version"), (F.col("event_id") % 10).cast("int").alias("sub"),
        kind.alias("type"), F.encode("event_type", "UTF-8").alias("param1"), F.encode(F.when(kind == backup.CLEAR_RANGE, "sk").otherwise("v"), "UTF-8").alias("param2"),
    )


@query("select event_id // 10 as version, cast(event_id % 10 as int) as sub, case when event_type = 'error' then 1 else 0 end as type, event_type as param1, case when event_type = 'error' then 'sk' else 'v' end as param2 from events")
def backup_log_file(t):
    got = backup.log_rows(backup.log_files(_log(t), "part", BLOCK), BLOCK)
    return got.select("version", "sub", "type", F.decode("param1", "UTF-8").alias("param1"), F.decode("param2", "UTF-8").alias("param2"))


@query("select event_id // 10 as version, event_type as param1 from events where event_type <> 'error' and (event_type like 'si%' or event_type like 'v%') or event_type = 'error'")
def match_filters(t):
    return _log(t).where(backup.matches([b"si", b"v"])).select("version", F.decode("param1", "UTF-8").alias("param1"))


@query(
    "with p as (select c_custkey, c_name as b, lead(c_name) over (partition by c_nationkey order by c_name) as e from customer) "
    "select c_custkey, substr(e, 1, len(list_filter(range(1, least(length(b), length(e)) + 1), lambda n: substr(b, 1, n) = substr(e, 1, n))) + 1) as key from p where e is not null"
)
def key_between_names(t):
    p = t("customer").withColumn("e", F.lead("c_name").over(Window.partitionBy("c_nationkey").orderBy("c_name"))).where("e is not null")
    return p.select("c_custkey", F.decode(key_between(F.encode("c_name", "UTF-8"), F.encode("e", "UTF-8")), "UTF-8").alias("key"))


@query(f"select key, value from {ORDERS_KV} where key >= 100 and key < 5000")
def bulk_dump_load(t):
    kv = orders_kv(t)
    path = scratch(kv.sparkSession)
    dump.dump(kv, path, 4, version=7)
    return dump.load(kv.sparkSession, path, 100, 5000).select("key", "value")


@query(f"select key, arg_max(value, version) as value from {EVENT_LOG} group by key having arg_max(kind, version) = 'set'")
def dr_copy(t):
    """The log comes in two parts and is copied by a stream that goes on where it ended; the copy's last state is read."""
    log = event_log(t).withColumn("end", F.lit(None).cast("bigint"))
    spark, path = log.sparkSession, scratch(log.sparkSession)
    for part in (F.col("version") < 5000, F.col("version") >= 5000):
        log.where(part).write.mode("append").parquet(f"{path}/log")
        stream = spark.readStream.schema(log.schema).parquet(f"{path}/log")
        changes.replicate(stream, 0, 1 << 62, f"{path}/copy", f"{path}/applied", f"{path}/cursor")
    return versions.state_at(spark.read.parquet(f"{path}/copy"), 1 << 62).select("key", "value")


@query(
    "with a as (select event_type as name, max(event_id // 2) as v from events group by 1) select event_type as name, event_id as \"cursor\", "
    "case when event_id >= v then 'ok' else 'too_old' end as status, case when event_id >= v then event_id + 1 end as first_version from events join a on a.name = event_type"
)
def cdc_resume(t):
    e = t("events").withColumnRenamed("event_type", "name")
    path = scratch(e.sparkSession)
    for odd in (0, 1):
        changes.acknowledge(e.where(F.col("user_id") % 2 == odd).select("name", F.floor(F.col("event_id") / 2).alias("version")), path)
    return changes.resume(e.select("name", F.col("event_id").alias("cursor")), changes.acknowledged(e.sparkSession, path)).select("name", "cursor", "status", "first_version")
