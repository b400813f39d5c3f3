"""Key-range dumps with a manifest, and loads that check it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.ordered import position


def checksum(key: str = "key", value: str = "value"):
    """An aggregate that does not depend on the order of pairs."""
    return F.bit_xor(F.xxhash64(key, value))


def dump(kv: DataFrame, path: str, files: int, version: int = 0) -> DataFrame:
    """Pairs written in ``files`` key ranges, each sorted; returns the manifest that is written beside them."""
    ranged = kv.repartitionByRange(files, "key").sortWithinPartitions("key")
    ranged.write.mode("overwrite").parquet(f"{path}/data")
    written = kv.sparkSession.read.parquet(f"{path}/data").select("*", F.col("_metadata.file_name").alias("file"))
    manifest = manifests(written, ["file"], version)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return kv.sparkSession.read.parquet(f"{path}/manifest")


def manifests(kv: DataFrame, by: list[str], version: int = 0) -> DataFrame:
    """A row for each file set: key range, version, checksum, bytes and pairs."""
    size = F.octet_length("key") + F.octet_length("value") if kv.schema["key"].dataType.simpleString() in ("binary", "string") else F.lit(8) + F.octet_length(F.col("value").cast("string"))
    return kv.groupBy(*by).agg(
        F.min("key").alias("begin"), F.max("key").alias("last"), F.lit(version).cast("bigint").alias("version"), checksum().alias("checksum"),
        F.sum(size.cast("bigint")).alias("bytes"), F.count(F.lit(1)).alias("pairs"),
    )


def load(spark: SparkSession, path: str, begin=None, end=None) -> DataFrame:
    """The pairs of a dump in a range; files whose checksum is not the manifest's raise."""
    data = spark.read.parquet(f"{path}/data").select("*", F.col("_metadata.file_name").alias("file"))
    found = manifests(data, ["file"]).select("file", F.col("checksum").alias("c"), F.col("pairs").alias("p"))
    bad = spark.read.parquet(f"{path}/manifest").join(found, "file", "left").where("not (checksum <=> c and pairs <=> p)")
    if bad.limit(1).count():
        raise ValueError(f"{path}: a file differs from its manifest")
    rows = data.drop("file")
    rows = rows if begin is None else rows.where(F.col("key") >= F.lit(begin))
    return rows if end is None else rows.where(F.col("key") < F.lit(end))


def load_into(old: DataFrame, loaded: DataFrame, begin, end) -> DataFrame:
    """Clear, then load: pairs of [begin, end) come from the dump only."""
    return old.where((F.col("key") < F.lit(begin)) | (F.col("key") >= F.lit(end))).unionByName(loaded.where((F.col("key") >= F.lit(begin)) & (F.col("key") < F.lit(end))))


def group_manifests(manifest: DataFrame, count: int) -> DataFrame:
    """Tasks of at most ``count`` manifests in key order, with the range they cover together."""
    numbered = position(manifest, "begin", "_n")
    task = numbered.withColumn("task", F.floor((F.col("_n") - 1) / count))
    return task.groupBy("task").agg(F.min("begin").alias("begin"), F.max("last").alias("last"), F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("manifests"))


def verify(source: DataFrame, restored: DataFrame) -> DataFrame:
    """Pairs of the source that the restored side lacks or has otherwise; extra restored pairs are not errors."""
    r = restored.select(F.col("key").alias("_k"), F.col("value").alias("restored_value"))
    joined = source.join(r, F.col("key") == F.col("_k"), "left")
    return joined.where(F.col("_k").isNull() | ~F.col("value").eqNullSafe(F.col("restored_value"))).drop("_k")
