"""CSV, JSON and blob files as rows, and rows as key-value pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.layers import explode_documents

#: Bytes of a blob chunk (fixed value).
CHUNK = 10_240


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = False, skip_empty: bool = False) -> DataFrame:
    """One array of strings for each line; ``skip_empty`` drops empty cells."""
    rows = spark.read.option("sep", delimiter).option("header", header).option("mode", "PERMISSIVE").csv(path)
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in rows.columns])
    cells = F.filter(cells, lambda x: x.isNotNull() & (x != "")) if skip_empty else F.transform(cells, lambda x: F.coalesce(x, F.lit("")))
    return rows.select(cells.alias("cells"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one object in each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_blob(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """(path, offset, chunk) of binary files."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    rows = files.select("path", "content", F.explode(F.sequence(F.lit(0), F.length("content") - 1, F.lit(size))).alias("offset"))
    return rows.select("path", "offset", F.substr("content", F.col("offset") + 1, F.lit(size)).alias("chunk"))


def to_kvp(rows: DataFrame, empty_value: str | None = None) -> DataFrame:
    """(key, value) of cell arrays: the last cell is the value, or all are the key where ``empty_value`` is given."""
    if empty_value is not None:
        return rows.select(F.col("cells").alias("key"), F.lit(empty_value).alias("value"))
    return rows.where(F.size("cells") > 0).select(F.expr("slice(cells, 1, size(cells) - 1)").alias("key"), F.element_at("cells", -1).alias("value"))


def csv_to_kvp(spark: SparkSession, path: str, out: str, **options) -> None:
    to_kvp(read_csv(spark, path, **options)).write.mode("overwrite").parquet(out)


def json_to_doc(spark: SparkSession, path: str, out: str) -> None:
    explode_documents(read_json(spark, path), "path", "text").write.mode("overwrite").parquet(out)


def blob_to_blob(spark: SparkSession, path: str, out: str, size: int = CHUNK) -> None:
    read_blob(spark, path, size).write.mode("overwrite").parquet(out)
