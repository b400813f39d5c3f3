"""Where queries register themselves with their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of a table reader under its name; ``sql`` is None where SQL cannot tell the rows."""

    def put(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__ = key
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return f

    return put


# ---- views of the tables that many queries share, and their SQL -----------------


def orders_kv(t) -> DataFrame:
    """Orders as ordered pairs."""
    return t("orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))


ORDERS_KV = "(select o_orderkey as key, o_orderpriority as value from orders)"


def event_log(t) -> DataFrame:
    """Events as a log of sets and clears on users, in the order of event ids."""
    e = t("events")
    return e.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("version"), F.lit(0).cast("bigint").alias("seq"),
        F.when(F.col("event_type") == "error", "clear").otherwise("set").alias("kind"), F.col("event_type").alias("value"),
    )


EVENT_LOG = "(select user_id as key, event_id as version, 0 as seq, case when event_type = 'error' then 'clear' else 'set' end as kind, event_type as value from events)"


def event_cents(t) -> DataFrame:
    return t("events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))


EVENT_CENTS = "(select user_id, event_id, cast(round(value * 100) as bigint) as cents from events)"


def user_spans(t) -> DataFrame:
    """Intervals [event_id, event_id + ceil(value)) by user."""
    return t("events").select("user_id", F.col("event_id").alias("begin"), (F.col("event_id") + F.ceil("value")).cast("bigint").alias("end"))


USER_SPANS = "(select user_id, event_id as \"begin\", event_id + cast(ceil(value) as bigint) as \"end\" from events)"


def type_map(t) -> DataFrame:
    """Transition keys of a map by user: the event type holds from its event id on."""
    return t("events").select("user_id", F.col("event_id").alias("key"), F.col("event_type").alias("value"))


TYPE_MAP = "(select user_id, event_id as key, event_type as value from events)"


def shard_map(t) -> DataFrame:
    """The suppliers' nations as shards of the order keys: shard i holds [1000 i, 1000 (i + 1))."""
    n = t("nation")
    return n.select((F.col("n_nationkey") * 1000).cast("bigint").alias("begin"), ((F.col("n_nationkey") + 1) * 1000).cast("bigint").alias("end"), F.col("n_name").alias("address"))


SHARD_MAP = "(select cast(n_nationkey * 1000 as bigint) as \"begin\", cast((n_nationkey + 1) * 1000 as bigint) as \"end\", n_name as address from nation)"
