"""States, conflicts and changes over a log of versioned mutations."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from keyloom.operators.folds import last_writer


def state_at(log: DataFrame, version, key: list[str] = ("key",), order: list[str] = ("version", "seq"), value: str = "value", kind: str = "kind") -> DataFrame:
    """Pairs present after all sets and clears up to ``version``."""
    return last_writer(log.where(F.col(order[0]) <= F.lit(version)), list(key), list(order), value, F.col(kind) == "clear")


def clear_ranges(writes: DataFrame, clears: DataFrame, width: int | None = None) -> DataFrame:
    """Writes (key, version, value) that no later clear (begin, end, version) covers.

    A left anti join on the range. With integer keys and ``width`` the clears are cut into cells, so that the
    join is an equi-join on the cell.
    """
    w = writes.withColumn("_k", F.col("key"))
    c = clears.select(F.col("begin").alias("_b"), F.col("end").alias("_e"), F.col("version").alias("_v"))
    covers = (F.col("_b") <= F.col("_k")) & (F.col("_k") < F.col("_e")) & (F.col("_v") > F.col("version"))
    if width:
        c = c.where("_b < _e").withColumn("_c", F.explode(F.sequence(F.floor(F.col("_b") / width), F.floor((F.col("_e") - 1) / width))))
        covers = covers & (F.floor(F.col("_k") / width) == F.col("_c"))
    return w.join(c, covers, "left_anti").drop("_k")


def read_your_writes(snapshot: DataFrame, writes: DataFrame, value: str = "value", kind: str = "kind", order: str = "seq") -> DataFrame:
    """A snapshot (key, value) under a transaction's own sets and clears."""
    base = snapshot.select("key", F.col(value).alias("value"), F.lit("set").alias("kind"), F.lit(-1).cast("bigint").alias("seq"))
    own = writes.select("key", F.col(value).alias("value"), F.col(kind).alias("kind"), F.col(order).cast("bigint").alias("seq"))
    return last_writer(base.unionByName(own), ["key"], ["seq"], "value", F.col("kind") == "clear")


def restore(snapshots: DataFrame, log: DataFrame, version) -> DataFrame:
    """State at ``version`` from range snapshots (key, value, file_version) and the log (key, kind, value, version, seq).

    Each key takes only log entries later than the version of the file that its own range came from; ranges of
    files are given per key by ``file_version`` (null value: the range was read there and lacks the key).
    """
    base = snapshots.where(F.col("file_version") <= F.lit(version))
    base = base.select("key", "value", F.when(F.col("value").isNull(), "clear").otherwise("set").alias("kind"), F.col("file_version").alias("version"), F.lit(1 << 62).alias("seq"))
    later = log.where(F.col("version") <= F.lit(version)).select("key", "value", "kind", "version", F.col("seq").cast("bigint").alias("seq"))
    return last_writer(base.unionByName(later), ["key"], ["version", "seq"], "value", F.col("kind") == "clear")


def with_prefix(kv: DataFrame, add: str = "", remove: str = "") -> DataFrame:
    """Keys moved from one text prefix to another on restore; keys without the old one are left out."""
    rows = kv.where(F.col("key").startswith(remove)) if remove else kv
    return rows.withColumn("key", F.concat(F.lit(add), F.substr("key", F.lit(len(remove) + 1))))


def watches(log: DataFrame, key: list[str] = ("key",), order: list[str] = ("version", "seq"), value: str = "value") -> DataFrame:
    """Log rows at which a watch on their key fires: the value differs from the one before (absent counts)."""
    before = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(*key).orderBy(*order))
    return log.withColumn("_b", before).where(~F.col("_b.v").eqNullSafe(F.col(value))).withColumn("old_value", F.col("_b.v")).drop("_b")


def transaction_size(mutations: DataFrame, ranges: DataFrame, txn: str = "txn") -> DataFrame:
    """Bytes of each transaction: both parameters of its mutations and both ends of its conflict ranges."""
    bytes_of = lambda a, b: (F.octet_length(a) + F.octet_length(b)).cast("bigint")
    parts = mutations.select(txn, bytes_of("param1", "param2").alias("n")).union(ranges.select(txn, bytes_of("begin", "end")))
    return parts.groupBy(txn).agg(F.sum("n").alias("size"))


def once(commits: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """The first of retried commits with one idempotency id."""
    cols = [c for c in commits.columns if c not in identity]
    return commits.groupBy(*identity).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_f")).select(*identity, "_f.*")


# ---- conflicts -------------------------------------------------------------------


def history_conflicts(reads: DataFrame, writes: DataFrame, width: int | None = None) -> DataFrame:
    """Read ranges (txn, begin, end, snapshot) that a committed write (begin, end, version) after their snapshot touches: a range join.

    Where reads have ``upto``, only writes of earlier versions count.
    """
    w = writes.select(F.col("begin").alias("_b"), F.col("end").alias("_e"), F.col("version").alias("_v"))
    hit = (F.col("begin") < F.col("_e")) & (F.col("_b") < F.col("end")) & (F.col("_v") > F.col("snapshot"))
    if "upto" in reads.columns:
        hit = hit & (F.col("_v") < F.col("upto"))
    r = reads
    if width:
        cells = lambda b, e: F.explode(F.sequence(F.floor(F.col(b) / width), F.floor((F.col(e) - 1) / width)))
        r, w = reads.withColumn("_x", cells("begin", "end")), w.withColumn("_y", cells("_b", "_e"))
        hit = hit & (F.col("_x") == F.col("_y"))
    return r.join(w, hit).groupBy("txn", "begin", "end").agg(F.max("_v").alias("version"))


def resolve_batch(rows: list[tuple], oldest: int) -> list[tuple]:
    """Verdicts of one batch in commit order: (txn, status, begin and end of the first conflicting read).

    ``rows`` are (txn, snapshot, reads, writes, hit) where hit says that committed history already conflicts.
    Writes of aborted transactions do not count against later ones.
    """
    begins: list = []
    ends: list = []  # disjoint written ranges in order
    out = []
    for txn, snapshot, reads, writes, hit in rows:
        if snapshot < oldest and reads:
            out.append((txn, "too_old", None, None))
            continue
        clash = hit
        if clash is None:
            for b, e in reads:
                i = bisect_right(ends, b)
                if b < e and i < len(begins) and begins[i] < e:
                    clash = (b, e)
                    break
        if clash is not None:
            out.append((txn, "conflict", *clash))
            continue
        for b, e in writes:
            if b < e:
                i, j = bisect_left(ends, b), bisect_right(begins, e)
                if i < j:
                    b, e = min(b, begins[i]), max(e, ends[j - 1])
                begins[i:j], ends[i:j] = [b], [e]
        out.append((txn, "committed", None, None))
    return out


def detect_conflicts(txns: DataFrame, history: DataFrame | None = None, oldest: int = 0, width: int | None = None, before: Column | None = None) -> DataFrame:
    """batch, txn, status and the conflicting range. ``txns``: batch, txn, snapshot, reads and writes (arrays of struct begin, end).
    History of versions from ``before`` on does not count (that of the batch itself, where history holds it).

    Committed history is checked by a parallel join; inside a batch, order decides, so that the rows of a batch (bounded
    by the commit pipeline) are read in order by one task, which holds one batch at a time.
    """
    rows = txns.select("batch", "txn", "snapshot", "reads", "writes")
    if history is None:
        rows = rows.withColumn("hit", F.lit(None).cast("struct<begin:bigint,end:bigint>"))
    else:
        upto = [] if before is None else [before.alias("upto")]
        reads = rows.select("txn", "snapshot", *upto, F.explode("reads").alias("r"))
        reads = reads.select("txn", "snapshot", *(["upto"] if upto else []), "r.begin", "r.end")
        hits = history_conflicts(reads, history, width).groupBy("txn").agg(F.min(F.struct("begin", "end")).alias("hit"))
        rows = rows.join(hits, "txn", "left")
    kind = txns.select(F.col("reads")[0]["begin"].alias("k")).schema[0]
    arrow = to_arrow_type(kind.dataType)

    def run(batches):
        open_, own = None, []
        for record in batches:
            for r in record.to_pylist():
                if r["batch"] != open_ and own:
                    yield verdicts(open_, own, oldest, arrow)
                    own = []
                open_ = r["batch"]
                own.append(r)
        if own:
            yield verdicts(open_, own, oldest, arrow)

    ordered = rows.select("batch", "txn", "snapshot", "reads", "writes", "hit").repartition("batch").sortWithinPartitions("batch", "txn")
    name = kind.dataType.simpleString()
    return ordered.mapInArrow(run, f"batch bigint, txn bigint, status string, begin {name}, end {name}")


def verdicts(batch: int, rows: list[dict], oldest: int, kind: pa.DataType) -> pa.RecordBatch:
    ranges = lambda x: [(r["begin"], r["end"]) for r in x or ()]
    got = resolve_batch([(r["txn"], r["snapshot"], ranges(r["reads"]), ranges(r["writes"]), r["hit"] and (r["hit"]["begin"], r["hit"]["end"])) for r in rows], oldest)
    columns = [pa.array([batch] * len(got), pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string())]
    columns += [pa.array([g[i] for g in got], kind) for i in (2, 3)]
    return pa.RecordBatch.from_arrays(columns, names=["batch", "txn", "status", "begin", "end"])


def lock_conflicts(requests: DataFrame, locks: DataFrame) -> DataFrame:
    """Requests (begin, end, owner) that touch a lock of another owner."""
    l = locks.select(F.col("begin").alias("_b"), F.col("end").alias("_e"), F.col("owner").alias("lock_owner"))  # noqa: E741
    return requests.join(l, (F.col("begin") < F.col("_e")) & (F.col("_b") < F.col("end")) & (F.col("owner") != F.col("lock_owner"))).drop("_b", "_e")


def latest(log: DataFrame, by: list[str], version: Column) -> DataFrame:
    """The last version of each group: triggers, metadata versions, configuration histories."""
    return log.groupBy(*by).agg(F.max(version).alias("version"))
