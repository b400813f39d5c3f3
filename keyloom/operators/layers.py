"""Data models over ordered keys: sets, queues, tables, vectors, graphs, documents, blobs, feeds, directories."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.buckets import interleave
from keyloom.operators.folds import last_writer

# ---- sets (one column x) -------------------------------------------------------


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def set_symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One aggregate over both sides, not two differences."""
    x = a.columns
    sides = a.withColumn("_a", F.lit(True)).union(b.withColumn("_a", F.lit(False)))
    return sides.groupBy(*x).agg(F.max("_a").alias("_m"), F.min("_a").alias("_n")).where("_m = _n").select(*x)


def is_subset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether every element of ``a`` is in ``b``."""
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in a.columns]
    lost = a.alias("a").join(b.alias("b"), reduce(lambda p, q: p & q, on), "left_anti")
    return lost.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_subset"))


def set_add(a: DataFrame, *values) -> DataFrame:
    return set_union(a, a.sparkSession.createDataFrame([(v,) for v in values], a.schema))


def set_discard(a: DataFrame, *values) -> DataFrame:
    return a.where(~F.col(a.columns[0]).isin(*values))


def set_contains(a: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked elements with ``contains``: whether each is in the set."""
    x = a.columns
    marked = a.distinct().select(*[F.col(c).alias(f"_{c}") for c in x], F.lit(True).alias("_in"))
    on = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in x])
    return asked.join(marked, on, "left").select(*asked.columns, F.col("_in").isNotNull().alias("contains"))


def set_pop(a: DataFrame, by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The least element of each set and what is left of the sets. The last column holds the elements."""
    x = a.columns[-1]
    least = a.groupBy(*by).agg(F.min(x).alias(x)) if by else a.agg(F.min(x).alias(x)).where(F.col(x).isNotNull())
    return least, a.join(least, [*by, x], "left_anti")


# ---- bags: elements count as often as they stand ----------------------------------


def bag_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionAll(b)


def bag_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b)


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


# ---- queues ---------------------------------------------------------------------


def dequeue(queue: DataFrame, order: list[str], n: int = 1, by: list[str] = ()) -> DataFrame:
    """The next ``n`` items, of every queue told apart by ``by``."""
    if not by:
        return queue.orderBy(*order).limit(n)
    return queue.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def pop_priority(queue: DataFrame, order: list[str], by: list[str], largest: bool = False) -> DataFrame:
    """The item of least (or greatest) priority of every queue; the earliest of equals."""
    pick = F.max_by if largest else F.min_by
    key = F.struct(order[0], *[-F.col(c) for c in order[1:]]) if largest else F.struct(*order)
    rest = [c for c in queue.columns if c not in by]
    return queue.groupBy(*by).agg(pick(F.struct(*rest), key).alias("_i")).select(*by, "_i.*")


def next_index(queue: DataFrame, index: str = "index") -> DataFrame:
    """The index that an item put in now gets."""
    return queue.agg((F.coalesce(F.max(index), F.lit(-1)) + 1).alias("next_index"))


# ---- tables ----------------------------------------------------------------------


def to_cells(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """(row, column, value) of a wide table, without absent cells."""
    return df.select(F.col(row).alias("row"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot("row", columns, "column", "value").where("value is not null")


def to_rows(cells: DataFrame, columns: list[str]) -> DataFrame:
    return cells.groupBy("row").pivot("column", columns).agg(F.first("value"))


def set_cells(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Cells under later ones; a null value clears."""
    both = cells.withColumn("_s", F.lit(0)).unionByName(changes.withColumn("_s", F.lit(1)))
    return last_writer(both, ["row", "column"], ["_s"], "value", F.col("value").isNull())


# ---- sparse vectors ------------------------------------------------------------


def dense(vector: DataFrame, size: Column, default, by: list[str] = (), start: int = 0, step: int = 1) -> DataFrame:
    """Every slot from ``start`` below the size, missing ones with the default. Trailing empty slots are emitted too."""
    sizes = vector.groupBy(*by).agg(size.alias("_size")) if by else vector.agg(size.alias("_size"))
    slots = sizes.where(F.col("_size") > start).select(*by, F.explode(F.sequence(F.lit(start).cast("bigint"), F.col("_size").cast("bigint") - 1, F.lit(step).cast("bigint"))).alias("index"))
    joined = slots.join(vector.select(*by, F.col("index").cast("bigint").alias("index"), "value"), [*by, "index"], "left")
    return joined.withColumn("value", F.coalesce("value", F.lit(default)))


def swap(vector: DataFrame, i: int, j: int) -> DataFrame:
    at = F.col("index")
    return vector.withColumn("index", F.when(at == i, j).when(at == j, i).otherwise(at))


def resize(vector: DataFrame, size: int) -> DataFrame:
    return vector.where(F.col("index") < size)


def _sizes(vector: DataFrame, by: list[str]) -> DataFrame:
    size = (F.max("index") + 1).cast("bigint").alias("_size")
    return vector.groupBy(*by).agg(size) if by else vector.agg(size).where("_size is not null")


def element_at(vector: DataFrame, i: int, default, by: list[str] = ()) -> DataFrame:
    """Slot ``i`` of each vector, from the end where it is negative (0 is the front, -1 the back); vectors without that slot have no row."""
    at = _sizes(vector, by).withColumn("index", F.lit(i).cast("bigint") if i >= 0 else F.col("_size") + i).where("index >= 0 and index < _size").drop("_size")
    joined = at.join(vector.select(*by, F.col("index").cast("bigint").alias("index"), "value"), [*by, "index"], "left")
    return joined.withColumn("value", F.coalesce("value", F.lit(default)))


def push(vector: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """Vectors with one value each (by, value) behind their last slot; a vector that does not exist begins at 0."""
    new = values.select(*by, "value").join(_sizes(vector, by), list(by), "left").select(*by, F.coalesce("_size", F.lit(0)).cast("bigint").alias("index"), "value")
    return vector.select(*by, F.col("index").cast("bigint").alias("index"), "value").unionByName(new)


def pop(vector: DataFrame, default, by: list[str] = ()) -> DataFrame:
    """Vectors without their last slot; an empty slot before it is written out, so that the size falls by one."""
    own = vector.select(*by, F.col("index").cast("bigint").alias("index"), "value")
    sizes = _sizes(own, by)
    kept = own.join(sizes.select(*by, (F.col("_size") - 1).alias("index")), [*by, "index"], "left_anti")
    ends = sizes.where("_size > 1").select(*by, (F.col("_size") - 2).alias("index"))
    return kept.unionByName(ends.join(own, [*by, "index"], "left_anti").withColumn("value", F.lit(default)))


# ---- graphs, multimaps -----------------------------------------------------------


def neighbours(edges: DataFrame, node: str = "src", other: str = "dst") -> DataFrame:
    return edges.groupBy(F.col(node).alias("node")).agg(F.array_sort(F.collect_set(other)).alias("neighbours"))


def multimap_counts(changes: DataFrame) -> DataFrame:
    """(index, value, count) after added (+1) and subtracted (-1) elements; counts of zero or less are absent."""
    return changes.groupBy("index", "value").agg(F.sum("delta").alias("count")).where("count > 0")


# ---- documents -------------------------------------------------------------------

# What stands for an empty object and an empty array.
EMPTY_OBJECT = -2
EMPTY_ARRAY = -1


def to_paths(doc) -> list[tuple]:
    """Leaves of nested objects as (path..., value), in the order of keys and places."""
    if isinstance(doc, dict):
        inner = [(k, v) for k, v in sorted(doc.items())]
        empty = EMPTY_OBJECT
    elif isinstance(doc, list):
        inner = list(enumerate(doc))
        empty = EMPTY_ARRAY
    else:
        return [(doc,)]
    return [(k, *rest) for k, v in inner for rest in to_paths(v)] or [(empty,)]


def from_paths(paths: list[tuple]):
    """The inverse: integer steps make arrays, text steps objects."""
    if len(paths) == 1 and len(paths[0]) == 1:
        only = paths[0][0]
        return {} if only == EMPTY_OBJECT and not isinstance(only, bool) else [] if only == EMPTY_ARRAY and not isinstance(only, bool) else only
    grouped: dict = {}
    for first, *rest in paths:
        grouped.setdefault(first, []).append(tuple(rest))
    if all(isinstance(k, int) for k in grouped):
        return [from_paths(v) for _, v in sorted(grouped.items())]
    return {k: from_paths(v) for k, v in grouped.items()}


def explode_documents(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, path, value): one row for each leaf of JSON text; path and value are JSON."""

    def run(batches):
        for pdf in batches:
            out = []
            for i, t in zip(pdf["doc_id"], pdf["t"], strict=True):
                if t is not None:
                    out += [(i, json.dumps(p[:-1]), json.dumps(p[-1])) for p in to_paths(json.loads(t))]
            yield pd.DataFrame(out, columns=["doc_id", "path", "value"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInPandas(run, f"doc_id {kind}, path string, value string")


def assemble_documents(leaves: DataFrame) -> DataFrame:
    """(doc_id, text) from leaves."""

    @F.pandas_udf("string")
    def build(x: pd.Series) -> pd.Series:
        return x.map(lambda own: json.dumps(from_paths([(*json.loads(e["path"]), json.loads(e["value"])) for e in own]), sort_keys=True))

    lists = leaves.groupBy("doc_id").agg(F.collect_list(F.struct("path", "value")).alias("x"))
    return lists.select("doc_id", build("x").alias("text"))


def subdocument(leaves: DataFrame, prefix: list) -> DataFrame:
    """Leaves under a path."""
    start = json.dumps(prefix)[:-1]
    path = F.col("path")
    return leaves.where(path.startswith(start + ", ") | (path == json.dumps(prefix)) if prefix else F.lit(True))


# ---- blobs -----------------------------------------------------------------------


def to_chunks(df: DataFrame, blob_id: str, data: str, size: int) -> DataFrame:
    """(id, offset, chunk) of text or bytes."""
    offsets = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(data) - 1), F.lit(size))
    rows = df.where(F.length(data) > 0).select(F.col(blob_id).alias("id"), F.col(data).alias("_d"), F.explode(offsets).alias("offset"))
    return rows.select("id", "offset", F.substr("_d", F.col("offset") + 1, F.lit(size)).alias("chunk"))


def from_chunks(chunks: DataFrame) -> DataFrame:
    """(id, data) of text chunks in the order of their offsets."""
    lists = chunks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("offset", "chunk"))).alias("x"))
    return lists.select("id", F.array_join(F.transform("x", lambda e: e["chunk"]), "").alias("data"))


# ---- spatial ---------------------------------------------------------------------


def in_rectangle(points: DataFrame, z: str, x: str, y: str, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """Points in a rectangle: the range of z-order values first (a key range that prunes), then both coordinates."""
    spark = points.sparkSession
    ends = spark.range(1).select(interleave(F.lit(low[0]), F.lit(low[1])).alias("a"), interleave(F.lit(high[0]), F.lit(high[1])).alias("b")).first()
    return points.where(F.col(z).between(ends["a"], ends["b"]) & F.col(x).between(low[0], high[0]) & F.col(y).between(low[1], high[1]))


# ---- compressed columns ---------------------------------------------------------


def merged_column(packed: DataFrame, unpacked: DataFrame) -> DataFrame:
    """(row, value): single rows override those of packed blocks (row list and value list of equal length)."""
    inner = packed.select(F.explode(F.arrays_zip("rows", "values")).alias("e")).select(F.col("e.rows").alias("row"), F.col("e.values").alias("value"), F.lit(0).alias("fresh"))
    both = inner.unionByName(unpacked.select("row", "value", F.lit(1).alias("fresh")))
    return both.groupBy("row").agg(F.max_by("value", "fresh").alias("value"))


def delete_rows(packed: DataFrame, unpacked: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, value) of a column after rows are deleted from its blocks and its single rows."""
    return merged_column(packed, unpacked).join(rows.select("row").distinct(), "row", "left_anti")


def pack_column(rows: DataFrame, per_block: int) -> DataFrame:
    """Blocks of about ``per_block`` neighbouring rows."""
    from keyloom.operators.scans import segments

    cut = segments(rows, per_block, "row")
    block = cut.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("x"))
    return block.select(F.col("x")[0]["row"].alias("first_row"), F.transform("x", lambda e: e["row"]).alias("rows"), F.transform("x", lambda e: e["value"]).alias("values"))


# ---- feeds -----------------------------------------------------------------------


def inbox_messages(subscriptions: DataFrame, messages: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` messages of every inbox, of all feeds it is subscribed to (also those posted before).

    They are among the newest ``limit`` of its feeds, so no more of a feed are joined.
    """
    newest = feed_messages(messages, limit).drop("rank")
    own = subscriptions.select("inbox", "feed").distinct().join(newest, "feed")
    order = Window.partitionBy("inbox").orderBy(F.desc("message"))
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def feed_messages(messages: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("feed").orderBy(F.desc("message"))
    return messages.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


# ---- directories -------------------------------------------------------------------


class Directory:
    """A catalogue of paths: DataFrame (path array<string>, prefix bigint, layer string, partition boolean). Changes return a new one."""

    SCHEMA = "path array<string>, prefix bigint, layer string, is_partition boolean"

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    @classmethod
    def empty(cls, spark) -> Directory:
        return cls(spark.createDataFrame([], cls.SCHEMA))

    def _at(self, path) -> Column:
        return F.col("path") == F.array(*[F.lit(p) for p in path]).cast("array<string>")

    def _under(self, path) -> Column:
        n = len(path)
        return F.slice("path", 1, n) == F.array(*[F.lit(p) for p in path]).cast("array<string>") if n else F.lit(True)

    def exists(self, path) -> bool:
        """The root always exists."""
        return not path or bool(self.nodes.where(self._at(path)).limit(1).count())

    def create(self, path, layer: str = "", prefix: int | None = None, partition: bool = False) -> Directory:
        """The path and those above it that are missing, with prefixes no other node has."""
        if self.exists(path):
            raise ValueError(f"{path} exists")
        if prefix is not None and self.nodes.where(F.col("prefix") == prefix).limit(1).count():
            raise ValueError(f"prefix {prefix} is taken")
        known = {tuple(r["path"]) for r in self.nodes.where(F.size("path") <= len(path)).where(F.array_position(F.array(*[F.array(*[F.lit(q) for q in path[:k]]) for k in range(1, len(path) + 1)]), F.col("path")) > 0).collect()}
        top = self.nodes.agg(F.coalesce(F.max("prefix"), F.lit(-1))).first()[0]
        rows = []
        for k in range(1, len(path) + 1):
            if tuple(path[:k]) not in known:
                top += 1
                last = k == len(path)
                rows.append((list(path[:k]), prefix if last and prefix is not None else top, layer if last else "", partition and last))
        return Directory(self.nodes.union(self.nodes.sparkSession.createDataFrame(rows, self.SCHEMA)))

    def open(self, path, layer: str | None = None) -> DataFrame:
        node = self.nodes.where(self._at(path))
        got = node.first()
        if got is None:
            raise KeyError(f"{path} does not exist")
        if layer and got["layer"] != layer:
            raise ValueError(f"{path} has layer {got['layer']!r}")
        return node

    def create_or_open(self, path, layer: str = "") -> Directory:
        if self.exists(path):
            self.open(path, layer)
            return self
        return self.create(path, layer)

    def list(self, path=()) -> DataFrame:
        return self.nodes.where(self._under(path) & (F.size("path") == len(path) + 1)).select(F.element_at("path", -1).alias("name"))

    def move(self, old, new) -> Directory:
        """The node and all below it under another path; prefixes stay."""
        if list(new[: len(old)]) == list(old):
            raise ValueError("a directory cannot be moved below itself")
        if not self.exists(old) or not self.exists(new[:-1]):
            raise KeyError("the source or the new parent does not exist")
        if self.exists(new):
            raise ValueError(f"{new} exists")
        if self._partition_of(old) != self._partition_of(new):
            raise ValueError("directories cannot be moved between partitions")
        moved = F.concat(F.array(*[F.lit(p) for p in new]), F.expr(f"slice(path, {len(old) + 1}, size(path))"))
        return Directory(self.nodes.withColumn("path", F.when(self._under(old), moved).otherwise(F.col("path"))))

    def _partition_of(self, path):
        above = self.nodes.where(F.col("is_partition") & (F.size("path") < len(path)))
        starts = F.array(*[F.array(*[F.lit(q) for q in path[:k]]) for k in range(1, len(path))]) if len(path) > 1 else None
        if starts is None:
            return None
        got = above.where(F.array_position(starts, F.col("path")) > 0).agg(F.max(F.struct(F.size("path").alias("n"), "prefix"))).first()[0]
        return got and got["prefix"]

    def remove(self, path) -> Directory:
        if not self.exists(path):
            raise KeyError(f"{path} does not exist")
        return self.remove_if_exists(path)

    def remove_if_exists(self, path) -> Directory:
        return Directory(self.nodes.where(~self._under(path)))


def publish(tree: Directory, contents: DataFrame, path, rows: DataFrame) -> tuple[Directory, DataFrame]:
    """Rows written to a new directory that then stands in for the one at ``path``: readers through the path see the old rows or the new.

    ``contents`` holds (prefix, key, value) of all directories, ``rows`` the (key, value) of the new one. What stood at the path goes.
    """
    beside = [*path[:-1], f"{path[-1]}_new"]
    tree = tree.create(beside)
    prefix = tree.open(beside).first()["prefix"]
    contents = contents.unionByName(rows.select(F.lit(prefix).cast("bigint").alias("prefix"), "key", "value"))
    if tree.exists(path):
        gone = tree.nodes.where(tree._under(path)).select("prefix")
        contents = contents.join(gone, "prefix", "left_anti")
        tree = tree.remove(path)
    return tree.move(beside, path), contents


def read_through(tree: Directory, contents: DataFrame, path) -> DataFrame:
    """(key, value) of the directory that a path names now."""
    return contents.where(F.col("prefix") == tree.open(path).first()["prefix"]).select("key", "value")


def allocate(df: DataFrame, out: str = "prefix", taken: int = -1) -> DataFrame:
    """Rows with prefixes that are unique and above ``taken``; no order among rows is needed, so there is no shuffle."""
    return df.withColumn(out, F.monotonically_increasing_id() + F.lit(taken + 1))
