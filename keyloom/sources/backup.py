"""Backup files: range files of pairs and log files of mutations, in blocks.

A block is padded with 0xFF to its size. Numbers are big-endian. A range block holds its
first key, then pairs, then its last key; a log block holds (version, sub, length, mutation) records.
"""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

# File versions and the numbers of mutation types.
RANGE_FILE = 1001
LOG_FILE = 2001
SET = 0
CLEAR_RANGE = 1
PAD = b"\xff"


def encode_range(pairs: list[tuple[bytes, bytes]], begin: bytes, end: bytes, block: int) -> bytes:
    """Pairs in blocks; each names where it begins and ends."""
    chunk = lambda b: struct.pack(">I", len(b)) + b
    out, body, first = [], b"", begin
    for k, v in pairs:
        piece = chunk(k) + chunk(v)
        head = 4 + len(chunk(first))
        if body and head + len(body) + len(piece) + len(chunk(k)) > block:
            out.append((struct.pack(">I", RANGE_FILE) + chunk(first) + body + chunk(k)).ljust(block, PAD))
            body, first = b"", k
        if 4 + len(chunk(first)) + len(piece) + len(chunk(k)) > block:
            raise ValueError("a pair is larger than a block")
        body += piece
    out.append((struct.pack(">I", RANGE_FILE) + chunk(first) + body + chunk(end)).ljust(block, PAD))
    return b"".join(out)


def decode_range(data: bytes) -> tuple[bytes, list[tuple[bytes, bytes]], bytes]:
    """First key, pairs and last key of one block."""
    (kind,) = struct.unpack_from(">I", data)
    if kind != RANGE_FILE:
        raise ValueError(f"file version {kind} is no range file")
    at, parts = 4, []
    while at + 4 <= len(data) and data[at : at + 1] != PAD:
        (n,) = struct.unpack_from(">I", data, at)
        if at + 4 + n > len(data):
            raise ValueError("a part reaches over its block")
        parts.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    if data[at:].strip(PAD):
        raise ValueError("bytes follow the padding")
    if len(parts) % 2:
        raise ValueError("a key has no value")
    inner = parts[1:-1]
    return parts[0], list(zip(inner[::2], inner[1::2], strict=True)), parts[-1]


def encode_log(rows: list[tuple[int, int, int, bytes, bytes]], block: int) -> bytes:
    """(version, sub, type, param1, param2) in blocks."""
    head, out, body = struct.pack(">I", LOG_FILE), [], b""
    for version, sub, kind, a, b in rows:
        mutation = struct.pack(">III", kind, len(a), len(b)) + a + b
        piece = struct.pack(">QII", version, sub, len(mutation)) + mutation
        if len(piece) + 4 > block:
            raise ValueError("a mutation is larger than a block")
        if len(body) + len(piece) + 4 > block:
            out.append((head + body).ljust(block, PAD))
            body = b""
        body += piece
    out.append((head + body).ljust(block, PAD))
    return b"".join(out)


def decode_log(data: bytes) -> list[tuple[int, int, int, bytes, bytes]]:
    (kind,) = struct.unpack_from(">I", data)
    if kind != LOG_FILE:
        raise ValueError(f"file version {kind} is no log file")
    at, out = 4, []
    while at + 16 <= len(data) and data[at : at + 8] != PAD * 8:
        version, sub, size = struct.unpack_from(">QII", data, at)
        mutation, n, m = struct.unpack_from(">III", data, at + 16)
        if size != 12 + n + m:
            raise ValueError("a mutation's lengths do not agree")
        body = at + 28
        out.append((version, sub, mutation, data[body : body + n], data[body + n : body + n + m]))
        at += 16 + size
    return out


def range_files(kv: DataFrame, part: str, block: int) -> DataFrame:
    """(path, content): the binary pairs of each ``part`` (a bounded key range) as one range file."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted((bytes(k), bytes(v)) for k, v in zip(pdf["key"], pdf["value"], strict=True))
        return pd.DataFrame({"path": [str(pdf[part].iloc[0])], "content": [encode_range(pairs, pairs[0][0], pairs[-1][0] + b"\x00", block)]})

    return kv.select(part, "key", "value").groupBy(part).applyInPandas(run, "path string, content binary")


def log_files(log: DataFrame, part: str, block: int) -> DataFrame:
    """(path, content): the mutations (version, sub, type, param1, param2) of each ``part`` (bounded in versions) as one log file."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((int(v), int(s), int(t), bytes(a), bytes(b)) for v, s, t, a, b in zip(*(pdf[c] for c in ("version", "sub", "type", "param1", "param2")), strict=True))
        return pd.DataFrame({"path": [str(pdf[part].iloc[0])], "content": [encode_log(rows, block)]})

    return log.select(part, "version", "sub", "type", "param1", "param2").groupBy(part).applyInPandas(run, "path string, content binary")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of stored files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _blocks(files: DataFrame, block: int) -> DataFrame:
    files = files.where(F.length("content") > 0)
    rows = files.select("path", "content", F.explode(F.sequence(F.lit(0), F.length("content") - 1, F.lit(block))).alias("offset"))
    return rows.select("path", "offset", F.substr("content", F.col("offset") + 1, F.lit(block)).alias("data"))


def _each_block(files: DataFrame, block: int) -> GroupedData:
    """Blocks as groups, so that Python holds one at a time: a batch of thousands of blocks would be larger than a worker's memory.
    A file that is listed twice gives two groups."""
    return _blocks(files, block).withColumn("_n", F.monotonically_increasing_id()).groupBy("path", "offset", "_n")


def read_range(spark: SparkSession, path: str, block: int) -> DataFrame:
    """(key, value, path) of stored range files."""
    return range_pairs(files(spark, path), block)


def range_pairs(files: DataFrame, block: int) -> DataFrame:
    """(key, value, path) of range files (path, content); blocks are decoded in parallel."""

    def run(table: pa.Table) -> pa.Table:
        pairs = decode_range(table["data"][0].as_py())[1]
        path = pa.repeat(table["path"][0], len(pairs))
        return pa.table({"key": pa.array([k for k, _ in pairs], pa.binary()), "value": pa.array([v for _, v in pairs], pa.binary()), "path": path})

    return _each_block(files, block).applyInArrow(run, "key binary, value binary, path string")


def read_log(spark: SparkSession, path: str, block: int) -> DataFrame:
    """(version, sub, type, param1, param2, path) of stored log files."""
    return log_rows(files(spark, path), block)


def log_rows(files: DataFrame, block: int) -> DataFrame:
    """(version, sub, type, param1, param2, path) of log files (path, content)."""

    kinds = {"version": pa.int64(), "sub": pa.int32(), "type": pa.int32(), "param1": pa.binary(), "param2": pa.binary()}

    def run(table: pa.Table) -> pa.Table:
        rows = decode_log(table["data"][0].as_py())
        columns = {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds.items())}
        return pa.table({**columns, "path": pa.repeat(table["path"][0], len(rows))})

    return _each_block(files, block).applyInArrow(run, "version bigint, sub int, type int, param1 binary, param2 binary, path string")


def convert_logs(log: DataFrame) -> DataFrame:
    """(version, mutations): the mutations of all parts of a partitioned log, by version in the order of ``sub``."""
    parts = log.groupBy("version").agg(F.array_sort(F.collect_set(F.struct("sub", "type", "param1", "param2"))).alias("mutations"))
    return parts.withColumn("continuous", F.col("mutations")[F.size("mutations") - 1]["sub"] - F.col("mutations")[0]["sub"] == F.size("mutations") - 1)


def matches(prefixes: list[str] | list[bytes]) -> Column:
    """Whether a mutation touches keys of any prefix: single keys by the prefix, cleared ranges by overlap."""
    from keyloom.functions.keys import next_prefix

    out = F.lit(False)
    for prefix in prefixes:
        end = next_prefix(prefix) if isinstance(prefix, bytes) else prefix[:-1] + chr(ord(prefix[-1]) + 1)
        single = (F.col("type") != CLEAR_RANGE) & (F.col("param1") >= F.lit(prefix)) & (F.col("param1") < F.lit(end))
        ranged = (F.col("type") == CLEAR_RANGE) & (F.col("param1") < F.lit(end)) & (F.col("param2") > F.lit(prefix))
        out = out | single | ranged
    return out


def decode_filter(log: DataFrame, prefix: str | bytes, begin_version: int | None = None, end_version: int | None = None) -> DataFrame:
    """Mutations of a version window that touch keys of a prefix."""
    rows = log.where(matches([prefix]))
    rows = rows if begin_version is None else rows.where(F.col("version") >= begin_version)
    return rows if end_version is None else rows.where(F.col("version") < end_version)
