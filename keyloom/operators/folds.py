"""Atomic mutations as aggregates, and the ordered fold where order matters.

Operands are byte strings. With equal widths every associative mutation is a built-in
aggregate over numbers, so that partial sums are made before the shuffle. Mixed
widths and the mutations that are not associative are folded in commit order.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from keyloom.functions.keys import VALUE_LIMIT, reversed_bytes, reversed_hex

#: Mutations that may be folded in any order (the others need commit order).
ASSOCIATIVE = frozenset({"add", "and", "or", "xor", "max", "min", "byte_max", "byte_min"})


# ---- partial aggregates over numbers of one width -------------------------------


def add_wrapped(x: Column, width: int = 8) -> Column:
    """Sum modulo 2^(8 * width), as an unsigned decimal(20, 0); plain sums of bigint would overflow."""
    top = F.lit(str(1 << 8 * width)).cast("decimal(38,0)")
    return F.pmod(F.sum(x.cast("decimal(20,0)")).cast("decimal(38,0)"), top).cast("decimal(20,0)")


def fold_numbers(log: DataFrame, key: list[str], operand: str, kinds: list[str], width: int = 8) -> DataFrame:
    """One row for each key with the fold of its operands (bigint) under each of ``kinds``."""
    x = F.col(operand)
    made = {"add": add_wrapped(x, width), "and": F.bit_and(x), "or": F.bit_or(x), "xor": F.bit_xor(x), "max": F.max(x), "min": F.min(x)}
    return log.groupBy(*key).agg(*[made[k].alias(f"fold_{k}") for k in kinds])


def fold_bytes(log: DataFrame, key: list[str], operand: str) -> DataFrame:
    """Byte-wise and little-endian extremes of binary operands of one width."""
    x = F.col(operand)
    return log.groupBy(*key).agg(
        F.max(x).alias("byte_max"), F.min(x).alias("byte_min"), reversed_bytes(F.max(reversed_bytes(x))).alias("max"), reversed_bytes(F.min(reversed_bytes(x))).alias("min")
    )


# ---- one mutation on a value --------------------------------------------------


def _fit(value: bytes, width: int) -> bytes:
    return value[:width].ljust(width, b"\x00")


def _number(value: bytes) -> int:
    return int.from_bytes(value, "little")


def apply_mutation(kind: str, old: bytes | None, operand: bytes) -> bytes | None:
    """The value after one mutation; None is absent. The operand's width is the result's."""
    width = len(operand)
    match kind:
        case "set":
            return operand
        case "clear":
            return None
        case "compare_and_clear":
            return None if old is None or old == operand else old
        case "append_if_fits":
            joined = (old or b"") + operand
            return joined if len(joined) <= VALUE_LIMIT else old
    if old is None:
        return operand
    if kind == "byte_max":
        return max(old, operand)
    if kind == "byte_min":
        return min(old, operand)
    if not width:
        return operand
    a, b = _number(_fit(old, width)), _number(operand)
    if kind == "add" and not old:
        return operand
    number = {"add": a + b, "and": a & b, "or": a | b, "xor": a ^ b, "max": max(a, b), "min": min(a, b)}[kind]
    return (number % (1 << 8 * width)).to_bytes(width, "little")


def apply_legacy(kind: str, old: bytes | None, operand: bytes) -> bytes | None:
    """The earlier forms of ``and`` and ``min``, which read an absent value as zeros."""
    return apply_mutation(kind, b"" if old is None and kind in ("and", "min") else old, operand)


def fold(mutations: Iterable[tuple[str, bytes]], start: bytes | None = None, step: Callable = apply_mutation) -> bytes | None:
    value = start
    for kind, operand in mutations:
        value = step(kind, value, operand)
    return value


def ordered_fold(log: DataFrame, key: list[str], order: list[str], kind: str = "kind", operand: str = "operand", upto: Column | None = None) -> DataFrame:
    """key, value after all mutations in commit order; keys that end absent have no row.

    What came before the last set or clear of a key cannot matter and is dropped first, by one aggregate, so
    that a key's list starts there. Keys follow one another, in order, through one Python function a task.
    """
    rows = log if upto is None else log.where(upto)
    at = F.struct(*order)
    reset = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.max(F.when(F.col(kind).isin("set", "clear"), at)).alias("_reset"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    live = rows.join(reset, on).where(F.col("_reset").isNull() | (at >= F.col("_reset"))).select(*key, *order, F.col(kind).alias("kind"), F.col(operand).alias("operand"))
    schema = log.select(*key).schema
    names = [f.name for f in schema]

    kinds = [to_arrow_type(f.dataType) for f in schema]

    def batch(keys: list[tuple], values: list[bytes]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.binary())], names=[*names, "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, value, keys, values = None, None, [], []
        for record in batches:
            for *own, mutation, x in zip(*[c.to_pylist() for c in record.columns], strict=True):
                if now is None or not _same(own, now):
                    if value is not None:
                        keys.append(now)
                        values.append(value)
                    now, value = own, None
                value = apply_mutation(mutation, value, b"" if x is None else x)
            if keys:
                yield batch(keys, values)
                keys, values = [], []
        if value is not None:
            yield batch([now], [value])

    ordered = live.repartition(*key).sortWithinPartitions(*key, *order).select(*key, "kind", "operand")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return ordered.mapInArrow(run, f"{fields}, value binary")


def _same(a: list, b: list) -> bool:
    """Whether two keys are one, NaN being equal to itself."""
    return a == b or all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def last_writer(log: DataFrame, key: list[str], order: list[str], value: str, cleared: Column) -> DataFrame:
    """Present keys with their last value: one aggregate, no sort."""
    state = log.groupBy(*key).agg(F.max_by(F.struct(F.col(value).alias("v"), cleared.alias("gone")), F.struct(*order)).alias("_s"))
    return state.where(~F.col("_s.gone")).select(*key, F.col("_s.v").alias(value))


# ---- versionstamps --------------------------------------------------------------


def stamp(version: Column, batch: Column) -> Column:
    """Ten big-endian bytes: commit version and place in its batch."""
    return F.unhex(F.concat(F.lpad(F.hex(version), 16, "0"), F.lpad(F.hex(batch.cast("bigint")), 4, "0")))


def place_stamp(template: Column, version: Column, batch: Column) -> Column:
    """A template whose last four bytes are a little-endian offset, with the stamp put there; an offset that does not fit raises."""
    body = F.substr(template, F.lit(1), F.octet_length(template) - 4)
    offset = F.conv(reversed_hex(F.substr(template, F.octet_length(template) - 3, F.lit(4))), 16, 10).cast("bigint")
    fits = (F.octet_length(template) >= 4) & (offset + 10 <= F.octet_length(body))
    placed = F.overlay(body, stamp(version, batch), (offset + 1).cast("int"), F.lit(10))
    return F.when(fits, placed).otherwise(F.raise_error(F.lit("versionstamp offset outside the template")).cast("binary"))


def unstamped_range(template: bytes) -> tuple[bytes, bytes]:
    """Keys a stamped key may take, which cannot be read before the commit: its stamp all zeros to all ones."""
    body, (at,) = template[:-4], struct.unpack("<I", template[-4:])
    if at + 10 > len(body):
        raise ValueError("versionstamp offset outside the template")
    return body[:at] + b"\x00" * 10 + body[at + 10 :], body[:at] + b"\xff" * 10 + body[at + 10 :] + b"\x00"
