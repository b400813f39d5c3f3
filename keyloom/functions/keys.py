"""Byte-string keys as Columns and as Python values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of keys, values and transactions in bytes.
KEY_LIMIT = 10_000
VALUE_LIMIT = 100_000
TRANSACTION_LIMIT = 10_000_000
#: Selectors that run off either end resolve to these.
FIRST_KEY = b""
END_KEY = b"\xff"


def next_prefix(prefix: bytes) -> bytes:
    """The first key behind all keys that start with ``prefix``."""
    kept = prefix.rstrip(b"\xff")
    if not kept:
        raise ValueError("a prefix must hold a byte other than 0xFF")
    return kept[:-1] + bytes([kept[-1] + 1])


def key_after(key: bytes) -> bytes:
    return key + b"\x00"


def prefix_range(prefix: bytes) -> tuple[bytes, bytes]:
    return prefix, next_prefix(prefix)


def strinc(key: Column) -> Column:
    """``next_prefix`` as a Column; null where there is none."""
    text = F.hex(key)
    kept = F.regexp_replace(text, "(FF)+$", "")  # whole bytes only, as the text has an even length from the start
    aligned = F.when(F.length(kept) % 2 == 0, kept).otherwise(F.concat(kept, F.lit("F")))
    last = F.conv(F.right(aligned, F.lit(2)), 16, 10).cast("int") + 1
    head = F.substr(aligned, F.lit(1), F.length(aligned) - 2)
    return F.when(F.length(aligned) >= 2, F.unhex(F.concat(head, F.lpad(F.hex(last.cast("bigint")), 2, "0"))))


def after(key: Column) -> Column:
    return F.concat(key, F.unhex(F.lit("00")))


def key_between(begin: Column, end: Column, limit: int = KEY_LIMIT) -> Column:
    """The shortest key behind ``begin`` that is not behind ``end``: what both share and one more byte of ``end``; ``end`` itself where ``limit`` bytes are shared."""
    least = F.least(F.octet_length(begin), F.octet_length(end), F.lit(limit))
    lengths = F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>"))
    shared = F.size(F.filter(lengths, lambda n: F.substr(begin, F.lit(1), n) == F.substr(end, F.lit(1), n)))
    return F.when(shared < limit, F.substr(end, F.lit(1), shared + 1)).otherwise(end)


def reversed_hex(value: Column) -> Column:
    """Hexadecimal digits of the bytes in reverse order (``reverse`` reads binary as text)."""
    pairs = F.transform(F.sequence(F.octet_length(value), F.lit(1), F.lit(-1)), lambda i: F.hex(F.substr(value, i, F.lit(1))))
    return F.when(F.octet_length(value) > 0, F.array_join(pairs, "")).otherwise(F.lit(""))


def reversed_bytes(value: Column) -> Column:
    return F.unhex(reversed_hex(value))


def little_endian(value: Column, width: int = 8) -> Column:
    """A bigint as ``width`` little-endian bytes, wrapped like two's complement."""
    return F.unhex(reversed_hex(F.unhex(F.right(F.lpad(F.hex(value), 16, "0"), F.lit(2 * width)))))


def from_little_endian(value: Column, signed: bool = True) -> Column:
    """A bigint from at most eight little-endian bytes; eight bytes are read as signed, fewer as unsigned."""
    digits = F.lpad(reversed_hex(value), 16, "0")
    high = F.conv(F.substr(digits, F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    low = F.conv(F.substr(digits, F.lit(9), F.lit(8)), 16, 10).cast("bigint")
    top = F.when(high >= F.lit(1 << 31), high - F.lit(1 << 32)).otherwise(high) if signed else high
    return top * F.lit(1 << 32) + low


def valid(key: Column, value: Column) -> Column:
    """Whether a pair keeps the size limits."""
    return (F.octet_length(key) <= KEY_LIMIT) & (F.octet_length(value) <= VALUE_LIMIT)
