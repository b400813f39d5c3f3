"""The order-preserving tuple encoding: Columns for flat tuples, Python for every type.

Packed keys sort as their tuples do: by type code, then by value.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Sequence
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# Type codes of the encoding.
NULL = 0x00
BYTES = 0x01
STRING = 0x02
NESTED = 0x05
BIG_NEGATIVE = 0x0B
ZERO = 0x14
BIG_POSITIVE = 0x1D
FLOAT = 0x20
DOUBLE = 0x21
FALSE = 0x26
TRUE = 0x27
UUID = 0x30
VERSIONSTAMP = 0x33


class Float32(NamedTuple):
    value: float


class Versionstamp(NamedTuple):
    """Ten bytes of commit order (None while unknown) and two of the writer's own."""

    commit: bytes | None
    user: int = 0


def _flip(raw: bytes, decode: bool = False) -> bytes:
    """Signed floats in unsigned byte order: negative ones inverted, the others with the sign bit set."""
    negative = (raw[0] < 0x80) if decode else (raw[0] >= 0x80)
    return bytes(b ^ 0xFF for b in raw) if negative else bytes([raw[0] ^ 0x80]) + raw[1:]


def _integer(n: int) -> bytes:
    size = (abs(n).bit_length() + 7) // 8
    if size <= 8:
        return bytes([ZERO + (size if n > 0 else -size)]) + (n if n >= 0 else n + (1 << 8 * size) - 1).to_bytes(size, "big")
    if size > 255:
        raise ValueError("integers of over 255 bytes cannot be packed")
    if n > 0:
        return bytes([BIG_POSITIVE, size]) + n.to_bytes(size, "big")
    return bytes([BIG_NEGATIVE, size ^ 0xFF]) + (n + (1 << 8 * size) - 1).to_bytes(size, "big")


def _element(x: Any, nested: bool) -> bytes:
    match x:
        case None:
            return b"\x00\xff" if nested else b"\x00"
        case bool():
            return bytes([TRUE if x else FALSE])
        case bytes() | bytearray():
            return bytes([BYTES]) + bytes(x).replace(b"\x00", b"\x00\xff") + b"\x00"
        case str():
            return bytes([STRING]) + x.encode().replace(b"\x00", b"\x00\xff") + b"\x00"
        case int():
            return _integer(x)
        case Float32():
            return bytes([FLOAT]) + _flip(struct.pack(">f", x.value))
        case float():
            return bytes([DOUBLE]) + _flip(struct.pack(">d", x))
        case uuid.UUID():
            return bytes([UUID]) + x.bytes
        case Versionstamp():
            return bytes([VERSIONSTAMP]) + (x.commit or b"\xff" * 10) + x.user.to_bytes(2, "big")
        case tuple() | list():
            return bytes([NESTED]) + b"".join(_element(y, True) for y in x) + b"\x00"
    raise TypeError(f"{type(x).__name__} cannot be packed")


def pack(items: Sequence, prefix: bytes = b"") -> bytes:
    return prefix + b"".join(_element(x, False) for x in items)


def pack_with_versionstamp(items: Sequence, prefix: bytes = b"") -> bytes:
    """The packed tuple, whose one incomplete versionstamp is marked by its offset as four little-endian bytes at the end."""
    out, at = prefix, None
    for x in items:
        for place in _open_stamps(x):
            if at is not None:
                raise ValueError("more than one incomplete versionstamp")
            at = len(out) + place
        out += _element(x, False)
    if at is None:
        raise ValueError("no incomplete versionstamp")
    return out + at.to_bytes(4, "little")


def _open_stamps(x: Any) -> list[int]:
    """Where incomplete stamps begin inside the element's bytes."""
    if isinstance(x, Versionstamp):
        return [1] if x.commit is None else []
    if isinstance(x, tuple | list):
        out, at = [], 1
        for y in x:
            out += [at + p for p in _open_stamps(y)]
            at += len(_element(y, True))
        return out
    return []


def unpack(key: bytes, skip: int = 0) -> tuple:
    items, at = _read(key, skip, False)
    return tuple(items)


def _terminated(key: bytes, at: int) -> tuple[bytes, int]:
    end = key.find(b"\x00", at)
    while end >= 0 and key[end + 1 : end + 2] == b"\xff":
        end = key.find(b"\x00", end + 2)
    if end < 0:
        raise ValueError("an element has no end")
    return key[at:end].replace(b"\x00\xff", b"\x00"), end + 1


def _read(key: bytes, at: int, nested: bool) -> tuple[list, int]:
    out: list = []
    while at < len(key):
        code = key[at]
        at += 1
        if code == NULL:
            if nested and key[at : at + 1] != b"\xff":
                return out, at
            at += nested
            out.append(None)
        elif code in (BYTES, STRING):
            raw, at = _terminated(key, at)
            out.append(raw if code == BYTES else raw.decode())
        elif code == NESTED:
            inner, at = _read(key, at, True)
            out.append(tuple(inner))
        elif ZERO - 8 <= code <= ZERO + 8:
            size = abs(code - ZERO)
            n = int.from_bytes(key[at : at + size], "big")
            out.append(n if code >= ZERO else n - (1 << 8 * size) + 1)
            at += size
        elif code in (BIG_POSITIVE, BIG_NEGATIVE):
            size = key[at] ^ (0xFF if code == BIG_NEGATIVE else 0)
            n = int.from_bytes(key[at + 1 : at + 1 + size], "big")
            out.append(n if code == BIG_POSITIVE else n - (1 << 8 * size) + 1)
            at += 1 + size
        elif code == FLOAT:
            out.append(Float32(struct.unpack(">f", _flip(key[at : at + 4], True))[0]))
            at += 4
        elif code == DOUBLE:
            out.append(struct.unpack(">d", _flip(key[at : at + 8], True))[0])
            at += 8
        elif code in (FALSE, TRUE):
            out.append(code == TRUE)
        elif code == UUID:
            out.append(uuid.UUID(bytes=key[at : at + 16]))
            at += 16
        elif code == VERSIONSTAMP:
            out.append(Versionstamp(key[at : at + 10], int.from_bytes(key[at + 10 : at + 12], "big")))
            at += 12
        else:
            raise ValueError(f"unknown type code {code:#x}")
    if nested:
        raise ValueError("a nested tuple has no end")
    return out, at


def tuple_range(items: Sequence, prefix: bytes = b"") -> tuple[bytes, bytes]:
    """All keys that extend the tuple by an element."""
    p = pack(items, prefix)
    return p + b"\x00", p + b"\xff"


def compare(a: Sequence, b: Sequence) -> int:
    x, y = pack(a), pack(b)
    return (x > y) - (x < y)


# ---- Columns -----------------------------------------------------------------


def packed_long(c: Column) -> Column:
    """bigint or smaller."""
    c = c.cast("bigint")
    digits = F.when(c >= 0, F.hex(c)).otherwise(F.hex(F.when(c == F.lit(-(1 << 63)), c).otherwise(-c)))
    size = F.ceil(F.length(digits) / 2).cast("int")
    positive = F.concat(F.lpad(F.hex((ZERO + size).cast("bigint")), 2, "0"), F.lpad(digits, 2 * size, F.lit("0")))
    # n + 256^size - 1 is n - 1 modulo 256^size: the low digits of its two's complement
    low = F.bitwise_not(F.when((c < 0) & (c > F.lit(-(1 << 63))), -c).otherwise(F.lit(0)))
    below = F.when(c == F.lit(-(1 << 63)), F.lit("7FFFFFFFFFFFFFFF")).otherwise(F.right(F.hex(low), 2 * size))
    negative = F.concat(F.lpad(F.hex((ZERO - size).cast("bigint")), 2, "0"), below)
    return F.unhex(F.when(c == 0, F.lit("14")).when(c > 0, positive).when(c < 0, negative).otherwise(F.lit("00")))


def packed_string(c: Column) -> Column:
    parts = F.transform(F.split(c, "\x00"), lambda p: F.hex(F.encode(p, "UTF-8")))
    return F.unhex(F.coalesce(F.concat(F.lit("02"), F.array_join(parts, "00FF"), F.lit("00")), F.lit("00")))


def packed_bytes(c: Column) -> Column:
    parts = F.transform(F.split(F.decode(c, "ISO-8859-1"), "\x00"), lambda p: F.hex(F.encode(p, "ISO-8859-1")))
    return F.unhex(F.coalesce(F.concat(F.lit("01"), F.array_join(parts, "00FF"), F.lit("00")), F.lit("00")))


def packed_bool(c: Column) -> Column:
    return F.unhex(F.when(c, F.lit("27")).when(~c, F.lit("26")).otherwise(F.lit("00")))


@F.pandas_udf(BinaryType())
def packed_double(c: pd.Series) -> pd.Series:
    """Spark has no raw bits of a double; -0.0 and NaN keep their place in the total order."""
    return c.map(lambda x: b"\x00" if x is None else _element(float(x), False))


@F.pandas_udf(StringType())
def unpacked_text(key: pd.Series) -> pd.Series:
    """Any packed tuple as text, for keys of mixed types."""
    return key.map(lambda k: None if k is None else repr(unpack(bytes(k))))


def packed(*columns: tuple[Column, str]) -> Column:
    """A packed tuple from (Column, kind) with kind long, string, bytes, bool or double."""
    kinds = {"long": packed_long, "string": packed_string, "bytes": packed_bytes, "bool": packed_bool, "double": packed_double}
    return F.concat(*[kinds[k](c) for c, k in columns])


class Subspace:
    """Keys under a packed prefix."""

    def __init__(self, items: Sequence = (), raw: bytes = b""):
        self.raw = pack(items, raw)

    def __getitem__(self, item) -> Subspace:
        return Subspace((item,), self.raw)

    @property
    def key(self) -> bytes:
        return self.raw

    def pack(self, items: Sequence = ()) -> bytes:
        return pack(items, self.raw)

    def pack_with_versionstamp(self, items: Sequence) -> bytes:
        return pack_with_versionstamp(items, self.raw)

    def unpack(self, key: bytes) -> tuple:
        if not self.contains(key):
            raise ValueError("the key is outside the subspace")
        return unpack(key, len(self.raw))

    def range(self, items: Sequence = ()) -> tuple[bytes, bytes]:
        return tuple_range(items, self.raw)

    def contains(self, key: bytes) -> bool:
        return key.startswith(self.raw)

    def holds(self, key: Column) -> Column:
        return F.substring(key, 1, len(self.raw)) == F.lit(self.raw)

    def packed(self, *columns: tuple[Column, str]) -> Column:
        return F.concat(F.lit(self.raw), packed(*columns))
