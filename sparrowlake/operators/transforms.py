"""Partition transforms, as Spark columns and on single values for pruning.

Identity, truncate, temporal and void are built-in expressions. Bucket is a 32-bit Murmur3 hash with seed 0 over fixed
byte encodings, which differs from Spark's own hash; it is composed of built-in bit operations for fixed-width
values and falls back to an Arrow function for strings, binaries and decimals.
"""

from __future__ import annotations

import datetime as dt
import math
import re
import struct
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = dt.datetime(1970, 1, 1)
MASK = 0xFFFFFFFF


def murmur3(data: bytes) -> int:
    """32-bit Murmur3 (x86 variant) with seed 0, as a signed number."""
    h, n = 0, len(data)

    def scramble(k: int) -> int:
        k = k * 0xCC9E2D51 & MASK
        k = (k << 15 | k >> 17) & MASK
        return k * 0x1B873593 & MASK

    whole = n // 4 * 4
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        h ^= scramble(k)
        h = (h << 13 | h >> 19) & MASK
        h = (h * 5 + 0xE6546B64) & MASK
    if n > whole:
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= n
    h = (h ^ h >> 16) * 0x85EBCA6B & MASK
    h = (h ^ h >> 13) * 0xC2B2AE35 & MASK
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def _twos_complement(n: int) -> bytes:
    return n.to_bytes(((n if n >= 0 else ~n).bit_length() + 8) // 8, "big", signed=True)


def micros(value: dt.datetime) -> int:
    if value.tzinfo:
        value = value.astimezone(dt.UTC).replace(tzinfo=None)
    return (value - EPOCH) // dt.timedelta(microseconds=1)


def days(value: dt.date) -> int:
    return (value - EPOCH.date()).days


def bucket_bytes(value: Any) -> bytes:
    """What is hashed: 8 little-endian bytes for integers, dates and times; text in UTF-8; decimals' unscaled bytes."""
    if isinstance(value, bool):
        raise TypeError("booleans have no bucket")
    if isinstance(value, int):
        return struct.pack("<q", value)
    if isinstance(value, str):
        return value.encode()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, Decimal):
        return _twos_complement(int(value.scaleb(-value.as_tuple().exponent)))
    if isinstance(value, dt.datetime):
        return struct.pack("<q", micros(value))
    if isinstance(value, dt.date):
        return struct.pack("<q", days(value))
    raise TypeError(f"no bucket for {type(value).__name__}")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: an expression that is used twice would otherwise be copied."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _low(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK).cast("long"))


def _times(c: Column, k: int) -> Column:
    """c * k in 32 bits; products are split so that they stay under 2**63."""
    return _let(c, lambda x: _low(x * (k & 0xFFFF) + F.shiftleft((x * (k >> 16)).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)))


def _rotated(c: Column, n: int) -> Column:
    return _let(c, lambda x: _low(F.shiftleft(x, n)).bitwiseOR(F.shiftright(x, 32 - n)))


def _folded(c: Column, n: int) -> Column:
    return _let(c, lambda x: x.bitwiseXOR(F.shiftright(x, n)))


def _hash_long(value: Column) -> Column:
    """murmur3 of a long's 8 bytes by built-in operations."""

    def hashed(v: Column) -> Column:
        h = F.lit(0).cast("long")
        for part in (_low(v), _low(F.shiftrightunsigned(v, 32))):
            k = _times(_rotated(_times(part, 0xCC9E2D51), 15), 0x1B873593)
            h = _low(_times(_rotated(h.bitwiseXOR(k), 13), 5) + 0xE6546B64)
        h = _folded(h.bitwiseXOR(F.lit(8).cast("long")), 16)
        return _folded(_times(_folded(_times(h, 0x85EBCA6B), 13), 0xC2B2AE35), 16)

    return _let(value.cast("long"), hashed)


@dataclass(frozen=True)
class Transform:
    """identity, bucket[N], truncate[W], year, month, day, hour or void."""

    kind: str
    width: int = 0

    @classmethod
    def parse(cls, text: str) -> Transform:
        if m := re.fullmatch(r"(bucket|truncate)\[(\d+)\]", text):
            if int(m[2]) < 1:
                raise ValueError(f"width must be positive: {text}")
            return cls(m[1], int(m[2]))
        if text in ("identity", "year", "month", "day", "hour", "void"):
            return cls(text)
        raise ValueError(f"unknown transform: {text}")

    def __str__(self) -> str:
        return f"{self.kind}[{self.width}]" if self.width else self.kind

    @property
    def keeps_order(self) -> bool:
        return self.kind not in ("bucket", "void")

    def result_type(self, source: str) -> str:
        return {"bucket": "int", "year": "int", "month": "int", "day": "int", "hour": "int"}.get(self.kind, source)

    def apply(self, value: Any) -> Any:
        """On one Python value; null gives null."""
        if value is None or self.kind == "void":
            return None
        if self.kind == "identity":
            return value
        if self.kind == "bucket":
            return (murmur3(bucket_bytes(value)) & 0x7FFFFFFF) % self.width
        if self.kind == "truncate":
            if isinstance(value, (str, bytes)):
                return value[: self.width]
            if isinstance(value, Decimal):
                exponent = value.as_tuple().exponent
                unscaled = int(value.scaleb(-exponent))
                return Decimal(unscaled - unscaled % self.width).scaleb(exponent)
            return value - value % self.width
        when = value if isinstance(value, dt.datetime) else dt.datetime(value.year, value.month, value.day)
        since = micros(when)
        if self.kind == "year":
            return when.year - 1970
        if self.kind == "month":
            return (when.year - 1970) * 12 + when.month - 1
        return math.floor(since / 86_400_000_000) if self.kind == "day" else since // 3_600_000_000

    def column(self, source: Column, source_type: str) -> Column:
        if self.kind == "identity":
            return source
        if self.kind == "void":
            return F.lit(None).cast("string")
        if self.kind == "bucket":
            if source_type in ("int", "long", "time"):
                number = source
            elif source_type == "date":
                number = F.unix_date(source)
            elif source_type in ("timestamp", "timestamptz"):
                number = F.unix_micros(source.cast("timestamp")) if source_type == "timestamptz" else _ntz_micros(source)
            else:
                return _bucket_udf(self.width)(source)
            return F.when(source.isNotNull(), (_hash_long(number).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")) % self.width).cast("int"))
        if self.kind == "truncate":
            if source_type == "string":
                return F.substring(source, 1, self.width)
            if source_type == "binary":
                return F.substring(source, 1, self.width)
            if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", source_type):
                unit = F.lit(Decimal(self.width).scaleb(-int(m[2])))
                return (source - F.pmod(source, unit)).cast(source_type)
            return (source - F.pmod(source, F.lit(self.width))).cast("int" if source_type == "int" else "long")
        if self.kind == "year":
            return F.year(source) - 1970
        if self.kind == "month":
            return (F.year(source) - 1970) * 12 + F.month(source) - 1
        if self.kind == "day":
            return F.unix_date(source.cast("date"))
        return F.floor(_ntz_micros(source) / F.lit(3_600_000_000)).cast("int") if source_type == "timestamp" else F.floor(F.unix_micros(source) / F.lit(3_600_000_000)).cast("int")


def _ntz_micros(source: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, whatever the session's zone."""
    return F.unix_date(source.cast("date")).cast("long") * 86_400_000_000 + (
        F.hour(source).cast("long") * 3_600_000_000 + F.minute(source).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), source) * 1_000_000).cast("long")
    )


def _bucket_udf(width: int):  # noqa: ANN202
    @F.pandas_udf("int")
    def bucket(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or v is pd.NaT else (murmur3(bucket_bytes(v)) & 0x7FFFFFFF) % width).astype("Int32")

    return bucket
