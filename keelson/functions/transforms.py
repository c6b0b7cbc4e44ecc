"""Partition transforms and the seed-0 murmur3 behind bucket, as columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Constants of murmur3 x86 32.
C1, C2, ADD, F1, F2 = 3432918353, 461845907, 3864292196, 2246822507, 3266489909
LOW = 4294967295


def year(c: Column) -> Column:
    return F.year(c) - 1970


def month(c: Column) -> Column:
    return (F.year(c) - 1970) * 12 + F.month(c) - 1


def day(c: Column) -> Column:
    return F.unix_date(c.cast("date"))


def hour(c: Column) -> Column:
    return F.floor(F.unix_micros(c.cast("timestamp")) / 3600000000).cast("long")


def truncate(c: Column, width: int) -> Column:
    """Down to a multiple of the width, below zero too."""
    return c - F.pmod(c, F.lit(width))


def truncate_text(c: Column, width: int) -> Column:
    return F.substring(c, 1, width)


def _mul(a: Column, k: int) -> Column:
    return (a.bitwiseAND(65535) * k + F.shiftrightunsigned(a, 16).__mul__(F.lit(k)).bitwiseAND(65535) * 65536).bitwiseAND(LOW)


def with_bucket_long(df: DataFrame, column: str, buckets: int, out: str = "bucket") -> DataFrame:
    """``df`` with the bucket of a whole-number, date or timestamp value, by column arithmetic.

    Steps are chained columns, since one nested expression would double at each rotation.
    """

    def rot(name: str, n: int) -> Column:
        c = F.col(name)
        return F.shiftleft(c, n).bitwiseOR(F.shiftrightunsigned(c, 32 - n)).bitwiseAND(LOW)

    value = F.col(column).cast("long")
    d = df.withColumn("_w0", value.bitwiseAND(LOW)).withColumn("_w1", F.shiftrightunsigned(value, 32)).withColumn("_h", F.lit(0).cast("long"))
    for w in ("_w0", "_w1"):
        d = d.withColumn("_k", _mul(F.col(w), C1)).withColumn("_k", rot("_k", 15)).withColumn("_k", _mul(F.col("_k"), C2))
        d = d.withColumn("_h", F.col("_h").bitwiseXOR(F.col("_k"))).withColumn("_h", rot("_h", 13)).withColumn("_h", (F.col("_h") * 5 + ADD).bitwiseAND(LOW))
    d = d.withColumn("_h", F.col("_h").bitwiseXOR(F.lit(8).cast("long")))
    for shift, factor in ((16, F1), (13, F2), (16, None)):
        d = d.withColumn("_h", F.col("_h").bitwiseXOR(F.shiftrightunsigned(F.col("_h"), shift)))
        if factor:
            d = d.withColumn("_h", _mul(F.col("_h"), factor))
    return d.withColumn(out, F.pmod(F.col("_h").bitwiseAND(2147483647), F.lit(buckets))).drop("_w0", "_w1", "_k", "_h")


def murmur3(data: bytes) -> int:
    """Seed 0, 32 bits, signed."""
    h, n = 0, len(data)
    for i in range(0, n - n % 4, 4):
        k = int.from_bytes(data[i : i + 4], "little") * C1 & LOW
        k = (k << 15 | k >> 17) & LOW
        h ^= k * C2 & LOW
        h = ((h << 13 | h >> 19) * 5 + ADD) & LOW
    if n % 4:
        k = int.from_bytes(data[n - n % 4 :], "little") * C1 & LOW
        k = (k << 15 | k >> 17) & LOW
        h ^= k * C2 & LOW
    h ^= n
    h = (h ^ h >> 16) * F1 & LOW
    h = (h ^ h >> 13) * F2 & LOW
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def bucket_text(buckets: int):
    """A vectorised function from strings to buckets; each distinct value of a batch is hashed once."""

    @F.pandas_udf("int")
    def bucket(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            codes, values = pd.factorize(s)
            found = np.array([(murmur3(v.encode()) & 2147483647) % buckets for v in values] + [0])
            yield pd.Series(found[codes]).where(codes >= 0, None).astype("Int32")

    return bucket


def bucket_bytes(buckets: int):
    """A vectorised function from binary values (bytes, or decimals as ``decimal_bytes`` has them) to buckets."""

    @F.pandas_udf("int")
    def bucket(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else (murmur3(bytes(v)) & 2147483647) % buckets).astype("Int32")

    return bucket


def decimal_bytes(scale: int):
    """A vectorised function from decimals to the fewest big-endian bytes of the unscaled number, two's complement."""

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(d):
            if d is None:
                return None
            n = int(d.scaleb(scale))
            return n.to_bytes((n if n >= 0 else ~n).bit_length() // 8 + 1, "big", signed=True)

        for s in batches:
            yield s.map(one)

    return packed


def truncate_decimal(c: Column, width: int, scale: int) -> Column:
    """Down to a multiple of ``width`` units of the last digit."""
    unit = F.lit(width).cast("decimal(20,0)") / F.lit(10**scale).cast("decimal(20,0)")
    return c - F.pmod(c, unit.cast(f"decimal(38,{scale})"))


def truncate_binary(c: Column, width: int) -> Column:
    return F.substring(c, 1, width)


def void(kind: str = "int") -> Column:
    return F.lit(None).cast(kind)


@dataclass(frozen=True)
class Transform:
    name: str
    width: int | None = None


def parse(text: str) -> Transform | None:
    """A transform by its name in table metadata; None for one that is not computed."""
    text = text.strip()
    if text in ("identity", "year", "month", "day", "hour", "void"):
        return Transform(text)
    m = re.fullmatch(r"(bucket|truncate)\[\s*\+?([0-9]+)\s*\]", text)
    return Transform(m[1], int(m[2])) if m and 0 < int(m[2]) < 1 << 32 else None


_WHOLE = frozenset(("int", "bigint"))
_MICROS = frozenset(("timestamp", "timestamp_ntz"))
_NANOS = frozenset(("timestamp_ns", "timestamptz_ns"))
_BYTES = frozenset(("string", "binary", "fixed", "uuid", "decimal"))


def supports(t: Transform, kind: str) -> bool:
    """Whether the transform is computed for a column of a type."""
    base = re.sub(r"[(\[].*", "", kind)
    return {
        "void": True,
        "identity": base in _WHOLE | _MICROS | _NANOS | _BYTES | {"boolean", "date"},
        "bucket": base in _WHOLE | _MICROS | _BYTES | {"date"},
        "truncate": base in _WHOLE | {"decimal", "string", "binary"},
        "hour": base in _MICROS | _NANOS,
    }.get(t.name, base in _MICROS | _NANOS | {"date"})


def computable(spec: list[dict], kinds: dict[int, str]) -> bool:
    """Whether all fields of a partition spec (source-id, transform) are computed from the given fields."""
    found = [(parse(f["transform"]), kinds.get(f["source-id"])) for f in spec]
    return all(t is not None and k is not None and supports(t, k) for t, k in found)


def key_determined(spec: list[dict], kinds: dict[int, str]) -> bool:
    """Whether a key of the given fields fixes the partition: the spec is computed from them and is not void in all fields."""
    return computable(spec, kinds) and any(parse(f["transform"]) != Transform("void") for f in spec)
