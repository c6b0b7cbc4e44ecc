"""Order-preserving key bytes: a version byte, then per column tag, NULL marker and value."""

from __future__ import annotations

import datetime
import decimal
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = -9223372036854775808


def part(c: Column, kind: str) -> Column:
    """Hex of one column.

    ``kind`` is integer, string, date, boolean, timestamp, timestamptz, binary,
    uuid (16 bytes or the usual text), nanos or nanostz (long nanoseconds since
    1970) or decimal:scale. Decimals and nanoseconds take 128 bits.
    """
    if kind.startswith("decimal:"):
        scale = int(kind[8:])
        tag = f"03{scale:02X}"
        return F.when(c.isNull(), f"{tag}00").otherwise(F.concat(F.lit(f"{tag}01"), _unscaled(c, scale)))
    tag, value = {
        "boolean": lambda: ("01", F.when(c, "01").otherwise("00")),
        "integer": lambda: ("02", F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(SIGN))), 16, "0")),
        "date": lambda: ("04", F.lpad(F.hex(F.unix_date(c).cast("long") + 2147483648), 8, "0")),
        "timestamp": lambda: ("05", _nanos(F.unix_micros(c.cast("timestamp")) * 1000)),
        "string": lambda: ("07", _escaped(F.hex(c))),
        "timestamptz": lambda: ("06", _nanos(F.unix_micros(c.cast("timestamp")) * 1000)),
        "nanos": lambda: ("05", _nanos(c)),
        "nanostz": lambda: ("06", _nanos(c)),
        "binary": lambda: ("08", _escaped(F.hex(c))),
        "uuid": lambda: ("09", F.upper(F.replace(c, F.lit("-"), F.lit("")))),
    }[kind]()
    return F.when(c.isNull(), f"{tag}00").otherwise(F.concat(F.lit(f"{tag}01"), value))


def _nanos(n: Column) -> Column:
    """128 bits from 64: years 1678 to 2262."""
    return F.concat(F.when(n >= 0, "8000000000000000").otherwise("7FFFFFFFFFFFFFFF"), F.lpad(F.hex(n), 16, "0"))


def _unscaled(c: Column, scale: int) -> Column:
    """128 bits of a decimal's unscaled number, in whole-number arithmetic: a high and a low half."""
    number = lambda text: F.lit(text).cast("decimal(38,0)")
    two64, two32 = number(str(1 << 64)), number(str(1 << 32))
    n = F.replace(c.cast(f"decimal(38,{scale})").cast("string"), F.lit("."), F.lit("")).cast("decimal(38,0)")
    cut = F.call_function("div", n, two64)  # towards zero
    rest = n - cut.cast("decimal(20,0)") * two64.cast("decimal(20,0)")
    high = F.when(rest < 0, cut - 1).otherwise(cut).bitwiseXOR(F.lit(SIGN))
    low = F.when(rest < 0, rest + two64).otherwise(rest).cast("decimal(38,0)")
    upper = F.call_function("div", low, two32)
    lower = (low - upper.cast("decimal(20,0)") * two32.cast("decimal(20,0)")).cast("long")
    return F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(upper), 8, "0"), F.lpad(F.hex(lower), 8, "0"))


_WIDE = decimal.Context(prec=76)


def _escaped(text: Column) -> Column:
    """Zero bytes are followed by FF; two zero bytes end the value."""
    pairs = F.regexp_replace(text, "(..)", "$1-")
    return F.concat(F.replace(F.replace(pairs, F.lit("00-"), F.lit("00FF-")), F.lit("-"), F.lit("")), F.lit("0000"))


def key_hex(columns: list[tuple[Column, str]]) -> Column:
    """Hex of a key tuple's encoding; ``unhex`` gives bytes in key order."""
    return reduce(lambda a, b: F.concat(a, b), [part(c, kind) for c, kind in columns], F.lit("01"))


class BadKey(ValueError):
    """Bytes that are not the one encoding of a key tuple."""


def _unescape(data: bytes, at: int) -> tuple[bytes, int]:
    out = bytearray()
    while True:
        zero = data.find(0, at)
        if zero < 0 or zero + 1 >= len(data):
            raise BadKey("a value does not end")
        out += data[at:zero]
        if data[zero + 1] == 0:
            return bytes(out), zero + 2
        if data[zero + 1] != 255:
            raise BadKey("a zero byte is not escaped")
        out.append(0)
        at = zero + 2


#: Bytes of a value by type tag; tags 7 and 8 have values that end with two zero bytes.
WIDTHS = {1: 1, 2: 8, 3: 16, 4: 4, 5: 16, 6: 16, 9: 16}
EPOCH = datetime.date(1970, 1, 1)


def decode(data: bytes) -> list[tuple[int, object]]:
    """(type tag, value) of each column of a key; anything but a canonical key is an error.

    Timestamps are nanoseconds since 1970, decimals are exact, NULL is None.
    """
    if len(data) < 2 or data[0] != 1:
        raise BadKey("empty, or of another version")
    out, at = [], 1
    while at < len(data):
        tag, scale = data[at], 0
        at += 1
        if tag not in WIDTHS and tag not in (7, 8):
            raise BadKey(f"unknown tag {tag}")
        if tag == 3:
            scale, at = (data[at : at + 1] or b"\xff")[0], at + 1
            if scale > 38:
                raise BadKey("a decimal's scale")
        if data[at : at + 1] not in (b"\0", b"\1"):
            raise BadKey("NULL marker")
        there, at = data[at], at + 1
        if not there:
            out.append((tag, None))
            continue
        if tag in (7, 8):
            raw, at = _unescape(data, at)
        else:
            raw, at = data[at : at + WIDTHS[tag]], at + WIDTHS[tag]
            if len(raw) != WIDTHS[tag]:
                raise BadKey("a value is cut off")
        out.append((tag, _value(tag, scale, raw)))
    return out


def _value(tag: int, scale: int, raw: bytes):
    number = int.from_bytes(raw, "big") - (1 << 8 * max(len(raw), 1) - 1)
    if tag == 1:
        if raw not in (b"\0", b"\1"):
            raise BadKey("a boolean's byte")
        return raw == b"\1"
    if tag == 3:
        if abs(number) >= 10**38:
            raise BadKey("a decimal of more than 38 digits")
        return decimal.Decimal(number).scaleb(-scale, _WIDE)
    if tag == 4:
        try:
            return EPOCH + datetime.timedelta(days=number)
        except OverflowError:
            return number  # days since 1970 outside of the calendar that Python knows
    if tag == 7:
        try:
            return raw.decode()
        except UnicodeDecodeError as e:
            raise BadKey("a string is no UTF-8") from e
    if tag == 9:
        return uuid.UUID(bytes=raw)
    return raw if tag == 8 else number


def decoded():
    """A vectorised function from encoded keys to their values as text, NULL for NULL; null for bytes that are no key."""

    def one(data):
        try:
            return None if data is None else [None if v is None else v.hex() if isinstance(v, bytes) else str(v).lower() if isinstance(v, bool) else str(v) for _, v in decode(bytes(data))]
        except BadKey:
            return None

    @F.pandas_udf("array<string>")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(one)

    return texts
