"""Avro object containers: a reader and a writer driven by the schema in the file.

Table manifests are small Avro files (some MB), decoded whole by one task each.
Codecs null, deflate and zstandard are known. Lengths are checked against what
is left of the data before anything is read, so a damaged file is an error and
never a large allocation.
"""

from __future__ import annotations

import io
import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator

MAGIC = b"Obj\x01"


class BadAvro(ValueError):
    """Bytes that are no whole Avro container."""


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or n > len(self.data) - self.at:
            raise BadAvro(f"{n} bytes wanted, {len(self.data) - self.at} left")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        shift = value = 0
        while True:
            if self.at >= len(self.data) or shift > 63:
                raise BadAvro("a number does not end")
            b = self.data[self.at]
            self.at += 1
            value |= (b & 127) << shift
            if b < 128:
                return (value >> 1) ^ -(value & 1)
            shift += 7

    def bytes(self) -> bytes:
        return self.take(self.long())

    def blocks(self) -> Iterator[int]:
        """The numbers of items of an array's or map's blocks; every item takes a byte at least, or has no size at all."""
        while n := self.long():
            if n < 0:
                n = -n
                self.long()
            if n > max(len(self.data) - self.at, 1 << 16):
                raise BadAvro(f"{n} items in {len(self.data) - self.at} bytes")
            yield n


def _reader(schema, named: dict) -> Callable[[_Cursor], object]:
    """A function that decodes one value of a schema."""
    if isinstance(schema, list):
        branches = [_reader(s, named) for s in schema]

        def union(c: _Cursor):
            k = c.long()
            if not 0 <= k < len(branches):
                raise BadAvro(f"branch {k} of {len(branches)}")
            return branches[k](c)

        return union
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return _reader(kind, named)
    if kind == "record":
        fields: list = []

        def record(c: _Cursor):
            return {name: read(c) for name, read in fields}

        named[schema["name"]] = record
        fields += [(f["name"], _reader(f["type"], named)) for f in schema["fields"]]
        return record
    if kind == "array":
        item = _reader(schema["items"], named)
        return lambda c: [item(c) for n in c.blocks() for _ in range(n)]
    if kind == "map":
        value = _reader(schema["values"], named)
        return lambda c: {c.bytes().decode(): value(c) for n in c.blocks() for _ in range(n)}
    if kind == "fixed":
        read = named[schema["name"]] = lambda c, n=schema["size"]: c.take(n)
        return read
    if kind == "enum":
        symbols = schema["symbols"]
        read = named[schema["name"]] = lambda c: symbols[c.long()]
        return read
    plain = {
        "null": lambda c: None,
        "boolean": lambda c: c.take(1) != b"\0",
        "int": _Cursor.long,
        "long": _Cursor.long,
        "float": lambda c: struct.unpack("<f", c.take(4))[0],
        "double": lambda c: struct.unpack("<d", c.take(8))[0],
        "bytes": _Cursor.bytes,
        "string": lambda c: c.bytes().decode(),
    }
    if kind in plain:
        return plain[kind]
    if kind in named:
        return lambda c: named[kind](c)
    raise BadAvro(f"unknown type {kind}")


def _unpacked(codec: str, data: bytes) -> bytes:
    if codec == "null":
        return data
    if codec == "deflate":
        return zlib.decompress(data, -15)
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise BadAvro(f"unknown codec {codec}")


def read(data: bytes) -> tuple[dict[str, bytes], list[dict]]:
    """(metadata, records) of a container."""
    c = _Cursor(data)
    if c.take(4) != MAGIC:
        raise BadAvro("no Avro container")
    meta = {c.bytes().decode(): c.bytes() for n in c.blocks() for _ in range(n)}
    sync = c.take(16)
    record = _reader(json.loads(meta["avro.schema"]), {})
    codec, out = meta.get("avro.codec", b"null").decode(), []
    while c.at < len(data):
        n, block = c.long(), _Cursor(_unpacked(codec, c.bytes()))
        if n < 0 or n > max(len(block.data), 1 << 16):
            raise BadAvro(f"{n} records in {len(block.data)} bytes")
        out += [record(block) for _ in range(n)]
        if c.take(16) != sync:
            raise BadAvro("a block does not end with the marker")
    return meta, out


def _long(out: io.BytesIO, value: int) -> None:
    n = (value << 1) ^ (value >> 63)
    while n > 127:
        out.write(bytes([n & 127 | 128]))
        n >>= 7
    out.write(bytes([n]))


def _write(out: io.BytesIO, schema, value) -> None:
    if isinstance(schema, list):
        k = next(i for i, s in enumerate(schema) if (s == "null") == (value is None))
        _long(out, k)
        return _write(out, schema[k], value)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return _write(out, kind, value)
    if kind == "record":
        for f in schema["fields"]:
            _write(out, f["type"], value.get(f["name"]))
    elif kind in ("array", "map"):
        if value:
            _long(out, len(value))
            for item in value.items() if kind == "map" else value:
                if kind == "map":
                    _write(out, "string", item[0])
                _write(out, schema["values" if kind == "map" else "items"], item[1] if kind == "map" else item)
        _long(out, 0)
    elif kind in ("int", "long"):
        _long(out, value)
    elif kind in ("string", "bytes"):
        data = value.encode() if kind == "string" else value
        _long(out, len(data))
        out.write(data)
    elif kind == "boolean":
        out.write(b"\1" if value else b"\0")
    elif kind in ("float", "double"):
        out.write(struct.pack("<f" if kind == "float" else "<d", value))
    elif kind == "fixed":
        out.write(value)
    elif kind != "null":
        raise BadAvro(f"unknown type {kind}")


def write(schema: dict, records: list[dict], meta: dict[str, str] | None = None, codec: str = "deflate") -> bytes:
    """A container with the records in one block."""
    out, sync = io.BytesIO(), os.urandom(16)
    out.write(MAGIC)
    head = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode(), **{k: v.encode() for k, v in (meta or {}).items()}}
    _write(out, {"type": "map", "values": "bytes"}, head)
    out.write(sync)
    if records:
        body = io.BytesIO()
        for r in records:
            _write(body, schema, r)
        data = body.getvalue()
        if codec == "deflate":
            packer = zlib.compressobj(wbits=-15)
            data = packer.compress(data) + packer.flush()
        _long(out, len(records))
        _long(out, len(data))
        out.write(data)
        out.write(sync)
    return out.getvalue()
