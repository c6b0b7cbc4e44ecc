"""Deletion vector blobs: length, magic, a 64-bit Roaring bitmap, CRC-32."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The blob's magic bytes and the Roaring formats' cookies.
MAGIC = bytes([0xD1, 0xD3, 0x39, 0x64])
PLAIN, WITH_RUNS = 12346, 12347


class BadVector(ValueError):
    """A blob that does not hold what it says."""


def encode(positions) -> bytes:
    """A blob of sorted distinct positions, in array and bitmap containers."""
    values = np.unique(np.asarray(list(positions), np.uint64))
    highs = np.unique(values >> np.uint64(32))
    body = struct.pack("<Q", len(highs))
    for high in highs:
        low = (values[values >> np.uint64(32) == high] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        keys = np.unique(low >> 16)
        parts = [(low[low >> 16 == k] & 0xFFFF).astype("<u2") for k in keys]
        heads = b"".join(struct.pack("<HH", k, len(p) - 1) for k, p in zip(keys, parts, strict=True))
        data = [p.tobytes() if len(p) <= 4096 else np.packbits(np.isin(np.arange(65536), p), bitorder="little").tobytes() for p in parts]
        at = 8 + len(heads) + 4 * len(keys)
        offsets = b""
        for d in data:
            offsets += struct.pack("<I", at)
            at += len(d)
        body += struct.pack("<III", int(high), PLAIN, len(keys)) + heads + offsets + b"".join(data)
    body = MAGIC + body
    return struct.pack(">I", len(body)) + body + struct.pack(">I", zlib.crc32(body))


def _bitmap(data: memoryview, at: int) -> tuple[np.ndarray, int]:
    (cookie,) = struct.unpack_from("<I", data, at)
    runs = np.zeros(0, bool)
    if cookie & 0xFFFF == WITH_RUNS:
        size = (cookie >> 16) + 1
        at += 4
        flags = np.frombuffer(data[at : at + (size + 7) // 8], np.uint8)
        runs = np.unpackbits(flags, bitorder="little")[:size].astype(bool)
        at += len(flags)
        offsets = size >= 4
    elif cookie == PLAIN:
        (size,) = struct.unpack_from("<I", data, at + 4)
        at, offsets = at + 8, True
        runs = np.zeros(size, bool)
    else:
        raise BadVector("no Roaring bitmap")
    heads = np.frombuffer(data[at : at + 4 * size], "<u2").reshape(-1, 2)
    if len(heads) != size:
        raise BadVector("the bitmap ends early")
    at += 4 * size + (4 * size if offsets else 0)
    out = []
    for (key, less), run in zip(heads.astype(np.int64), runs, strict=True):
        if run:
            (n,) = struct.unpack_from("<H", data, at)
            pairs = np.frombuffer(data[at + 2 : at + 2 + 4 * n], "<u2").reshape(-1, 2).astype(np.int64)
            low = np.concatenate([np.arange(s, s + k + 1) for s, k in pairs]) if n else np.zeros(0, np.int64)
            at += 2 + 4 * n
        elif less + 1 <= 4096:
            low = np.frombuffer(data[at : at + 2 * (less + 1)], "<u2").astype(np.int64)
            at += 2 * (less + 1)
        else:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(data[at : at + 8192], np.uint8), bitorder="little"))
            at += 8192
        if len(low) != less + 1:
            raise BadVector("a container is not as large as it says")
        out.append(low + (key << 16))
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), at


def decode(blob: bytes) -> np.ndarray:
    """The deleted positions of a blob, ascending; raises ``BadVector`` where anything is off."""
    if len(blob) < 20:
        raise BadVector("the blob is too short")
    (length,) = struct.unpack_from(">I", blob)
    if length != len(blob) - 8:
        raise BadVector("the length is not the blob's")
    body = memoryview(blob)[4:-4]
    if bytes(body[:4]) != MAGIC:
        raise BadVector("wrong magic")
    if zlib.crc32(body) != struct.unpack_from(">I", blob, len(blob) - 4)[0]:
        raise BadVector("wrong checksum")
    try:
        (count,) = struct.unpack_from("<Q", body, 4)
        at, out = 12, []
        for _ in range(count):
            (high,) = struct.unpack_from("<I", body, at)
            low, at = _bitmap(body, at + 4)
            out.append(low + (high << 32))
    except (struct.error, ValueError) as e:
        raise BadVector(str(e)) from e
    if at != len(body):
        raise BadVector("bytes after the bitmaps")
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def positions(blobs: DataFrame, path: str = "path", blob: str = "blob") -> DataFrame:
    """(path, pos) of rows (path, blob)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, b in zip(pdf["path"], pdf["blob"], strict=True):
                pos = decode(bytes(b))
                for s in range(0, len(pos), 100_000):
                    part = pos[s : s + 100_000]
                    yield pd.DataFrame({"path": p, "pos": part})

    return blobs.select(F.col(path).alias("path"), F.col(blob).alias("blob")).mapInPandas(run, "path string, pos long")
