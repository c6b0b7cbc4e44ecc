"""Where a table's files may lie, and reads that stay there and within a budget of bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import SparkSession

#: The properties that name further folders of a table.
PROPERTIES = ("write.data.path", "write.metadata.path", "write.object-storage.path", "write.folder-storage.path")


class Outside(ValueError):
    """A file outside the table's locations, or a path that may lead there."""


class OverBudget(ValueError):
    """A read beyond the budget of bytes."""


def normalized(location: str) -> str | None:
    """One form for each place: s3a is s3, local paths are file://. None for paths with empty, ``.`` or ``..`` segments."""
    text = location.replace("\\", "/")
    m = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*)://)?(.*)", text, re.S)
    scheme, path = m[1], m[2]
    if scheme is None or scheme == "file":
        scheme, path = "file", (path[5:] if path.startswith("file:") else path).lstrip("/")
    elif scheme == "s3a":
        scheme = "s3"
    parts = path.rstrip("/").split("/")
    return None if any(p in ("", ".", "..") for p in parts) else f"{scheme}://{path}"


def plain_path(location: str) -> str:
    """A local location as an absolute path; others as they are."""
    return re.sub(r"^file:/*", "/", location)


def below(path: str, locations: list[str]) -> bool:
    """Whether a path lies under one of the locations."""
    place = normalized(path)
    roots = [n.rstrip("/") + "/" for x in locations if (n := normalized(x))]
    return place is not None and any(place.startswith(r) for r in roots)


class FileAccess(Protocol):
    """What reads a table's metadata files."""

    def read(self, path: str) -> bytes: ...

    def size(self, path: str) -> int: ...

    def read_range(self, path: str, start: int, length: int) -> bytes: ...


@dataclass
class Memory:
    """Files held in a dictionary."""

    files: dict[str, bytes] = field(default_factory=dict)

    def read(self, path: str) -> bytes:
        return self.files[path]

    def size(self, path: str) -> int:
        return len(self.files[path])

    def read_range(self, path: str, start: int, length: int) -> bytes:
        return self.files[path][start : start + length]


class Hadoop:
    """Any file system Spark reaches. For metadata files; tables are read by ``spark.read``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def size(self, path: str) -> int:
        return self._fs(path).getFileStatus(self._path(path)).getLen()

    def read_range(self, path: str, start: int, length: int) -> bytes:
        stream = self._fs(path).open(self._path(path))
        try:
            stream.seek(start)
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
        finally:
            stream.close()

    def read(self, path: str) -> bytes:
        return self.read_range(path, 0, self.size(path))

    def write(self, path: str, data: bytes) -> None:
        stream = self._fs(path).create(self._path(path), True)
        stream.write(bytearray(data))
        stream.close()


@dataclass
class Confined:
    """Reads below the locations only, and of ``budget`` bytes in all. Checked before a byte is read."""

    files: FileAccess
    locations: list[str]
    budget: int
    used: int = 0

    def _spend(self, path: str, n: int) -> None:
        if not below(path, self.locations):
            raise Outside(path)
        if self.used + n > self.budget:
            raise OverBudget(f"{path}: {n} bytes, {self.budget - self.used} left")
        self.used += n

    def size(self, path: str) -> int:
        self._spend(path, 0)
        return self.files.size(path)

    def read(self, path: str) -> bytes:
        self._spend(path, self.size(path))
        return self.files.read(path)

    def read_range(self, path: str, start: int, length: int) -> bytes:
        self._spend(path, length)
        return self.files.read_range(path, start, length)
