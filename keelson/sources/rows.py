"""Rows of data files by field id, with their place in the file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keelson.model import family
from keelson.sources.metadata import BadMetadata

ID = "parquet.field.id"


def _ids(schema: StructType, nested: bool = False) -> list[tuple[int, str, bool]]:
    """(field id, column, nested) of all fields of a file's schema that have one."""
    out = []
    for f in schema.fields:
        if ID in f.metadata:
            out.append((f.metadata[ID], f.name, nested))
        inner = [f.dataType]
        while inner:
            t = inner.pop()
            if isinstance(t, StructType):
                out += _ids(t, True)
            inner += [getattr(t, k) for k in ("elementType", "keyType", "valueType") if hasattr(t, k)]
    return out


def resolve(schema: StructType, wanted: list[int]) -> dict[int, str | None]:
    """The column of each wanted field id; None for one that the file lacks (its values are NULL).

    A file without ids, an id that occurs twice and a wanted field inside another are errors.
    """
    found = _ids(schema)
    if not found:
        raise BadMetadata("the file has no field ids")
    if len({i for i, _, _ in found}) < len(found):
        raise BadMetadata("a field id occurs twice")
    if inside := [i for i, _, nested in found if nested and i in wanted]:
        raise BadMetadata(f"field {inside[0]} is inside another")
    return {i: next((name for j, name, _ in found if j == i), None) for i in wanted}


#: Types that a file may hold for a column of a wider type.
WIDER = {("int", "bigint"), ("float", "double")}


def check_type(held: str, wanted: str) -> None:
    """A file's column must have the table's type, a narrower one of the same kind, or a decimal of the same scale."""
    if held == wanted or (held, wanted) in WIDER or family(held) is not None and family(held) == family(wanted) and held.startswith("decimal"):
        return
    raise BadMetadata(f"{held} in the file, {wanted} in the table")


def read(spark: SparkSession, paths: list[str], columns: dict[int, tuple[str, str]]) -> DataFrame:
    """(path, pos, columns) of all rows: columns by field id, each with its name and type; ``pos`` is the row's place in its file.

    Only the wanted columns are read. Each file's own schema is checked first,
    from its footer; files of one schema are read together.
    """
    by: dict[str, list[str]] = {}
    for p in paths:
        by.setdefault(spark.read.parquet(p).schema.json(), []).append(p)
    out = None
    for text, same in by.items():
        schema = StructType.fromJson(json.loads(text))
        names = resolve(schema, list(columns))
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        cells = []
        for i, (name, kind) in columns.items():
            if names[i] is not None:
                check_type(kinds[names[i]], kind)
            cells.append((F.col(f"`{names[i]}`") if names[i] is not None else F.lit(None)).cast(kind).alias(name))
        place = [F.regexp_replace("_metadata.file_path", "^file:/*", "/").alias("path"), F.col("_metadata.row_index").alias("pos")]
        part = spark.read.schema(schema).parquet(*same).select(*place, *cells)
        out = part if out is None else out.unionByName(part)
    return out


def at(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """The rows at the listed (path, pos)."""
    return rows.join(positions.select("path", "pos").distinct(), ["path", "pos"], "left_semi")
