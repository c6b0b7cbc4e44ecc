"""Manifest lists and manifests of table snapshots as DataFrames, and the rules their entries keep.

Manifests are read by Spark, one task a file or more files. Their paths come
from the manifest list, which is metadata and planned on the driver. Entries
that leave out their sequence number or snapshot inherit the manifest's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.sources import avro
from keelson.sources.locations import plain_path

#: What files hold, and what entries say about them.
DATA, POSITION_DELETES, EQUALITY_DELETES = 0, 1, 2
EXISTING, ADDED, DELETED = 0, 1, 2

LISTS = "list_path string, manifest_path string, spec_id int, content int, sequence_number long, min_sequence_number long, added_snapshot_id long"
ENTRIES = "manifest string, status int, entry_snapshot_id long, explicit_sequence long, content int, path string, format string, partition string, record_count long, equality_ids array<int>, referenced_data_file string, content_offset long, content_size long"

LIST_SCHEMA = {
    "type": "record", "name": "manifest_file",
    "fields": [
        {"name": "manifest_path", "type": "string"}, {"name": "manifest_length", "type": "long"}, {"name": "partition_spec_id", "type": "int"}, {"name": "content", "type": "int"},
        {"name": "sequence_number", "type": "long"}, {"name": "min_sequence_number", "type": "long"}, {"name": "added_snapshot_id", "type": "long"},
    ],
}


def entry_schema(partition: list[dict]) -> dict:
    """The Avro schema of a manifest's entries, given the fields of its partition tuple."""
    optional = lambda t: ["null", t]
    data_file = {
        "type": "record", "name": "r2",
        "fields": [
            {"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"},
            {"name": "partition", "type": {"type": "record", "name": "r102", "fields": partition}}, {"name": "record_count", "type": "long"},
            {"name": "equality_ids", "type": optional({"type": "array", "items": "int"})}, {"name": "referenced_data_file", "type": optional("string")},
            {"name": "content_offset", "type": optional("long")}, {"name": "content_size_in_bytes", "type": optional("long")},
        ],
    }
    fields = [{"name": "status", "type": "int"}, {"name": "snapshot_id", "type": optional("long")}, {"name": "sequence_number", "type": optional("long")}, {"name": "data_file", "type": data_file}]
    return {"type": "record", "name": "manifest_entry", "fields": fields}


def _json(value):
    return value.hex() if isinstance(value, bytes) else value


def _decoded(columns: list[str], row):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                out = [row(path, r) for r in avro.read(bytes(content))[1]]
                if out:
                    yield pd.DataFrame(out, columns=columns, dtype=object)

    return run


def _list_row(path: str, r: dict) -> tuple:
    return path, r["manifest_path"], r.get("partition_spec_id", 0), r.get("content") or 0, r.get("sequence_number") or 0, r.get("min_sequence_number") or 0, r.get("added_snapshot_id")


def _entry_row(path: str, r: dict) -> tuple:
    f = r["data_file"]
    partition = {k: _json(v) for k, v in f["partition"].items()}
    return (
        path, r["status"], r.get("snapshot_id"), r.get("sequence_number"), f.get("content") or 0, f["file_path"], f["file_format"].lower(), json.dumps(list(partition.values())) if partition else None,
        f["record_count"], f.get("equality_ids"), f.get("referenced_data_file"), f.get("content_offset"), f.get("content_size_in_bytes"),
    )


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """The manifests of a snapshot."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_decoded(_names(LISTS), _list_row), LISTS)


def read_entries(spark: SparkSession, manifests: DataFrame) -> DataFrame:
    """All entries of the listed manifests, with the manifest's spec and what they inherit from it.

    ``sequence`` is the entry's own number or, for an added file, the manifest's.
    """
    listed = manifests.select("manifest_path", "spec_id", F.col("content").alias("manifest_content"), "sequence_number", "added_snapshot_id").collect()  # metadata
    paths = [r.manifest_path for r in listed]
    if not paths:
        return spark.createDataFrame([], f"{ENTRIES}, spec_id int, manifest_content int, sequence_number long, added_snapshot_id long, snapshot_id long, sequence long")
    read = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(_decoded(_names(ENTRIES), _entry_row), ENTRIES)
    known = spark.createDataFrame([(plain_path(r.manifest_path), *r[1:]) for r in listed], "at string, spec_id int, manifest_content int, sequence_number long, added_snapshot_id long")
    rows = read.join(F.broadcast(known), F.regexp_replace("manifest", "^file:/*", "/") == F.col("at")).drop("at")  # one row a manifest
    inherited = F.when(F.col("status") == ADDED, F.col("sequence_number"))
    return rows.withColumn("snapshot_id", F.coalesce("entry_snapshot_id", "added_snapshot_id")).withColumn("sequence", F.coalesce("explicit_sequence", inherited))


def live(entries: DataFrame) -> DataFrame:
    """Entries of files that the snapshot holds: existing or added, not deleted."""
    return entries.where(F.col("status").isin(EXISTING, ADDED))


def wrong_content(entries: DataFrame) -> DataFrame:
    """Data files in delete manifests and delete files in data manifests: an error."""
    data = F.col("content") == DATA
    return entries.where(data != (F.col("manifest_content") == 0)).select("manifest", "path", "content")


def _whole_vector() -> Column:
    return (F.col("format") == "puffin") & (F.col("content") == POSITION_DELETES) & F.col("content_offset").isNotNull() & F.col("content_size").isNotNull() & F.col("referenced_data_file").isNotNull()


def unreadable(entries: DataFrame) -> DataFrame:
    """Live files that are neither Parquet nor a deletion vector with its place and its data file."""
    return live(entries).where((F.col("format") != "parquet") & ~_whole_vector()).select("path", "format", "content")


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Manifests that only one of two lists names: (manifest_path, change). Those of both need not be read."""
    gone = before.join(after, "manifest_path", "left_anti").select("manifest_path", F.lit("removed").alias("change"))
    return gone.union(after.join(before, "manifest_path", "left_anti").select("manifest_path", F.lit("added").alias("change")))


def snapshot_sequence(manifests: DataFrame, snapshot: int) -> DataFrame:
    """The sequence number of a snapshot: the greatest among the manifests it introduced."""
    return manifests.where(F.col("added_snapshot_id") == snapshot).agg(F.max("sequence_number").alias("sequence"))


def write_manifest(records: list[dict], partition: list[dict]) -> bytes:
    return avro.write(entry_schema(partition), records)


def write_list(records: list[dict]) -> bytes:
    return avro.write(LIST_SCHEMA, records)
