"""Which changes of a snapshot's files can be proved, as probes: each gives the rows that refuse the commit.

``before`` and ``after`` are live entries of two snapshots (path, content,
spec_id, partition, sequence, explicit_sequence, equality_ids, record_count,
referenced_data_file); content is 0 for data, 1 for position and 2 for equality
deletes. File lists are metadata and small beside the rows; they meet on
equality wherever the rule allows it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATA, POSITIONS, EQUALITY = 0, 1, 2


def _of(files: DataFrame, content: int) -> DataFrame:
    return files.where(F.col("content") == content)


def _reason(rows: DataFrame, reason: str) -> DataFrame:
    return rows.select(F.col("path"), F.lit(reason).alias("reason"))


def added_files(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.join(before.select("path"), "path", "left_anti")


def changed_sequences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files of both snapshots whose data sequence number differs: other deletes would apply."""
    was = before.select("path", F.col("sequence").alias("was"))
    return _reason(after.join(was, "path").where(~F.col("sequence").eqNullSafe(F.col("was"))), "changes its sequence number")


def beyond_snapshot(after: DataFrame, snapshot_sequence: int) -> DataFrame:
    """Data files that claim a number above their snapshot's: later equality deletes would miss them."""
    return _reason(_of(after, DATA).where(F.col("explicit_sequence") > snapshot_sequence), "claims a sequence number above its snapshot's")


def equality_with_others(before: DataFrame, after: DataFrame) -> DataFrame:
    """In a commit that adds equality deletes: data files or equality deletes it removes, data files it adds with numbers of their own, several or no equality fields."""
    new, gone = added_files(before, after), added_files(after, before)
    deletes = _of(new, EQUALITY)
    flag = deletes.agg((F.count("*") > 0).alias("adds"))  # one row
    explicit = _of(new, DATA).where(F.col("explicit_sequence").isNotNull())
    fields = deletes.withColumn("ids", F.array_sort(F.coalesce("equality_ids", F.array().cast("array<int>"))))
    first = fields.agg(F.min("ids").alias("least"))
    mixed = fields.join(F.broadcast(first), (F.size("ids") == 0) | (F.col("ids") != F.col("least")))
    parts = [_reason(_of(gone, DATA), "removed beside equality deletes"), _reason(_of(gone, EQUALITY), "equality delete removed beside new ones"), _reason(explicit, "explicit sequence number beside equality deletes")]
    beside = reduce(DataFrame.union, parts).join(F.broadcast(flag), F.col("adds")).drop("adds")
    return beside.union(_reason(mixed, "equality fields missing or different"))


def still_applying(before: DataFrame, after: DataFrame) -> DataFrame:
    """Equality deletes that the commit removes while a live data file is older: its rows would come back."""
    oldest = _of(after, DATA).agg(F.min(F.coalesce("sequence", F.lit(-1).cast("long"))).alias("oldest"))  # one row
    gone = _of(added_files(after, before), EQUALITY)
    return _reason(gone.join(F.broadcast(oldest), F.col("sequence").isNull() | (F.col("oldest") < F.col("sequence"))), "still applies to a data file")


def old_deletes_naming_new_files(before: DataFrame, after: DataFrame, positions: DataFrame) -> DataFrame:
    """Position deletes (delete_path, target_path) of an earlier snapshot that name a data file which the commit adds."""
    old = _of(before, POSITIONS).select(F.col("path").alias("delete_path"))
    new = _of(added_files(before, after), DATA).select(F.col("path").alias("target_path"))
    named = positions.select("delete_path", "target_path").distinct().join(old, "delete_path", "left_semi").join(new, "target_path", "left_semi")
    return _reason(named.select(F.col("delete_path").alias("path")).distinct(), "names a data file that the commit adds")


def several_vectors(files: DataFrame) -> DataFrame:
    """Data files with more than one deletion vector."""
    vectors = files.where((F.col("content") == POSITIONS) & (F.col("format") == "puffin"))
    return _reason(vectors.groupBy(F.col("referenced_data_file").alias("path")).count().where("count > 1"), "has several deletion vectors")


def beyond_partition(rows: DataFrame, files: DataFrame, tuple_of: Column) -> DataFrame:
    """Files (path, partition) with rows outside their partition, and how many. ``tuple_of`` gives a row's tuple as the files name it."""
    placed = rows.select("path", tuple_of.alias("own")).join(files.select("path", "partition"), "path")
    return placed.where(~F.col("own").eqNullSafe(F.col("partition"))).groupBy("path").agg(F.count("*").alias("rows_outside"))


def partitioned_upsert(before: DataFrame, after: DataFrame, computable_specs: list[int]) -> DataFrame:
    """Partitioned equality deletes that do not reach what their key names: of a spec that is not computed from the key, of several specs, or beside data files of another spec."""
    deletes = _of(added_files(before, after), EQUALITY).where(F.col("partition").isNotNull())
    unknown = deletes.where(~F.col("spec_id").isin(computable_specs or [-1]) | F.col("spec_id").isNull())
    specs = deletes.agg(F.min("spec_id").alias("low"), F.max("spec_id").alias("high"))  # one row
    several = deletes.join(F.broadcast(specs), F.col("low") != F.col("high"))
    others = _of(before, DATA).join(F.broadcast(specs), ~F.col("spec_id").eqNullSafe(F.col("low")) & F.col("low").isNotNull())
    parts = [_reason(unknown, "its spec is not computed from the key"), _reason(several, "equality deletes of several specs"), _reason(others, "of another spec than the equality deletes")]
    return reduce(DataFrame.union, parts)


def operation_errors(operation: str, added: DataFrame, removed: DataFrame, row_changes: DataFrame) -> DataFrame:
    """What a declared operation forbids: removed files of an append, added ones of a delete, changed rows of a replace. One row where it is broken."""
    wrong = {"append": removed, "delete": added, "replace": row_changes}.get(operation)
    if wrong is None:
        return added.sparkSession.createDataFrame([] if operation == "overwrite" else [(f"unknown operation {operation}", 0)], "reason string, changes long")
    return wrong.agg(F.count("*").alias("changes")).where("changes > 0").select(F.lit(f"{operation} does more than it says").alias("reason"), "changes")
