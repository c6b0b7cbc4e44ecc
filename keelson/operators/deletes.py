"""Files of two snapshots: differences and the rows that delete files hide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTRIBUTES = ("content", "spec_id", "partition", "sequence", "record_count")


def _attributes(files: DataFrame) -> list[str]:
    return [c for c in ATTRIBUTES if c in files.columns]


def file_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files by change: added, removed (path and all attributes differ) or kept."""
    same = _attributes(before)
    x, y = before.alias("x"), after.alias("y")
    on = F.col("x.path") == F.col("y.path")
    for c in same:
        on = on & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    kept = x.join(y, on, "left_semi").withColumn("change", F.lit("kept"))
    removed = x.join(y, on, "left_anti").withColumn("change", F.lit("removed"))
    added = y.join(x, on, "left_anti").withColumn("change", F.lit("added"))
    return kept.unionByName(removed).unionByName(added)


def reaching_deletes(position_deletes: DataFrame, delete_files: DataFrame, files: DataFrame) -> DataFrame:
    """(path, pos) that position deletes hide: same spec and partition, the file not younger than the delete, and the file that the delete file refers to, if it names one.

    A file or delete file without spec or sequence number has ones that are not
    known, which equal nothing: its deletes reach no row here and ``unknown_reach`` reports them.
    The file lists are metadata; only they meet in the conditions, rows meet on path.
    """
    named = F.col("referenced_data_file") if "referenced_data_file" in delete_files.columns else F.lit(None).cast("string")
    d = delete_files.select(F.col("path").alias("delete_path"), F.col("spec_id").alias("ds"), F.col("partition").alias("dp"), F.col("sequence").alias("dq"), named.alias("only"))
    f = files.select(F.col("path").alias("target_path"), "spec_id", "partition", "sequence")
    hits = position_deletes.join(d, "delete_path").join(f, "target_path")
    hits = hits.where((F.col("ds") == F.col("spec_id")) & F.col("dp").eqNullSafe(F.col("partition")) & (F.col("sequence") <= F.col("dq")) & (F.col("only").isNull() | (F.col("only") == F.col("target_path"))))
    return hits.select(F.col("target_path").alias("path"), "pos").distinct()


def unknown_reach(delete_files: DataFrame, files: DataFrame) -> DataFrame:
    """Files and delete files whose spec or sequence number is not known: no one can say what is hidden."""
    return delete_files.select("path", "spec_id", "sequence").union(files.select("path", "spec_id", "sequence")).where("spec_id is null or sequence is null").select("path")


def with_vectors(hidden: DataFrame, vectors: DataFrame) -> DataFrame:
    """A file's deletion vector replaces all position deletes of the file. Several vectors of one file are an error that ``changes.several_vectors`` finds."""
    rest = hidden.join(vectors.select("path").distinct(), "path", "left_anti")
    return rest.unionByName(vectors.select("path", "pos")).distinct()


def live_rows(rows: DataFrame, hidden: DataFrame) -> DataFrame:
    return rows.join(hidden, ["path", "pos"], "left_anti")


def out_of_bounds(hidden: DataFrame, files: DataFrame) -> DataFrame:
    """Deleted positions outside their file: an error."""
    return hidden.join(files.select("path", "record_count"), "path").where("pos < 0 or pos >= record_count").select("path", "pos")


def apply_equality_deletes(rows: DataFrame, files: DataFrame, deletes: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that no equality delete hides.

    ``deletes`` has the key columns, the delete's sequence and its partition
    (null: of all partitions), and its spec_id where files have one: the same
    tuple under another spec is another partition. A row is hidden by a delete of its key (NULL equals NULL)
    that is strictly younger than its file. Deletes older than the
    oldest file are not read; of the rest only the newest per scope and key counts.
    """
    specs = "spec_id" in deletes.columns and "spec_id" in files.columns
    spec = F.col("spec_id") if specs else F.lit(0)
    oldest = files.agg(F.min("sequence").alias("oldest"))
    young = deletes.join(F.broadcast(oldest), F.col("sequence") > F.col("oldest")).drop("oldest")  # one row
    newest = young.groupBy(*[F.col(c).alias(f"_d_{c}") for c in columns], F.col("partition").alias("_dp"), F.when(F.col("partition").isNotNull(), spec).alias("_ds")).agg(F.max("sequence").alias("_dq"))
    placed = rows.join(files.select("path", F.col("sequence").alias("_fq"), F.col("partition").alias("_fp"), spec.alias("_fs")), "path")
    on = (F.col("_dp").isNull() | (F.col("_dp") == F.col("_fp")) & (F.col("_ds") == F.col("_fs"))) & (F.col("_dq") > F.col("_fq"))
    for c in columns:
        on = on & placed[c].eqNullSafe(newest[f"_d_{c}"])
    return placed.join(newest, on, "left_anti").drop("_fq", "_fp", "_fs")


def kept_file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Positions of kept files that became hidden (removed) or visible again (added)."""
    gone = after.join(before, ["path", "pos"], "left_anti").withColumn("change", F.lit("removed"))
    back = before.join(after, ["path", "pos"], "left_anti").withColumn("change", F.lit("added"))
    return gone.unionByName(back)


def row_count_errors(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Files of which other than the listed number of rows was read."""
    read = rows.groupBy("path").agg(F.count("*").alias("rows_read"))
    both = files.select("path", "record_count").join(read, "path", "left")
    return both.select("path", "record_count", F.coalesce("rows_read", F.lit(0)).alias("rows_read")).where("rows_read <> record_count")
