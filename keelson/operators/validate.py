"""Whole-table and incremental validation. Every violated (constraint, code) is reported; errors beat verdicts."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.model import FK, INCONSISTENT, MISSING_PARENT, NOT_NULL, NULL_VALUE, PARENT_DELETED, PK, UNIQUE, Constraint, Registry
from keelson.operators import keys

SAMPLES = 10
_SCHEMA = "constraint_id long, constraint string, table_name string, code string, phase int, key string"


@dataclass
class Indexes:
    """Unique indexes by key constraint (its columns) and reference indexes by foreign key (parent key columns, child_count)."""

    unique: dict[int, DataFrame] = field(default_factory=dict)
    references: dict[int, DataFrame] = field(default_factory=dict)


def key_text(columns) -> Column:
    """A key for people: values joined by commas, NULL spelled out.

    Values with a comma, a quote or a backslash, empty ones and the text NULL
    stand in quotes, so no two keys read alike.
    """

    def one(c: str) -> Column:
        text = F.col(c).cast("string")
        quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        return F.when(text.isNull(), "NULL").when(text.rlike(r'[,"\\]') | text.isin("", "NULL"), quoted).otherwise(text)

    return F.concat_ws(",", *map(one, columns))


def _found(rows: DataFrame, c: Constraint, table: str, code: str, phase: int | Column, columns) -> DataFrame:
    phase = phase if isinstance(phase, Column) else F.lit(phase)
    return rows.select(F.lit(c.id).cast("long").alias("constraint_id"), F.lit(c.label).alias("constraint"), F.lit(table).alias("table_name"), F.lit(code).alias("code"), phase.alias("phase"), key_text(columns).alias("key"))


def _all(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], _SCHEMA)


def summary(found: DataFrame, samples: bool = False) -> DataFrame:
    """(constraint_id, constraint, table_name, code, violation_count[, sample_keys]): distinct keys and rows without one."""
    by = ("constraint_id", "constraint", "table_name", "code")
    total = found.groupBy(*by).agg(F.count("*").alias("violation_count"))
    if not samples:
        return total
    return total.join(first_samples(found).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda s: s["key"]).alias("sample_keys")), list(by))


def first_samples(found: DataFrame, most: int = SAMPLES) -> DataFrame:
    """The first keys of each (constraint, code): rows without a key, duplicates within the commit, then the rest, in key order."""
    order = Window.partitionBy("constraint_id", "code").orderBy("phase", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def onboard_table(rows: DataFrame, constraints: list[Constraint], parents: Mapping[int, DataFrame]) -> DataFrame:
    """Violations of all rows of a table as one insert into empty indexes. ``parents`` has each foreign key's parent keys."""
    parts = []
    for c in constraints:
        nulls = MISSING_PARENT if c.kind == FK else NULL_VALUE
        if c.kind in (PK, NOT_NULL) or c.kind == FK and c.full:
            parts.append(_found(keys.violating(rows, c), c, c.table, nulls, 0, c.columns))
        if c.kind in (PK, UNIQUE):
            parts.append(_found(keys.duplicates(keys.keys_of(rows, c)), c, c.table, c.duplicate_code, 1, c.columns))
        if c.kind == FK:
            child = keys.counts(keys.keys_of(rows, c))
            parts.append(_found(keys.matched(child, parents[c.id], c.columns, "left_anti", c.parent_columns), c, c.table, MISSING_PARENT, 2, c.columns))
    return _all(parts, rows.sparkSession)


def reference_counts(children: DataFrame, c: Constraint) -> DataFrame:
    """The reference index of a foreign key: parent key and number of children, never 0."""
    named = keys.keys_of(children, c).toDF(*c.parent_columns)
    return keys.counts(named).withColumnRenamed("n", "child_count")


@dataclass
class Decision:
    violations: DataFrame
    errors: DataFrame


def commit(registry: Registry, table: str, added: DataFrame, removed: DataFrame, indexes: Indexes) -> Decision:
    """Decide one commit to a table against the indexes of the state before it.

    Added keys are counted before netting, so a key added twice is a duplicate
    whatever is removed. Only child keys whose count rises need a parent, only
    parent keys whose count falls are checked for children.
    """
    parts, errors = [], []
    for c in registry.governing(table):
        if c.table == table:
            _own(registry, c, added, removed, indexes, parts, errors)
        else:
            key = registry.parent_key(c)
            counted = keys.sides(keys.keys_of(added, key), keys.keys_of(removed, key))
            falling = counted.where("a < r")
            parts.append(_found(keys.matched(falling, indexes.references[c.id], key.columns, "left_semi", c.parent_columns), c, table, PARENT_DELETED, 2, key.columns))
    spark = added.sparkSession
    return Decision(_all(parts, spark), _all(errors, spark))


def _own(registry: Registry, c: Constraint, added: DataFrame, removed: DataFrame, indexes: Indexes, parts: list, errors: list) -> None:
    if c.kind in (PK, NOT_NULL) or c.kind == FK and c.full:
        parts.append(_found(keys.violating(added, c), c, c.table, MISSING_PARENT if c.kind == FK else NULL_VALUE, 0, c.columns))
        errors.append(_found(keys.violating(removed, c), c, c.table, INCONSISTENT, 0, c.columns))
    if c.kind == NOT_NULL:
        return
    counted = keys.sides(keys.keys_of(added, c), keys.keys_of(removed, c))
    if c.kind == FK:
        parent = indexes.unique[registry.parent_key(c).id]
        parts.append(_found(keys.matched(counted.where("a > r"), parent, c.columns, "left_anti", c.parent_columns), c, c.table, MISSING_PARENT, 2, c.columns))
        return
    probed = keys.with_held(counted, indexes.unique[c.id], c.columns, nulls_equal=not c.nulls_distinct)  # one aggregate and one probe for all that follows
    parts.append(_found(probed.where("a > 1 or a > r and held"), c, c.table, c.duplicate_code, F.when(F.col("a") > 1, 1).otherwise(2), c.columns))
    errors.append(_found(probed.where("a < r and (not held or a - r < -1)"), c, c.table, INCONSISTENT, 1, c.columns))


def stage_unique(index: DataFrame, net: DataFrame, snapshot: int) -> DataFrame:
    """Exact writes of a unique index: (key, last_snapshot), null for a removal."""
    return net.select(*[c for c in net.columns if c != "net"], F.when(F.col("net") > 0, F.lit(snapshot).cast("long")).alias("last_snapshot"))


def stage_reference(index: DataFrame, net: DataFrame) -> DataFrame:
    """Exact writes of a reference index: (key, child_count), 0 for a removal; a count below 0 is an error row (null)."""
    columns = [c for c in net.columns if c != "net"]
    total = index.withColumnRenamed("child_count", "n").select(*columns, "n", F.lit(0).cast("long").alias("d"))
    both = total.unionByName(net.select(*columns, F.lit(0).cast("long").alias("n"), F.col("net").alias("d")))
    summed = both.groupBy(*columns).agg(F.sum("n").alias("n"), F.sum("d").alias("d")).where("d <> 0")
    now = F.col("n") + F.col("d")
    return summed.select(*columns, F.when(now >= 0, now).alias("child_count"))


def overlay(base: DataFrame, pending: DataFrame, columns, value: str) -> DataFrame:
    """Base and pending writes read together: the newest version of a key wins, a null value hides it."""
    old = base.select(*columns, F.col(value), F.lit(-1).cast("long").alias("version"))
    both = old.unionByName(pending.select(*columns, value, "version"))
    newest = both.groupBy(*columns).agg(F.max(F.struct("version", F.col(value).alias("v"))).alias("w"))
    return newest.select(*columns, F.col("w.v").alias(value)).where(F.col(value).isNotNull())


def upsert_removals(index: DataFrame, deletes: DataFrame, columns) -> DataFrame:
    """Equality deletes as index changes: each distinct key that the index holds falls by one."""
    return keys.matched(deletes.select(*columns).dropDuplicates(), index, columns, "left_semi").withColumn("net", F.lit(-1).cast("long"))
