"""Keys of rows: NULL rules, multiset counts, deltas."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.model import FK, NOT_NULL, PK, Constraint


def any_null(columns) -> Column:
    return reduce(or_, (F.col(c).isNull() for c in columns))


def all_null(columns) -> Column:
    return reduce(and_, (F.col(c).isNull() for c in columns))


def classify(c: Constraint) -> Column:
    """``key``, ``exempt`` or ``violation`` by the constraint's role and the NULLs of a row."""
    some, every = any_null(c.columns), all_null(c.columns)
    if c.kind in (PK, NOT_NULL):
        return F.when(some, "violation").otherwise("key")
    if c.kind == FK and c.full:
        return F.when(every, "exempt").when(some, "violation").otherwise("key")
    if c.kind == FK or c.nulls_distinct:
        return F.when(some, "exempt").otherwise("key")
    return F.lit("key")


def keys_of(rows: DataFrame, c: Constraint) -> DataFrame:
    """The key columns of the rows that form a key."""
    return rows.where(classify(c) == "key").select(*c.columns)


def violating(rows: DataFrame, c: Constraint) -> DataFrame:
    """The key columns of the rows that break the NULL rule."""
    return rows.where(classify(c) == "violation").select(*c.columns)


def counts(keys: DataFrame) -> DataFrame:
    """Key multiset: each key and how often it occurs."""
    return keys.groupBy(*keys.columns).agg(F.count("*").alias("n"))


def duplicates(keys: DataFrame) -> DataFrame:
    return counts(keys).where("n > 1")


def sides(added: DataFrame, removed: DataFrame) -> DataFrame:
    """Each key with a, how often it is added, and r, how often removed: one union, one shuffle.

    Only keys whose counts matter are kept: added more than once, or changed.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = added.select("*", one.alias("a"), none.alias("r")).unionByName(removed.select("*", none.alias("a"), one.alias("r")))
    return both.groupBy(*added.columns).agg(F.sum("a").alias("a"), F.sum("r").alias("r")).where("a > 1 or a <> r")


def net_delta(added: DataFrame, removed: DataFrame) -> DataFrame:
    """Signed change of each key, never zero."""
    return sides(added, removed).withColumn("net", F.col("a") - F.col("r")).where("net <> 0").drop("a", "r")


def same_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs between two tables, with the signed difference; empty when they are equal."""
    weighted = before.withColumn("w", F.lit(-1).cast("long")).unionByName(after.withColumn("w", F.lit(1).cast("long")))
    return weighted.groupBy(*before.columns).agg(F.sum("w").alias("net")).where("net <> 0")


def each(found: DataFrame) -> DataFrame:
    """What ``same_rows`` finds with net 1 or -1: as many rows as the multiplicity differs by, so that no order of equal rows is needed."""
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.abs("net"))).alias("_i")
    return found.select("*", times).withColumn("net", F.signum("net").cast("long")).drop("_i")


def null_safe(left: DataFrame, right: DataFrame, columns, other=None) -> Column:
    """Equality of key tuples with NULL equal to NULL."""
    return reduce(and_, (left[x].eqNullSafe(right[y]) for x, y in zip(columns, other or columns, strict=True)))


def matched(left: DataFrame, right: DataFrame, columns, how: str, other=None, nulls_equal: bool = False) -> DataFrame:
    """Semi or anti join of keys; plain equality unless NULLs are part of keys."""
    right = right.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(other or columns)])
    names = [f"_k{i}" for i in range(len(columns))]
    on = [left[c].eqNullSafe(right[k]) if nulls_equal else left[c] == right[k] for c, k in zip(columns, names, strict=True)]
    return left.join(right, on, how)


def with_held(left: DataFrame, index: DataFrame, columns, nulls_equal: bool = False) -> DataFrame:
    """``left`` with held: whether the index, whose keys are distinct, has the key."""
    names = [f"_k{i}" for i in range(len(columns))]
    right = index.select(*[F.col(c).alias(k) for c, k in zip(columns, names, strict=True)], F.lit(True).alias("_held"))
    on = [left[c].eqNullSafe(right[k]) if nulls_equal else left[c] == right[k] for c, k in zip(columns, names, strict=True)]
    return left.join(right, on, "left").select(*left.columns, F.coalesce("_held", F.lit(False)).alias("held"))
