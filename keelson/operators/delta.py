"""Algebra of key deltas, epochs and the numbers that reports show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram's buckets, in seconds.
BOUNDS = (0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def _keys(delta: DataFrame) -> list[str]:
    return [c for c in delta.columns if c != "net"]


def plus(*deltas: DataFrame) -> DataFrame:
    """The sum of deltas (key, net); keys whose changes cancel out are left out."""
    both = reduce(DataFrame.unionByName, deltas)
    return both.groupBy(*_keys(both)).agg(F.sum("net").alias("net")).where("net <> 0")


def minus(delta: DataFrame) -> DataFrame:
    return delta.withColumn("net", -F.col("net"))


def of_keys(delta: DataFrame, wanted: DataFrame) -> DataFrame:
    """The change of each wanted key, 0 where there is none; NULL is a value of keys."""
    names = _keys(delta)
    own = delta.select(*[F.col(c).alias(f"_{c}") for c in names], "net")
    on = reduce(lambda a, b: a & b, (wanted[c].eqNullSafe(own[f"_{c}"]) for c in names))
    return wanted.join(own, on, "left").select(*[wanted[c] for c in names], F.coalesce("net", F.lit(0)).alias("net"))


def applied(counts: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts (key, n) after the delta, keys whose count would fall below 0). The first counts only where the second is empty: all or nothing."""
    names = _keys(delta)
    both = counts.unionByName(delta.withColumnRenamed("net", "n"))
    total = both.groupBy(*names).agg(F.sum("n").alias("n"))
    return total.where("n > 0"), total.where("n < 0")


def next_epoch(epochs: DataFrame) -> DataFrame:
    """One row: the epoch after the greatest of a domain's indexes (index, epoch)."""
    return epochs.agg((F.coalesce(F.max("epoch"), F.lit(0)) + 1).alias("epoch"))


def primary_code(violations: DataFrame, by: list[str]) -> DataFrame:
    """The code that stands for a commit: the least number, then the least constraint."""
    number = F.regexp_extract("code", r"(\d+)$", 1).cast("int")
    return violations.groupBy(*by).agg(F.min(F.struct(number.alias("number"), "constraint_id", "code")).alias("least")).select(*by, "least.code", "least.constraint_id")


def out_of_order(rows: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """Rows of a written run whose key does not rise."""
    before = F.lag(key).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("before", before).where(F.col("before") >= F.col(key))


def bucket_of(seconds: Column) -> Column:
    """The place of a duration among the bounds; beyond the last one, their number."""
    return F.coalesce(*[F.when(seconds <= b, F.lit(k)) for k, b in enumerate(BOUNDS)], F.lit(len(BOUNDS)))


def histogram(rows: DataFrame, seconds: str, by: list[str]) -> DataFrame:
    """Per group the cumulative buckets (bound; infinite for the last), the number of rows and the sum of seconds."""
    one = rows.groupBy(*by, bucket_of(F.col(seconds)).alias("bucket")).agg(F.count("*").alias("n"), F.sum(seconds).alias("s"))
    total = one.groupBy(*by).agg(F.sum("n").alias("count"), F.sum("s").alias("sum"), F.collect_list(F.struct("bucket", "n")).alias("parts"))
    bounds = F.explode(F.array(*[F.struct(F.lit(k).alias("bucket"), F.lit(b).alias("bound")) for k, b in enumerate((*BOUNDS, float("inf")))]))
    spread = total.withColumn("b", bounds)
    held = F.aggregate(F.filter("parts", lambda p: p["bucket"] <= F.col("b.bucket")), F.lit(0).cast("long"), lambda a, p: a + p["n"])
    return spread.select(*by, "b.bucket", "b.bound", held.alias("at_most"), "count", "sum")


def quantile_bound(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """The least bound below which a share q of a histogram's rows lie; infinite beyond the last one, none without rows."""
    enough = buckets.where((F.col("count") > 0) & (F.col("at_most") >= F.col("count") * q))
    return enough.groupBy(*by).agg(F.min("bound").alias("bound"))


def state_counts(domains: DataFrame) -> DataFrame:
    return domains.groupBy("state").agg(F.count("*").alias("domains"))
