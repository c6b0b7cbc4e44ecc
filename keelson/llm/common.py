"""Shared pieces of the operators: written tables, broadcasts of checked size, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: the session's checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Where neither it nor a
    checkpoint folder is set, a temporary one is made on one machine (tests);
    a cluster without one is an error.
    """
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="keelson-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/tables"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives executors.

    The shuffle files of a query that has ended go only when the driver's
    garbage collector finds its plan. A driver that needs little memory would
    keep all of them on the executors' disks, so it is asked to look.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """How many tasks a shuffle is dealt to: what the session says."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on Arrow batches of the session hold so many rows at most: whole texts are long, and both ends hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 250_000) -> DataFrame:
    """A broadcast hint where the counted rows are few; else the planner's own join."""
    return F.broadcast(df) if rows <= limit else df


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of links u-v, for all nodes but those smallest ones."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = a[open_], b[open_]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links to the stars of its own components: the same components with a link a node at most."""
    held, have = [], 0
    for batch in batches:
        held.append([batch.column(k).to_numpy() for k in (0, 1)])
        have += batch.num_rows
        if have > 1 << 20:
            held = [stars(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))]
            have = len(held[0][0])
    if held:
        u, v = stars(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
        for k in range(0, len(u), 1 << 16):
            yield pa.record_batch([pa.array(u[k : k + (1 << 16)]), pa.array(v[k : k + (1 << 16)])], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = 300_000) -> DataFrame:
    """(node, component): the smallest node reachable over the given links.

    Each task first contracts the links it holds to stars. What is left is
    finished in one task where it is counted and few (``one_task`` links, some
    MB); else alternating large-star and small-star rounds, contracted again,
    go on until nothing changes. Both ways give the same result. Every round is
    a written table, so a lost executor costs one round. Links with null ends
    and loops are ignored; repeated ones count once.
    """
    now = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = saved(now.mapInArrow(_contract, "u long, v long"), "stars")
    mark = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40))).alias("s")).first()
        if new.n <= one_task:
            last, now = now, saved(now.repartition(1).mapInArrow(_contract, "u long, v long"), "stars")
            release(last)
            break
        if new == mark:
            break
        mark = new
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        last, now = now, saved(small.where("u <> v").distinct(), "stars")
        release(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
