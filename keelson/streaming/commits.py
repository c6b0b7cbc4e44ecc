"""Commits as a stream: change files in, verdicts out, indexes moved on.

A commit of many rows comes as a folder of any number of change files and a
small file that names it, so that no task reads or writes a whole commit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.model import FK, PK, UNIQUE, Registry
from keelson.operators import keys, validate
from keelson.operators.validate import Indexes, commit, summary
from keelson.sources.index_store import IndexStore
from keelson.sources.locations import Hadoop

COUNT = "child_count"


def unique_name(constraint_id: int) -> str:
    return f"unique-{constraint_id}"


def reference_name(constraint_id: int) -> str:
    return f"reference-{constraint_id}"


def install(store: IndexStore, registry: Registry, tables: dict[str, DataFrame], epoch: int = 1) -> None:
    """Build all indexes of the registry from whole tables, at one epoch."""
    found = {}
    for c in registry.constraints.values():
        if c.enabled and c.kind in (PK, UNIQUE):
            found[unique_name(c.id)] = keys.keys_of(tables[c.table], c).distinct()
        elif c.enabled and c.kind == FK:
            found[reference_name(c.id)] = validate.reference_counts(tables[c.table], c)
    store.apply(found, epoch)


def indexes_for(store: IndexStore, registry: Registry, table: str) -> Indexes:
    """The indexes that decide a commit to a table: its own keys, its parents' keys, the references to it."""
    unique, references = {}, {}
    for c in registry.governing(table):
        if c.kind in (PK, UNIQUE) and c.table == table:
            unique[c.id] = store.read(unique_name(c.id))
        elif c.kind == FK:
            if c.table == table:
                parent = registry.parent_key(c).id
                unique[parent] = store.read(unique_name(parent))
            if c.parent == table:
                references[c.id] = store.read(reference_name(c.id), COUNT)
    return Indexes(unique, references)


def deltas_of(registry: Registry, table: str, added: DataFrame, removed: DataFrame) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """What a valid commit changes: index name to (key, net), and the count columns of those that have one."""
    deltas, values = {}, {}
    for c in registry.of_table(table):
        if c.kind not in (PK, UNIQUE, FK):
            continue
        net = keys.net_delta(keys.keys_of(added, c), keys.keys_of(removed, c))
        if c.kind == FK:
            deltas[reference_name(c.id)] = net.toDF(*c.parent_columns, "net")
            values[reference_name(c.id)] = COUNT
        else:
            deltas[unique_name(c.id)] = net
    return deltas, values


def announce(spark: SparkSession, waiting: str, name: str, folders: list[str]) -> None:
    """Name a commit's folders of change files, all written, to those who wait for commits."""
    Hadoop(spark).write(f"{waiting}/.{name}.tmp", "\n".join(folders).encode())
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    if not path(waiting).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path(f"{waiting}/.{name}.tmp"), path(f"{waiting}/{name}")):
        raise FileExistsError(f"commit {name} is announced already")


def announced(spark: SparkSession, waiting: str) -> DataFrame:
    """The stream of announced commits (value: a folder), one in each micro-batch, as ``validate_stream`` takes it with a schema."""
    return spark.readStream.option("maxFilesPerTrigger", 1).text(waiting)


def validate_stream(spark: SparkSession, changes: DataFrame, registry: Registry, table: str, store: IndexStore, out: str, checkpoint: str, schema: str | None = None) -> None:
    """Run all waiting changes (rows with op = +1 or -1) through validation, one commit per micro-batch.

    With ``schema``, changes are the folders of such rows, as ``announced`` gives
    them. The store holds the indexes that ``install`` builds. A commit without
    violations and errors adds its deltas at epoch batch + 2. A batch that is
    run again after its epoch was applied does nothing, so its verdict stays;
    one that stopped before that is decided again on the same indexes and
    overwrites its verdict with the same one.
    """

    def one(waiting: DataFrame, batch: int) -> None:
        own = in_small_parts(waiting.sparkSession)
        rows = waiting
        if schema:
            folders = [r.value for r in waiting.collect() if r.value]  # a commit's folders, few
            rows = own.read.schema(schema).parquet(*folders) if folders else own.createDataFrame([], schema)
        batch_of(registry, table, IndexStore(own, store.folder), out)(rows, batch)

    changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: At most so many bytes of files or of shuffled keys in a task: keys compress to a few bytes, but take a hundred in a hash map or a sort.
PARTS = {"spark.sql.files.maxPartitionBytes": 8 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 4 << 20}


def in_small_parts(own: SparkSession) -> SparkSession:
    """The session of a stream, which is a copy of its starter's, with parts of the tasks' input no larger than ``PARTS``."""
    size = own.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most in PARTS.items():
        if size(own.conf.get(name)) > most:
            own.conf.set(name, str(most))
    return own


def batch_of(registry: Registry, table: str, store: IndexStore, out: str) -> Callable[[DataFrame, int], None]:
    keyed = sorted({x for c in registry.governing(table) for x in (c.columns if c.table == table else c.parent_columns)})

    def run(rows: DataFrame, batch: int) -> None:
        if store.pointer()["epoch"] >= batch + 2:
            return
        rows = rows.select(*keyed, "op").persist()
        added, removed = rows.where("op = 1").drop("op"), rows.where("op = -1").drop("op")
        decision = commit(registry, table, added, removed, indexes_for(store, registry, table))
        found = summary(decision.violations).withColumn("kind", F.lit("violation")).union(summary(decision.errors).withColumn("kind", F.lit("error")))
        verdict = found.withColumn("batch", F.lit(batch).cast("long")).persist()
        verdict.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        if verdict.isEmpty():
            deltas, values = deltas_of(registry, table, added, removed)
            store.apply_deltas(deltas, batch + 2, values=values)
        verdict.unpersist()
        rows.unpersist()

    return run
