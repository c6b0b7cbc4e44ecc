"""Index tables in epoch directories; a pointer file, renamed last, says which epoch counts.

An index is a multiset of keys: a base table and the deltas (key, net) of later
epochs, read together. A commit writes its delta only; when an index has
``COMPACT`` deltas they are folded into a new base. Applying a change is
idempotent: the last (epoch, digest) again does nothing, the same epoch with
another digest or an older epoch is refused. What a stopped writer leaves
beside the pointer is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT = 16


class StaleEpoch(ValueError):
    """A write that does not follow the current epoch."""


class IndexStore:
    """A folder on any Hadoop file system with ``epoch=N-*`` directories and one pointer."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def pointer(self) -> dict:
        """{epoch, digest, head, tables: {name: path}, deltas: {name: [path]}}; epoch 0 before the first write."""
        place = self._path(f"{self.folder}/pointer.json")
        if not self._fs.exists(place):
            return {"epoch": 0, "digest": None, "head": None, "tables": {}, "deltas": {}}
        rows = self.spark.read.text(f"{self.folder}/pointer.json", wholetext=True).first()
        return json.loads(rows[0])

    def read(self, name: str, value: str | None = None) -> DataFrame:
        """The keys of an index; with ``value`` the name of a last column that has how often each occurs."""
        now = self.pointer()
        base, deltas = self.spark.read.parquet(now["tables"][name]), now["deltas"].get(name, [])
        if not deltas:
            return base
        columns = [c for c in base.columns if c != value]
        count = F.col(value) if value else F.lit(1)
        both = base.select(*columns, count.cast("long").alias("net")).unionByName(self.spark.read.parquet(*deltas).select(*columns, "net"))
        held = both.groupBy(*columns).agg(F.sum("net").alias("net")).where("net > 0")
        return held.withColumnRenamed("net", value) if value else held.select(*columns)

    @staticmethod
    def digest(tables: dict[str, DataFrame]) -> str:
        """Of the rows of all tables, whatever their order; repeated rows count."""
        parts = []
        for name in sorted(tables):
            names = sorted(tables[name].columns)
            sums = [F.sum(F.pmod(F.xxhash64(F.lit(salt), *names), F.lit((1 << 31) - 1))).alias(f"s{salt}") for salt in (1, 2)]
            row = tables[name].agg(F.count("*").alias("n"), *sums).first()
            parts.append(f"{name}:{row.n}:{row.s1}:{row.s2}")
        return ";".join(parts)

    def _due(self, tables: dict[str, DataFrame], epoch: int) -> tuple[dict, str] | None:
        now, digest = self.pointer(), self.digest(tables)
        if epoch == now["epoch"] and digest == now["digest"]:
            return None
        if epoch <= now["epoch"]:
            raise StaleEpoch(f"epoch {epoch} after {now['epoch']}")
        return now, digest

    def apply(self, tables: dict[str, DataFrame], epoch: int, head: int | None = None) -> bool:
        """Write whole tables at an epoch, then point to them. False if this very epoch is there already."""
        if (due := self._due(tables, epoch)) is None:
            return False
        now, digest = due
        base = f"{self.folder}/epoch={epoch}-{uuid.uuid4().hex[:8]}"
        for name, rows in tables.items():
            rows.write.parquet(f"{base}/{name}")
        deltas = {n: d for n, d in now["deltas"].items() if n not in tables}
        self._point({"epoch": epoch, "digest": digest, "head": head, "tables": {**now["tables"], **{n: f"{base}/{n}" for n in tables}}, "deltas": deltas})
        return True

    def apply_deltas(self, deltas: dict[str, DataFrame], epoch: int, head: int | None = None, values: dict[str, str] | None = None) -> bool:
        """Add the deltas (key, net) of one commit. ``values`` names the count columns of indexes that have one."""
        if (due := self._due(deltas, epoch)) is None:
            return False
        now, digest = due
        base = f"{self.folder}/epoch={epoch}-{uuid.uuid4().hex[:8]}"
        tables, all_of = dict(now["tables"]), {n: list(d) for n, d in now["deltas"].items()}
        for name, rows in deltas.items():
            rows.write.parquet(f"{base}/{name}")
            all_of.setdefault(name, []).append(f"{base}/{name}")
        new = {"epoch": epoch, "digest": digest, "head": head, "tables": tables, "deltas": all_of}
        self._point(new)
        for name in [n for n in deltas if len(all_of[n]) >= COMPACT]:
            self.read(name, (values or {}).get(name)).write.parquet(f"{base}/{name}-base")
            tables[name] = f"{base}/{name}-base"
            all_of.pop(name)
            self._point(new)
        return True

    def head(self) -> int | None:
        """The table's snapshot that the indexes reflect."""
        return self.pointer()["head"]

    def check_head(self, main: int | None) -> str:
        """``current`` where the indexes reflect main, ``behind`` where the table has moved without them."""
        return "current" if self.head() == main else "behind"

    def _point(self, new: dict) -> None:
        draft = self._path(f"{self.folder}/pointer-{uuid.uuid4().hex[:8]}.tmp")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._path(f"{self.folder}/pointer.json")), overwrite)
