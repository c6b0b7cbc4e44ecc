"""The log of transactions: what was decided, what was sent, what has to be settled after a stop.

Every change of a state is one small JSON file, named by transaction and step,
so writers never rewrite anything and the last step of a transaction counts.
The log is the control plane's (some thousands of open entries): states are
read as a DataFrame, decisions about single transactions are the driver's.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.sources.locations import Hadoop

#: States, and those that may follow each.
NEXT = {
    None: ("PREPARED",),
    "PREPARED": ("VALIDATED", "REJECTED", "ABORTED"),
    "VALIDATED": ("COMMITTING", "ABORTED"),
    "COMMITTING": ("COMMITTED", "ABORTED"),
    "COMMITTED": (),
    "REJECTED": (),
    "ABORTED": (),
}
FINAL = tuple(s for s, after in NEXT.items() if not after)
_SCHEMA = "txn string, step int, state string, table_id string, request string, snapshot long, answer string, at double"


class WrongState(ValueError):
    """A step that does not follow from a transaction's state."""


@dataclass
class TransactionLog:
    spark: SparkSession
    folder: str
    clock: Callable[[], float] = time.time

    def __post_init__(self):
        self._files = Hadoop(self.spark)
        self._path = self.spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/steps"))

    def steps(self) -> DataFrame:
        """All steps; a file that a stopped writer left unfinished has no whole JSON and is left out."""
        found = self.spark.read.schema(f"{_SCHEMA}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{self.folder}/steps")
        return found.where("txn is not null").drop("_corrupt_record")

    def states(self) -> DataFrame:
        """The last step of every transaction."""
        return self.steps().groupBy("txn").agg(F.max_by(F.struct("step", "state", "table_id", "request", "snapshot", "answer", "at"), "step").alias("s")).select("txn", "s.*")

    def _last(self, txn: str):
        return self.states().where(F.col("txn") == txn).first()

    def prepare(self, table: str, request: str) -> str:
        """Begin a transaction for a request; its id."""
        txn = uuid.uuid4().hex
        self._write({"txn": txn, "step": 0, "state": "PREPARED", "table_id": table, "request": request, "snapshot": None, "answer": None})
        return txn

    def move(self, txn: str, state: str, snapshot: int | None = None, answer: str | None = None) -> None:
        """The next step of a transaction. A repeated last step does nothing."""
        last = self._last(txn)
        if last is None:
            raise WrongState(f"unknown transaction {txn}")
        if last.state == state and (snapshot, answer) in ((None, None), (last.snapshot, last.answer)):
            return
        if state not in NEXT[last.state]:
            raise WrongState(f"{state} after {last.state}")
        row = {"txn": txn, "step": last.step + 1, "state": state, "table_id": last.table_id, "request": last.request, "snapshot": last.snapshot if snapshot is None else snapshot, "answer": last.answer if answer is None else answer}
        self._write(row)

    def _write(self, row: dict) -> None:
        name = f"{row['txn']}-{row['step']:04d}"
        draft, final = self._path(f"{self.folder}/steps/.{name}"), self._path(f"{self.folder}/steps/{name}.json")
        self._files.write(draft.toString(), (json.dumps(row | {"at": self.clock()}) + "\n").encode())
        if not self._fs.rename(draft, final):
            raise WrongState(f"step {row['step']} of {row['txn']} was written by another")

    def replay(self, request: str) -> str | None:
        """The answer recorded for a request that was finished before."""
        done = self.states().where((F.col("request") == request) & F.col("state").isin(*FINAL) & F.col("answer").isNotNull())
        row = done.orderBy(F.desc("at")).select("answer").first()
        return row.answer if row else None

    def recover(self, history: Callable[[str], set[int]]) -> dict[str, str]:
        """Settle what a stop left open: what was not sent aborts; what was sent is committed where the table's history has its snapshot."""
        settled = {}
        for row in self.states().where(~F.col("state").isin(*FINAL)).collect():  # open transactions: one a domain
            state = "COMMITTED" if row.state == "COMMITTING" and row.snapshot in history(row.table_id) else "ABORTED"
            self.move(row.txn, state)
            settled[row.txn] = state
        return settled

    def prune(self, older_than: float = 24 * 3600) -> int:
        """Drop the steps of transactions finished so many seconds ago; how many transactions."""
        gone = [r.txn for r in self.states().where(F.col("state").isin(*FINAL) & (F.col("at") < self.clock() - older_than)).select("txn").collect()]
        for txn in gone:
            for k in range(len(NEXT)):
                self._fs.delete(self._path(f"{self.folder}/steps/{txn}-{k:04d}.json"), False)
        return len(gone)


@dataclass
class FailureWindow:
    """Refuses a client after ``most`` failures within ``seconds`` of the first of them."""

    most: int = 10
    seconds: float = 60.0
    clock: Callable[[], float] = time.monotonic

    def __post_init__(self):
        self._first: dict[str, tuple[float, int]] = {}

    def failed(self, client: str) -> None:
        now = self.clock()
        first, n = self._first.get(client, (now, 0))
        self._first[client] = (now, 1) if now - first > self.seconds else (first, n + 1)

    def refused(self, client: str) -> bool:
        first, n = self._first.get(client, (0.0, 0))
        return n >= self.most and self.clock() - first <= self.seconds
