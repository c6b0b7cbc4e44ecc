"""Certificates: a BLAKE3 chain over snapshots, and its verification.

Digests fold bytes in a fixed order, so they run on the driver; key deltas
arrive in key order through an iterator, one partition at a time. Good for
deltas of some millions of keys.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.model import FK, NOT_NULL, PK, Constraint

#: The format's domain prefixes and the certificate that begins a chain.
CONSTRAINTS, DELTA, CERTIFICATE = b"oip-constraints-v1", b"oip-key-delta-v1", b"oip-cert-v1"


class Hasher:
    """BLAKE3 of the JVM that Spark runs in; whole numbers are big-endian, lengths 32 bits."""

    def __init__(self, spark: SparkSession, prefix: bytes):
        self._h = spark.sparkContext._jvm.org.apache.commons.codec.digest.Blake3.initHash()
        self.raw(prefix)

    def raw(self, data: bytes) -> None:
        self._h.update(bytearray(data))

    def number(self, form: str, value: int) -> None:
        self.raw(struct.pack(f">{form}", value))

    def text(self, value: str) -> None:
        data = value.encode()
        self.number("I", len(data))
        self.raw(data)

    def fields(self, ids: Iterable[int]) -> None:
        ids = list(ids)
        self.number("I", len(ids))
        for i in ids:
            self.number("i", i)

    def hex(self) -> str:
        out = self._h.doFinalize(32)
        return bytes(b & 255 for b in out).hex()


def constraint_set_digest(spark: SparkSession, version: int, constraints: Iterable[tuple[Constraint, list[int], int | None]]) -> str:
    """Of enabled constraints by id; each with its columns' field ids and, for foreign keys, the parent key's id."""
    enabled = sorted(((c, f, p) for c, f, p in constraints if c.enabled), key=lambda x: x[0].id)
    h = Hasher(spark, CONSTRAINTS)
    h.number("Q", version)
    h.number("I", len(enabled))
    for c, fields, parent in enabled:
        h.number("Q", c.id)
        h.text(c.table)
        if c.kind == PK:
            h.number("B", 1)
            h.fields(fields)
        elif c.kind == FK:
            h.number("B", 3)
            h.fields(fields)
            h.text(c.parent or "")
            h.number("Q", parent or 0)
            h.number("B", int(c.full))
            h.number("B", 0)
        elif c.kind == NOT_NULL:
            h.number("B", 4)
            h.number("i", fields[0])
        else:
            h.number("B", 2)
            h.fields(fields)
            h.number("B", int(not c.nulls_distinct))
    return h.hex()


def key_delta_digest(spark: SparkSession, deltas: dict[int, DataFrame]) -> str:
    """Of net deltas (key binary, net long) by constraint id, each folded in key order."""
    h = Hasher(spark, DELTA)
    h.number("I", len(deltas))
    for i in sorted(deltas):
        rows = deltas[i].orderBy("key")
        h.number("Q", i)
        h.number("I", rows.count())
        for r in rows.toLocalIterator():
            h.number("I", len(r.key))
            h.raw(bytes(r.key))
            h.number("q", r.net)
    return h.hex()


def certificate(spark: SparkSession, table: str, snapshot: int, parent: int | None, constraint_set: str, key_delta: str, previous: str) -> str:
    h = Hasher(spark, CERTIFICATE)
    h.raw(uuid.UUID(table).bytes)
    h.number("q", snapshot)
    h.number("B", int(parent is not None))
    h.number("q", parent or 0)
    for digest in (constraint_set, key_delta, previous):
        h.raw(bytes.fromhex(digest))
    return h.hex()


def chain_statuses(chain: DataFrame) -> DataFrame:
    """Rows (chain_pos, snapshot, stored, recomputed, previous) with the status of each link.

    The first is the anchor; a missing certificate, one that is no hex digest, one that does not follow
    from the link before, and one that differs from what is recomputed have names of their own.
    """
    order = Window.partitionBy("table_id").orderBy("chain_pos")
    linked = chain.withColumn("before", F.lag("stored").over(order))
    status = F.when(F.col("chain_pos") == 0, "ANCHOR").when(F.col("stored").isNull(), "MISSING").when(~F.col("stored").rlike("^[0-9a-f]{64}$"), "MALFORMED")
    status = status.when(~F.col("previous").eqNullSafe(F.col("before")) | (F.col("stored") != F.col("recomputed")), "MISMATCH").otherwise("OK")
    return linked.withColumn("status", status).drop("before")


def chain_verdict(statuses: DataFrame) -> DataFrame:
    """Per table: whether all links hold, and the oldest that does not."""
    good = F.col("status").isin("OK", "ANCHOR")
    return statuses.groupBy("table_id").agg(F.bool_and(good).alias("ok"), F.min_by("snapshot", "chain_pos").alias("anchor"), F.min_by(F.when(~good, F.col("snapshot")), F.when(~good, F.col("chain_pos"))).alias("first_broken"))
