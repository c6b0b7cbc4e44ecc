"""Vectors, registration rules and random commits against a plain oracle."""

import random
import uuid
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.functions import encoding, transforms
from keelson.model import FK, NOT_NULL, PK, UNIQUE, Constraint, DefinitionError, Registry
from keelson.operators import validate
from keelson.plans import certify, domain
from keelson.sources import deletion_vectors as dv
from keelson.sources.index_store import IndexStore, StaleEpoch

SCHEMAS = {"customer": {"id": "bigint", "email": "string", "score": "double"}, "account": {"cust": "bigint", "region": "string", "aid": "bigint"}, "orders": {"oid": "bigint", "cust": "int", "region": "string"}}
ALL = [
    Constraint(1, PK, "customer", ("id",)), Constraint(2, UNIQUE, "customer", ("email",)), Constraint(3, NOT_NULL, "customer", ("score",)), Constraint(4, PK, "account", ("aid",)),
    Constraint(5, UNIQUE, "account", ("cust", "region"), nulls_distinct=False), Constraint(6, PK, "orders", ("oid",)), Constraint(7, FK, "orders", ("cust",), parent="customer", parent_columns=("id",)),
    Constraint(8, FK, "orders", ("cust", "region"), full=True, parent="account", parent_columns=("cust", "region")),
]


def registry():
    r = Registry(SCHEMAS)
    for c in ALL:
        r.register(c)
    return r


def test_murmur_vectors(spark):
    assert transforms.murmur3(b"iceberg") == 1210000089
    assert transforms.murmur3(uuid.UUID("f79c3e09-677c-4bbd-a479-3f349cb785e7").bytes) == 1488055340
    assert transforms.murmur3(bytes([0, 1, 2, 3])) == -188683207
    df = spark.createDataFrame([(34,), (17486,), (-5,)], "v long")
    got = {r.v: r.bucket for r in transforms.with_bucket_long(df, "v", 16).collect()}
    assert got == {v: (transforms.murmur3(v.to_bytes(8, "little", signed=True)) & 2147483647) % 16 for v in got}
    assert got[34] == 3


def test_transform_vectors(spark):
    row = spark.sql("select timestamp_ntz'2017-11-16 22:31:08' t, 1L a, -1L b, 10L c, -11L d, 'iceberg' s").select(
        transforms.year(F.col("t")), transforms.month(F.col("t")), transforms.day(F.col("t")), transforms.hour(F.col("t")), *[transforms.truncate(F.col(x), 10) for x in "abcd"], transforms.truncate_text(F.col("s"), 3)
    ).first()
    assert tuple(row) == (47, 574, 17486, 419686, 0, -10, 10, -20, "ice")


def test_key_encoding_vectors(spark):
    df = spark.createDataFrame([(1, "a\0"), (-1, ""), (None, None)], "i long, s string")
    got = [tuple(r) for r in df.select(encoding.key_hex([(F.col("i"), "integer")]), encoding.key_hex([(F.col("s"), "string")])).collect()]
    assert got[0] == ("0102018000000000000001", "0107016100FF0000")
    assert got[1][0] == "0102017FFFFFFFFFFFFFFF" and got[2] == ("010200", "010700")


def test_certificate_vectors(spark):
    t = "6c1b2d42-0000-4000-8000-000000000001"
    cs = [
        (Constraint(4, NOT_NULL, t, ("d",)), [4], None), (Constraint(1, PK, t, ("a",)), [1], None), (Constraint(5, PK, t, ("i",), enabled=False), [9], None),
        (Constraint(3, FK, "child-table", ("b",), full=True, parent=t, parent_columns=("a",)), [2], 1), (Constraint(2, UNIQUE, t, ("b", "c"), nulls_distinct=False), [2, 3], None),
    ]
    own = certify.constraint_set_digest(spark, 7, cs)
    assert own == "beefdb9fb8d82373d5d96d38044197d1317b589966b30184668eeed356c368cb"
    keys = spark.createDataFrame([(1, 1), (2, -1)], "k long, net long").select(F.unhex(encoding.key_hex([(F.col("k"), "integer")])).alias("key"), "net")
    delta = certify.key_delta_digest(spark, {2: keys.limit(0), 1: keys})
    assert delta == "e27cb3961b604010c23c1159871d47a9198c98fa9a33196236b226e969b12ea1"


def test_registration_rules():
    r = registry()
    with pytest.raises(DefinitionError):
        r.register(Constraint(9, PK, "customer", ("score",)))
    with pytest.raises(DefinitionError):
        r.register(Constraint(9, FK, "customer", ("id",), parent="customer", parent_columns=("id",)))
    with pytest.raises(DefinitionError):
        r.register(Constraint(9, FK, "orders", ("oid",), parent="customer", parent_columns=("score",)))
    with pytest.raises(DefinitionError):
        r.drop(1)
    r.drop(7)
    r.drop(1)


def _classify(c, row):
    values = [row[x] for x in c.columns]
    nulls = [v is None for v in values]
    if c.kind in (PK, NOT_NULL):
        return "violation" if any(nulls) else "key"
    if c.kind == FK and c.full:
        return "exempt" if all(nulls) else "violation" if any(nulls) else "key"
    return "exempt" if any(nulls) and (c.kind == FK or c.nulls_distinct) else "key"


def _oracle(r, table, state, added):
    """Codes by brute force over the state after the commit; only for states that were valid before."""
    found = set()
    for c in r.governing(table):
        if c.table == table:
            rows = state[table]
            if any(_classify(c, x) == "violation" for x in added):
                found.add((c.id, "INT-005" if c.kind == FK else "INT-007"))
            made = [tuple(x[k] for k in c.columns) for x in rows if _classify(c, x) == "key"]
            if c.kind in (PK, UNIQUE) and max(Counter(made).values(), default=0) > 1:
                found.add((c.id, c.duplicate_code))
        if c.kind == FK:
            parents = {tuple(x[k] for k in c.parent_columns) for x in state[c.parent]}
            children = {tuple(x[k] for k in c.columns) for x in state[c.table] if _classify(c, x) == "key"}
            if children - parents:
                found.add((c.id, "INT-005" if c.table == table else "INT-006"))
    return found


def test_random_commits_match_the_oracle(spark):
    rng, r = random.Random(5), registry()
    state = {t: [] for t in SCHEMAS}
    seen = set()

    def frame(table, rows):
        return spark.createDataFrame([tuple(x[c] for c in SCHEMAS[table]) for x in rows], ", ".join(f"{c} {k}" for c, k in SCHEMAS[table].items()))

    def cell(kind):
        v = rng.choice([None, 1, 2, 3, 1, 2, 3])
        return None if v is None else str(v) if kind == "string" else float(v) if kind == "double" else v

    for step in range(24):
        table = rng.choice(list(SCHEMAS))
        added = [{c: cell(k) for c, k in SCHEMAS[table].items()} for _ in range(rng.randint(1, 2))]
        removed = rng.sample(state[table], min(len(state[table]), rng.randint(0, 2)))
        unique = {c.id: frame(c.table, [x for x in state[c.table] if _classify(c, x) == "key"]).select(*c.columns) for c in ALL if c.kind in (PK, UNIQUE)}
        refs = {c.id: validate.reference_counts(frame(c.table, state[c.table]), c) for c in ALL if c.kind == FK}
        decision = validate.commit(r, table, frame(table, added), frame(table, removed), validate.Indexes(unique, refs))
        got = {(x.constraint_id, x.code) for x in validate.summary(decision.violations).collect()}
        after = {**state, table: [x for x in state[table] if not any(x is y for y in removed)] + added}
        assert got == _oracle(r, table, after, added), (step, table, added, removed)
        assert decision.errors.isEmpty()
        seen |= {code for _, code in got}
        if not got:
            state = after
    assert seen >= {"INT-003", "INT-005", "INT-007"}


def test_store_is_idempotent_and_ordered(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    one, two = spark.range(5), spark.range(7)
    assert store.apply({"u": one}, 1) and not store.apply({"u": one}, 1)
    with pytest.raises(StaleEpoch):
        store.apply({"u": two}, 1)
    one.write.parquet(str(tmp_path / "index" / "epoch=2-stopped" / "u"))  # a writer that stopped before the pointer
    assert store.read("u").count() == 5
    assert store.apply({"u": two}, 2) and store.read("u").count() == 7 and store.pointer()["epoch"] == 2


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 1 << 34), max_size=300))
def test_deletion_vectors_round_trip(values):
    blob = dv.encode(values)
    assert dv.decode(blob).tolist() == sorted(set(values))
    for bad in (blob[:-1], blob[:5] + bytes([blob[5] ^ 1]) + blob[6:], b""):
        with pytest.raises(dv.BadVector):
            dv.decode(bad)


def test_dense_deletion_vector():
    values = np.arange(10_000)
    assert (dv.decode(dv.encode(values)) == values).all()


def test_domains():
    edges = [("a", "b"), ("b", "c"), ("x", "y")]
    assert domain.component(edges, "c") == {"a", "b", "c"}
    assert domain.parents_first(edges, "abc") == ["c", "b", "a"]
    with pytest.raises(ValueError):
        domain.parents_first([("a", "b"), ("b", "a")], "ab")
    assert domain.ancestry({1: None, 2: 1}, 2) == [2, 1]
    assert domain.allowed_promotion("decimal(9,2)", "decimal(12,2)") and not domain.allowed_promotion("decimal(9,2)", "decimal(12,3)")
