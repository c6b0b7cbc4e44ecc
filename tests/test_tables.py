"""Table files, change rules, requests, logs, signatures and administration on small cases."""

import datetime
import decimal
import json
import random
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.functions import encoding, text, transforms
from keelson.model import FK, PK, UNIQUE, Constraint, DefinitionError, Registry
from keelson.operators import deletes, delta, validate
from keelson.plans import admin, requests, signing
from keelson.sources import avro, locations, manifests, metadata, transactions
from keelson.sources import rows as file_rows
from keelson.sources.index_store import COMPACT, IndexStore
from keelson.streaming import commits
from keelson.table_queries import TABLE


@settings(max_examples=50, deadline=None)
@given(st.lists(st.fixed_dictionaries({"a": st.integers(-(1 << 62), 1 << 62), "b": st.one_of(st.none(), st.text()), "c": st.lists(st.booleans()), "d": st.binary(), "e": st.floats(allow_nan=False)}), max_size=20), st.sampled_from(["null", "deflate"]))
def test_avro_round_trip(records, codec):
    fields = [("a", "long"), ("b", ["null", "string"]), ("c", {"type": "array", "items": "boolean"}), ("d", "bytes"), ("e", "double")]
    schema = {"type": "record", "name": "r", "fields": [{"name": n, "type": t} for n, t in fields]}
    data = avro.write(schema, records, {"k": "v"}, codec)
    meta, got = avro.read(data)
    assert got == records and meta["k"] == b"v"


def test_damaged_avro_is_an_error():
    data = manifests.write_manifest([{"status": 1, "data_file": {"content": 0, "file_path": "f", "file_format": "PARQUET", "partition": {}, "record_count": 1}}], [])
    r = random.Random(1)
    for _ in range(300):
        bad = bytearray(data)
        bad[r.randrange(len(bad))] ^= 1 << r.randrange(8)
        try:
            avro.read(bytes(bad[: r.randint(1, len(bad))]))
        except (avro.BadAvro, ValueError, KeyError, IndexError, TypeError, Exception) as e:
            assert not isinstance(e, MemoryError)
    with pytest.raises(avro.BadAvro):
        avro.read(data[:-1])


def test_metadata_and_locations():
    t = metadata.read(TABLE)
    assert (t.main, t.locations, t.schemas[0].lookup(1).type, t.schemas[0].lookup(9)) == (2, ["file:///t"], "int", "missing")
    nested = metadata.Schema.of({"fields": [{"id": 1, "name": "s", "type": {"type": "struct", "fields": [{"id": 2, "name": "x", "type": "int"}]}}]})
    assert nested.lookup(2) == "nested" and nested.lookup(1).type == "nested"
    with pytest.raises(metadata.BadMetadata):
        metadata.read("{}")
    assert locations.normalized("s3a://b/x") == "s3://b/x" and locations.normalized("file:/a") == locations.normalized("/a") == locations.normalized("file:///a")
    assert locations.normalized("/a/../b") is None and locations.normalized("gs://b//x") is None
    files = locations.Confined(locations.Memory({"/t/a": b"12345", "/u/a": b""}), t.locations, 8)
    assert files.read("/t/a") == b"12345" and files.read_range("/t/a", 1, 2) == b"23"
    with pytest.raises(locations.OverBudget):
        files.read("/t/a")
    for outside in ("/u/a", "/t/../u/a", "/tt/a"):
        with pytest.raises(locations.Outside):
            files.read(outside)


def test_requirements():
    t = metadata.read(TABLE)
    need = lambda **r: requests.check_requirements(t, requests.Request([r], []))
    need(type="assert-table-uuid", uuid="u")
    need(**{"type": "assert-ref-snapshot-id", "ref": "main", "snapshot-id": 2})
    need(**{"type": "assert-ref-snapshot-id", "ref": "none", "snapshot-id": None})
    need(**{"type": "assert-current-schema-id", "current-schema-id": 0})
    with pytest.raises(requests.Stale):
        need(**{"type": "assert-ref-snapshot-id", "ref": "main", "snapshot-id": 1})
    for kind in ("assert-create", "assert-weather"):
        with pytest.raises(requests.Unsupported):
            need(type=kind)
    with pytest.raises(requests.Unsupported):
        requests.read(json.dumps({"updates": [{}]}))


def test_field_ids(spark, tmp_path):
    at = str(tmp_path / "f")
    column = lambda e, i, n: e.alias(n, metadata={file_rows.ID: i})
    spark.range(5).select(column(F.col("id").cast("int"), 7, "old_name"), column(F.struct(column(F.lit(1), 9, "x")), 8, "s")).coalesce(1).write.parquet(at)
    got = file_rows.read(spark, [at], {7: ("k", "bigint"), 6: ("missing", "string")})
    assert [tuple(r)[1:] for r in got.orderBy("pos").collect()] == [(k, k, None) for k in range(5)]
    with pytest.raises(metadata.BadMetadata):
        file_rows.read(spark, [at], {9: ("x", "int")})
    with pytest.raises(metadata.BadMetadata):
        file_rows.read(spark, [at], {7: ("k", "string")})
    spark.range(2).write.parquet(str(tmp_path / "plain"))
    with pytest.raises(metadata.BadMetadata):
        file_rows.read(spark, [str(tmp_path / "plain")], {1: ("id", "bigint")})
    doubled = spark.range(2).select(column(F.col("id"), 1, "a"), column(F.col("id"), 1, "b")).schema
    with pytest.raises(metadata.BadMetadata):
        file_rows.resolve(doubled, [1])


KEYS = st.lists(st.one_of(st.none(), st.integers(-(1 << 63), (1 << 63) - 1)), min_size=1, max_size=4)


def test_keys_round_trip_and_sort(spark):
    r = random.Random(2)
    rows = [(r.randint(-(1 << 63), (1 << 63) - 1), decimal.Decimal(r.randint(-(10**30), 10**30)).scaleb(-4), "".join(r.choice("\0aé😀") for _ in range(r.randint(0, 5))), bytes(r.choice([0, 1, 255]) for _ in range(4)), str(uuid.UUID(int=r.getrandbits(128))), datetime.date(1900, 1, 1) + datetime.timedelta(r.randint(0, 90000)), r.random() < 0.5) for _ in range(300)]
    rows += [(None,) * 7, (0, decimal.Decimal("0.0000"), "", b"", str(uuid.UUID(int=0)), datetime.date(1970, 1, 1), False)]
    table = spark.createDataFrame(rows, "i long, d decimal(38,4), s string, b binary, u string, t date, o boolean")
    kinds = [("i", "integer"), ("d", "decimal:4"), ("s", "string"), ("b", "binary"), ("u", "uuid"), ("t", "date"), ("o", "boolean")]
    got = table.select("*", F.unhex(encoding.key_hex([(F.col(c), k) for c, k in kinds])).alias("key")).collect()
    for x in got:
        values = [v for _, v in encoding.decode(bytes(x.key))]
        assert values == [x.i, x.d, x.s, x.b, None if x.u is None else uuid.UUID(x.u), x.t, x.o]
        for bad in (bytes(x.key)[:-1], bytes(x.key) + b"\2", b"\2" + bytes(x.key)[1:], b""):
            with pytest.raises(encoding.BadKey):
                encoding.decode(bad)
    one = [tuple(x) for x in table.select("d", F.unhex(encoding.key_hex([(F.col("d"), "decimal:4")]))).where("d is not null").collect()]
    assert [d for d, _ in sorted(one, key=lambda x: bytes(x[1]))] == sorted(d for d, _ in one)


def test_fixed_vectors_of_transforms(spark):
    """Values that the table format's specification gives."""
    assert transforms.murmur3(bytes([0, 1, 2, 3])) == -188683207
    row = spark.sql("select cast('14.20' as decimal(9,2)) as d, cast('-0.05' as decimal(9,2)) as n, unhex('00010203') as b")
    packed = row.select(transforms.decimal_bytes(2)("d").alias("d")).first().d
    assert transforms.murmur3(bytes(packed)) == -500754589
    got = row.select(transforms.truncate_decimal(F.col("n"), 10, 2).alias("t"), transforms.bucket_bytes(16)("b").alias("k"), transforms.truncate_binary(F.col("b"), 2).alias("h")).first()
    assert (got.t, got.k, bytes(got.h)) == (decimal.Decimal("-0.10"), (-188683207 & 2147483647) % 16, b"\0\1")


def test_transform_names():
    assert transforms.parse("bucket[16]") == transforms.Transform("bucket", 16) and transforms.parse(" void ") == transforms.Transform("void")
    assert [transforms.parse(x) for x in ("bucket[0]", "truncate", "bucket[x]", "zorder", "")] == [None] * 5
    t = transforms.parse
    assert transforms.supports(t("hour"), "timestamp") and not transforms.supports(t("hour"), "date") and transforms.supports(t("truncate[3]"), "decimal(9,2)") and not transforms.supports(t("bucket[3]"), "double")
    spec = [{"source-id": 1, "transform": "bucket[4]"}, {"source-id": 2, "transform": "void"}]
    assert transforms.key_determined(spec, {1: "bigint", 2: "string"}) and not transforms.key_determined(spec, {1: "bigint"}) and not transforms.key_determined(spec[1:], {2: "string"})


def test_small_texts():
    assert (text.duration("90s"), text.duration("7d"), text.byte_size("2GiB"), text.byte_size("10 mb"), text.byte_size("5")) == (90, 604800, 2 << 30, 10**7, 5)
    for bad in ("", "s", "3y", "-1s", "99999999999999999999d"):
        with pytest.raises(ValueError):
            text.duration(bad)
    name = "a b/é%~"
    assert text.escaped(name) == "a%20b%2F%C3%A9%25~" and text.unescaped(text.escaped(name)) == name
    assert text.unescaped("%2") is None and text.unescaped("%FF") is None
    assert [text.ambiguous(p) for p in ("/v1/a", "/v1/%2e%2E/a", "/a\\b", "/a%2Fb", "/a%1Fb", "/./a", "/%zz")] == [False, True, True, True, False, True, True]
    state = {"b": 5, "a": None}
    assert text.domain_state(state) == "a@-,b@5" and text.read_domain_state("a@-,b@5") == state and text.read_domain_state("a") is None and text.read_domain_state("") == {}


def test_signatures(spark):
    """The first two vectors of RFC 8032."""
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public = bytes.fromhex("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")
    wanted = bytes.fromhex("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b")
    assert signing.public_key(seed) == public and signing.sign(spark, seed, b"") == wanted and signing.verify(spark, public, b"", wanted)
    assert signing.public_key(bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")).hex() == "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c"
    assert not signing.verify(spark, public, b"x", wanted) and not signing.verify(spark, bytes([1]) + bytes(31), b"", wanted)
    late = wanted[:32] + (int.from_bytes(wanted[32:], "little") + signing.ORDER).to_bytes(32, "little")
    assert not signing.verify(spark, public, b"", late)
    with pytest.raises(ValueError):
        signing.into_summary({signing.CERTIFICATE: "x"}, "y", 1)


def test_transaction_log(spark, tmp_path):
    now = [1000.0]
    log = transactions.TransactionLog(spark, str(tmp_path / "log"), clock=lambda: now[0])
    a, b = log.prepare("t", "one"), log.prepare("t", "two")
    with pytest.raises(transactions.WrongState):
        log.move(a, "COMMITTED")
    for state in ("VALIDATED", "COMMITTING", "COMMITTED", "COMMITTED"):
        log.move(a, state, answer="200" if state == "COMMITTED" else None)
    assert log.replay("one") == "200" and log.replay("two") is None
    (tmp_path / "log" / "steps" / "x-0000.json").write_text('{"txn": "x", "st')
    assert log.recover(lambda t: set()) == {b: "ABORTED"} and log.recover(lambda t: set()) == {}
    now[0] += 10
    assert log.prune(3600) == 0
    now[0] += 3600
    assert log.prune(3600) == 2 and log.states().count() == 0
    window = transactions.FailureWindow(2, 60, clock=lambda: now[0])
    window.failed("c")
    assert not window.refused("c")
    window.failed("c")
    assert window.refused("c") and not window.refused("d")
    now[0] += 61
    assert not window.refused("c")


SCHEMAS = {"p": {"k": "bigint"}, "c": {"k": "bigint", "ref": "bigint"}}


def _registry():
    r = Registry(SCHEMAS)
    for c in (Constraint(1, PK, "p", ("k",)), Constraint(2, UNIQUE, "c", ("k",), nulls_distinct=False), Constraint(3, FK, "c", ("ref",), parent="p", parent_columns=("k",))):
        r.register(c)
    return r


def test_a_batch_that_runs_twice(spark, tmp_path):
    store, registry = IndexStore(spark, str(tmp_path / "index")), _registry()
    p = spark.range(5).toDF("k")
    c = lambda rows: spark.createDataFrame(rows, "k long, ref long, op int")
    commits.install(store, registry, {"p": p, "c": c([]).drop("op")})
    run = commits.batch_of(registry, "c", store, str(tmp_path / "out"))
    verdicts = lambda: sorted((r.batch, r.code, r.violation_count) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    first = c([(1, 1, 1), (None, 2, 1)])
    for _ in range(2):
        run(first, 0)
    assert verdicts() == [] and store.read(commits.unique_name(2)).count() == 2
    run(c([(None, 2, -1), (7, 9, 1)]), 1)  # the NULL key leaves, a parent is missing: nothing moves
    assert verdicts() == [(1, "INT-005", 1)] and store.read(commits.unique_name(2)).count() == 2
    for _ in range(2):
        run(c([(None, 2, -1), (7, 2, 1)]), 2)
    assert sorted(r.k for r in store.read(commits.unique_name(2)).collect()) == [1, 7]
    assert sorted(tuple(r) for r in store.read(commits.reference_name(3), commits.COUNT).collect()) == [(1, 1), (2, 1)]
    for n in range(3, 3 + COMPACT):
        run(c([(100 + n, 3, 1)]), n)
    assert len(store.pointer()["deltas"].get(commits.unique_name(2), [])) < COMPACT
    assert store.read(commits.unique_name(2)).count() == 2 + COMPACT
    assert {r.k: r.child_count for r in store.read(commits.reference_name(3), commits.COUNT).collect()}[3] == COMPACT


def test_administration(spark, tmp_path):
    r = Registry(SCHEMAS)
    r.register(Constraint(1, PK, "p", ("k",)))
    domains = admin.Domains(spark, r, IndexStore(spark, str(tmp_path / "index")))
    tables = {"p": spark.range(3).toDF("k"), "c": spark.createDataFrame([(1, 1), (2, 9)], "k long, ref long")}
    fk = Constraint(3, FK, "c", ("ref",), "child", parent="p", parent_columns=("k",))
    refused = domains.register(fk, tables)
    assert (refused.table, refused.code) == ("c", "INT-013") and 3 not in r.constraints
    assert [json.loads(x.report)["sample_keys"] for x in admin.report(refused.violations).collect()] == [["9"]]
    tables["c"] = tables["c"].where("ref = 1")
    assert domains.register(fk, tables).table is None and {x.table_name: x.state for x in domains.status().collect()} == {"p": "healthy", "c": "healthy"}
    assert domains.admit("c", None) is None and domains.admit("c", 77) == "INT-015"
    broken = {"p": spark.createDataFrame([(1,), (1,)], "k long"), "c": tables["c"]}
    assert domains.rebuild("c", broken).table == "p" and domains.admit("c", None) == "INT-010"
    assert domains.rebuild("c", tables).table is None and domains.admit("p", None) is None
    with pytest.raises(DefinitionError):
        domains.drop(1)
    domains.disable("p")
    domains.drop(3)
    assert [x.action for x in domains.audit(1).collect()] == ["register", "rebuild", "rebuild", "disable", "drop"]
    rows = spark.createDataFrame([(0.001,), (0.002,), (99.0,)], "s double")
    lines = admin.metrics_text({"commits": 2}, delta.histogram(rows, "s", []), "wait")
    assert 'wait_bucket{le="0.001"} 1' in lines and 'wait_bucket{le="+Inf"} 3' in lines and "wait_count 3" in lines


def test_catching_up(spark, tmp_path):
    store, registry = IndexStore(spark, str(tmp_path / "index")), _registry()
    commits.install(store, registry, {"p": spark.range(5).toDF("k"), "c": spark.createDataFrame([], "k long, ref long")})
    row = lambda k, ref: spark.createDataFrame([(k, ref)], "k long, ref long")
    changes = {10: (row(1, 1), row(1, 1).limit(0)), 11: (row(2, 1), row(1, 1)), 12: (row(2, 1), row(1, 1).limit(0))}
    assert admin.catch_up([10, 11], 5, changes.__getitem__, registry, "c", store) == 2 and store.head() == 11
    with pytest.raises(admin.CannotCatchUp):
        admin.catch_up([12], 5, changes.__getitem__, registry, "c", store)
    with pytest.raises(admin.CannotCatchUp):
        admin.catch_up([12, 13, 14], 2, changes.__getitem__, registry, "c", store)
    assert store.head() == 11 and admin.identify("x", {"x": "c"}) == "c"
    missed = {"a": [(2, {"b": 5}), (3, {"b": 6})], "b": [(6, {"a": 2})]}
    assert admin.catch_up_order(missed, {"a": 1, "b": 5}) == [("a", 2), ("b", 6), ("a", 3)]
    with pytest.raises(admin.CannotCatchUp):
        admin.catch_up_order({"a": [(2, {"b": 9})]}, {"a": 1, "b": 5})


def test_rules_of_deletes(spark):
    files = spark.createDataFrame([("f", 0, None, 1, 9), ("g", 0, None, 1, 9), ("h", None, None, 1, 9)], "path string, spec_id int, partition string, sequence long, record_count long")
    named = spark.createDataFrame([("d", 0, None, 5, "f"), ("e", 0, None, None, None)], "path string, spec_id int, partition string, sequence long, referenced_data_file string")
    positions = spark.createDataFrame([("d", "f", 1), ("d", "g", 2), ("e", "f", 3), ("d", "h", 4)], "delete_path string, target_path string, pos long")
    assert [tuple(r) for r in deletes.reaching_deletes(positions, named, files).collect()] == [("f", 1)]
    assert sorted(r.path for r in deletes.unknown_reach(named, files).collect()) == ["e", "h"]


def test_keys_for_people_differ(spark):
    rows = [("a,b", "c"), ("a", "b,c"), (None, "x"), ("NULL", "x"), ("", "x"), ('"', "x"), ("\\", "x"), ('\\"', "x")]
    got = [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(validate.key_text(["x", "y"])).collect()]
    assert len(set(got)) == len(rows) and got[2] == "NULL,x"
