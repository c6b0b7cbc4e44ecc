"""Registered queries against their SQL on small tables that the given ones do not resemble."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from keelson import catalog_queries
from keelson.model import FK, PK, Constraint, Registry
from keelson.operators import changes
from keelson.sources.index_store import IndexStore
from keelson.streaming import commits


def _written(folder, **tables):
    """Tables of columns as files, one for each list of rows."""
    con = duckdb.connect()
    for name, (schema, files) in tables.items():
        (folder / f"{name}.parquet").mkdir(parents=True)
        for k, rows in enumerate(files):
            pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema), folder / f"{name}.parquet" / f"{k}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


def _both(spark, con, folder, name):
    """The rows of a query and of its SQL, each sorted."""
    want = con.execute(catalog_queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = catalog_queries.queries()[name](spark, str(folder)).select(*columns).collect()
    return sorted(map(repr, map(tuple, got))), sorted(map(repr, want.fetchall()))


SUPPLIER = pa.schema([("s_suppkey", pa.int64()), ("s_name", pa.string()), ("s_nationkey", pa.int32()), ("s_acctbal", pa.float64())])


def test_new_equality_deletes_of_every_nation(spark, tmp_path):
    rows = [(100 * n + k, f"s{n}", n, b) for n in range(25) for k, b in enumerate((-5.0, 100.0, 7999.0, 8000.0, 9500.0))]
    got, want = _both(spark, _written(tmp_path, supplier=(SUPPLIER, [rows])), tmp_path, "refuse_partitioned_upsert")
    assert got == want and len(want) == 2 + 3 * 8  # nation 19's deletes, three old files of each nation of the other spec up to 14


def test_partitioned_equality_deletes_of_several_specs(spark):
    files = lambda *rows: spark.createDataFrame(rows, "path string, content int, spec_id int, partition string")
    old = files(("a", 0, 0, "x"), ("b", 0, 1, "x"))
    found = changes.partitioned_upsert(old, old.union(files(("d", 2, 0, "x"), ("e", 2, 1, "y"), ("g", 2, 1, None))), [0])
    assert sorted((r.path, r.reason[:20]) for r in found.collect()) == [("b", "of another spec than"), ("d", "equality deletes of "), ("e", "equality deletes of "), ("e", "its spec is not comp")]


LINEITEM = pa.schema([("l_orderkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_partkey", pa.int64()), ("l_returnflag", pa.string()), ("l_linestatus", pa.string())])


def test_rewritten_rows_beside_equal_keys(spark, tmp_path):
    """Repeats of a key with other flags or none, equal rows, and numbers that the rewriting meets."""
    flags = [("R", "F"), ("N", "O"), ("A", "F"), ("R", "F"), (None, "F"), ("R", None)]
    files = [[(k, n, k % 3, *flags[(k * n + f) % 6]) for k in range(40) for n in (1, 1, 2, 1001, 2001)] for f in range(6)]
    got, want = _both(spark, _written(tmp_path, lineitem=(LINEITEM, files)), tmp_path, "replace_changes_rows")
    assert got == want and len(want) == 2 * sum(r[3:] == ("R", "F") for f in files for r in f)


def test_a_commit_of_many_files_is_one_batch(spark, tmp_path):
    """Each commit is one micro-batch whatever its number of files, and no task of the stream reads more than its part."""
    schemas = {"p": {"k": "bigint"}, "c": {"k": "bigint", "ref": "bigint"}}
    registry = Registry(schemas)
    for c in (Constraint(1, PK, "p", ("k",)), Constraint(2, PK, "c", ("k",)), Constraint(3, FK, "c", ("ref",), "child", parent="p", parent_columns=("k",))):
        registry.register(c)
    store, schema = IndexStore(spark, f"{tmp_path}/index"), "k long, ref long, op int"
    commits.install(store, registry, {"p": spark.range(5).toDF("k"), "c": spark.createDataFrame([], "k long, ref long")})
    rows = lambda ids, op: spark.range(*ids, 1, 4).select(F.col("id").alias("k"), (F.col("id") % 5).alias("ref"), F.lit(op).alias("op"))
    for name, parts in (("a", [rows((0, 100), 1)]), ("b", [rows((50, 60), -1), rows((100, 110), 1)]), ("c", [rows((0, 10), 1), rows((200, 300), 1)]), ("d", [])):
        for k, part in enumerate(parts):
            part.write.parquet(f"{tmp_path}/in/{name}{k}")
        commits.announce(spark, f"{tmp_path}/waiting", name, [f"{tmp_path}/in/{name}{k}" for k in range(len(parts))])
        if name == "b":  # two commits wait, two come later
            commits.validate_stream(spark, commits.announced(spark, f"{tmp_path}/waiting"), registry, "c", store, f"{tmp_path}/out", f"{tmp_path}/checkpoint", schema)
    before = {k: spark.conf.get(k) for k in commits.PARTS}
    commits.validate_stream(spark, commits.announced(spark, f"{tmp_path}/waiting"), registry, "c", store, f"{tmp_path}/out", f"{tmp_path}/checkpoint", schema)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"batch={k}" for k in range(4)]
    assert [(r.batch, r.code, r.violation_count) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(2, "INT-003", 10)]
    assert sorted(r.k for r in store.read(commits.unique_name(2)).collect()) == [*range(50), *range(60, 110)]
    assert before == {k: spark.conf.get(k) for k in commits.PARTS}  # the session that started the stream keeps its own
    with pytest.raises(FileExistsError):
        commits.announce(spark, f"{tmp_path}/waiting", "a", [])


def test_no_task_of_the_stream_writes_a_whole_commit(spark, tmp_path, monkeypatch):
    """Orders in several files stay several change files."""
    schema = pa.schema([("o_orderkey", pa.int64()), ("o_custkey", pa.int64()), ("o_orderstatus", pa.string()), ("o_totalprice", pa.float64()), ("o_orderpriority", pa.string())])
    orders = [[(10 * f + k, k % 3, "FOP"[k % 3], 1.0, ("1-URGENT", "5-LOW")[k % 2]) for k in range(10)] for f in range(4)]
    customer = pa.schema([("c_custkey", pa.int64())])
    con = _written(tmp_path / "in", orders=(schema, orders), customer=(customer, [[(k,) for k in range(3)]]))
    monkeypatch.setattr(catalog_queries, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    own.conf.set("spark.sql.files.openCostInBytes", "1k")
    got, want = _both(own, con, tmp_path / "in", "stream_commits")
    assert got == want
    for name in "ab":
        assert len(list((tmp_path / "stream" / "in" / name).glob("part-*.parquet"))) > 1
