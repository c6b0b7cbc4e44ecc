"""The registered queries and the SQL that each must equal.

The tables hold neither NULLs nor orphans, so changes, NULLs and dangling keys
come from arithmetic on keys, the same in both forms.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.functions import encoding, transforms
from keelson.model import FK, NOT_NULL, PK, UNIQUE, Constraint, Registry
from keelson.operators import deletes, keys, validate
from keelson.plans import certify, domain
from keelson.sources import deletion_vectors
from keelson.sources.index_store import IndexStore
from keelson.streaming import commits

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _null_every(column: str, n: int) -> Column:
    return F.when(F.col(column) % n != 0, F.col(column))


SCHEMAS = {
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double"},
    "lineitem": {"l_orderkey": "bigint", "l_linenumber": "int", "l_partkey": "bigint", "l_suppkey": "bigint"},
    "part": {"p_partkey": "bigint", "p_name": "string"},
}
PK_CUSTOMER = Constraint(1, PK, "customer", ("c_custkey",))
PK_ORDERS = Constraint(2, PK, "orders", ("o_orderkey",))
NN_PRICE = Constraint(3, NOT_NULL, "orders", ("o_totalprice",), "price_present")
FK_CUSTOMER = Constraint(4, FK, "orders", ("o_custkey",), parent="customer", parent_columns=("c_custkey",))
UQ_STATUS = Constraint(5, UNIQUE, "orders", ("o_custkey", "o_orderstatus"), "one_open_order")


def _registry(*constraints: Constraint) -> Registry:
    r = Registry(SCHEMAS)
    for c in constraints:
        r.register(c)
    return r


# Whole tables


@_register("SELECT CAST(1 AS BIGINT) AS constraint_id, 'pk_lineitem' AS \"constraint\", 'lineitem' AS table_name, 'INT-003' AS code, count(*) AS violation_count FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def onboard_pk_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    c = Constraint(1, PK, "lineitem", ("l_orderkey", "l_linenumber"), "pk_lineitem")
    return validate.summary(validate.onboard_table(_t(spark, sf, "lineitem"), [c], {}))


_CLEAN = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey"}


@_register(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS key_count, count(*) FILTER (WHERE n > 1) AS duplicate_keys FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})" for t, k in _CLEAN.items()))
def onboard_pk_clean(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for t, k in _CLEAN.items():
        one = keys.counts(_t(spark, sf, t).select(k)).agg(F.count("*").alias("key_count"), F.count_if(F.col("n") > 1).alias("duplicate_keys")).select(F.lit(t).alias("table_name"), "*")
        out = one if out is None else out.union(one)
    return out


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select(F.when(F.col("p_partkey") % 10 != 0, F.col("p_name")).alias("p_name"))


_NAMES_SQL = "SELECT CASE WHEN p_partkey % 10 <> 0 THEN p_name END AS p_name FROM part"


@_register(f"SELECT p_name, count(*) AS n FROM ({_NAMES_SQL}) WHERE p_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def unique_nulls_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return keys.duplicates(keys.keys_of(_names(spark, sf), Constraint(1, UNIQUE, "part", ("p_name",))))


@_register(f"SELECT p_name, count(*) AS n FROM ({_NAMES_SQL}) GROUP BY 1 HAVING count(*) > 1")
def unique_nulls_not_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return keys.duplicates(keys.keys_of(_names(spark, sf), Constraint(1, UNIQUE, "part", ("p_name",), nulls_distinct=False)))


@_register("SELECT CAST(3 AS BIGINT) AS constraint_id, 'price_present' AS \"constraint\", 'orders' AS table_name, 'INT-007' AS code, count(*) AS violation_count FROM orders WHERE o_orderkey % 10 = 0")
def not_null_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    return validate.summary(validate.onboard_table(rows, [NN_PRICE], {}))


@_register("SELECT CAST(2 AS BIGINT) AS constraint_id, 'primary_key_orders' AS \"constraint\", 'orders' AS table_name, 'INT-007' AS code, count(*) AS violation_count FROM orders WHERE o_orderkey % 10 = 0")
def pk_null_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "orders").select(_null_every("o_orderkey", 10).alias("o_orderkey"))
    return validate.summary(validate.onboard_table(rows, [PK_ORDERS], {}))


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = _t(spark, sf, "lineitem")
    parent = items.select(F.when(F.col("l_partkey") % 7 == 3, -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("l_partkey"), "l_suppkey").distinct()
    child = items.select(_null_every("l_partkey", 11).alias("l_partkey"), _null_every("l_suppkey", 5).alias("l_suppkey"))
    return parent, child


_PAIRS = """WITH parent AS (SELECT DISTINCT CASE WHEN l_partkey % 7 = 3 THEN -l_partkey ELSE l_partkey END AS p, l_suppkey AS s FROM lineitem),
child AS (SELECT CASE WHEN l_partkey % 11 <> 0 THEN l_partkey END AS p, CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey END AS s FROM lineitem),
dangling AS (SELECT DISTINCT p, s FROM child c WHERE p IS NOT NULL AND s IS NOT NULL AND NOT EXISTS (SELECT 1 FROM parent q WHERE q.p = c.p AND q.s = c.s))
"""


def _fk(full: bool) -> Constraint:
    return Constraint(6, FK, "lineitem", ("l_partkey", "l_suppkey"), "supply", full=full, parent="supply", parent_columns=("l_partkey", "l_suppkey"))


@_register(_PAIRS + "SELECT CAST(6 AS BIGINT) AS constraint_id, 'supply' AS \"constraint\", 'lineitem' AS table_name, 'INT-005' AS code, count(*) AS violation_count FROM dangling")
def fk_simple_onboard(spark: SparkSession, sf: str) -> DataFrame:
    parent, child = _pairs(spark, sf)
    return validate.summary(validate.onboard_table(child, [_fk(False)], {6: parent}))


@_register(_PAIRS + "SELECT CAST(6 AS BIGINT) AS constraint_id, 'supply' AS \"constraint\", 'lineitem' AS table_name, 'INT-005' AS code, (SELECT count(*) FROM dangling) + (SELECT count(*) FROM child WHERE (p IS NULL) <> (s IS NULL)) AS violation_count")
def fk_full_onboard(spark: SparkSession, sf: str) -> DataFrame:
    parent, child = _pairs(spark, sf)
    return validate.summary(validate.onboard_table(child, [_fk(True)], {6: parent}))


@_register("SELECT o_custkey AS c_custkey, count(*) AS child_count FROM orders GROUP BY 1")
def reference_counts(spark: SparkSession, sf: str) -> DataFrame:
    return validate.reference_counts(_t(spark, sf, "orders"), FK_CUSTOMER)


# Deltas


@_register("SELECT o_custkey, CAST(sum(w) AS BIGINT) AS net FROM (SELECT o_custkey, 1 AS w FROM orders UNION ALL SELECT c_custkey, -1 FROM customer) GROUP BY 1 HAVING sum(w) <> 0")
def net_delta(spark: SparkSession, sf: str) -> DataFrame:
    return keys.net_delta(_t(spark, sf, "orders").select("o_custkey"), _t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")))


@_register("SELECT count(*) AS changed_keys FROM (SELECT o_orderkey, count(*) FILTER (WHERE w = 1) - count(*) FILTER (WHERE w = -1) AS n FROM (SELECT o_orderkey, 1 AS w FROM orders UNION ALL SELECT o_orderkey, -1 FROM orders) GROUP BY 1) WHERE n <> 0")
def net_delta_zero_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "orders").select("o_orderkey")
    return keys.net_delta(rows, rows).agg(F.count("*").alias("changed_keys"))


@_register("SELECT o_orderkey, CAST(2 AS BIGINT) AS added, CAST(1 AS BIGINT) AS removed FROM orders")
def dup_before_net(spark: SparkSession, sf: str) -> DataFrame:
    old = _t(spark, sf, "orders").select("o_orderkey")
    found = keys.sides(old.union(old), old).where("a > 1")
    return found.select("o_orderkey", F.col("a").alias("added"), F.col("r").alias("removed"))


# Commits


def _append(spark: SparkSession, sf: str) -> DataFrame:
    """Orders again under shifted keys: most are new, every seventh exists, every 97th customer does not."""
    old = _t(spark, sf, "orders")
    top = F.lit(10_000_000)
    return old.select(
        F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey")).otherwise(F.col("o_orderkey") + top).alias("o_orderkey"),
        F.when(F.col("o_orderkey") % 97 == 0, F.col("o_custkey") + top).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 50 != 1, F.col("o_totalprice")).alias("o_totalprice"),
    )


_APPEND = """appended AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey ELSE o_orderkey + 10000000 END AS o_orderkey,
 CASE WHEN o_orderkey % 97 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS o_custkey, o_orderstatus,
 CASE WHEN o_orderkey % 50 <> 1 THEN o_totalprice END AS o_totalprice FROM orders)"""


def _indexes(spark: SparkSession, sf: str) -> validate.Indexes:
    orders = _t(spark, sf, "orders")
    unique = {1: _t(spark, sf, "customer").select("c_custkey"), 2: orders.select("o_orderkey")}
    return validate.Indexes(unique, {4: validate.reference_counts(orders, FK_CUSTOMER)})


def _none(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


_ROW = "CAST({} AS BIGINT) AS constraint_id, '{}' AS \"constraint\", '{}' AS table_name, '{}' AS code, "
_APPEND_PARTS = f"""SELECT {_ROW.format(2, 'primary_key_orders', 'orders', 'INT-003')} count(DISTINCT o_orderkey) AS violation_count FROM appended a WHERE o_orderkey IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT {_ROW.format(3, 'price_present', 'orders', 'INT-007')} count(*) FROM appended WHERE o_totalprice IS NULL
UNION ALL SELECT {_ROW.format(4, 'foreign_key_orders', 'orders', 'INT-005')} count(DISTINCT o_custkey) FROM appended WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"""


@_register(f"WITH {_APPEND} {_APPEND_PARTS}")
def commit_append_violations(spark: SparkSession, sf: str) -> DataFrame:
    added = _append(spark, sf)
    found = validate.commit(_registry(PK_CUSTOMER, PK_ORDERS, NN_PRICE, FK_CUSTOMER), "orders", added, _none(added), _indexes(spark, sf))
    return validate.summary(found.violations)


_DELETED = f"SELECT {_ROW.format(4, 'foreign_key_orders', 'customer', 'INT-006')} count(*) AS violation_count FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"


def _parent_delete(spark: SparkSession, sf: str) -> validate.Decision:
    gone = _t(spark, sf, "customer")
    return validate.commit(_registry(PK_CUSTOMER, PK_ORDERS, FK_CUSTOMER), "customer", _none(gone), gone, _indexes(spark, sf))


@_register(_DELETED)
def commit_parent_delete(spark: SparkSession, sf: str) -> DataFrame:
    return validate.summary(_parent_delete(spark, sf).violations)


@_register(f"SELECT {_ROW.format(2, 'primary_key_orders', 'orders', 'INT-010')} count(*) AS violation_count FROM orders")
def commit_inconsistent(spark: SparkSession, sf: str) -> DataFrame:
    gone = _t(spark, sf, "orders").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    return validate.summary(validate.commit(_registry(PK_ORDERS), "orders", _none(gone), gone, _indexes(spark, sf)).errors)


def _status_commit(spark: SparkSession, sf: str) -> validate.Decision:
    """Orders appended to an empty unique index of (customer, status)."""
    added = _t(spark, sf, "orders")
    return validate.commit(_registry(UQ_STATUS), "orders", added, _none(added), validate.Indexes({5: _none(added.select("o_custkey", "o_orderstatus"))}))


@_register(f"WITH {_APPEND} {_APPEND_PARTS} UNION ALL {_DELETED} UNION ALL SELECT {_ROW.format(5, 'one_open_order', 'orders', 'INT-004')} count(*) AS violation_count FROM (SELECT 1 FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) > 1)")
def commit_all_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Three commits that together break every rule, ordered by code and constraint."""
    added = _append(spark, sf)
    first = validate.commit(_registry(PK_CUSTOMER, PK_ORDERS, NN_PRICE, FK_CUSTOMER), "orders", added, _none(added), _indexes(spark, sf))
    found = first.violations.union(_parent_delete(spark, sf).violations).union(_status_commit(spark, sf).violations)
    return validate.summary(found).orderBy("code", "constraint_id")


@_register(f"""WITH {_APPEND}, found AS (SELECT DISTINCT o_orderkey FROM appended WHERE o_orderkey IN (SELECT o_orderkey FROM orders)),
ranked AS (SELECT CAST(o_orderkey AS VARCHAR) AS "key", row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) AS rank FROM found)
SELECT {_ROW.format(2, 'primary_key_orders', 'orders', 'INT-003')} CAST(rank AS INTEGER) AS rank, "key" FROM ranked WHERE rank <= 10""")
def violation_samples(spark: SparkSession, sf: str) -> DataFrame:
    added = _append(spark, sf)
    found = validate.commit(_registry(PK_ORDERS), "orders", added, _none(added), _indexes(spark, sf)).violations
    return validate.first_samples(found).drop("phase")


@_register(f"""WITH {_APPEND}, parts AS ({_APPEND_PARTS} UNION ALL {_DELETED})
SELECT table_name, code, CAST(sum(violation_count) AS BIGINT) AS violations FROM parts GROUP BY ROLLUP (table_name, code)""")
def violations_by_code_rollup(spark: SparkSession, sf: str) -> DataFrame:
    added = _append(spark, sf)
    first = validate.commit(_registry(PK_CUSTOMER, PK_ORDERS, NN_PRICE, FK_CUSTOMER), "orders", added, _none(added), _indexes(spark, sf))
    found = first.violations.union(_parent_delete(spark, sf).violations)
    return found.rollup("table_name", "code").agg(F.count("*").alias("violations"))


# Files


@_register("SELECT 0 AS changed_rows")
def replace_same_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "supplier")
    return keys.same_rows(rows, rows.repartition(4, "s_nationkey")).agg(F.count("*").cast("int").alias("changed_rows"))


@_register("SELECT s_suppkey, s_nationkey, CAST(-1 AS BIGINT) AS net FROM supplier WHERE s_suppkey % 9 = 0 UNION ALL SELECT s_suppkey, s_nationkey + 1, 1 FROM supplier WHERE s_suppkey % 9 = 0")
def replace_changed_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    after = rows.withColumn("s_nationkey", F.when(F.col("s_suppkey") % 9 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")))
    return keys.same_rows(rows, after)


_FILES = "SELECT 'f' || n_nationkey AS path, 0 AS content, 0 AS spec_id, CASE WHEN n_regionkey <> 2 THEN CAST(n_regionkey AS VARCHAR) END AS \"partition\", CAST(n_nationkey AS BIGINT) AS sequence, CAST(10 AS BIGINT) AS record_count FROM nation"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation")
    key = F.col("n_nationkey")
    return n.select(F.concat(F.lit("f"), key.cast("string")).alias("path"), F.lit(0).alias("content"), F.lit(0).alias("spec_id"), F.when(F.col("n_regionkey") != 2, F.col("n_regionkey").cast("string")).alias("partition"), key.cast("long").alias("sequence"), F.lit(10).cast("long").alias("record_count"))


@_register(f"""WITH f AS ({_FILES}), b AS (SELECT * FROM f WHERE sequence < 20),
a AS (SELECT path, content, spec_id, "partition", CASE WHEN sequence = 7 THEN CAST(99 AS BIGINT) ELSE sequence END AS sequence, record_count FROM f WHERE sequence >= 5)
SELECT *, 'kept' AS change FROM (SELECT * FROM b INTERSECT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'added' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def file_diff(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    after = files.where("sequence >= 5").withColumn("sequence", F.when(F.col("sequence") == 7, F.lit(99).cast("long")).otherwise(F.col("sequence")))
    return deletes.file_diff(files.where("sequence < 20"), after)


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events dealt to 25 files by user; the position in the file is the event's number."""
    e = _t(spark, sf, "events")
    return e.select(F.concat(F.lit("f"), (F.col("user_id") % 25).cast("string")).alias("path"), F.col("event_id").alias("pos"), "user_id", "event_type")


_ROWS = "SELECT 'f' || (user_id % 25) AS path, event_id AS pos, user_id, event_type FROM events"
_POSITIONS = "SELECT 'd' || (event_id % 6) AS delete_path, 'f' || (user_id % 25) AS target_path, event_id AS pos FROM events"


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    """A position delete of every row; of the six files that hold them three are live."""
    return _rows(spark, sf).select(F.concat(F.lit("d"), (F.col("pos") % 6).cast("string")).alias("delete_path"), F.col("path").alias("target_path"), "pos")


def _delete_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"d{k}", 0, p, q) for k, p, q in ((0, None, 12), (1, "1", 30), (2, "3", 30))], "path string, spec_id int, partition string, sequence long")


_DELETE_FILES = "SELECT * FROM (VALUES ('d0', 0, NULL, 12), ('d1', 0, '1', 30), ('d2', 0, '3', 30)) AS d(path, spec_id, part, sequence)"
_HIDDEN = f"""f AS ({_FILES}), d AS ({_DELETE_FILES}), p AS ({_POSITIONS}), r AS ({_ROWS}),
hidden AS (SELECT DISTINCT p.target_path AS path, p.pos FROM p JOIN d ON p.delete_path = d.path JOIN f ON f.path = p.target_path
 WHERE d.spec_id = f.spec_id AND d.part IS NOT DISTINCT FROM f."partition" AND f.sequence <= d.sequence)"""


def _hidden(spark: SparkSession, sf: str) -> DataFrame:
    return deletes.reaching_deletes(_positions(spark, sf), _delete_files(spark), _files(spark, sf))


@_register(f"WITH {_HIDDEN} SELECT path, count(*) AS live_rows FROM r WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.path = r.path AND h.pos = r.pos) GROUP BY 1")
def apply_position_deletes(spark: SparkSession, sf: str) -> DataFrame:
    return deletes.live_rows(_rows(spark, sf), _hidden(spark, sf)).groupBy("path").agg(F.count("*").alias("live_rows"))


_VECTORS = "v AS (SELECT path, pos FROM r WHERE length(path) = 2 AND event_type = 'error')"


@_register(f"WITH {_HIDDEN}, {_VECTORS} SELECT path, pos FROM hidden WHERE path NOT IN (SELECT path FROM v) UNION SELECT path, pos FROM v")
def deletion_vector_override(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _rows(spark, sf).where("length(path) = 2 and event_type = 'error'").select("path", "pos")
    return deletes.with_vectors(_hidden(spark, sf), vectors)


_EQUAL = "SELECT CASE WHEN user_id % 17 <> 0 THEN user_id END AS user_id, user_id * 7 % 25 AS q, CASE WHEN user_id % 2 = 0 THEN CAST(user_id % 3 AS VARCHAR) END AS part FROM events"
_EQUAL_ROWS = f"f AS ({_FILES}), r AS (SELECT path, pos, CASE WHEN user_id % 17 <> 0 THEN user_id END AS user_id FROM ({_ROWS})), e AS ({_EQUAL})"


def _equality(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, sf, "events")
    wanted = e.select(_null_every("user_id", 17).alias("user_id"), (F.col("user_id") * 7 % 25).alias("sequence"), F.when(F.col("user_id") % 2 == 0, (F.col("user_id") % 3).cast("string")).alias("partition"))
    return _rows(spark, sf).withColumn("user_id", _null_every("user_id", 17)), wanted


@_register(f"WITH {_EQUAL_ROWS} SELECT r.path, count(*) AS live_rows FROM r JOIN f USING (path) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id IS NOT DISTINCT FROM r.user_id AND e.q > f.sequence) GROUP BY 1")
def apply_equality_deletes(spark: SparkSession, sf: str) -> DataFrame:
    rows, wanted = _equality(spark, sf)
    wanted = wanted.withColumn("partition", F.lit(None).cast("string"))
    return deletes.apply_equality_deletes(rows, _files(spark, sf), wanted, ["user_id"]).groupBy("path").agg(F.count("*").alias("live_rows"))


@_register(f"WITH {_EQUAL_ROWS} SELECT r.path, count(*) AS live_rows FROM r JOIN f USING (path) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id IS NOT DISTINCT FROM r.user_id AND e.q > f.sequence AND (e.part IS NULL OR e.part = f.\"partition\")) GROUP BY 1")
def apply_equality_deletes_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    rows, wanted = _equality(spark, sf)
    return deletes.apply_equality_deletes(rows, _files(spark, sf), wanted, ["user_id"]).groupBy("path").agg(F.count("*").alias("live_rows"))


@_register(f"WITH r AS ({_ROWS}), b AS (SELECT path, pos FROM r WHERE event_type <> 'view'), a AS (SELECT path, pos FROM r WHERE event_type <> 'click') SELECT *, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def kept_file_changes(spark: SparkSession, sf: str) -> DataFrame:
    rows, place = _rows(spark, sf), ["path", "pos"]
    return deletes.kept_file_changes(rows.where("event_type <> 'view'").select(place), rows.where("event_type <> 'click'").select(place))


@_register(f"WITH f AS ({_FILES}), r AS ({_ROWS}), c AS (SELECT path, count(*) AS n FROM r GROUP BY 1) SELECT f.path, f.record_count, coalesce(n, 0) AS rows_read FROM f LEFT JOIN c USING (path) WHERE coalesce(n, 0) <> f.record_count")
def row_count_check(spark: SparkSession, sf: str) -> DataFrame:
    return deletes.row_count_errors(_rows(spark, sf), _files(spark, sf))


@_register(f"WITH {_HIDDEN} SELECT path, pos FROM hidden JOIN f USING (path) WHERE pos < 0 OR pos >= record_count * 100")
def position_bounds_check(spark: SparkSession, sf: str) -> DataFrame:
    return deletes.out_of_bounds(_hidden(spark, sf), _files(spark, sf).withColumn("record_count", F.col("record_count") * 100))


# Indexes


@_register("SELECT o_orderkey, CAST(-1 AS BIGINT) AS net FROM orders")
def upsert_index_delta(spark: SparkSession, sf: str) -> DataFrame:
    orders = _t(spark, sf, "orders").select("o_orderkey")
    missing = orders.select(F.col("o_orderkey") + 10_000_000)
    return validate.upsert_removals(orders, orders.union(orders).union(missing), ["o_orderkey"])


_PENDING = """base AS (SELECT o_orderkey, CAST(1 AS BIGINT) AS last_snapshot FROM orders WHERE o_orderstatus <> 'P'),
pending AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN CAST(2 AS BIGINT) END AS last_snapshot, 0 AS version FROM orders WHERE o_orderpriority <> '5-LOW'
 UNION ALL SELECT o_orderkey, CAST(3 AS BIGINT), 1 FROM orders WHERE o_orderpriority = '1-URGENT')"""


@_register(f"WITH {_PENDING} SELECT o_orderkey, last_snapshot FROM (SELECT o_orderkey, last_snapshot, row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC) AS n FROM (SELECT *, -1 AS version FROM base UNION ALL SELECT * FROM pending)) WHERE n = 1 AND last_snapshot IS NOT NULL")
def overlay_read(spark: SparkSession, sf: str) -> DataFrame:
    orders = _t(spark, sf, "orders")
    number = lambda n: F.lit(n).cast("long")
    base = orders.where("o_orderstatus <> 'P'").select("o_orderkey", number(1).alias("last_snapshot"))
    first = orders.where("o_orderpriority <> '5-LOW'").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", number(2)).alias("last_snapshot"), number(0).alias("version"))
    second = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", number(3).alias("last_snapshot"), number(1).alias("version"))
    return validate.overlay(base, first.union(second), ["o_orderkey"], "last_snapshot")


@_register(f"SELECT 2 AS step, {_ROW.format(2, 'primary_key_orders', 'orders', 'INT-003')} count(*) AS violation_count FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'")
def multi_step_commit(spark: SparkSession, sf: str) -> DataFrame:
    """Step 1 deletes the finished orders; step 2 appends the urgent ones, of which those deleted are free again."""
    r, orders = _registry(PK_ORDERS), _t(spark, sf, "orders")
    gone, new = orders.where("o_orderstatus = 'F'"), orders.where("o_orderpriority = '1-URGENT'")
    index = orders.select("o_orderkey", F.lit(1).cast("long").alias("last_snapshot"))
    first = validate.commit(r, "orders", _none(gone), gone, validate.Indexes({2: index.select("o_orderkey")}))
    staged = validate.stage_unique(index, keys.net_delta(_none(gone).select("o_orderkey"), gone.select("o_orderkey")), 2)
    now = validate.overlay(index, staged.withColumn("version", F.lit(0).cast("long")), ["o_orderkey"], "last_snapshot")
    second = validate.commit(r, "orders", new, _none(new), validate.Indexes({2: now.select("o_orderkey")}))
    steps = validate.summary(first.violations).select(F.lit(1).alias("step"), "*")
    return steps.union(validate.summary(second.violations).select(F.lit(2).alias("step"), "*"))


@_register("SELECT o_orderkey + 10000000 AS o_orderkey, CAST(9 AS BIGINT) AS last_snapshot FROM orders UNION ALL SELECT o_orderkey, NULL FROM orders")
def stage_unique(spark: SparkSession, sf: str) -> DataFrame:
    orders = _t(spark, sf, "orders").select("o_orderkey")
    new = orders.select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"))
    return validate.stage_unique(orders, keys.net_delta(new, orders), 9)


@_register("WITH n AS (SELECT o_custkey AS c_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS gone FROM orders GROUP BY 1) SELECT c_custkey, n - gone AS child_count FROM n WHERE gone > 0")
def stage_reference(spark: SparkSession, sf: str) -> DataFrame:
    orders = _t(spark, sf, "orders")
    gone = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return validate.stage_reference(validate.reference_counts(orders, FK_CUSTOMER), keys.net_delta(_none(gone), gone))


# Functions


@_register("SELECT o_orderkey, CAST(year(o_orderdate) - 1970 AS INTEGER) AS y, CAST((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS d, CAST(floor(epoch_us(o_orderdate) / 3600000000) AS BIGINT) AS h FROM orders")
def transform_temporal(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("o_orderdate")
    return _t(spark, sf, "orders").select("o_orderkey", transforms.year(t).alias("y"), transforms.month(t).alias("m"), transforms.day(t).alias("d"), transforms.hour(t).alias("h"))


@_register("SELECT o_orderkey, (o_orderkey - 500) - ((o_orderkey - 500) % 10 + 10) % 10 AS t, substr(o_orderpriority, 1, 3) AS s FROM orders")
def transform_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders").select("o_orderkey", transforms.truncate(F.col("o_orderkey") - 500, 10).alias("t"), transforms.truncate_text(F.col("o_orderpriority"), 3).alias("s"))


def _murmur_sql(source: str, key: str) -> str:
    """The same 32-bit steps in wide integers."""
    low, rot = "& 4294967295", lambda c, n: f"((({c} << {n}) | ({c} >> {32 - n})) & 4294967295)"
    mul = lambda c, k: f"((CAST({c} AS HUGEINT) * {k}) % 4294967296)::BIGINT"
    steps, last = [f"s0 AS (SELECT {key}, {key} {low} AS w0, ({key} >> 32) {low} AS w1, CAST(0 AS BIGINT) AS h FROM {source})"], "s0"
    for i, w in enumerate(("w0", "w1")):
        chain = [("k", mul(w, transforms.C1)), ("k", rot("k", 15)), ("k", mul("k", transforms.C2)), ("h", "xor(h, k)"), ("h", rot("h", 13)), ("h", f"(h * 5 + {transforms.ADD}) {low}")]
        for j, (name, e) in enumerate(chain):
            keep = f"{key}, w0, w1" + (", h" if name == "k" else ", k")
            steps.append(f"a{i}{j} AS (SELECT {keep}, {e} AS {name} FROM {last})")
            last = f"a{i}{j}"
    for j, e in enumerate(["xor(h, 8)", "xor(h, h >> 16)", mul("h", transforms.F1), "xor(h, h >> 13)", mul("h", transforms.F2), "xor(h, h >> 16)"]):
        steps.append(f"z{j} AS (SELECT {key}, {e} AS h FROM {last})")
        last = f"z{j}"
    return f"WITH {', '.join(steps)} SELECT {key}, (h & 2147483647) % 16 AS bucket FROM {last}"


@_register(_murmur_sql("orders", "o_orderkey"))
def transform_bucket_long(spark: SparkSession, sf: str) -> DataFrame:
    return transforms.with_bucket_long(_t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 16)


@_register("SELECT o_orderkey, o_orderkey - o_orderkey % 100 AS wanted, CASE WHEN o_orderkey % 77 = 0 THEN NULL ELSE o_orderkey - o_orderkey % 100 END AS declared FROM orders WHERE o_orderkey % 77 = 0")
def partition_check(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose transform is not the tuple that their file declares."""
    rows = _t(spark, sf, "orders").select("o_orderkey", transforms.truncate(F.col("o_orderkey"), 100).alias("wanted"))
    rows = rows.withColumn("declared", F.when(F.col("o_orderkey") % 77 != 0, F.col("wanted")))
    return rows.where(~F.col("wanted").eqNullSafe(F.col("declared")))


_TEXT_HEX = "'0701' || replace(replace(regexp_replace(hex({}), '(..)', '\\1-', 'g'), '00-', '00FF-'), '-', '') || '0000'"


@_register("SELECT k, '01' || CASE WHEN k IS NULL THEN '0200' ELSE '0201' || lpad(hex(xor(k, -9223372036854775808)), 16, '0') END AS encoded FROM (SELECT CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey - 700 END AS k FROM orders)")
def key_encode_int(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey") - 700).alias("k"))
    return rows.select("k", encoding.key_hex([(F.col("k"), "integer")]).alias("encoded"))


@_register(f"SELECT p_partkey, '01' || {_TEXT_HEX.format('p_name')} AS encoded FROM part")
def key_encode_string(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", encoding.key_hex([(F.col("p_name"), "string")]).alias("encoded"))


@_register(f"SELECT c_custkey, '01' || '0201' || lpad(hex(xor(CAST(c_nationkey AS BIGINT), -9223372036854775808)), 16, '0') || {_TEXT_HEX.format('c_mktsegment')} AS encoded FROM customer")
def key_encode_composite(spark: SparkSession, sf: str) -> DataFrame:
    parts = [(F.col("c_nationkey"), "integer"), (F.col("c_mktsegment"), "string")]
    return _t(spark, sf, "customer").select("c_custkey", encoding.key_hex(parts).alias("encoded"))


@_register("SELECT n_name, row_number() OVER (ORDER BY n_name) AS by_value, row_number() OVER (ORDER BY n_name) AS by_bytes FROM nation")
def key_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "nation").select("n_name", F.unhex(encoding.key_hex([(F.col("n_name"), "string")])).alias("b"))
    rank = lambda c: F.row_number().over(Window.orderBy(c)).cast("long")  # noqa: E731  25 rows
    return rows.select("n_name", rank("n_name").alias("by_value"), rank("b").alias("by_bytes"))


# Workload


@_register("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_event_per_key(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _t(spark, sf, "events").withColumn("n", F.row_number().over(order)).where("n = 1").select("user_id", "event_id", "event_type")


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    """Latest events as an order feed: known order keys update, others insert."""
    last = latest_event_per_key(spark, sf)
    return last.select((F.col("event_id") * 3).alias("o_orderkey"), F.col("user_id").alias("o_custkey"), F.col("event_type").alias("o_orderstatus"))


_FEED = """last_event AS (SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1),
feed AS (SELECT event_id * 3 AS o_orderkey, user_id AS o_custkey, event_type AS o_orderstatus FROM last_event),
old AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders)"""


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Matched rows are updated, others of the feed inserted, the rest kept."""
    rest = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    hit = F.col(f"n.{rest[0]}").isNotNull()
    return joined.select(key, *[F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest])


@_register(f"WITH {_FEED} SELECT * FROM feed UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM feed)")
def etl_orders_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merge(_t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), _feed(spark, sf), "o_orderkey")


@_register(f"WITH {_FEED} SELECT *, 'added' AS side FROM feed UNION ALL SELECT *, 'removed' FROM old WHERE o_orderkey IN (SELECT o_orderkey FROM feed)")
def merge_added_removed(spark: SparkSession, sf: str) -> DataFrame:
    new = _feed(spark, sf)
    old = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return new.withColumn("side", F.lit("added")).unionByName(old.join(new, "o_orderkey", "left_semi").withColumn("side", F.lit("removed")))


@_register("SELECT o_custkey, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(date_diff('day', DATE '1970-01-01', CAST(max(o_orderdate) AS DATE)) AS INTEGER) AS last_day, count(DISTINCT o_orderstatus) AS statuses FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def etl_customer_summary(spark: SparkSession, sf: str) -> DataFrame:
    orders, customers = _t(spark, sf, "orders"), _t(spark, sf, "customer").select("c_custkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return joined.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(cents).alias("cents"), F.unix_date(F.max("o_orderdate").cast("date")).alias("last_day"), F.count_distinct("o_orderstatus").alias("statuses"))


BUCKETS = (5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0)


@_register("SELECT b.le, count(e.value) AS n FROM (VALUES " + ", ".join(f"(CAST({b} AS DOUBLE))" for b in BUCKETS) + ") AS b(le) LEFT JOIN events e ON e.value <= b.le GROUP BY 1")
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    row = _t(spark, sf, "events").agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BUCKETS)])).alias("x")).select("x.le", "x.n")


@_register("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by value)")
    return _t(spark, sf, "events").groupBy("event_type").agg(at(0.5).alias("p50"), at(0.99).alias("p99"))


# Metadata

FOREIGN_KEYS = [("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier"), ("customer", "nation"), ("supplier", "nation"), ("nation", "region"), ("labels", "documents"), ("events", "customer")]
_EDGES = "edges(c, p) AS (VALUES " + ", ".join(f"('{c}', '{p}')" for c, p in FOREIGN_KEYS) + ")"


@_register(f"""WITH RECURSIVE {_EDGES}, depth(t, d) AS (SELECT p, 0 FROM edges WHERE p NOT IN (SELECT c FROM edges) UNION SELECT e.c, d + 1 FROM depth JOIN edges e ON e.p = t),
reach(t, r) AS (SELECT t, t FROM (SELECT c AS t FROM edges UNION SELECT p FROM edges) UNION SELECT e.b, r FROM reach JOIN (SELECT c AS a, p AS b FROM edges UNION SELECT p, c FROM edges) e ON e.a = t)
SELECT r.t AS table_name, min(r.r) AS domain, (SELECT CAST(max(d) AS INTEGER) FROM depth WHERE depth.t = r.t) AS level FROM reach r GROUP BY r.t""")
def fk_component(spark: SparkSession, sf: str) -> DataFrame:
    tables = sorted({t for e in FOREIGN_KEYS for t in e})
    level: dict[str, int] = {}
    for t in domain.parents_first(FOREIGN_KEYS, tables):
        level[t] = max((level[p] + 1 for c, p in FOREIGN_KEYS if c == t), default=0)
    return spark.createDataFrame([(t, min(domain.component(FOREIGN_KEYS, t)), level[t]) for t in tables], "table_name string, domain string, level int")


_SNAPSHOTS = {k: (k - 1 if k > 1 else None) for k in range(1, 13)} | {50: 6, 51: 50}


@_register("WITH RECURSIVE s(id, parent) AS (VALUES " + ", ".join(f"({k}, {'NULL' if p is None else p})" for k, p in _SNAPSHOTS.items()) + "), walk(id, parent, pos) AS (SELECT id, parent, 0 FROM s WHERE id = 51 UNION ALL SELECT s.id, s.parent, pos + 1 FROM walk JOIN s ON s.id = walk.parent) SELECT CAST(id AS BIGINT) AS snapshot, CAST(pos AS INTEGER) AS pos FROM walk")
def snapshot_chain(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(s, k) for k, s in enumerate(domain.ancestry(_SNAPSHOTS, 51))], "snapshot long, pos int")


_CHAIN = """SELECT n_regionkey AS table_id, n_nationkey AS snapshot, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS chain_pos,
CASE WHEN n_nationkey % 11 = 10 THEN NULL WHEN n_nationkey % 13 = 12 THEN 'zz' ELSE sha256(n_name) END AS stored,
CASE WHEN n_nationkey = 18 THEN sha256('x') ELSE sha256(n_name) END AS recomputed FROM nation"""


@_register(f"""WITH c AS ({_CHAIN}), s AS (SELECT *, CASE WHEN chain_pos = 0 THEN 'ANCHOR' WHEN stored IS NULL THEN 'MISSING' WHEN stored = 'zz' THEN 'MALFORMED' WHEN stored <> recomputed THEN 'MISMATCH' ELSE 'OK' END AS status FROM c)
SELECT table_id, bool_and(status IN ('OK', 'ANCHOR')) AS ok, arg_min(snapshot, chain_pos) AS anchor, arg_min(snapshot, chain_pos) FILTER (WHERE status NOT IN ('OK', 'ANCHOR')) AS first_broken FROM s GROUP BY 1""")
def chain_verdict(spark: SparkSession, sf: str) -> DataFrame:
    key, order = F.col("n_nationkey"), Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    own = F.sha2("n_name", 256)
    chain = _t(spark, sf, "nation").select(
        F.col("n_regionkey").alias("table_id"), key.alias("snapshot"), (F.row_number().over(order) - 1).alias("chain_pos"),
        F.when(key % 11 == 10, None).when(key % 13 == 12, "zz").otherwise(own).alias("stored"), F.when(key == 18, F.sha2(F.lit("x"), 256)).otherwise(own).alias("recomputed"),
    ).withColumn("previous", F.lag("stored").over(Window.partitionBy("table_id").orderBy("chain_pos")))
    return certify.chain_verdict(certify.chain_statuses(chain))


@_register()
def certificate_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Certificates of a two-step history of the regions' keys."""
    regions = _t(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("k"))
    encoded = F.unhex(encoding.key_hex([(F.col("k"), "integer")])).alias("key")
    steps = [regions.select(encoded, F.lit(1).cast("long").alias("net")), regions.where("k = 0").select(encoded, F.lit(-1).cast("long").alias("net"))]
    table, previous, out = "6c1b2d42-0000-4000-8000-000000000001", "00" * 32, []
    own = certify.constraint_set_digest(spark, 1, [(Constraint(1, PK, table, ("r_regionkey",)), [1], None)])
    for k, delta in enumerate(steps, 1):
        digest = certify.key_delta_digest(spark, {1: delta})
        previous = certify.certificate(spark, table, k, k - 1 or None, own, digest, previous)
        out.append((k, own, digest, previous))
    return spark.createDataFrame(out, "snapshot long, constraint_set string, key_delta string, certificate string")


@_register()
def bucket_string(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", transforms.bucket_text(16)("p_name").alias("bucket"))


@_register(f"SELECT path, pos FROM ({_ROWS})")
def deletion_vector_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Positions per file, written as deletion vector blobs and read again."""
    wanted = _rows(spark, sf).groupBy("path").agg(F.collect_list("pos").alias("pos"))

    def run(batches):
        for pdf in batches:
            pdf["blob"] = [deletion_vectors.encode(p) for p in pdf.pop("pos")]
            yield pdf

    return deletion_vectors.positions(wanted.mapInPandas(run, "path string, blob binary"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp()
    return f"{base}/{name}-{uuid.uuid4().hex}"


@_register("""WITH rows AS (SELECT o_orderkey, o_custkey, 0 AS batch FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN -o_custkey ELSE o_custkey END, 1 FROM orders WHERE o_orderstatus <> 'O')
SELECT CAST(2 AS BIGINT) AS constraint_id, 'INT-003' AS code, count(*) AS violation_count, 'violation' AS kind, CAST(1 AS BIGINT) AS batch FROM (SELECT 1 FROM rows WHERE batch = 1 AND o_orderkey IN (SELECT o_orderkey FROM rows WHERE batch = 0))
UNION ALL SELECT CAST(4 AS BIGINT), 'INT-005', count(DISTINCT o_custkey), 'violation', CAST(1 AS BIGINT) FROM rows WHERE batch = 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def stream_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as change files, two commits: the second repeats keys of the first and has orders of unknown customers."""
    base = scratch(spark, "stream")
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderpriority").alias("p"), F.lit(1).alias("op"))
    urgent = F.when(F.col("p") == "1-URGENT", -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    for name, rows in (("a", orders.where("o_orderstatus <> 'P'")), ("b", orders.where("o_orderstatus <> 'O'").withColumn("o_custkey", urgent))):
        rows.drop("p").write.option("maxRecordsPerFile", 1_000_000).parquet(f"{base}/in/{name}")
        commits.announce(spark, f"{base}/waiting", name, [f"{base}/in/{name}"])
    store, registry = IndexStore(spark, f"{base}/index"), _registry(PK_CUSTOMER, PK_ORDERS, FK_CUSTOMER)
    commits.install(store, registry, {"customer": _t(spark, sf, "customer"), "orders": _t(spark, sf, "orders").limit(0)})
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, op int"
    commits.validate_stream(spark, commits.announced(spark, f"{base}/waiting"), registry, "orders", store, f"{base}/out", f"{base}/checkpoint", schema)
    return spark.read.parquet(f"{base}/out").select("constraint_id", "code", "violation_count", "kind", "batch")


from keelson import table_queries  # noqa: E402,F401  registers the queries over table files
