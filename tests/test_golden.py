"""Golden facts of the tool's own tests, on its three seed tables."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from branchdata.functions import changes as FC
from branchdata.operators import catalog as CT
from branchdata.operators import conflicts as CF
from branchdata.operators import evolve as EV
from branchdata.operators import extract as X
from branchdata.operators import history as HI
from branchdata.sources.store import BranchStore

TS = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def seed(spark):
    users = spark.createDataFrame(
        [(1, "alice@example.com", "Alice", "pro", TS, "active"),
         (2, "bob@example.com", "Bob", "free", TS, "active"),
         (3, "charlie@example.com", "Charlie", "enterprise", TS, "active")],
        "id int, email string, name string, plan string, created_at timestamp, status string")
    orders = spark.createDataFrame(
        [(1, 1, Decimal("9.99"), "completed", TS), (2, 3, Decimal("19.99"), "pending", TS)],
        "id int, user_id int, amount decimal(10,2), status string, created_at timestamp")
    products = spark.createDataFrame(
        [(1, "Widget A", Decimal("9.99"), 100, TS), (2, "Widget B", Decimal("19.99"), 50, TS)],
        "id int, name string, price decimal(10,2), stock int, created_at timestamp")
    return {"users": users, "orders": orders, "products": products}


class _Src:
    """Source over in-memory frames (same interface the loader uses)."""

    def __init__(self, spark, frames):
        self.spark, self.frames = spark, frames

    def table(self, name):
        return self.frames[name]


def _catalog(spark, seed):
    return CT.catalog_of(spark, seed)


def test_catalog_has_three_tables(spark, seed):
    assert _catalog(spark, seed).select("table_name").distinct().count() == 3


def test_users_has_six_columns(spark, seed):
    cols = [r[0] for r in _catalog(spark, seed).filter("table_name = 'users'").orderBy("position")
            .select("column_name").collect()]
    assert cols == ["id", "email", "name", "plan", "created_at", "status"]


def _store(spark, tmp_path):
    return BranchStore(spark, str(tmp_path / "store"))


def test_load_all_rows_then_ready(spark, seed, tmp_path):
    store = _store(spark, tmp_path)
    res = X.snapshot_load(_Src(spark, seed), store, "b1", X.ExtractSpec("users"))
    assert (res.status, res.rows) == ("ready", 3)
    state = store.latest().filter("table_name = 'users'").collect()[0]
    assert state.status == "ready" and state.rows_loaded == 3


def test_load_with_predicate(spark, seed, tmp_path):
    store = _store(spark, tmp_path)
    res = X.snapshot_load(_Src(spark, seed), store, "b1", X.ExtractSpec("users", where="plan = 'pro'"))
    assert res.rows == 1
    assert [r.name for r in spark.read.parquet(res.path).collect()] == ["Alice"]


def test_empty_extraction_is_success(spark, seed, tmp_path):
    store = _store(spark, tmp_path)
    res = X.snapshot_load(_Src(spark, seed), store, "b1", X.ExtractSpec("users", where="plan = 'none'"))
    assert (res.status, res.rows) == ("ready", 0)


def test_exists_before_and_after(spark, seed, tmp_path):
    store = _store(spark, tmp_path)
    assert store.ready_tables("b1") == []
    X.snapshot_load(_Src(spark, seed), store, "b1", X.ExtractSpec("users"))
    assert store.ready_tables("b1") == ["users"]


def _batch(spark, sqls, branch=1):
    rows = [(branch, i, s, datetime(2024, 1, 1, 0, i)) for i, s in enumerate(sqls, start=1)]
    return spark.createDataFrame(rows, "branch_id long, migration_id long, sql_text string, applied_at timestamp")


def _empty_history(spark):
    return spark.createDataFrame([], "branch_id long, sequence int")


def test_sequences_run_from_one(spark):
    rec = HI.record(_empty_history(spark), _batch(spark, ["CREATE TABLE a (id INT)", "CREATE TABLE b (id INT)",
                                                        "CREATE TABLE c (id INT)"]))
    assert [r.sequence for r in rec.orderBy("sequence").collect()] == [1, 2, 3]


def test_one_ddl_one_test_gives_one_mergeable(spark):
    rec = HI.record(_empty_history(spark), _batch(spark, ["ALTER TABLE users ADD COLUMN x TEXT",
                                                        "INSERT INTO users VALUES (4)"]))
    assert HI.mergeable(rec).count() == 1


@pytest.mark.parametrize("sql,kind", [
    ("ALTER TABLE users ADD COLUMN x TEXT", "ddl"), ("CREATE TABLE t (id INT)", "ddl"),
    ("DROP TABLE t", "ddl"), ("CREATE INDEX i ON users(email)", "ddl"),
    ("INSERT INTO users VALUES (1)", "test"), ("UPDATE users SET name = 'x'", "test"),
    ("DELETE FROM users WHERE id = 1", "test"), ("/* @seed */ INSERT INTO plans VALUES (1)", "seed"),
    ("  truncate users  ", "ddl"), ("CREATE UNIQUE INDEX u ON users(email)", "test"),
])
def test_change_type_table(spark, sql, kind):
    got = spark.createDataFrame([(sql,)], "s string").select(FC.change_type(F.col("s"))).first()[0]
    assert got == kind


def _check(spark, seed, sqls):
    rec = HI.record(_empty_history(spark), _batch(spark, sqls))
    cat = _catalog(spark, seed)
    idx = spark.createDataFrame([("users_pkey", "users")], "index_name string, table_name string")
    return CF.check(rec, cat, idx)


def test_two_clean_changes(spark, seed):
    res = _check(spark, seed, ["ALTER TABLE users ADD COLUMN phone TEXT", "CREATE TABLE t (id INT)"])
    assert res.filter("conflict_type IS NOT NULL").count() == 0 and res.count() == 2


def test_adding_existing_column_is_one_conflict(spark, seed):
    res = _check(spark, seed, ["ALTER TABLE users ADD COLUMN email TEXT"]).collect()
    assert len(res) == 1 and res[0].conflict_type == "column_exists"


def test_batch_replay_follows_objects(spark, seed):
    res = _check(spark, seed, ["CREATE TABLE t (id INT)", "CREATE TABLE t (id INT)", "DROP TABLE t",
                               "DROP TABLE t", "ALTER TABLE users ADD COLUMN x TEXT",
                               "ALTER TABLE users ADD COLUMN x TEXT", "ALTER TABLE users DROP COLUMN x",
                               "ALTER TABLE users DROP COLUMN x", "CREATE TABLE t (id INT)",
                               "ALTER TABLE t ADD COLUMN id INT"])
    got = [r.conflict_type for r in res.orderBy("sequence").collect()]
    assert got == [None, "table_exists", None, "dropped_reference", None, "column_exists", None,
                   "dropped_reference", None, "column_exists"]


def test_index_exists_resolves_to_if_not_exists(spark):
    df = spark.createDataFrame([("CREATE INDEX idx ON users(email)", "index_exists")], "sql_text string, c string")
    r = df.select(*FC.auto_resolve(F.col("sql_text"), F.col("c"))).first()
    assert r.resolved_sql == "CREATE INDEX IF NOT EXISTS idx ON users(email)" and r.resolved


def test_column_exists_resolves_to_skip(spark):
    df = spark.createDataFrame([("ALTER TABLE users ADD COLUMN email TEXT", "column_exists")], "sql_text string, c string")
    r = df.select(*FC.auto_resolve(F.col("sql_text"), F.col("c"))).first()
    assert r.resolved_sql == "" and r.resolved


def test_check_never_changes_parent(spark, seed):
    before = sorted(map(tuple, _catalog(spark, seed).collect()))
    _check(spark, seed, ["ALTER TABLE users ADD COLUMN phone TEXT", "DROP TABLE orders"]).collect()
    assert sorted(map(tuple, _catalog(spark, seed).collect())) == before


def test_lifecycle_two_ddl_one_test(spark, seed):
    sqls = ["ALTER TABLE users ADD COLUMN phone TEXT", "CREATE INDEX idx_phone ON users(phone)",
            "INSERT INTO users VALUES (9)"]
    rec = HI.record(_empty_history(spark), _batch(spark, sqls))
    merge = HI.mergeable(rec)
    assert merge.count() == 2
    # the parent gets the column, and no row of the test change
    to_apply = [r.sql_text for r in merge.orderBy("sequence").collect()]
    parent = EV.apply_changes(seed["users"], to_apply, "users")
    assert "phone" in parent.columns and parent.count() == 3


def test_extraction_from_query_text(spark, seed):
    src = _Src(spark, seed)
    src.table = lambda name, _f=seed: _f[name]
    out = X.extract_query(src, "users", "SELECT * FROM users WHERE plan = 'pro' LIMIT 10",
                          masks={"users.email": "masked_{{id}}@example.com"}, id_col="id").collect()
    assert [(r.name, r.email) for r in out] == [("Alice", "masked_1@example.com")]
