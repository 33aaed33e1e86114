"""Nothing is lost or leaked: versions, masks, casts, skips, ranks, keys."""

import pytest
from pyspark.sql import functions as F

from branchdata.operators import evolve as EV
from branchdata.operators import extract as X
from branchdata.operators import history as HI
from branchdata.sources.store import BranchStore


class Frame:
    """A source of one table."""

    def __init__(self, spark, df):
        self.spark, self.df = spark, df

    def table(self, name):
        return self.df


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "a@x.example"), (2, "b@x.example")], "id long, email string")


def test_failed_reload_keeps_the_ready_version(spark, people, tmp_path):
    store = BranchStore(spark, str(tmp_path / "store"))
    assert X.snapshot_load(Frame(spark, people), store, "b", X.ExtractSpec("people")).status == "ready"
    long = "x" * 300 + " = 1"
    bad = X.snapshot_load(Frame(spark, people), store, "b", X.ExtractSpec("people", where=long))
    assert bad.status == "failed" and "x" * 300 in bad.error
    assert store.read("b", "people").count() == 2 and "people" in store.ready_versions("b")
    stored = store.events().filter("status = 'failed'").select("error").first()[0]
    assert stored == bad.error


def test_query_text_never_sees_raw_values(spark, people):
    out = X.extract_query(Frame(spark, people), "people", "SELECT id, email AS e, upper(email) u FROM people",
                          {"people.email": "hidden"})
    assert {tuple(r) for r in out.collect()} == {(1, "hidden", "HIDDEN"), (2, "hidden", "HIDDEN")}
    assert not spark.catalog.tableExists("people")


def test_rule_of_a_column_that_is_not_selected(spark, people):
    out = X.extract(people, X.ExtractSpec("people", columns=("id",)), {"people.email": "hidden"})
    assert out.columns == ["id"] and out.count() == 2


@pytest.mark.parametrize("sql,spark_type", [
    ("numeric(30,2)", "decimal(30,2)"), ("timestamp with time zone", "timestamp"), ("timestamp", "timestamp_ntz"),
    ("text[]", "array<string>"), ("varchar(20) NOT NULL", "string"), ("numeric", "decimal(38,18)")])
def test_column_types(sql, spark_type):
    assert EV.spark_type(sql) == spark_type


def test_changes_that_lose_values_raise(spark, people):
    big = spark.createDataFrame([("123456789012345678901234.5",)], "v string")
    out = EV.apply_changes(big, ["ALTER TABLE t ALTER COLUMN v TYPE numeric(30,2)"], "t")
    assert str(out.first()[0]) == "123456789012345678901234.50"
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        EV.apply_changes(people, ["ALTER TABLE people ALTER COLUMN email TYPE int"], "people").collect()
    with pytest.raises(ValueError, match="column_exists"):
        EV.apply_changes(people, ["ALTER TABLE people ADD COLUMN email text"], "people")
    with pytest.raises(ValueError, match="unknown column type"):
        EV.spark_type("geometry")
    _, skipped = EV.rebase(people, ["ALTER TABLE people DROP COLUMN nope"], [], "people")
    assert [r for _, r in skipped] == ["dropped_reference"]


def test_last_n_counts_changes_not_numbers(spark):
    ch = spark.createDataFrame([(1, s) for s in (1, 2, 9, 30)], "branch_id long, sequence int")
    assert sorted(r.sequence for r in HI.last_n(ch, 3).collect()) == [2, 9, 30]
    assert [r.sequence for r in HI.without_last_n(ch, 3).collect()] == [1]


def test_insert_ignore_makes_incoming_keys_unique(spark):
    have = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "b"), (2, "a")], "k int, v string")
    assert {tuple(r) for r in HI.insert_ignore(have, new, ["k"]).collect()} == {(1, "old"), (2, "a")}


def test_seed_rows_of_every_form_and_first_of_a_key_wins(spark):
    from datetime import datetime

    from branchdata.operators import conflicts as CF
    t = [datetime(2024, 1, d) for d in range(1, 7)]
    changes = spark.createDataFrame([
        (1, "seed", "/* @seed */ INSERT INTO plans VALUES (1)", t[3], 1),
        (2, "seed", "/* @seed */ insert into public.plans (id, label) values (2, 'a, (b)'), ('x', f(1, 2)), (1, null)", t[2], 2),
        (3, "seed", "/* @seed */ INSERT INTO plans VALUES (2), (7)", t[1], 3),
        (3, "seed", "/* @seed */ INSERT INTO plans SELECT 5", t[4], 4),
        (3, "ddl", "CREATE TABLE t (id INT)", t[5], 5),
    ], "branch_id long, type string, sql_text string, applied_at timestamp, migration_id long")
    keys = sorted((r.branch_id, r.table_name or "", r.row_key or "") for r in CF.seed_rows(changes).collect())
    assert keys == [(1, "plans", "1"), (2, "plans", "1"), (2, "plans", "2"), (2, "plans", "x"),
                    (3, "", ""), (3, "plans", "2"), (3, "plans", "7")]
    branches = spark.createDataFrame([(1, "main", "main", "active"), (2, "b2", "main", "active"), (3, "b3", "main", "active")],
                                     "branch_id long, name string, parent_branch string, status string")
    merged = CF.merge_seed_rows(branches.withColumn("branch_id", F.when(F.col("name") == "main", 0).otherwise(F.col("branch_id"))),
                                changes.withColumn("branch_id", F.when(F.col("branch_id") == 1, 0).otherwise(F.col("branch_id"))))
    got = sorted((r.row_key or "", r.from_branch or "own") for r in merged.collect())
    assert got == [("", "b3"), ("1", "own"), ("2", "b3"), ("7", "b3"), ("x", "b2")]
