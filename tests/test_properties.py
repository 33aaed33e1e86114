"""Properties: pack/unpack identity, self-difference empty, swapped diff,
page coverage, resume adds nothing."""

from pyspark.sql import functions as F

from branchdata.operators import catalog as CT
from branchdata.operators import extract as X
from branchdata.operators import history as HI
from branchdata.plans.registry import Ctx
from conftest import SF001


def test_pack_unpack_identity(spark):
    c = Ctx(spark, SF001)
    rec = c.recorded.select("branch_id", "sequence", "sql_text", "type", "description", "checksum")
    back = HI.unpack(HI.pack(c.recorded, part_size=3)).select(*rec.columns)
    assert rec.exceptAll(back).count() == 0 and back.exceptAll(rec).count() == 0


def test_self_difference_is_empty(spark):
    c = Ctx(spark, SF001)
    main_only = c.branches.filter("branch_id = 0")     # main is its own parent
    assert HI.diff_vs_parent(c.recorded, main_only).count() == 0


def test_schema_diff_swapped_exchanges_add_and_remove(spark):
    a = spark.createDataFrame([], "x int, y string")
    b = spark.createDataFrame([], "x bigint, z string")
    ca, cb = CT.catalog_of(spark, {"t": a, "only_a": a}), CT.catalog_of(spark, {"t": b, "only_b": b})
    d1 = {(r.change_kind, r.table_name, r.column_name) for r in CT.schema_diff(ca, cb).collect()}
    d2 = {(r.change_kind, r.table_name, r.column_name) for r in CT.schema_diff(cb, ca).collect()}
    swap = {"add_table": "remove_table", "remove_table": "add_table", "add_column": "remove_column",
            "remove_column": "add_column", "change_type": "change_type"}
    assert {(swap[k], t, c) for k, t, c in d1} == d2


def test_pages_cover_each_key_once(spark):
    conv = spark.read.parquet(f"{SF001}/conversations.parquet")
    plan = X.chunk_plan(conv, ["conv_id", "turn"], 7).collect()
    assert sum(r.rows for r in plan) == conv.count()
    # walking the pages with the cursor gives every key exactly once
    seen, cursor = [], None
    while True:
        page = X.keyset_page(conv, ["conv_id", "turn"], cursor, 7).collect()
        if not page:
            break
        seen += [(r.conv_id, r.turn) for r in page]
        cursor = [page[-1].conv_id, page[-1].turn]
    assert len(seen) == len(set(seen)) == conv.count()


def test_audit_json_omits_empty_fields(spark, tmp_path):
    import json
    import os
    from branchdata.operators import reports as R
    c = Ctx(spark, SF001)
    trail = R.audit_trail(c.branches, c.recorded, c.snapshots, limit=None)
    R.export_audit(trail, str(tmp_path / "j"), "json")
    R.export_audit(trail, str(tmp_path / "t"), "text")
    docs = [json.loads(line) for f in os.listdir(tmp_path / "j") if f.endswith(".json")
            for line in open(tmp_path / "j" / f)]
    assert len(docs) == trail.count()
    created = [d for d in docs if d["event_type"] == "branch_created"]
    assert created and all("migration_type" not in d and "rows_loaded" not in d for d in created)
    assert all("migration_type" in d for d in docs if d["event_type"] == "migration_applied")
    assert spark.read.text(str(tmp_path / "t")).count() == trail.count()


def test_change_log_filters_branch_and_type(spark):
    from branchdata.operators import reports as R
    c = Ctx(spark, SF001)
    rows = R.change_log(c.recorded, c.branches, change_type="ddl", branch="main", limit=5).collect()
    assert rows and all(r.branch == "main" and r.type == "ddl" for r in rows) and len(rows) <= 5


def test_chunk_plan_on_text_keys(spark):
    """Pages of text keys: in byte order, whole, also for short, empty and non-ASCII keys."""
    import hashlib
    keys = sorted({hashlib.md5(str(i).encode()).hexdigest() for i in range(500)} | {"", "a", "zz", "ä", "日本", "same-head-1", "same-head-2"},
                  key=lambda k: k.encode())
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(5)
    plan = sorted(X.chunk_plan(df, ["k"], 50).collect(), key=lambda r: r.page)
    want = [keys[i:i + 50] for i in range(0, len(keys), 50)]
    assert [(r.low_k, r.high_k, r["rows"]) for r in plan] == [(p[0], p[-1], len(p)) for p in want]


def test_cursor_candidates_with_nulls_repeats_and_no_rows(spark):
    from branchdata.operators import quality as Q
    t = spark.sql("select * from values (1, 1L, 1), (2, null, 1), (3, 3L, 2) as t(a, b, c)").withColumn("text", F.lit("x"))
    got = {(r.table_name, r.column_name): (r.n_rows, r.n_distinct, r.is_candidate)
           for r in Q.cursor_candidates({"t": t, "none": t.limit(0), "texts": t.select("text")}).collect()}
    assert got == {("t", "a"): (3, 3, True), ("t", "b"): (3, 2, False), ("t", "c"): (3, 2, False),
                   **{("none", c): (0, 0, True) for c in "abc"}}
    assert [r.next_key for r in Q.next_keys([("t", "a", t), ("none", "a", t.limit(0))]).collect()] == [4, 1]
