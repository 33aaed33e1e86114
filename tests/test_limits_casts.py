"""Large limits without a one-task sort, cast profiles, seed rows, merges and lineage in small."""

import random

import pytest
from pyspark.sql import functions as F

from branchdata.operators import casts as C
from branchdata.operators import conflicts as CF
from branchdata.operators import evolve as EV
from branchdata.operators import history as HI
from branchdata.operators import lineage as LN
from branchdata.operators import limits as L
from branchdata.operators import merging as MG
from branchdata.functions.changes import statement_actions
from test_conflict_replay import BASE, BASE_IDX, _random_batch, _step_by_step


@pytest.mark.parametrize("key", [("k",), ("g", "k"), ("t", "k"), ("d",)])
def test_first_rows(spark, key):
    rng = random.Random(3)
    rows = [(i if rng.random() > .02 else None, i % 3, f"same beginning {i % 40:03d}", float(rng.randrange(300))) for i in range(1500)]
    rows += [(10 ** 12, 0, "a", 1e12)]
    df = spark.createDataFrame(rows, "k long, g int, t string, d double").repartition(5)
    want = sorted([r for r in rows if all(r["kgtd".index(c)] is not None for c in key)], key=lambda r: [r["kgtd".index(c)] for c in key])
    for n in (1, 700, len(want), len(want) + 3):
        got = sorted(map(tuple, L.first_rows(df, key, n, small=20).collect()), key=repr)
        assert len(got) == min(n, len(rows))
        cut = [[r["kgtd".index(c)] for c in key] for r in want[:n]]
        assert sorted([[r["kgtd".index(c)] for c in key] for r in got if all(r["kgtd".index(c)] is not None for c in key)]) == cut
        assert len(set(got)) == len(got)
    plan = L.first_rows(df, ("k",), 700, small=20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan


def test_cast_profile(spark):
    df = spark.createDataFrame([("1", 1.5, 70000, None), ("x", 2.0, 3, True), (None, None, None, None), ("1e3", -0.25, -5, False)],
                               "s string, d double, i int, b boolean")
    got = {(r.column_name, r.target_type): (r.n_values, r.failed, r.changed) for r in C.cast_profile({"t": df}).collect()}
    assert got["i", "smallint"] == (3, 1, 0) and got["d", "int"] == (3, 0, 2) and got["s", "int"][:2] == (3, 2)
    assert got["s", "double"][1] == 1 and got["i", "date"] == (3, 3, 0) and got["b", "int"] == (2, 0, 0)
    verdicts = C.type_verdicts(spark.createDataFrame([("t", "i", "smallint"), ("t", "i", "bigint"), ("t", "zz", "int")],
                                                     "table_name string, column_name string, target_type string"), C.cast_profile({"t": df}))
    assert {(r.column_name, r.target_type): r.conflict_type for r in verdicts.collect()} == {
        ("i", "smallint"): "type_mismatch", ("i", "bigint"): None, ("zz", "int"): None}
    assert C.cast_profile({"t": df.limit(0)}).where("failed > 0 OR n_values > 0").count() == 0


def test_actions_and_silent_skips(spark):
    texts = ["ALTER TABLE t ADD COLUMN a NUMERIC(10, 2) DEFAULT 'x, y', DROP COLUMN b;",
             "/* two\n lines */ -- and\nALTER TABLE ONLY p.t\n  ADD COLUMN a TEXT,\n  ALTER COLUMN c TYPE varchar(3)",
             "CREATE TABLE t (a INT, b TEXT)", "INSERT INTO t VALUES (1, 'a'), (2, 'b')", ""]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(statement_actions("s")).collect()
    want = [["ALTER TABLE t ADD COLUMN a NUMERIC(10, 2) DEFAULT 'x, y'", "ALTER TABLE t DROP COLUMN b"],
            ["ALTER TABLE ONLY p.t\n  ADD COLUMN a TEXT", "ALTER TABLE ONLY p.t\n  ALTER COLUMN c TYPE varchar(3)"], [texts[2]], [texts[3]], [""]]
    assert [r[0] for r in got] == want == [EV.actions(t) for t in texts]
    df = spark.createDataFrame([(1, 2)], "id int, b int")
    out = EV.apply_changes(df, ["ALTER TABLE t ADD COLUMN a INT, ADD COLUMN c INT DEFAULT 7", "CREATE INDEX i ON t(id)"])
    assert out.columns == ["id", "b", "a", "c"] and out.first()["c"] == 7
    for bad in (["TRUNCATE t"], ["ALTER TABLE t DROP COLUMN nope"], ["ALTER TABLE t ADD COLUMN id INT"]):
        with pytest.raises(ValueError):
            EV.apply_changes(df, bad)
        with pytest.raises(ValueError):
            EV.reset(df, [*bad, "ALTER TABLE t DROP COLUMN b"], 1)


def test_multi_line_create_is_read(spark):
    changes = spark.createDataFrame([(1, i, s) for i, s in enumerate([
        "CREATE TABLE t9 (\n id INT,\n price NUMERIC(10,2),\n name TEXT\n)", "ALTER TABLE t9 DROP COLUMN name",
        "/* a\n b */ ALTER TABLE t9 ADD COLUMN name TEXT", "ALTER TABLE t9 ADD COLUMN price INT", "DROP TABLE t9, users"], 1)],
        "branch_id long, sequence int, sql_text string")
    catalog = spark.createDataFrame([(t, c) for t, cols in BASE.items() for c in cols], "table_name string, column_name string")
    got = CF.check(changes, catalog, spark.createDataFrame([(i, "users") for i in BASE_IDX], "index_name string, table_name string"))
    assert [r.conflict_type for r in got.orderBy("sequence").collect()] == [None, None, None, "column_exists", "unverified"]


def test_given_type_and_description_win(spark):
    rows = spark.createDataFrame([("DROP TABLE t", "test", "mine"), ("DROP TABLE t", None, "")], "sql_text string, type string, description string")
    assert [(r.type, r.description) for r in HI.classify(rows).collect()] == [("test", "mine"), ("ddl", "drop table t")]


def _whole(batch):
    """Statements of one action each (several come apart in the merge)."""
    return [s for s in batch if "," not in s.split("(")[0]]


@pytest.mark.parametrize("strategy", ["ours", None])
def test_merge_up_the_tree(spark, strategy):
    rng = random.Random(8)
    parents = {0: None, 1: 0, 2: 0, 3: 1, 4: 1, 5: 3, 6: 3, 7: 2, 8: 7}
    closed, gated = {4}, {2}
    own = {b: _whole(_random_batch(rng, rng.choice([0, 3, 9]))) for b in parents}
    branches = spark.createDataFrame([(b, p, b not in closed and b != 0) for b, p in parents.items()],
                                     "branch_id long, parent_id long, is_open boolean")
    changes = spark.createDataFrame([(b, i, s, "ddl") for b, batch in own.items() for i, s in enumerate(batch, 1)],
                                    "branch_id long, sequence int, sql_text string, type string")
    catalog = spark.createDataFrame([(t, c) for t, cols in BASE.items() for c in cols], "table_name string, column_name string")
    indexes = spark.createDataFrame([(i, "users") for i in BASE_IDX], "index_name string, table_name string")
    added, outcomes = MG.merge_apply(branches, changes, catalog, indexes, spark.createDataFrame([(g,) for g in gated], "branch_id long"), strategy)

    def level(b):
        return 0 if parents[b] is None else 1 + level(parents[b])
    history = {b: list(batch) for b, batch in own.items()}
    want, results = [], {}
    for depth in range(max(map(level, parents)), 0, -1):
        kids = [b for b in sorted(parents) if level(b) == depth and b not in closed]
        for p in {parents[b] for b in kids}:
            sent = [(b, i, s) for b in kids if parents[b] == p and p not in gated for i, s in enumerate(history[b], 1)]
            verdicts = _step_by_step(history[p] + [s for *_, s in sent])[len(history[p]):]
            bad = {b for (b, *_), v in zip(sent, verdicts) if v} if strategy is None else set()
            kept = [x for x, v in zip(sent, verdicts) if not v and x[0] not in bad]
            for b in kids:
                if parents[b] == p:
                    n, k = sum(x[0] == b for x in sent), sum(x[0] == b for x in kept)
                    results[b] = ("gated" if p in gated else "nothing to merge" if not n else "refused" if b in bad else "merged", n, k)
            want += [(p, len(history[p]) + j, b, i) for j, (b, i, _) in enumerate(kept, 1)]
            history[p] = history[p] + [s for *_, s in kept]
    assert sorted((r.branch_id, r.sequence, r.from_branch, r.from_sequence) for r in added.collect()) == sorted(want)
    assert {r.branch_id: (r.outcome, r.sent, r.applied) for r in outcomes.collect()} == results


def test_circle_of_branches(spark):
    with pytest.raises(ValueError, match="circle"):
        MG.tree_levels(spark.createDataFrame([(1, 2), (2, 1), (0, None)], "branch_id long, parent_id long"))


def test_lineage_follows_long_chains(spark):
    """Renames of renames, types on the way, drops and tables made anew, step by step."""
    rng, rows, want = random.Random(5), [], {}
    for branch in range(6):
        cols = {"id": ("seed", "id", 0, "int", None), "name": ("seed", "name", 0, "text", None)}
        for seq in range(1, rng.choice([4, 40])):
            kind, new = rng.randrange(6), f"c{rng.randrange(30)}"
            have = sorted(cols)
            if kind == 0 and new not in cols:
                cols[new] = ("add", new, 0, "numeric(10,2)", "'x, y'")
                sql = f"ALTER TABLE users ADD COLUMN {new} NUMERIC(10,2) DEFAULT 'x, y' NOT NULL"
            elif kind in (1, 2, 3) and have and new not in cols:
                old = rng.choice(have)
                o = cols.pop(old)
                cols[new] = (o[0], o[1], o[2] + 1, *o[3:])
                sql = f"ALTER TABLE users RENAME COLUMN {old} TO {new}"
            elif kind == 4 and have:
                old = rng.choice(have)
                cols[old] = (*cols[old][:3], "bigint", cols[old][4])
                sql = f"ALTER TABLE users ALTER COLUMN {old} TYPE BIGINT USING {old}::bigint"
            elif kind == 5 and len(have) > 1:
                old = rng.choice(have)
                del cols[old]
                sql = f"ALTER TABLE users DROP COLUMN {old}"
            else:
                sql = "ALTER TABLE users DROP COLUMN never_there"
            rows.append((branch, seq, sql))
        want[branch] = {(c, *o) for c, o in cols.items()}
    changes = spark.createDataFrame(rows, "branch_id long, sequence int, sql_text string")
    catalog = spark.createDataFrame([("users", "id", "int"), ("users", "name", "text")], "table_name string, column_name string, data_type string")
    actions = LN.effective_actions(changes, catalog.select("table_name", "column_name"),
                                   spark.createDataFrame([], "index_name string, table_name string"))
    got = {}
    for r in LN.column_lineage(actions, catalog).collect():
        got.setdefault(r.branch_id, set()).add((r.column_name, r.origin, r.origin_column, r.renames, r.data_type, r.default))
    assert got == want and max(r[3] for rows in want.values() for r in rows) > 4
    assert LN.skipped_actions(actions).count() == sum("never_there" in s for *_, s in rows)
