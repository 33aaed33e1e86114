"""The window-based conflict replay equals a step-by-step replay on random
batches of table, column, index and rename changes (plain and hot paths)."""

import random
from datetime import datetime, timedelta

import pytest

from branchdata.operators import conflicts as CF

BASE = {"users": {"id", "email", "name"}, "orders": {"id", "amount"}}
BASE_IDX = {"users_pkey"}
TABLES = ["users", "orders", "t1", "t2"]
COLS = ["id", "email", "amount", "c1", "c2"]


def _random_batch(rnd, n):
    out = []
    for _ in range(n):
        t, c, c2 = rnd.choice(TABLES), rnd.choice(COLS), rnd.choice(COLS)
        kind = rnd.randrange(12)
        if kind == 0:
            out.append(f"CREATE TABLE {t} (id INT, c1 TEXT)")
        elif kind == 1:
            out.append(f"DROP TABLE {t}")
        elif kind == 2:
            out.append(f"ALTER TABLE {t} ADD COLUMN {c} TEXT")
        elif kind == 3:
            out.append(f"ALTER TABLE {t} DROP COLUMN {c}")
        elif kind == 4:
            out.append(f"CREATE INDEX idx_{rnd.randrange(3)} ON {t}(id)")
        elif kind == 5:
            out.append(f"DROP INDEX idx_{rnd.randrange(3)}")
        elif kind == 7:
            out.append(f"create table if not exists public.{t} (id INT, c1 TEXT)")
        elif kind == 8:
            out.append(rnd.choice([f"DROP TABLE IF EXISTS {t}", f"DROP INDEX IF EXISTS public.idx_{rnd.randrange(3)}"]))
        elif kind == 9:
            out.append(rnd.choice([f"ALTER TABLE IF EXISTS ONLY public.{t} ADD COLUMN IF NOT EXISTS {c} TEXT",
                                   f"ALTER TABLE {t} ADD {c} INT", f"ALTER TABLE ONLY {t} DROP COLUMN IF EXISTS {c}"]))
        elif kind == 10:
            out.append(f"CREATE INDEX IF NOT EXISTS idx_{rnd.randrange(3)} ON {t}(id)")
        elif kind == 11:
            out.append(rnd.choice([f"ALTER TABLE {t} ADD COLUMN {c} INT, DROP COLUMN {c2}", f"ALTER TABLE {t} RENAME TO {c}",
                                   f"ALTER TABLE {t} ADD CONSTRAINT k CHECK (id > 0)", "GRANT ALL ON users TO x"]))
        elif c != c2:
            out.append(f"ALTER TABLE {t} RENAME COLUMN {c} TO {c2}")
        else:
            out.append(f"TRUNCATE {t}")
    return out


def _step_by_step(sqls):
    """Each change judged on its own against the state left by the earlier
    ones; accepted changes update the state, rejected ones do not (a rename's
    old name counts as gone and its new name as present either way, as documented)."""
    tables = {t: set(cols) for t, cols in BASE.items()}
    idx = set(BASE_IDX)
    out = []
    for s in sqls:
        w = s.replace("(", " (").lower().replace("public.", "")
        words = [x for x in w.split() if x not in ("if", "not", "exists", "only", "column")]
        guard = "if exists" in w or "if not exists" in w
        res = None
        if "," in w and w.startswith("alter") or " rename to " in w or " constraint " in w or w.startswith("grant"):
            res = "unverified"
        elif words[:2] == ["create", "table"]:
            t = words[2]
            if t in tables:
                res = None if guard else "table_exists"
            else:
                tables[t] = {"id", "c1"}
        elif words[:2] == ["drop", "table"]:
            if tables.pop(words[2], None) is None and not guard:
                res = "dropped_reference"
        elif words[0] == "alter":
            t, act, col = words[2], words[3], words[4]
            if t not in tables:
                res = None if "table if exists" in w else "dropped_reference"
            elif act == "add":
                if col in tables[t] and not guard:
                    res = "column_exists"
                tables[t].add(col)
            elif act == "drop":
                if col not in tables[t] and not guard:
                    res = "dropped_reference"
                tables[t].discard(col)
            else:  # rename
                if col not in tables[t]:
                    res = "dropped_reference"
                elif words[6] in tables[t]:
                    res = "column_exists"
                tables[t].discard(col)
                tables[t].add(words[6])
        elif words[:2] == ["create", "index"]:
            name, t = words[2], words[4]
            if t not in tables:
                res = "dropped_reference"
            elif name in idx:
                res = None if guard else "index_exists"
            else:
                idx.add(name)
        elif words[:2] == ["drop", "index"]:
            if words[2] in idx:
                idx.discard(words[2])
            elif not guard:
                res = "dropped_reference"
        elif words[0] == "truncate":
            if words[1] not in tables:
                res = "dropped_reference"
        out.append(res)
    return out


@pytest.fixture(scope="module")
def batches():
    rnd = random.Random(11)
    return {b: _random_batch(rnd, rnd.randint(5, 40)) for b in range(60)}


def _frame(spark, batches):
    t0 = datetime(2024, 1, 1)
    rows = [(b, i, s, t0 + timedelta(minutes=i)) for b, sqls in batches.items() for i, s in enumerate(sqls, 1)]
    return spark.createDataFrame(rows, "branch_id long, sequence int, sql_text string, applied_at timestamp")


def _catalogs(spark):
    cat = spark.createDataFrame([(t, c) for t, cols in BASE.items() for c in cols],
                                "table_name string, column_name string")
    idx = spark.createDataFrame([(i, "users") for i in BASE_IDX], "index_name string, table_name string")
    return cat, idx


@pytest.mark.parametrize("hot_rows", [None, 10])
def test_replay_matches_step_by_step(spark, batches, hot_rows):
    cat, idx = _catalogs(spark)
    got = CF.check(_frame(spark, batches), cat, idx, hot_rows=hot_rows, max_hot=25).collect()
    by_branch = {}
    for r in got:
        by_branch.setdefault(r.branch_id, {})[r.sequence] = r.conflict_type
    for b, sqls in batches.items():
        want = _step_by_step(sqls)
        have = [by_branch[b][i] for i in range(1, len(sqls) + 1)]
        assert have == want, (b, list(zip(sqls, want, have)))


def test_parents_are_replayed_once(spark):
    """What the parents held is written, so that no reader replays their time lines again."""
    at = datetime(2024, 1, 1)
    changes = spark.createDataFrame([(1, 1, at, "CREATE TABLE t1 (id INT)"), (1, 2, at + timedelta(days=2), "DROP TABLE t1")],
                                    "branch_id long, position long, at timestamp_ntz, sql_text string")
    links = spark.createDataFrame([(2, 1, at + timedelta(days=1)), (3, 1, None)], "branch_id long, parent_id long, at timestamp_ntz")
    touched = spark.createDataFrame([(b, "t1", "id", None) for b in (2, 3)] + [(2, None, None, "users_pkey")],
                                    "branch_id long, table_name string, column_name string, detail string")
    base = spark.createDataFrame([("users", "id")], "table_name string, column_name string")
    idx = spark.createDataFrame([("users_pkey", "users")], "index_name string, table_name string")
    there, there_idx = CF.parent_catalogs(changes, links, touched, base, idx)
    for found in (there, there_idx):
        assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in there.collect()] == [(2, "t1", "id")]
    assert [r.index_name for r in there_idx.collect()] == ["users_pkey"]
