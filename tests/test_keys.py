"""Keys, foreign keys and load order found in data, against brute force."""

import random
from itertools import combinations

import pytest

from branchdata.operators import keys as K


def _frames(spark, tables):
    return {t: spark.createDataFrame(rows, schema) for t, (schema, rows) in tables.items()}


def _brute(tables, max_columns=2):
    keys, included = [], []
    cols = {t: [c.split()[0] for c in schema.split(", ")] for t, (schema, _) in tables.items()}
    for t, (_, rows) in tables.items():
        whole = [i for i in range(len(cols[t])) if rows and all(r[i] is not None for r in rows)]
        for width in range(1, max_columns + 1):
            for some in combinations(whole, width):
                if len({tuple(r[i] for i in some) for r in rows}) == len(rows) and not any(
                        u == t and set(k) <= {cols[t][i] for i in some} for u, k in keys):
                    keys.append((t, tuple(cols[t][i] for i in some)))
    kinds = {(t, c.split()[0]): c.split()[1] for t, (schema, _) in tables.items() for c in schema.split(", ")}
    for t, (_, rows) in tables.items():
        for i, c in enumerate(cols[t]):
            mine = {r[i] for r in rows if r[i] is not None}
            for u, k in keys:
                if len(k) == 1 and u != t and mine and (kinds[t, c] in ("int", "long")) == (kinds[u, k[0]] in ("int", "long")):
                    theirs = {r[cols[u].index(k[0])] for r in tables[u][1]}
                    if mine <= theirs:
                        included.append((t, c, u, k[0]))
    return keys, included


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([1, 7, 60, 400])
    tables = {
        "item": ("i_id int, i_code string, i_shelf int, i_place int", [(i, f"c{i}", i // 9, i % 9) for i in range(n)]),
        "sale": ("s_id long, i_id long, s_code string, s_note string",
                 [(i, rng.randrange(n), f"c{rng.randrange(n)}", rng.choice([None, "x", ""])) for i in range(2 * n)]),
        "odd": ("a int, b int, c int", [(rng.randrange(-3, 3), None if rng.random() < .3 else i, i % 4) for i in range(n)]),
        "none": ("x int, y string", []),
        "line": ("i_id int, line int, twin int", [(i // 3, i % 3, i // 2) for i in range(n)]),
    }
    got = K.key_catalog(_frames(spark, tables)).collect()
    keys, included = _brute(tables)
    assert sorted((r.table_name, r["columns"]) for r in got if r.kind == "key") == sorted((t, ",".join(k)) for t, k in keys)
    assert sorted((r.table_name, r["columns"], r.ref_table, r.ref_column) for r in got if r.kind != "key") == sorted(included)
    assert all(sum(r.is_primary for r in got if r.kind == "key" and r.table_name == t) == 1 for t in {t for t, _ in keys})
    foreign = {(r.table_name, r["columns"], r.ref_table) for r in got if r.kind == "foreign"}
    if ("item", ("i_id",)) in keys:
        assert ("sale", "i_id", "item") in foreign


def test_hot_value_and_wide_words(spark, monkeypatch):
    """A value of most rows, and more columns than one word holds."""
    monkeypatch.setattr(K, "BITS", 3)
    n = 300
    tables = {"p": ("p_id int", [(i,) for i in range(n)]),
              **{f"t{k}": (f"t{k}_no int, p_id int", [(1000 * k + i, 7 if i % 3 else i) for i in range(n)]) for k in range(6)}}
    got = K.key_catalog(_frames(spark, tables)).collect()
    foreign = {(r.table_name, r["columns"], r.ref_table, r.ref_column) for r in got if r.kind == "foreign"}
    assert foreign == {(f"t{k}", "p_id", "p", "p_id") for k in range(6)}
    assert ({(r.table_name, r["columns"], r.ref_table, r.ref_column) for r in got if r.kind == "included"}
            == {x for x in map(tuple, _brute(tables)[1])} - foreign)


def test_circle_of_references(spark):
    catalog = spark.createDataFrame([("a", "foreign", "x", None, "b", "x"), ("b", "foreign", "y", None, "a", "y"),
                                     ("c", "foreign", "z", None, "d", "z")], K.CATALOG)
    got = {r.table_name: r.level for r in K.dependency_order(["a", "b", "c", "d"], catalog).collect()}
    assert got == {"d": 0, "c": 1, "a": 2, "b": 2}


def test_dense_keys_are_shuffled_as_blocks(spark):
    """A single key and a pair take a few rows a block, not one a table row."""
    n = 64_000
    tables = {"line": spark.range(0, n, 1, 2).selectExpr("id AS l_id", "id div 4 AS l_order", "cast(id % 4 AS int) AS l_no")}
    sets = [("line", ("l_id",)), ("line", ("l_order", "l_no")), ("line", ("l_order",))]
    columns = K.profiles(tables)
    assert K.set_blocks(tables, sets, columns).count() <= n / 16
    assert K.repeated_sets(tables, sets, columns) == {sets[2]}


def test_values_at_the_ends_of_their_types(spark):
    """Negative and extreme numbers, dates and times, one value apart."""
    ends = [-(1 << 63), -(1 << 63) + 1, -65, -64, -1, 0, 63, 64, (1 << 63) - 2, (1 << 63) - 1]
    one = spark.createDataFrame([(x, i % 2) for i, x in enumerate(ends)], "a long, b int")
    two = spark.createDataFrame([(x, 0) for x in ends[1:]], "a long, b int")
    lacks = spark.createDataFrame([(x,) for x in ends if x != -64] + [(7,)], "z long")
    days = spark.sql("""SELECT date'1969-12-31' + cast(id div 3 AS int) AS d,
      timestamp_ntz'1969-12-31 23:59:59.999999' + make_interval(0, 0, 0, 0, 0, 0, id % 3) AS t FROM range(300)""")
    got = K.key_catalog({"one": one, "two": two, "lacks": lacks, "days": days}).collect()
    assert {(r.table_name, r["columns"]) for r in got if r.kind == "key"} == {
        ("one", "a"), ("two", "a"), ("lacks", "z"), ("days", "d,t")}
    assert {(r.table_name, r["columns"], r.ref_table, r.ref_column) for r in got if r.kind != "key"} == {
        ("two", "a", "one", "a"), ("two", "b", "one", "a"), ("two", "b", "lacks", "z")}
