"""Registered queries: sources, extraction, masking, quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import casts as C
from ..operators import extract as X
from ..operators import limits as L
from ..operators import masking as M
from ..operators import quality as Q
from ..operators.catalog import catalog_of
from ..sources.store import BranchStore
from ..sources.tables import DRIVER_TABLES
from . import settings as S
from .registry import Ctx, query
from .sqlparts import catalog, hist

# ---------------------------------------------------------------- sources


@query("scan_table", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'
""")
def scan_table(c: Ctx):
    return (c.t("orders").filter(F.col("o_orderdate") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
            .select("o_orderkey", "o_custkey", "o_totalprice"))


_COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in DRIVER_TABLES)


@query("table_stats", _COUNTS_SQL)
def table_stats(c: Ctx):
    return X.table_stats(c.src, DRIVER_TABLES)


@query("schema_catalog", f"WITH {catalog(list(DRIVER_TABLES))} SELECT * FROM cat")
def schema_catalog(c: Ctx):
    return catalog_of(c.spark, {t: c.t(t) for t in DRIVER_TABLES})


_CURSOR_COLS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"],
    "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"],
    "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    "events": ["event_id", "user_id"], "documents": ["doc_id", "n_chars"], "embeddings": ["vec_id", "label"],
    "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn"],
}
_CURSOR_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{col}' AS column_name, count(*) AS n_rows, "
    f"count(DISTINCT {col}) AS n_distinct, count(DISTINCT {col}) = count(*) AND count({col}) = count(*) AS is_candidate "
    f"FROM {t}"
    for t, cols in _CURSOR_COLS.items() for col in cols)


@query("cursor_candidates", _CURSOR_SQL)
def cursor_candidates(c: Ctx):
    """Integer columns of all tables, and which of them may be a load cursor."""
    return Q.cursor_candidates({t: c.t(t) for t in DRIVER_TABLES})


_NEXT_KEY_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{k}' AS key_column, CAST(coalesce(max({k}), 0) + 1 AS BIGINT) AS next_key FROM {t}"
    for t, k in S.KEYED_TABLES)


@query("next_key", _NEXT_KEY_SQL)
def next_key(c: Ctx):
    return Q.next_keys([(t, k, c.t(t)) for t, k in S.KEYED_TABLES])


@query("exclude_tables", f"""
WITH s AS ({_COUNTS_SQL}) SELECT table_name, row_count FROM s
WHERE table_name NOT IN ({", ".join(f"'{t}'" for t in S.EXCLUDED_TABLES)})
""")
def exclude_tables(c: Ctx):
    stats = X.table_stats(c.src, DRIVER_TABLES)
    return stats.filter(~F.col("table_name").isin(*S.EXCLUDED_TABLES))


@query("extraction_plan", f"""
WITH s AS ({_COUNTS_SQL}),
spec AS (SELECT * FROM (VALUES ('customer', 'c_mktsegment = ''BUILDING''', 500), ('orders', 'o_orderstatus = ''F''', NULL))
         AS t(table_name, where_clause, spec_limit)),
j AS (SELECT s.table_name, s.row_count, spec.where_clause,
        CASE WHEN spec.where_clause IS NOT NULL THEN CAST(coalesce(spec.spec_limit, 5000) AS BIGINT)
             WHEN s.row_count < 1000 THEN NULL ELSE CAST(5000 AS BIGINT) END AS row_limit
      FROM s LEFT JOIN spec ON s.table_name = spec.table_name)
SELECT table_name, row_count, where_clause, row_limit,
  'SELECT * FROM ' || table_name || CASE WHEN where_clause IS NOT NULL THEN ' WHERE ' || where_clause ELSE '' END
  || CASE WHEN row_limit IS NOT NULL THEN ' LIMIT ' || CAST(row_limit AS VARCHAR) ELSE '' END AS query_text
FROM j
""")
def extraction_plan(c: Ctx):
    stats = X.table_stats(c.src, DRIVER_TABLES)
    return X.extraction_plan(stats, X.plan_specs(c.spark, S.PLAN_SPECS))


# ---------------------------------------------------------------- extraction


@query("extract_subset", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice > 100000
""")
def extract_subset(c: Ctx):
    spec = X.ExtractSpec("orders", where="o_orderstatus = 'F' AND o_totalprice > 100000",
                         columns=("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))
    return X.extract(c.t("orders"), spec)


@query("extract_recent", f"""
SELECT event_id, user_id, event_type, ts FROM events
WHERE ts >= TIMESTAMP '{S.EVENTS_REF_TS}' - INTERVAL {S.RECENT_DAYS} DAY
""")
def extract_recent(c: Ctx):
    return X.recent(c.t("events"), "ts", S.EVENTS_REF_TS, S.RECENT_DAYS) \
        .select("event_id", "user_id", "event_type", "ts")


_LI_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


@query("extract_limited", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate FROM lineitem
ORDER BY {", ".join(_LI_ORDER)} LIMIT 10000
""")
def extract_limited(c: Ctx):
    """Default-limit load (10,000 rows) made repeatable by a total key order."""
    spec = X.ExtractSpec("lineitem", columns=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                              "l_quantity", "l_extendedprice", "l_shipdate"),
                         limit=10_000, key=_LI_ORDER)
    return X.extract(c.t("lineitem"), spec)


@query("extract_half", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate FROM lineitem
ORDER BY {", ".join(_LI_ORDER)} LIMIT (SELECT count(*) // 2 FROM lineitem)
""")
def extract_half(c: Ctx):
    """The first half of lineitem in key order: no task holds the limit's rows."""
    rows = c.t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return L.first_rows(rows, _LI_ORDER, rows.count() // 2)


@query("extract_query", """
SELECT o_orderkey, o_custkey, '#' || right(o_orderstatus, 4) AS status, o_totalprice * 2 AS doubled, '***' AS o_orderpriority
FROM orders WHERE o_totalprice > 100000
""")
def extract_query(c: Ctx):
    """An extraction written as query text, run over the masked table."""
    text = ("SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_totalprice * 2 AS doubled, o_orderpriority "
            "FROM orders WHERE o_totalprice > 100000")
    return X.extract_query(c.src, "orders", text, S.MASK_RULES, id_col="o_orderkey")


@query("keyset_page", """
SELECT conv_id, turn, role FROM conversations
WHERE (conv_id, turn) > (20, 2) ORDER BY conv_id, turn LIMIT 100
""")
def keyset_page(c: Ctx):
    return X.keyset_page(c.t("conversations").select("conv_id", "turn", "role"),
                         ["conv_id", "turn"], [20, 2], 100)


@query("chunk_plan", """
WITH n AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS rn FROM conversations)
SELECT CAST((rn - 1) // 50 AS INT) AS page, arg_min(conv_id, rn) AS low_conv_id, arg_min(turn, rn) AS low_turn,
  arg_max(conv_id, rn) AS high_conv_id, arg_max(turn, rn) AS high_turn, count(*) AS rows
FROM n GROUP BY 1
""")
def chunk_plan(c: Ctx):
    return X.chunk_plan(c.t("conversations"), ["conv_id", "turn"], 50)


_SNAP_SQL = """
SELECT c_custkey, '***-**-' || right(c_name, 4) AS c_name, c_nationkey, c_acctbal, c_mktsegment
FROM customer WHERE c_mktsegment = 'BUILDING'
"""


@query("snapshot_load", _SNAP_SQL)
def snapshot_load(c: Ctx):
    """Extract + mask + write into a branch store, then read the stored rows back."""
    store = BranchStore(c.spark, c.scratch())
    res = X.snapshot_load(c.src, store, "branch_feature_x", S.CUSTOMER_LOAD, S.MASK_RULES)
    if res.status != "ready":
        raise RuntimeError(res.error)
    return c.spark.read.parquet(res.path)


_LOAD_ALL_SQL = """
SELECT 'customer' AS table_name, 'ready' AS status, count(*) AS rows_loaded FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'orders', 'ready', count(*) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'supplier', 'ready', count(*) FROM supplier
UNION ALL SELECT 'part', 'ready', count(*) FROM part WHERE p_size <= 10
UNION ALL SELECT 'nation', 'ready', count(*) FROM nation
UNION ALL SELECT 'region', 'ready', count(*) FROM region
"""


@query("snapshot_all", _LOAD_ALL_SQL)
def snapshot_all(c: Ctx):
    """Load six tables with three concurrent jobs; the result is the stored
    per-table state (rows counted during the write)."""
    store = BranchStore(c.spark, c.scratch())
    X.snapshot_all(c.src, store, "branch_feature_x", S.LOAD_SPECS, S.MASK_RULES, parallel_tables=3)
    return (store.latest().filter(F.col("branch") == "branch_feature_x")
            .select("table_name", "status", "rows_loaded"))


@query("clone_branch", _LOAD_ALL_SQL)
def clone_branch(c: Ctx):
    """Give a new branch the ready tables of another (pointers at their
    versions), then report the new branch's tables as read back."""
    store = BranchStore(c.spark, c.scratch())
    X.snapshot_all(c.src, store, "branch_a", S.LOAD_SPECS, S.MASK_RULES, parallel_tables=3)
    tables = X.copy_branch(store, "branch_a", "branch_b")
    counts = reduce(DataFrame.unionByName, [
        store.read("branch_b", t).agg(F.count(F.lit(1)).alias("rows_loaded")).select(F.lit(t).alias("table_name"), "rows_loaded")
        for t in tables])
    state = store.latest().filter(F.col("branch") == "branch_b").select("table_name", "status")
    return state.join(counts, "table_name").select("table_name", "status", "rows_loaded")


# ---------------------------------------------------------------- masking


@query("mask_projection", """
SELECT o_orderkey, o_custkey, '#' || right(o_orderstatus, 4) AS o_orderstatus, o_totalprice, o_orderdate,
  '***' AS o_orderpriority FROM orders
""")
def mask_projection(c: Ctx):
    return M.mask_frame(c.t("orders"), "orders", S.MASK_RULES, id_col="o_orderkey")


@query("mask_static", "SELECT s_suppkey, 'REDACTED' AS s_name, s_nationkey, s_acctbal FROM supplier")
def mask_static(c: Ctx):
    return M.mask_frame(c.t("supplier"), "supplier", S.MASK_RULES, id_col="s_suppkey")


@query("mask_row_id", """
SELECT c_custkey, 'masked_' || CAST(c_custkey AS VARCHAR) || '@example.com' AS c_name, c_mktsegment FROM customer
""")
def mask_row_id(c: Ctx):
    rules = {"customer.c_name": "masked_{{id}}@example.com"}
    return M.mask_frame(c.t("customer").select("c_custkey", "c_name", "c_mktsegment"), "customer",
                        rules, id_col="c_custkey")


@query("mask_last4", """
SELECT c_custkey, '***-**-' || right(c_name, 4) AS c_name, c_nationkey FROM customer
""")
def mask_last4(c: Ctx):
    return M.mask_frame(c.t("customer").select("c_custkey", "c_name", "c_nationkey"), "customer",
                        S.MASK_RULES, id_col="c_custkey")


@query("mask_column_name", """
SELECT p_partkey, 'redacted p_name' AS p_name, p_brand FROM part
""")
def mask_column_name(c: Ctx):
    return M.mask_frame(c.t("part").select("p_partkey", "p_name", "p_brand"), "part", S.MASK_RULES,
                        id_col="p_partkey")


_RULES_SQL = ", ".join(f"('{k.lower()}', '{v}')" for k, v in sorted(S.MASK_RULES.items()))


@query("mask_rules_applied", f"""
WITH {catalog(list(DRIVER_TABLES))},
r AS (SELECT * FROM (VALUES {_RULES_SQL}) AS t(rule_key, pattern)),
q AS (SELECT split_part(rule_key, '.', 1) AS q_table, split_part(rule_key, '.', 2) AS q_col, pattern AS q_pattern,
        rule_key AS q_key FROM r WHERE contains(rule_key, '.')),
b AS (SELECT rule_key AS b_col, pattern AS b_pattern, rule_key AS b_key FROM r WHERE NOT contains(rule_key, '.'))
SELECT cat.table_name, cat.column_name, coalesce(q_pattern, b_pattern) AS pattern, coalesce(q_key, b_key) AS rule_key
FROM cat LEFT JOIN q ON lower(cat.table_name) = q.q_table AND lower(cat.column_name) = q.q_col
LEFT JOIN b ON lower(cat.column_name) = b.b_col
WHERE q_pattern IS NOT NULL OR b_pattern IS NOT NULL
""")
def mask_rules_applied(c: Ctx):
    cat = catalog_of(c.spark, {t: c.t(t) for t in DRIVER_TABLES})
    return M.rules_applied(cat, M.rules_frame(c.spark, S.MASK_RULES))


def _pii_sql_case(col: str) -> tuple[str, str]:
    from ..constants import PII_RULES
    rule = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower({col}), '{n}')" for n in needles) + f" THEN '{g}'"
        for g, needles, _ in PII_RULES) + " END"
    mask = "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower({col}), '{n}')" for n in needles) + f" THEN '{p}'"
        for g, needles, p in PII_RULES) + " END"
    return rule, mask


_PII_RULE, _PII_MASK = _pii_sql_case("column_name")


@query("pii_detect", f"""
WITH {catalog(list(DRIVER_TABLES))}
SELECT table_name, column_name, rule, mask FROM (
  SELECT table_name, column_name, {_PII_RULE} AS rule, {_PII_MASK} AS mask FROM cat) WHERE rule IS NOT NULL
""")
def pii_detect(c: Ctx):
    cat = catalog_of(c.spark, {t: c.t(t) for t in DRIVER_TABLES})
    return M.pii_detect(cat)


@query("mask_leak_check", """
WITH m AS (SELECT c_custkey, '***-**-' || right(c_name, 4) AS c_name, c_mktsegment FROM customer
           WHERE c_mktsegment = 'BUILDING')
SELECT 'c_name' AS column_name, count(*) FILTER (WHERE m.c_name = r.c_name) AS leaks FROM m JOIN customer r USING (c_custkey)
""")
def mask_leak_check(c: Ctx):
    """Load a masked subset into a branch, read the stored rows back and
    count values still equal to the raw source (must be 0)."""
    store = BranchStore(c.spark, c.scratch())
    res = X.snapshot_load(c.src, store, "branch_leak", S.CUSTOMER_LOAD, S.MASK_RULES)
    stored = c.spark.read.parquet(res.path)
    return M.leak_check(c.t("customer"), stored, "c_custkey", ["c_name"])


# ---------------------------------------------------------------- quality


@query("check_unique", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def check_unique(c: Ctx):
    return Q.check_unique(c.t("lineitem"), ["l_orderkey", "l_linenumber"])


_NN_COLS = ("branch_id", "name", "parent_branch", "status", "created_at", "merged_at")


@query("check_not_null", hist(" UNION ALL ".join(
    f"SELECT '{col}' AS column_name, count(*) FILTER (WHERE {col} IS NULL) AS nulls FROM v_branches" for col in _NN_COLS)))
def check_not_null(c: Ctx):
    return Q.check_not_null(c.branches, list(_NN_COLS))


@query("check_expression", """
SELECT o_orderkey, o_totalprice FROM orders WHERE NOT coalesce(o_totalprice >= 1000, true)
""")
def check_expression(c: Ctx):
    return Q.check_expression(c.t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice >= 1000")


@query("check_orphans", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
                  WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderkey = l.l_orderkey)
""")
def check_orphans(c: Ctx):
    """Line items whose order is missing from the extracted orders subset
    (orders of BUILDING customers): foreign keys are not enforced on branches."""
    cust = c.t("customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    sub = c.t("orders").join(cust, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    li = c.t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return Q.check_orphans(li, sub, ["l_orderkey"], ["o_orderkey"])


@query("check_masked_unique", """
SELECT 'row_id' AS mask_kind, count(*) AS n_rows,
  count(DISTINCT 'masked_' || CAST(c_custkey AS VARCHAR) || '@example.com') AS n_distinct,
  count(*) = count(DISTINCT 'masked_' || CAST(c_custkey AS VARCHAR) || '@example.com') AS unique_kept FROM customer
UNION ALL
SELECT 'static', count(*), count(DISTINCT 'REDACTED'), count(*) = count(DISTINCT 'REDACTED') FROM customer
""")
def check_masked_unique(c: Ctx):
    cust = c.t("customer").select("c_custkey", "c_name")
    by_id = M.mask_frame(cust, "customer", {"customer.c_name": "masked_{{id}}@example.com"}, id_col="c_custkey")
    static = M.mask_frame(cust, "customer", {"customer.c_name": "REDACTED"}, id_col="c_custkey")
    a = Q.masked_uniqueness(by_id, "c_name").select(F.lit("row_id").alias("mask_kind"), "*")
    b = Q.masked_uniqueness(static, "c_name").select(F.lit("static").alias("mask_kind"), "*")
    return a.unionByName(b)


# ---------------------------------------------------------------- type changes

_PROFILED = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
               "o_orderpriority": "string"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
             "p_retailprice": "double"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
                 "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
                 "l_linestatus": "string"},
}
_TARGETS = ("smallint", "int", "bigint")


def _profile_sql() -> str:
    """Integer targets only: there both engines' casts agree (a fraction is a changed value)."""
    duck = {"smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
    low = {"smallint": -2 ** 15, "int": -2 ** 31, "bigint": -2 ** 63}
    out = []
    for t, cols in _PROFILED.items():
        for c, kind in cols.items():
            for to in _TARGETS:
                if kind == to:
                    continue
                if kind == "double":
                    bad = f"{c} IS NOT NULL AND NOT (trunc({c}) >= {low[to]} AND trunc({c}) < {-low[to]})"
                    back = f"trunc({c})"
                else:
                    bad = f"{c} IS NOT NULL AND TRY_CAST({c} AS {duck[to]}) IS NULL"
                    back = f"CAST(TRY_CAST({c} AS {duck[to]}) AS {duck[kind]})"
                out.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{kind}' AS data_type, '{to}' AS target_type, "
                           f"count({c}) AS n_values, count(*) FILTER (WHERE {bad}) AS failed, "
                           f"count(*) FILTER (WHERE {c} IS NOT NULL AND NOT ({bad}) AND {back} IS DISTINCT FROM {c}) AS changed FROM {t}")
    return " UNION ALL ".join(out)


@query("cast_profile", _profile_sql())
def cast_profile(c: Ctx):
    """What each integer type would do to the values of each column."""
    return C.cast_profile({t: c.t(t).select(*cols) for t, cols in _PROFILED.items()}, _TARGETS)


@query("type_mismatch", f"""SELECT table_name, column_name, target_type, CASE WHEN failed > 0 THEN 'type_mismatch' END AS conflict_type,
  failed, changed FROM ({_profile_sql()})""")
def type_mismatch(c: Ctx):
    """The verdict on an ALTER TYPE of every column to every integer type, by what is stored."""
    from ..functions.changes import with_objects
    tables = {t: c.t(t).select(*cols) for t, cols in _PROFILED.items()}
    texts = [(f"ALTER TABLE {t} ALTER COLUMN {col} TYPE {to}",) for t, cols in _PROFILED.items() for col, kind in cols.items()
             for to in _TARGETS if kind != to]
    actions = (with_objects(c.spark.createDataFrame(texts, "sql_text string"))
               .select("table_name", "column_name", F.col("detail").alias("target_type")))
    return C.type_verdicts(actions, C.cast_profile(tables, _TARGETS)).select(
        "table_name", "column_name", "target_type", "conflict_type", "failed", "changed")
