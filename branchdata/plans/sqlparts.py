"""DuckDB SQL pieces for the oracle queries (the expected results).

These mirror, in plain SQL, what the Spark side computes with DataFrame
expressions; they are only used to check results.
"""

from __future__ import annotations

from ..constants import DDL_PREFIXES
from ..functions.changes import ALTER_PARTS, ITEM, LEADING_COMMENTS

V_BRANCHES = """v_branches AS (
SELECT c.c_custkey AS branch_id,
  CASE WHEN c.c_custkey = 0 THEN 'main' ELSE concat('feature/', lower(c.c_mktsegment), '-', CAST(c.c_custkey AS VARCHAR)) END AS name,
  CASE WHEN p.c_custkey = 0 THEN 'main' ELSE concat('feature/', lower(p.c_mktsegment), '-', CAST(p.c_custkey AS VARCHAR)) END AS parent_branch,
  CASE WHEN c.c_custkey = 0 THEN 'active' WHEN c.c_custkey % 7 = 3 THEN 'merged' WHEN c.c_custkey % 11 = 5 THEN 'deleted' ELSE 'active' END AS status,
  COALESCE(o.first_ts, (SELECT min(o_orderdate) FROM orders)) AS created_at,
  CASE WHEN c.c_custkey % 7 = 3 THEN o.last_ts END AS merged_at
FROM customer c
JOIN customer p ON p.c_custkey = CAST(floor(c.c_custkey / 5) AS BIGINT)
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey)"""

V_MIGRATIONS = """v_migrations AS (
SELECT o_orderkey AS migration_id, o_custkey AS branch_id,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS sequence,
  CASE o_orderkey % 24
    WHEN 12 THEN concat('ALTER TABLE public.users ADD COLUMN IF NOT EXISTS c', CAST(o_orderkey % 50 AS VARCHAR), ' TEXT')
    WHEN 13 THEN concat('CREATE TABLE IF NOT EXISTS t', CAST(o_orderkey % 50 AS VARCHAR), ' (id INT)')
    WHEN 14 THEN concat('CREATE INDEX IF NOT EXISTS idx_', CAST(o_orderkey % 50 AS VARCHAR), ' ON users(email)')
    WHEN 16 THEN concat('/* @seed */ INSERT INTO public.prices (id, label) VALUES (', CAST(o_orderkey % 50 AS VARCHAR),
      ', ''a, b''), (''k', CAST(o_orderkey % 7 AS VARCHAR), ''', lower(''c''))')
    WHEN 17 THEN concat('ALTER TABLE users ADD COLUMN d', CAST(o_orderkey % 50 AS VARCHAR), ' INT, DROP COLUMN status')
    WHEN 18 THEN concat('ALTER TABLE ONLY users DROP COLUMN IF EXISTS c', CAST(o_orderkey % 50 AS VARCHAR))
    WHEN 19 THEN 'ALTER TABLE users ALTER COLUMN plan TYPE varchar'
    WHEN 20 THEN concat('DROP TABLE IF EXISTS t', CAST(o_orderkey % 50 AS VARCHAR))
    WHEN 21 THEN concat('CREATE TABLE w', CAST(o_orderkey % 50 AS VARCHAR), ' (', chr(10), '  id INT,', chr(10),
      '  price NUMERIC(10,2),', chr(10), '  name TEXT', chr(10), ')')
    WHEN 23 THEN concat('/* two', chr(10), '   lines */', chr(10), 'ALTER TABLE w', CAST(o_orderkey % 50 AS VARCHAR), chr(10),
      '  DROP COLUMN name')
    WHEN 22 THEN concat('ALTER TABLE users RENAME COLUMN name TO c', CAST(o_orderkey % 50 AS VARCHAR))
    ELSE CASE o_orderkey % 12
    WHEN 0 THEN concat('ALTER TABLE users ADD COLUMN c', CAST(o_orderkey % 50 AS VARCHAR), ' TEXT')
    WHEN 1 THEN concat('CREATE TABLE t', CAST(o_orderkey % 50 AS VARCHAR), ' (id INT)')
    WHEN 2 THEN concat('CREATE INDEX idx_', CAST(o_orderkey % 50 AS VARCHAR), ' ON users(email)')
    WHEN 3 THEN concat('INSERT INTO users VALUES (', CAST(o_orderkey % 50 AS VARCHAR), ')')
    WHEN 4 THEN concat('/* @seed */ INSERT INTO plans VALUES (', CAST(o_orderkey % 50 AS VARCHAR), ')')
    WHEN 5 THEN 'UPDATE users SET name = ''x'''
    WHEN 6 THEN concat('ALTER TABLE users DROP COLUMN c', CAST(o_orderkey % 50 AS VARCHAR))
    WHEN 7 THEN 'TRUNCATE users'
    WHEN 8 THEN concat('  drop table t', CAST(o_orderkey % 50 AS VARCHAR), '  ')
    WHEN 9 THEN concat('CREATE UNIQUE INDEX ux_', CAST(o_orderkey % 50 AS VARCHAR), ' ON users(email)')
    WHEN 10 THEN 'ALTER TABLE orders RENAME COLUMN amount TO total'
    ELSE concat('DELETE FROM users WHERE id = ', CAST(o_orderkey % 50 AS VARCHAR)) END END AS sql_text,
  o_orderdate AS applied_at
FROM orders)"""

V_SNAPSHOTS = """v_snapshots AS (
SELECT user_id AS branch_id, event_type AS table_name,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'loading' WHEN 'click' THEN 'paused' ELSE 'ready' END AS status,
  count(*) AS rows_loaded,
  CASE WHEN event_type IN ('signup','purchase') THEN max(ts) END AS completed_at
FROM events GROUP BY user_id, event_type)"""


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


DDL_RX = "^(" + "|".join(DDL_PREFIXES) + ")"


def ctype(x: str) -> str:
    return (f"CASE WHEN contains({x}, '@seed') THEN 'seed' "
            f"WHEN regexp_matches(upper({trim(x)}), '{DDL_RX}') THEN 'ddl' ELSE 'test' END")


def cdesc(x: str) -> str:
    t = trim(x)
    up = f"upper({t})"
    words = f"string_split_regex({t}, '\\s+')"
    third = f"{words}[3]"
    alter = f"starts_with({up}, 'ALTER TABLE')"
    return (f"CASE WHEN len({words}) < 3 THEN {t} "
            f"WHEN {alter} AND contains({up}, 'ADD COLUMN') THEN 'add column to ' || lower({third}) "
            f"WHEN {alter} AND contains({up}, 'DROP COLUMN') THEN 'drop column from ' || lower({third}) "
            f"WHEN {alter} AND contains({up}, 'RENAME') THEN 'rename in ' || lower({third}) "
            f"WHEN {alter} THEN 'alter ' || lower({third}) "
            f"WHEN starts_with({up}, 'CREATE TABLE') THEN 'create table ' || lower({third}) "
            f"WHEN starts_with({up}, 'DROP TABLE') THEN 'drop table ' || lower({third}) "
            f"WHEN starts_with({up}, 'CREATE INDEX') THEN 'create index ' || {third} "
            f"WHEN starts_with({up}, 'DROP INDEX') THEN 'drop index ' || {third} "
            f"WHEN starts_with({up}, 'INSERT') THEN 'insert seed data' "
            f"WHEN starts_with({up}, 'UPDATE') THEN 'update data' "
            f"WHEN length({t}) > 50 THEN left({t}, 50) || '...' ELSE {t} END")


def checksum(x: str) -> str:
    return f"substr(sha256({trim(x)}), 1, 16)"


V_CHANGES = f"""v_changes AS (
SELECT migration_id, branch_id, sequence, sql_text, applied_at,
  {ctype('sql_text')} AS type, {cdesc('sql_text')} AS description, {checksum('sql_text')} AS checksum
FROM v_migrations)"""

V_STASHES = """v_stashes AS (
SELECT sha256(CAST(branch_id AS VARCHAR) || ':' || CAST(yr AS VARCHAR)) AS stash_id, branch_id,
  'wip ' || CAST(yr AS VARCHAR) AS message, max(applied_at) AS created_at, count(*) AS migration_count
FROM (SELECT branch_id, applied_at, year(applied_at) AS yr FROM v_migrations) GROUP BY branch_id, yr)"""

HISTORY = "WITH " + ",\n".join([V_BRANCHES, V_MIGRATIONS, V_SNAPSHOTS, V_CHANGES, V_STASHES])


def hist(body: str, *extra_ctes: str) -> str:
    """History CTEs, optional extra CTEs, then the query body."""
    ctes = HISTORY + "".join(",\n" + c for c in extra_ctes)
    return ctes + "\n" + body


def fmt_ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def spark_type(x: str) -> str:
    """DuckDB catalog type name -> Spark simple type name."""
    return (f"CASE {x} WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' "
            f"WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' WHEN 'BOOLEAN' THEN 'boolean' "
            f"WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' "
            f"WHEN 'DATE' THEN 'date' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower({x}) END")


def catalog(tables: list[str]) -> str:
    """Catalog CTE ``cat`` (table_name, column_name, data_type, nullable,
    position) from DESCRIBE of each table (works for views, tables and
    registered frames alike)."""
    parts = [f"SELECT '{t}' AS table_name, column_name, {spark_type('column_type')} AS data_type, "
             f"\"null\" = 'YES' AS nullable, CAST(row_number() OVER () AS INT) AS position FROM (DESCRIBE {t})"
             for t in tables]
    return "cat AS (" + " UNION ALL ".join(parts) + ")"


def body_expr(x: str) -> str:
    """Statement without surrounding blanks and leading comments."""
    return (f"regexp_replace(regexp_replace({trim(x)}, '{LEADING_COMMENTS}', ''), "
            f"'^\\s+|\\s+$', '', 'g')")


def object_exprs(body: str = "body") -> dict[str, str]:
    """op, table_name, column_name, detail of a statement (first shape wins)."""
    from ..functions.changes import OBJECT_GUARD, OBJECT_SHAPES, TABLE_GUARD

    def name(rx, g, bare=False):
        if not g:
            return "NULL"
        text = f"lower(replace(regexp_extract({body}, '{rx}', {g}), '\"', ''))"
        return f"regexp_replace({text}, '^.*\\.', '')" if bare else text
    out = {"op": "CASE " + " ".join(f"WHEN regexp_matches({body}, '{rx}') THEN '{n}'"
                                    for n, rx, *_ in OBJECT_SHAPES) + " ELSE 'other' END"}
    for key, idx in (("table_name", 2), ("column_name", 3), ("detail", 4)):
        out[key] = "CASE " + " ".join(f"WHEN regexp_matches({body}, '{s[1]}') THEN "
                                      f"{name(s[1], s[idx], key == 'table_name' or s[0] == 'drop_index')}"
                                      for s in OBJECT_SHAPES) + " END"
    out["table_guard"] = f"regexp_matches({body}, '{TABLE_GUARD}')"
    out["object_guard"] = f"regexp_matches({body}, '{OBJECT_GUARD}')"
    return out


_ITEM = ITEM.replace("'", "''")


def create_cols_expr(body: str = "body") -> str:
    return (f"list_filter(list_transform(regexp_extract_all(regexp_extract({body}, '(?s)\\((.*)\\)', 1), '{_ITEM}'), "
            f"lambda x: lower(regexp_extract({trim('x')}, '^\"?(\\w+)', 1))), "
            f"lambda x: x != '' AND x NOT IN ('primary', 'unique', 'constraint', 'foreign', 'check'))")


def actions_cte(name: str, source: str) -> str:
    """CTE ``name``: ``source`` with one row per action, numbered from 1, in ``sql_text``."""
    return f"""{name} AS (
  SELECT * EXCLUDE (texts, i), texts[i] AS sql_text, i AS action FROM (
    SELECT * EXCLUDE (body, items, sql_text), CASE WHEN len(items) > 1 THEN list_transform(items, lambda x:
      regexp_extract(body, '{ALTER_PARTS}', 1) || {trim('x')}) ELSE [body] END AS texts
    FROM (SELECT *, regexp_extract_all(regexp_extract(body, '{ALTER_PARTS}', 2), '{_ITEM}') AS items
          FROM (SELECT *, regexp_replace({body_expr('sql_text')}, '[;\\s]+$', '') AS body FROM {source}))),
  unnest(range(1, len(texts) + 1)) AS r(i))"""
