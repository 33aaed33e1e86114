"""Registered queries: keys, foreign keys and load order found in the data."""

from __future__ import annotations

from ..operators import keys as K
from .registry import Ctx, query

# Columns that can be keys, per table, for the expected results in SQL.
_COLUMNS = {
    "region": {"r_regionkey": "integer", "r_name": "text"},
    "nation": {"n_nationkey": "integer", "n_name": "text", "n_regionkey": "integer"},
    "customer": {"c_custkey": "integer", "c_name": "text", "c_nationkey": "integer", "c_mktsegment": "text"},
    "supplier": {"s_suppkey": "integer", "s_name": "text", "s_nationkey": "integer"},
    "part": {"p_partkey": "integer", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "integer"},
    "orders": {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "text", "o_orderdate": "time",
               "o_orderpriority": "text"},
    "lineitem": {"l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
                 "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time"},
    "events": {"event_id": "integer", "ts": "time", "user_id": "integer", "event_type": "text", "props": "text"},
    "documents": {"doc_id": "integer", "text": "text", "lang": "text", "source": "text", "n_chars": "integer"},
    "embeddings": {"vec_id": "integer", "label": "integer"},
    "pages": {"page_id": "integer", "url": "text", "html": "text"},
    "benchmark": {"item_id": "integer", "text": "text"},
    "labels": {"doc_id": "integer", "quality": "integer", "toxic": "integer"},
    "conversations": {"conv_id": "integer", "turn": "integer", "role": "text", "text": "text"},
}


def _tries() -> str:
    """(table_name, columns, width, pos1, pos2, rank, is_key) of every column and pair."""
    out = []
    for t, cols in _COLUMNS.items():
        names = list(cols)
        for i, a in enumerate(names):
            out.append(f"SELECT '{t}' AS table_name, '{a}' AS a, NULL AS b, '{a}' AS columns, {i} AS place, "
                       f"{0 if cols[a] == 'integer' else 1} AS other, count(DISTINCT {a}) = count(*) AND count(*) > 0 AS is_key FROM {t}")
            out += [f"SELECT '{t}', '{a}', '{b}', '{a},{b}', {100 * i + names.index(b)}, "
                    f"{(0 if cols[a] == 'integer' else 1) * 2 + (0 if cols[b] == 'integer' else 1)}, "
                    f"count(*) > 0 AND count({a}) = count(*) AND count({b}) = count(*) "
                    f"AND (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM {t})) = count(*) FROM {t}" for b in names[i + 1:]]
    return " UNION ALL ".join(out)


def _values() -> str:
    return " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{k}' AS k, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL"
                              for t, cols in _COLUMNS.items() for c, k in cols.items())


# A pair's order is by its first column's kind and place, then its second's.
_KEYS = f"""tries AS MATERIALIZED ({_tries()}),
one AS (SELECT * FROM tries WHERE b IS NULL AND is_key),
keys AS MATERIALIZED (
  SELECT * FROM one
  UNION ALL SELECT p.* FROM tries p WHERE p.b IS NOT NULL AND p.is_key AND NOT EXISTS (
    SELECT 1 FROM one o WHERE o.table_name = p.table_name AND (o.a = p.a OR o.a = p.b))),
best AS (
  SELECT table_name, columns, row_number() OVER (PARTITION BY table_name ORDER BY b IS NOT NULL,
    CASE WHEN b IS NULL THEN other ELSE other // 2 END, CASE WHEN b IS NULL THEN place ELSE place // 100 END,
    other % 2, place) AS r
  FROM keys),
vals AS MATERIALIZED ({_values()}),
sizes AS (SELECT t, c, count(*) AS n FROM vals GROUP BY t, c),
refs AS (SELECT v.* FROM vals v JOIN one o ON o.table_name = v.t AND o.a = v.c),
found AS (
  SELECT x.t, x.c, y.t AS rt, y.c AS rc, count(*) AS n
  FROM vals x JOIN refs y ON x.v = y.v AND x.k = y.k AND x.t <> y.t GROUP BY x.t, x.c, y.t, y.c),
incl AS (
  SELECT f.t, f.c, rt, rc, regexp_replace(f.c, '^[a-z]{{0,2}}_', '') = regexp_replace(rc, '^[a-z]{{0,2}}_', '') AS alike
  FROM found f JOIN sizes s ON s.t = f.t AND s.c = f.c AND s.n = f.n)"""


@query("key_catalog", f"""WITH {_KEYS}
SELECT table_name, 'key' AS kind, columns, r = 1 AS is_primary, CAST(NULL AS VARCHAR) AS ref_table,
  CAST(NULL AS VARCHAR) AS ref_column FROM best
UNION ALL SELECT t, CASE WHEN alike THEN 'foreign' ELSE 'included' END, c, NULL, rt, rc FROM incl""")
def key_catalog(c: Ctx):
    return K.key_catalog(c.tables())


@query("cursor_columns", f"WITH {_KEYS} SELECT table_name, columns AS cursor_columns FROM best WHERE r = 1")
def cursor_columns(c: Ctx):
    return K.cursor_columns(K.key_catalog(c.tables()))


@query("dependency_order", f"""WITH RECURSIVE {_KEYS},
fk AS (SELECT DISTINCT t, rt FROM incl WHERE alike),
names AS ({" UNION ALL ".join(f"SELECT '{t}' AS t" for t in _COLUMNS)}),
walk AS (
  SELECT t, 0 AS level FROM names
  UNION SELECT fk.t, walk.level + 1 FROM walk JOIN fk ON fk.rt = walk.t WHERE walk.level < 20)
SELECT t AS table_name, CAST(max(level) AS INT) AS level FROM walk GROUP BY t""")
def dependency_order(c: Ctx):
    tables = c.tables()
    return K.dependency_order(list(tables), K.key_catalog(tables))
