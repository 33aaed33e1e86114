"""Parameters of the registered queries (extraction specs, mask rules,
reference times).  Fixed, so results are repeatable."""

from __future__ import annotations

from ..operators.extract import ExtractSpec

# reference times (never now(): results must not move)
HISTORY_REF_TS = "2001-08-02 00:00:00"
EVENTS_REF_TS = "2024-01-31 00:00:00"
RECENT_DAYS = 7

# mask rules: bare rules apply to every table, table rules win over them
MASK_RULES = {
    "o_orderpriority": "UNSET",
    "orders.o_orderpriority": "***",
    "orders.o_orderstatus": "#{{last4}}",
    "customer.c_name": "***-**-{{last4}}",
    "supplier.s_name": "REDACTED",
    "part.p_name": "redacted {{p_name}}",
    "email": "masked_{{id}}@example.com",
    "phone": "+10000000000",
}

CUSTOMER_LOAD = ExtractSpec("customer", where="c_mktsegment = 'BUILDING'", key=("c_custkey",),
                            id_col="c_custkey")

LOAD_SPECS = (
    ExtractSpec("customer", where="c_mktsegment = 'BUILDING'", key=("c_custkey",), id_col="c_custkey"),
    ExtractSpec("orders", where="o_orderstatus = 'F'", key=("o_orderkey",), id_col="o_orderkey"),
    ExtractSpec("supplier", key=("s_suppkey",), id_col="s_suppkey"),
    ExtractSpec("part", where="p_size <= 10", key=("p_partkey",), id_col="p_partkey"),
    ExtractSpec("nation", key=("n_nationkey",)),
    ExtractSpec("region", key=("r_regionkey",)),
)

# extraction config as a team writes it: predicate and optional own limit
PLAN_SPECS = {
    "customer": {"where": "c_mktsegment = 'BUILDING'", "limit": 500},
    "orders": {"where": "o_orderstatus = 'F'"},
}
EXCLUDED_TABLES = ("embeddings", "pages", "benchmark")

# declared foreign keys of the driver tables (child, column, parent, column)
FOREIGN_KEYS = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("events", "user_id", "customer", "c_custkey"),
)

KEYED_TABLES = (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"),
                ("supplier", "s_suppkey"), ("events", "event_id"), ("documents", "doc_id"),
                ("pages", "page_id"), ("benchmark", "item_id"), ("region", "r_regionkey"),
                ("nation", "n_nationkey"), ("embeddings", "vec_id"), ("conversations", "conv_id"))

# the parent's catalog that merges are checked against (the seed schema)
BASE_CATALOG = (
    ("users", ("id", "email", "name", "plan", "created_at", "status")),
    ("orders", ("id", "user_id", "amount", "status", "created_at")),
    ("products", ("id", "name", "price", "stock", "created_at")),
)
# types of its columns (text unless named)
BASE_TYPES = {"id": "int", "user_id": "int", "amount": "numeric", "price": "numeric", "stock": "int", "created_at": "timestamp"}
BASE_INDEXES = (("users_pkey", "users"), ("users_email_key", "users"),
                ("orders_pkey", "orders"), ("products_pkey", "products"))

# schema changes of a branch on customer, and of its parent (for rebase)
CUSTOMER_CHANGES = (
    "ALTER TABLE customer ADD COLUMN c_note TEXT DEFAULT 'n/a'",
    "ALTER TABLE customer DROP COLUMN c_acctbal",
    "ALTER TABLE customer RENAME COLUMN c_name TO c_full_name",
    "ALTER TABLE customer ALTER COLUMN c_nationkey TYPE bigint",
)
PARENT_CUSTOMER_CHANGES = (
    "ALTER TABLE customer ADD COLUMN c_note TEXT DEFAULT 'n/a'",
    "ALTER TABLE customer ADD COLUMN c_region INT",
)
