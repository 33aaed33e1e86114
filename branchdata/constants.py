"""Fixed values that must equal the tool we mirror for right results.

Everything here is stated plainly and in the order the rules are applied.
"""

# --- fixed values: change classification ---------------------------------
# Statement prefixes (after trimming and upper-casing) that make a change "ddl".
DDL_PREFIXES = (
    "CREATE TABLE", "DROP TABLE", "ALTER TABLE",
    "CREATE INDEX", "DROP INDEX",
    "CREATE SEQUENCE", "DROP SEQUENCE",
    "CREATE TYPE", "DROP TYPE",
    "CREATE VIEW", "DROP VIEW",
    "CREATE FUNCTION", "DROP FUNCTION",
    "CREATE TRIGGER", "DROP TRIGGER",
    "CREATE SCHEMA", "DROP SCHEMA",
    "TRUNCATE",
)
# Extra prefixes accepted only with ``extended=True`` (statements the fixed
# list misses, so they would otherwise be lost on merge).
DDL_PREFIXES_EXTENDED = (
    "CREATE UNIQUE INDEX", "CREATE OR REPLACE", "ALTER INDEX",
    "ALTER SEQUENCE", "ALTER TYPE", "ALTER VIEW",
)
# Default seed marker (a parameter; the derived test history uses "@seed").
SEED_MARKER = "@seed"

CHANGE_TYPES = ("ddl", "seed", "test")
MERGEABLE_TYPES = ("ddl", "seed")

# --- fixed values: PII detection by column name ---------------------------
# Rule groups in the order they are tested (first hit wins), each with the
# substrings that trigger it and the default mask it proposes.
PII_RULES = (
    ("email", ("email", "mail", "e_mail"), "masked_{{id}}@example.com"),
    ("phone", ("phone", "mobile", "cell", "tel", "telephone"), "+10000000000"),
    ("ssn", ("ssn", "social_security", "national_id", "tax_id"), "***-**-{{last4}}"),
    ("card", ("card_number", "credit_card", "debit_card", "pan"), "****-****-****-{{last4}}"),
    ("name", ("first_name", "last_name", "full_name", "display_name"), "REDACTED"),
    ("dob", ("dob", "date_of_birth", "birth_date", "birthday"), "1970-01-01"),
    ("address", ("address", "street", "city", "zip", "postal"), "REDACTED"),
    ("ip", ("ip_address", "ip", "remote_addr", "client_ip"), "0.0.0.0"),
)

# --- fixed values: conflict classes from error text -----------------------
# (class, description, suggestion, auto_resolvable); the last class
# ("unknown") uses the message itself as suggestion.
CONFLICT_CLASSES = {
    "column_exists": ("Column already exists in parent schema",
                      "Remove duplicate column or rename it", True),
    "index_exists": ("Index or table already exists",
                     "Use CREATE INDEX IF NOT EXISTS", True),
    "table_exists": ("Table already exists in parent schema",
                     "Use CREATE TABLE IF NOT EXISTS", True),
    "dropped_reference": ("References a column or table that no longer exists",
                          "Check if parent branch dropped this object", False),
    "type_mismatch": ("Type mismatch — cannot cast",
                      "Add explicit USING clause for type conversion", False),
    "unknown": ("Migration failed — manual review required", None, False),
}

# --- fixed values: catalog type names --------------------------------------
# Source catalog type name -> type name used when a table shape is rebuilt.
TYPE_NAMES = {
    "integer": "INTEGER",
    "bigint": "BIGINT",
    "smallint": "SMALLINT",
    "text": "TEXT",
    "character varying": "TEXT",
    "character": "TEXT",
    "boolean": "BOOLEAN",
    "numeric": "NUMERIC",
    "real": "REAL",
    "double precision": "DOUBLE PRECISION",
    "timestamp with time zone": "TIMESTAMPTZ",
    "timestamp without time zone": "TIMESTAMP",
    "date": "DATE",
    "time with time zone": "TIMETZ",
    "time without time zone": "TIME",
    "jsonb": "JSONB",
    "json": "JSON",
    "uuid": "UUID",
    "bytea": "BYTEA",
    "inet": "INET",
    "cidr": "CIDR",
}

# --- fixed values: limits and thresholds ------------------------------------
DEFAULT_ROW_LIMIT = 10_000      # single-table load without a limit
DEFAULT_CONFIG_LIMIT = 5_000    # generated extraction plan
SMALL_TABLE_ROWS = 1_000        # below this a table is taken whole
CHUNK_ROWS = 10_000             # rows per load page
AUDIT_LIMIT = 100
LOG_LIMIT = 20
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
