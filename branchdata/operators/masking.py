"""Masked projections and PII rules.

Masks are applied as a projection on the DataFrame, below any write, so no
raw value of a masked column is ever stored.  Catalyst prunes the raw
column from the scan when its mask does not read it (static masks).
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import PII_RULES
from ..functions.masks import mask_column, pattern_needs_id


def flatten_rules(spec: dict) -> dict[str, str]:
    """Flatten ``{"users": {"email": p}, "phone": p2}`` into
    ``{"users.email": p, "phone": p2}`` (keys lower-cased)."""
    flat: dict[str, str] = {}
    for k, v in spec.items():
        if isinstance(v, dict):
            for col, pattern in v.items():
                flat[f"{k}.{col}".lower()] = pattern
        else:
            flat[k.lower()] = v
    return flat


def table_masks(rules: dict, table: str) -> dict[str, str]:
    """column -> pattern for one table; a ``table.column`` rule beats a bare
    ``column`` rule."""
    rules = flatten_rules(rules)
    t = table.lower()
    bare = {k: p for k, p in rules.items() if "." not in k}
    qualified = {k.split(".", 1)[1]: p for k, p in rules.items()
                 if "." in k and k.split(".", 1)[0] == t}
    return {**bare, **qualified}


def mask_frame(df: DataFrame, table: str, rules: dict, id_col: str | None = None,
               strict: bool = True, as_text: Collection[str] = ()) -> DataFrame:
    """All columns in order; masked ones replaced under the same name and
    type.  A mask that is no value of its column's type raises when the frame
    is read (ANSI cast), unless ``as_text`` names the column: it then becomes
    a string.

    Fails closed: a ``table.column`` rule for a column the frame lacks, or an
    ``{{id}}`` mask without a key column, raises instead of copying raw data.
    """
    masks = table_masks(rules, table)
    cols = {c.lower(): c for c in df.columns}
    if strict:
        for key in flatten_rules(rules):
            if "." in key and key.split(".", 1)[0] == table.lower() and key.split(".", 1)[1] not in cols:
                raise ValueError(f"mask rule {key!r} names a column that {table!r} lacks")
    if any(pattern_needs_id(p) for c, p in masks.items() if c in cols) and id_col is None:
        raise ValueError(f"table {table!r} has an {{{{id}}}} mask but no key column")
    text = {c.lower() for c in as_text}
    out = []
    for field in df.schema.fields:
        c, p = field.name, masks.get(field.name.lower())
        if p is None:
            out.append(F.col(f"`{c}`"))
            continue
        masked = mask_column(p, c, id_col)
        if not isinstance(field.dataType, T.StringType) and c.lower() not in text:
            masked = masked.cast(field.dataType)
        out.append(masked.alias(c))
    return df.select(*out)


def rules_frame(spark: SparkSession, rules: dict) -> DataFrame:
    flat = flatten_rules(rules)
    schema = T.StructType([T.StructField("rule_key", T.StringType()),
                           T.StructField("pattern", T.StringType())])
    return spark.createDataFrame(sorted(flat.items()), schema)


def rules_applied(catalog: DataFrame, rules: DataFrame) -> DataFrame:
    """Which rule masks which catalog column: table rule first, then bare rule.
    (table_name, column_name, pattern, rule_key)."""
    r = rules.select(F.lower("rule_key").alias("rule_key"), "pattern",
                     F.split(F.lower("rule_key"), r"\.", 2).alias("parts"))
    qualified = r.filter(F.size("parts") == 2).select(
        F.col("parts")[0].alias("q_table"), F.col("parts")[1].alias("q_col"),
        F.col("pattern").alias("q_pattern"), F.col("rule_key").alias("q_key"))
    bare = r.filter(F.size("parts") == 1).select(
        F.col("parts")[0].alias("b_col"), F.col("pattern").alias("b_pattern"),
        F.col("rule_key").alias("b_key"))
    cat = catalog.select("table_name", "column_name")
    joined = (cat.join(F.broadcast(qualified),
                       (F.lower(cat.table_name) == qualified.q_table) &
                       (F.lower(cat.column_name) == qualified.q_col), "left")
                 .join(F.broadcast(bare), F.lower(cat.column_name) == bare.b_col, "left"))
    return (joined.filter(F.col("q_pattern").isNotNull() | F.col("b_pattern").isNotNull())
                  .select("table_name", "column_name",
                          F.coalesce("q_pattern", "b_pattern").alias("pattern"),
                          F.coalesce("q_key", "b_key").alias("rule_key")))


def pii_detect(catalog: DataFrame, match: str = "substring") -> DataFrame:
    """Likely PII columns by name, first rule group wins.
    (table_name, column_name, rule, mask).  ``match="word"`` only matches
    whole ``_``-separated words instead of substrings."""
    name = F.lower(F.col("column_name"))
    rule = mask = None
    for group, needles, pattern in PII_RULES:
        if match == "word":
            hit = F.lit(False)
            for n in needles:
                hit = hit | name.rlike(r"(^|_)" + n + r"($|_)")
        else:
            hit = F.lit(False)
            for n in needles:
                hit = hit | name.contains(n)
        rule = F.when(hit, F.lit(group)) if rule is None else rule.when(hit, F.lit(group))
        mask = F.when(hit, F.lit(pattern)) if mask is None else mask.when(hit, F.lit(pattern))
    return (catalog.select("table_name", "column_name", rule.alias("rule"), mask.alias("mask"))
                   .filter(F.col("rule").isNotNull()))


def leak_check(raw: DataFrame, masked: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Count masked values still equal to the raw value (should be 0), per column.
    Joins raw and masked on the key; one pass, one aggregate."""
    r = raw.select(key, *[F.col(c).alias(f"raw_{c}") for c in columns])
    j = masked.select(key, *columns).join(r, key)
    aggs = [F.count_if(F.col(c).cast("string") == F.col(f"raw_{c}").cast("string")).alias(c)
            for c in columns]
    wide = j.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    return wide.selectExpr(f"stack({len(columns)}, {stack}) as (column_name, leaks)")
