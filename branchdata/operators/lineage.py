"""Column lineage: where each column of each branch's tables comes from.

The replay of ``conflicts`` tells for every action what it found, so each
branch's effective actions are known without running them.  They give
*stretches*: a column under one name, from the action that made it (or the
seed catalog) to the one that ended it.  A rename links a stretch to the one
it goes on from; the links of all branches are followed together by pointer
jumping (a chain of n renames takes log n joins).  What is left is a small
table: per branch and table the columns at its head, each with its origin,
last type and default, from which one projection per table rebuilds the data.

A column's type is its last one: several type changes are one cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.changes import ACTION_BITS, ITEM, strip_comments, with_actions
from ..functions.text import trim_ws
from .conflicts import replayed
from .evolve import spark_type
from .numbering import DETECT
from .scan import balanced_scan

SEED = -1                # position of the seed catalog's columns

#: a column definition's type ends where one of these begins
AFTER_TYPE = r"(?:DEFAULT|NOT\s+NULL|NULL|PRIMARY|UNIQUE|REFERENCES|CHECK|CONSTRAINT|COLLATE|GENERATED)"
TYPE_PART = rf"(?is)^\s*(.*?)(?:\s+{AFTER_TYPE}\b.*)?$"
DEFAULT_PART = r"(?is)\bDEFAULT\s+('[^']*(?:''[^']*)*'|[^\s,()']+(?:\([^)]*\))?)"
ADD_TAIL = r"(?is)\bADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?\"?\w+\"?\s*(.*)$"
NEW_TYPE = r"(?is)\bTYPE\s+(.+?)(?:\s+USING\b.*)?$"
NAME_AND_REST = r"(?is)^\s*\"?(\w+)\"?\s*(.*)$"
NOT_COLUMNS = ("primary", "unique", "constraint", "foreign", "check")


def _type_of(definition: Column) -> Column:
    return F.nullif(F.lower(trim_ws(F.regexp_extract(definition, TYPE_PART, 1))), F.lit(""))


def _default_of(definition: Column) -> Column:
    return F.nullif(F.regexp_extract(definition, DEFAULT_PART, 1), F.lit(""))


def _created(sql: Column) -> Column:
    """(column_name, data_type, default) of a CREATE TABLE's columns."""
    items = F.regexp_extract_all(F.regexp_extract(strip_comments(sql), r"(?s)\((.*)\)", 1), F.lit(ITEM), F.lit(0))

    def one(x: Column) -> Column:
        rest = F.regexp_extract(x, NAME_AND_REST, 2)
        return F.struct(F.lower(F.regexp_extract(x, NAME_AND_REST, 1)).alias("column_name"), _type_of(rest).alias("data_type"),
                        _default_of(rest).alias("default"))
    return F.filter(F.transform(items, one), lambda c: (c["column_name"] != "") & ~c["column_name"].isin(*NOT_COLUMNS))


def effective_actions(changes: DataFrame, catalog: DataFrame, indexes: DataFrame, hot=DETECT) -> DataFrame:
    """Every action of ``changes`` (branch_id, sequence, sql_text) with what
    the replay found before it: position, op, table_before, col_before,
    target_before, epoch, detail and its conflict_type (NULL: none).  Written
    once (checkpoint), as every later step reads it."""
    actions = with_actions(changes.select("branch_id", "sequence", "sql_text"))
    return replayed(actions.select("branch_id", F.col("position").alias("sequence"), "sql_text"), catalog, indexes,
                    hot=hot).withColumnRenamed("sequence", "position").checkpoint()


def skipped_actions(actions: DataFrame) -> DataFrame:
    """The actions that can't be applied: (branch_id, sequence, action,
    sql_text, conflict_type)."""
    return actions.where("conflict_type IS NOT NULL").select(
        "branch_id", F.shiftright("position", ACTION_BITS).cast("int").alias("sequence"),
        (F.col("position") % (1 << ACTION_BITS) + 1).cast("int").alias("action"), "sql_text", "conflict_type")


_STRETCH = ["branch_id", "table_name", "epoch", "column_name"]


def _events(actions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Begins and ends of stretches and type changes, one row each."""
    op, found = F.col("op"), F.col("table_before") & F.col("col_before")
    made = (op == "add_column") & F.col("table_before") & ~F.col("col_before")
    renamed = (op == "rename_column") & found & ~F.col("target_before")
    tail = F.regexp_extract("sql_text", ADD_TAIL, 1)
    none = F.lit(None).cast("string")

    def event(kind: str, column: Column, how: Column = none, dtype: Column = none, default: Column = none, old: Column = none,
              epoch: Column = F.col("epoch")) -> Column:
        return F.struct(F.lit(kind).alias("kind"), epoch.cast("long").alias("epoch"), column.alias("column_name"), how.alias("how"),
                        dtype.alias("data_type"), default.alias("default"), old.alias("old_name"))
    created = F.transform(_created(F.col("sql_text")), lambda c: event(
        "begin", c["column_name"], F.lit("create"), c["data_type"], c["default"], epoch=F.col("epoch") + 1))
    events = (F.when(made, F.array(event("begin", F.col("column_name"), F.lit("add"), _type_of(tail), _default_of(tail))))
              .when(renamed, F.array(event("end", F.col("column_name")),
                                     event("begin", F.col("detail"), F.lit("rename"), old=F.col("column_name"))))
              .when((op == "drop_column") & found, F.array(event("end", F.col("column_name"))))
              .when((op == "alter_type") & found, F.array(event("type", F.col("column_name"), dtype=F.lower(trim_ws(
                  F.regexp_extract("sql_text", NEW_TYPE, 1))))))
              .when((op == "create_table") & ~F.col("table_before"), created))
    rows = (actions.select("branch_id", "table_name", "position", F.explode(events).alias("e"))
            .select("branch_id", "table_name", "position", "e.*"))
    touched = actions.where("table_name IS NOT NULL").select("branch_id", "table_name").distinct()
    seeds = (touched.join(F.broadcast(catalog), "table_name")
             .select("branch_id", "table_name", F.lit(SEED).cast("long").alias("position"), F.lit("begin").alias("kind"),
                     F.lit(0).cast("long").alias("epoch"), "column_name", F.lit("seed").alias("how"), "data_type",
                     none.alias("default"), none.alias("old_name")))
    return rows.unionByName(seeds)


def _origins(renames: DataFrame) -> DataFrame:
    """(branch_id, table_name, column_name, position) of stretches that a rename
    began, with the column and position of the stretch that the whole chain
    began with (``o_name``, ``o_at``) and the number of ``renames``."""
    key = ["branch_id", "table_name"]
    known = renames.select(*key, "column_name", "position", F.col("old_name").alias("o_name"), F.col("old_at").alias("o_at"),
                           F.lit(1).cast("long").alias("renames")).checkpoint()
    for _ in range(known.count().bit_length() + 1):
        before = known.select(*key, F.col("column_name").alias("o_name"), F.col("position").alias("o_at"),
                              F.col("o_name").alias("o_name2"), F.col("o_at").alias("o_at2"), F.col("renames").alias("more"))
        further = known.join(before, [*key, "o_name", "o_at"], "left")
        moved = F.col("more").isNotNull()
        known = further.select(*key, "column_name", "position", F.when(moved, F.col("o_name2")).otherwise(F.col("o_name")).alias("o_name"),
                               F.when(moved, F.col("o_at2")).otherwise(F.col("o_at")).alias("o_at"),
                               (F.col("renames") + F.coalesce("more", F.lit(0))).alias("renames"),
                               moved.alias("moved")).checkpoint()
        if known.where("moved").isEmpty():
            return known.drop("moved")
        known = known.drop("moved")
    raise ValueError("renames go round in a circle")


def column_lineage(actions: DataFrame, catalog: DataFrame) -> DataFrame:
    """The columns at the head of every table that a branch's changes touch:
    (branch_id, table_name, column_name, origin seed / create / add,
    origin_column, origin_position, renames, data_type, default, place).
    ``actions``: see ``effective_actions``; ``catalog``: the seed columns
    (table_name, column_name, data_type, position)."""
    events = _events(actions, catalog.select("table_name", "column_name", "data_type"))
    begins = F.when(F.col("kind") == "begin", F.col("position"))
    # A rename asks on its old name's stretch; every other event on its own.
    asks = events.withColumn("ask", F.explode(F.when(
        F.col("how") == "rename", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    asks = asks.withColumn("new_name", F.col("column_name")).withColumns({
        "column_name": F.when(F.col("ask"), F.col("old_name")).otherwise(F.col("column_name")),
        "begins_at": F.when(~F.col("ask"), begins)})
    seen = balanced_scan(asks, _STRETCH, "position", lasts={"_since": F.col("begins_at")}, hot_cols=["branch_id"]).checkpoint()
    # Stretches, and what ends them: an end, the next begin, or the table's drop.
    stretches = seen.where("kind = 'begin' AND NOT ask").select(
        *_STRETCH, "position", "how", "data_type", "default")
    ends = (seen.where("kind IN ('begin', 'end') AND NOT ask AND _since IS NOT NULL")
            .groupBy(*_STRETCH, F.col("_since").alias("position")).agg(F.min("position").alias("ended")))
    dropped = (actions.where("op = 'drop_table' AND table_before")
               .select("branch_id", "table_name", F.col("epoch").cast("long").alias("epoch"), F.lit(True).alias("gone")).distinct())
    stretches = (stretches.join(ends, [*_STRETCH, "position"], "left").join(dropped, ["branch_id", "table_name", "epoch"], "left")
                 .withColumn("alive", F.col("ended").isNull() & F.col("gone").isNull()).drop("ended", "gone"))
    renames = seen.where("ask AND _since IS NOT NULL").select(
        "branch_id", "table_name", F.col("new_name").alias("column_name"), "position", "old_name", F.col("_since").alias("old_at"))
    key = ["branch_id", "table_name", "column_name", "position"]
    rooted = (stretches.join(_origins(renames), key, "left")
              .withColumns({"o_name": F.coalesce("o_name", "column_name"), "o_at": F.coalesce("o_at", "position"),
                            "renames": F.coalesce("renames", F.lit(0))}).checkpoint())
    types = (seen.where("kind = 'type' AND _since IS NOT NULL")
             .select("branch_id", "table_name", "column_name", F.col("_since").alias("position"), F.col("position").alias("changed"),
                     F.col("data_type").alias("new_type"))
             .join(rooted.select(*key, "o_name", "o_at"), key)
             .groupBy("branch_id", "table_name", "o_name", "o_at").agg(F.max_by("new_type", "changed").alias("new_type")))
    roots = (rooted.where("how <> 'rename'")
             .select("branch_id", "table_name", F.col("column_name").alias("o_name"), F.col("position").alias("o_at"),
                     F.col("how").alias("origin"), F.col("data_type").alias("o_type"), F.col("default").alias("o_default")))
    return (rooted.where("alive").select("branch_id", "table_name", "column_name", "o_name", "o_at", "renames")
            .join(roots, ["branch_id", "table_name", "o_name", "o_at"]).join(types, ["branch_id", "table_name", "o_name", "o_at"], "left")
            .select("branch_id", "table_name", "column_name", "origin", F.col("o_name").alias("origin_column"),
                    F.col("o_at").alias("origin_position"), "renames", F.coalesce("new_type", "o_type").alias("data_type"),
                    F.col("o_default").alias("default")))


def rebuilt(source: DataFrame, lineage: DataFrame) -> DataFrame:
    """``source`` (a table of the seed) as one branch's ``lineage`` rows of it
    say: one projection.  Columns keep the source's order, new ones follow in
    the order they were made.  Values that don't fit a new type raise."""
    rows = lineage.collect()                 # one row per column of one table
    place = {c.lower(): i for i, c in enumerate(source.columns)}
    kept = {f.name.lower(): f for f in source.schema.fields}
    out = []
    for r in sorted(rows, key=lambda r: (r.origin_position, place.get(r.origin_column, -1), r.origin_column)):
        if r.origin == "seed":
            field = kept[r.origin_column]
            value = F.col(f"`{field.name}`")
            same = r.data_type == field.dataType.simpleString()
            out.append((value if same else value.cast(spark_type(r.data_type))).alias(r.column_name))
        else:
            value = F.expr(r.default) if r.default is not None else F.lit(None)
            out.append(value.cast(spark_type(r.data_type or "text")).alias(r.column_name))
    return source.select(*out)


def seed_catalog(name: str, df: DataFrame) -> DataFrame:
    """The seed rows (table_name, column_name, data_type) of a table."""
    return df.sparkSession.createDataFrame([(name, f.name.lower(), f.dataType.simpleString()) for f in df.schema.fields],
                                           "table_name string, column_name string, data_type string")
