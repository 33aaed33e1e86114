"""Check a batch of changes against a parent catalog without running them.

Each change is judged on its own, in order, against the parent's catalog as
changed by the *earlier* changes of the same batch (the parent itself is
never touched; a plan has no side effects).  The replay needs no loop:

1. table state before a change = the last CREATE/DROP TABLE of that table
   earlier in the batch (a rejected CREATE or DROP leaves the same state),
   else whether the parent catalog has the table;
2. an *epoch* counts the accepted CREATE/DROP TABLEs before a change;
   inside an epoch a table's existence does not change;
3. column state before a change = the last add/drop/rename touching that
   column earlier in the same epoch, else (epoch 0) the parent catalog,
   else the column list of the CREATE TABLE that opened the epoch;
4. index state = the last CREATE INDEX (on an existing table) or DROP INDEX
   of that name, else the catalog.

A rename onto a column that is there is a conflict; for later changes a
rename counts as done all the same.  IF [NOT] EXISTS makes the missing or
present object no conflict.  A statement that fits no known shape, or has
several actions, is ``unverified``, never safe.  Indexes are not dropped
together with their table; type changes are not checked against a cast
matrix (no types in the statement shapes we read).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.changes import (ACTION_BITS, ITEM, OBJECT_GUARD, TABLE_GUARD, auto_resolve, conflict_class,
                                 conflict_details, create_columns, with_actions, with_objects)
from ..functions.text import trim_ws
from .numbering import DETECT, collect_hot, number_rows
from .scan import pieced_scan, plain_scan

NEEDS_TABLE = ("add_column", "drop_column", "rename_column", "alter_type", "drop_table",
               "create_index", "truncate", "insert", "update", "delete")
NEEDS_COLUMN = ("drop_column", "rename_column", "alter_type")


def check(changes: DataFrame, catalog: DataFrame, indexes: DataFrame,
          hot_rows: int | None = None, max_hot: int | None = None, hot=DETECT) -> DataFrame:
    """changes: (branch_id, sequence, sql_text, ...); catalog: (table_name,
    column_name); indexes: (index_name, table_name).  A catalog with a
    branch_id holds for that branch alone (``parent_catalogs`` makes such
    ones).  ``hot``: keys of the branches to scan in pieces (found on
    ``changes`` when not given; any superset of the hot branches gives the
    same result).

    Returns every change with op, table_name, column_name, conflict_type
    (NULL = safe) and a database-style message.
    """
    return _classify(_states(changes, catalog, indexes, hot_rows, max_hot, hot))


def replayed(changes: DataFrame, catalog: DataFrame, indexes: DataFrame, hot=DETECT) -> DataFrame:
    """``check`` with what each change found before it: epoch (accepted
    creates and drops of its table), table_before, col_before, target_before
    (a rename's new name) and detail."""
    return _classify(_states(changes, catalog, indexes, hot=hot), "detail", "epoch", "table_before", "col_before", "target_before")


def _states(changes: DataFrame, catalog: DataFrame, indexes: DataFrame, hot_rows: int | None = None,
            max_hot: int | None = None, hot=DETECT) -> DataFrame:
    return _object_states(_objects(changes), catalog, indexes, hot_rows, max_hot, hot)


def _object_states(objs: DataFrame, catalog: DataFrame, indexes: DataFrame, hot_rows: int | None = None,
                   max_hot: int | None = None, hot=DETECT) -> DataFrame:
    cats = _catalogs(catalog, indexes)

    # Branches with very many changes take the pieced (parallel) scan path;
    # the keys are found once, on the input, and the input is split once.
    if hot is DETECT:      # a superset of the hot branches is fine too
        hot = collect_hot(objs, ["branch_id"], hot_rows, max_hot)
    if hot is None:
        t = _replay(objs, *cats, _plain_step)
    else:
        cold = _replay(objs.join(hot, "branch_id", "left_anti"), *cats, _plain_step)
        warm = _replay(objs.join(hot, "branch_id", "left_semi"), *cats, _pieced_step)
        t = cold.unionByName(warm)
    return t


def _objects(changes: DataFrame, *extra: str) -> DataFrame:
    objs = with_objects(changes.select("branch_id", "sequence", "sql_text", *extra), "sql_text", keep_body=True)
    body = F.col("_body")
    return objs.withColumns({"create_cols": create_columns(body), "table_guard": body.rlike(TABLE_GUARD),
                             "object_guard": body.rlike(OBJECT_GUARD)}).drop("_body")


def _catalogs(catalog: DataFrame, indexes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables, columns and indexes that are there, of all branches or (with a
    branch_id) of each."""
    def named(df: DataFrame, flag: str, **names: str) -> DataFrame:
        own = ["branch_id"] if "branch_id" in df.columns else []
        return (df.select(*own, *[F.lower(c).alias(n) for n, c in names.items()])
                .where(" AND ".join(f"{n} IS NOT NULL" for n in names)).distinct().withColumn(flag, F.lit(True)))
    return (named(catalog, "cat_table", table_name="table_name"),
            named(catalog, "cat_col", table_name="table_name", column_name="column_name"),
            named(indexes, "cat_idx", detail="index_name"))


def _with_catalog(df: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """A catalog for all branches is a small list; one per branch grows with
    the branches and is joined by key."""
    if "branch_id" in catalog.columns:
        return df.join(catalog, ["branch_id", *keys], "left")
    return df.join(F.broadcast(catalog), keys, "left")


def touched_objects(objs: DataFrame) -> DataFrame:
    """(branch_id, table_name, column_name, detail) of every table, column (a
    rename's new name too) and index that a branch's changes name, once each."""
    op, none = F.col("op"), F.lit(None).cast("string")
    index = op.isin("create_index", "drop_index")
    rows = F.array(F.struct(F.col("table_name"), none.alias("column_name"), none.alias("detail")),
                   F.struct(F.col("table_name"), F.col("column_name"), none.alias("detail")),
                   F.struct(F.col("table_name"), F.when(op == "rename_column", F.col("detail")).alias("column_name"),
                            none.alias("detail")),
                   F.struct(none.alias("table_name"), none.alias("column_name"), F.when(index, F.col("detail")).alias("detail")))
    return (objs.select("branch_id", F.explode(rows).alias("o")).select("branch_id", "o.*")
            .where("coalesce(table_name, column_name, detail) IS NOT NULL").distinct())


def parent_catalogs(changes: DataFrame, links: DataFrame, touched: DataFrame, catalog: DataFrame,
                    indexes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each branch's own parent held of the objects the branch touches.

    ``changes``: actions of the parents (branch_id, position, at, sql_text) on
    top of the seed ``catalog`` and ``indexes``; ``links``: (branch_id,
    parent_id, at), the parent as of ``at`` (NULL: as it is now); ``touched``:
    see ``touched_objects``.  The questions stand on the parent's own time
    line, behind its changes up to ``at``, and ride through the same replay as
    these, so no branch is joined with its parent's changes.  Returns the
    catalog and the indexes per branch.  The time line's rows are parsed and
    written once (checkpoint), then searched for hot parents, numbered and
    replayed; the answers are written too, as a check reads them three times."""
    ends = F.lit("9999-12-31").cast("timestamp_ntz")
    asked = (touched.join(links, "branch_id")
             .select(F.col("parent_id").alias("branch_id"), F.coalesce(F.col("at").cast("timestamp_ntz"), ends).alias("at"),
                     F.lit(1).alias("asks"), F.col("branch_id").alias("position"), F.lit("probe").alias("op"), "table_name",
                     "column_name", "detail", F.lit(None).cast("string").alias("sql_text"),
                     F.lit(None).cast("array<string>").alias("create_cols"), F.lit(False).alias("table_guard"),
                     F.lit(False).alias("object_guard")))
    parents = links.select(F.col("parent_id").alias("branch_id")).distinct()
    own = changes.join(parents, "branch_id", "left_semi")
    known = (_objects(own.select("branch_id", F.col("position").alias("sequence"), "sql_text", "at"), "at")
             .withColumnRenamed("sequence", "position")
             .withColumns({"at": F.col("at").cast("timestamp_ntz"), "asks": F.lit(0)}))
    rows = known.unionByName(asked).checkpoint()
    hot = collect_hot(rows, ["branch_id"])
    line = number_rows(rows, ["branch_id"], ["at", "asks", "position", "table_name", "column_name", "detail"], out="sequence", hot=hot)
    cats = _catalogs(catalog, indexes)
    if hot is None:
        t = _replay(line, *cats, _plain_step)
    else:
        line = line.checkpoint()
        t = (_replay(line.join(hot, "branch_id", "left_anti"), *cats, _plain_step)
             .unionByName(_replay(line.join(hot, "branch_id", "left_semi"), *cats, _pieced_step)))
    held = ((F.col("table_name").isNotNull() & F.col("table_before")).alias("has_table"),
            (F.col("detail").isNotNull() & F.col("index_before")).alias("has_index"))
    found = (t.where("op = 'probe'").select(F.col("position").alias("branch_id"), "table_name", "column_name",
                                            F.col("detail").alias("index_name"), "col_before", *held)
             .where("has_table OR has_index").checkpoint())
    there = found.where("has_table").select(
        "branch_id", "table_name", F.when(F.col("col_before"), F.col("column_name")).alias("column_name"))
    return there, found.where("has_index").select("branch_id", "index_name", "table_name")


def check_against_parents(branches: DataFrame, changes: DataFrame, histories: DataFrame, catalog: DataFrame,
                          indexes: DataFrame, hot=DETECT) -> DataFrame:
    """Checks each branch's ``changes`` (branch_id, sequence, sql_text), action
    by action, against its own parent: ``histories`` (branch_id, sequence,
    sql_text, applied_at) on top of the seed catalog, as of the time given in
    ``branches`` (branch_id, parent_id, at).  (branch_id, sequence, action,
    position, op, table_name, column_name, conflict_type, message)."""
    actions = with_actions(changes.select("branch_id", "sequence", "sql_text"))
    mine = actions.select("branch_id", F.col("position").alias("sequence"), "sql_text")
    past = with_actions(histories.select("branch_id", "sequence", "sql_text", F.col("applied_at").alias("at")))
    objs = _objects(mine).checkpoint()         # parsed once: what is touched, then checked
    there, there_idx = parent_catalogs(past, branches, touched_objects(objs), catalog, indexes)
    checked = _classify(_object_states(objs, there, there_idx, hot=hot))
    place = F.col("sequence")
    return checked.select("branch_id", F.shiftright(place, ACTION_BITS).cast("int").alias("sequence"),
                          (place % (1 << ACTION_BITS) + 1).cast("int").alias("action"), place.alias("position"), "op",
                          "table_name", "column_name", "conflict_type", "message")


def _plain_step(df, parts, lasts=None, sums=None, order="sequence"):
    return plain_scan(df, parts, order, lasts, sums)


def _pieced_step(df, parts, lasts=None, sums=None, order="sequence"):
    return pieced_scan(df, parts, order, lasts, sums, piece_cols=["branch_id"])


def _replay(objs: DataFrame, cat_tables: DataFrame, cat_cols: DataFrame, cat_idx: DataFrame, scan) -> DataFrame:
    # 1-2: table state and epochs per (branch, table)
    op = F.col("op")
    t_event = F.when(op == "create_table", F.lit(True)).when(op == "drop_table", F.lit(False))
    t = scan(_with_catalog(objs, cat_tables, ["table_name"]), ["branch_id", "table_name"],
             lasts={"_tb": t_event})
    t = t.withColumn("table_before", F.coalesce("_tb", "cat_table", F.lit(False)))
    accepted_create = (op == "create_table") & ~F.col("table_before")
    accepted = (accepted_create | ((op == "drop_table") & F.col("table_before"))).cast("int")
    # epoch_cols: columns of the CREATE TABLE that opened the current epoch
    # (if a DROP opened it the table is absent and no column is checked)
    t = scan(t, ["branch_id", "table_name"],
             lasts={"epoch_cols": F.when(accepted_create, F.col("create_cols"))}, sums={"_ep": accepted})
    t = t.withColumn("epoch", F.coalesce("_ep", F.lit(0)))

    # 3: column touches; a rename touches its old name (gone) and new name
    # (present).  The extra rename row rides along in the same frame, tells
    # the rename the state of its new name in step 4, and is then dropped, so
    # no join back is needed.
    touches = F.array(
        F.struct(F.col("column_name").alias("col"),
                 F.when(op == "add_column", F.lit(True))
                  .when(op.isin("drop_column", "rename_column"), F.lit(False)).alias("effect"),
                 F.lit(True).alias("main")),
        F.struct(F.when(op == "rename_column", F.col("detail")).alias("col"),
                 F.lit(True).alias("effect"), F.lit(False).alias("main")))
    t = (t.select("*", F.explode(touches).alias("tc"))
          .filter(F.col("tc.main") | F.col("tc.col").isNotNull())
          .withColumn("col", F.col("tc.col")).withColumn("_effect", F.col("tc.effect"))
          .withColumn("_main", F.col("tc.main")).drop("tc"))
    t = _with_catalog(t, cat_cols.withColumnRenamed("column_name", "col"), ["table_name", "col"])
    t = scan(t, ["branch_id", "table_name", "epoch", "col"], lasts={"_cb": F.col("_effect")})
    t = (t.withColumn("col_before", F.when(F.col("col").isNotNull(), F.coalesce(
              F.col("_cb"),
              F.when(F.col("epoch") == 0, F.coalesce("cat_col", F.lit(False)))
               .otherwise(F.coalesce(F.array_contains("epoch_cols", F.col("col")), F.lit(False))))))
          .withColumn("_pos", F.col("sequence").cast("long") * 2 + F.col("_main").cast("long")))

    # 4: index state per (branch, index name)
    # a CREATE INDEX on a missing table is rejected and creates nothing
    i_event = (F.when((op == "create_index") & F.col("table_before"), F.lit(True))
                .when(op == "drop_index", F.lit(False)))
    t = scan(_with_catalog(t, cat_idx, ["detail"]), ["branch_id", "detail"], order="_pos",
             lasts={"_ib": i_event, "target_before": F.when(~F.col("_main"), F.col("col_before"))})
    t = t.filter(F.col("_main")).withColumn("index_before", F.when(op.isin("create_index", "drop_index", "probe"),
                                            F.coalesce("_ib", "cat_idx", F.lit(False))))

    return t


def _classify(t: DataFrame, *extra: str) -> DataFrame:
    op = F.col("op")
    tb, cb, ib = F.col("table_before"), F.col("col_before"), F.col("index_before")
    tbl, col, det = F.col("table_name"), F.col("column_name"), F.col("detail")
    q = F.lit('"')
    guard = F.col("object_guard")
    allowed = (F.col("table_guard") & ~tb) | ((op == "drop_table") & guard & ~tb)     # nothing to do, by its own words
    missing_table = op.isin(*NEEDS_TABLE) & ~tb
    onto = (op == "rename_column") & F.coalesce("target_before", F.lit(False))
    ctype = (F.when(op == "other", F.lit("unverified"))
              .when(allowed, F.lit(None))
              .when(missing_table, F.lit("dropped_reference"))
              .when((op == "create_table") & tb & ~guard, F.lit("table_exists"))
              .when((op == "create_index") & ib & ~guard, F.lit("index_exists"))
              .when((op == "drop_index") & ~ib & ~guard, F.lit("dropped_reference"))
              .when((op == "add_column") & cb & ~guard, F.lit("column_exists"))
              .when(op.isin(*NEEDS_COLUMN) & ~cb & ~guard, F.lit("dropped_reference"))
              .when(onto, F.lit("column_exists")))
    message = (F.when(ctype == "unverified", F.lit("statement not recognised, review it by hand"))
                .when(ctype.isNull(), F.lit(None))
                .when(missing_table & (op == "drop_table"), F.concat(F.lit('table "'), tbl, q, F.lit(" does not exist")))
                .when(missing_table, F.concat(F.lit('relation "'), tbl, q, F.lit(" does not exist")))
                .when(ctype == "table_exists", F.concat(F.lit('relation "'), tbl, q, F.lit(" already exists")))
                .when(ctype == "index_exists", F.concat(F.lit('relation "'), det, q, F.lit(" already exists")))
                .when((ctype == "dropped_reference") & (op == "drop_index"),
                      F.concat(F.lit('index "'), det, q, F.lit(" does not exist")))
                .when(ctype == "column_exists",
                      F.concat(F.lit('column "'), F.when(op == "rename_column", det).otherwise(col), F.lit('" of relation "'), tbl, q, F.lit(" already exists")))
                .when(ctype == "dropped_reference",
                      F.concat(F.lit('column "'), col, F.lit('" of relation "'), tbl, q, F.lit(" does not exist"))))
    return t.select("branch_id", "sequence", "sql_text", "op", "table_name", "column_name",
                    ctype.alias("conflict_type"), message.alias("message"), *extra)


def classify_messages(log: DataFrame) -> DataFrame:
    """Error text -> (conflict_type, description, suggestion, auto_resolvable),
    first matching rule wins."""
    cls = conflict_class(F.col("message"))
    return (log.withColumn("message_class", cls)
               .select("*", *conflict_details(F.col("message_class"), F.col("message"))))


def resolve(conflicts: DataFrame, class_col: str = "message_class") -> DataFrame:
    return conflicts.select("*", *auto_resolve(F.col("sql_text"), F.col(class_col)))


def merge_ours(checked: DataFrame) -> DataFrame:
    """Strategy ours: every checked (mergeable) change except the
    conflicting ones.  One pass over the check result, no join."""
    return checked.filter(F.col("conflict_type").isNull())


def merge_theirs(checked: DataFrame) -> DataFrame:
    """Strategy theirs: conflicting changes replaced by their resolved text
    (classified from the error message, as the tool does); an empty
    resolution means skip.  (branch_id, sequence, sql_to_apply, skip).

    Every change stays in the result with a ``skip`` flag rather than being
    filtered out: a filter would be pushed below the class projection and
    inline the message expression many times over."""
    classed = checked.withColumn("message_class", F.when(F.col("message").isNotNull(),
                                                        conflict_class(F.col("message"))))
    resolved = auto_resolve(F.col("sql_text"), F.col("message_class"))[0]
    to_apply = F.when(F.col("message_class").isNull(), F.col("sql_text")).otherwise(resolved)
    return (classed.select("branch_id", "sequence", to_apply.alias("sql_to_apply"))
                   .withColumn("skip", F.col("sql_to_apply") == ""))


def merge_refused(branches: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Without a strategy a branch with any conflict is refused."""
    n = (conflicts.filter(F.col("conflict_type").isNotNull())
         .groupBy("branch_id").agg(F.count(F.lit(1)).alias("conflicts")))
    return branches.select("branch_id", "name").join(n, "branch_id")


INSERT_VALUES = r"(?is)\bINSERT\s+INTO\s+([\w.\"]+)\s*(?:\([^)]*\))?\s*VALUES\s*(.*)$"
FIRST_OF_TUPLE = r"(?:^|\)\s*,)\s*\(\s*('(?:[^']|'')*'|[^,()\s']+)"


def seed_rows(recorded: DataFrame) -> DataFrame:
    """Rows that seed changes insert, one for each tuple of ``INSERT INTO t
    [(columns)] VALUES (key, ...), (key, ...)``: branch_id, table_name (no
    schema), row_key (the tuple's first value as text, without quotes),
    applied_at, migration_id.  A seed change of another form gives one row
    with a NULL row_key, so that it is seen."""
    sql = F.col("sql_text")
    table = F.regexp_replace(F.lower(F.translate(F.regexp_extract(sql, INSERT_VALUES, 1), '"', "")), r"^.*\.", "")
    keys = F.regexp_extract_all(F.regexp_extract(sql, INSERT_VALUES, 2), F.lit(FIRST_OF_TUPLE), F.lit(1))
    return (recorded.filter(F.col("type") == "seed")
            .select("branch_id", F.nullif(table, F.lit("")).alias("table_name"),
                    F.explode_outer(keys).alias("row_key"), "applied_at", "migration_id")
            .withColumn("row_key", F.regexp_replace("row_key", "^'|'$", "")))


def merge_seed_rows(branches: DataFrame, recorded: DataFrame) -> DataFrame:
    """The parents' seeded tables after every open branch merges its seed
    rows: the parent's own rows, plus of each key that the parent lacks the
    first row (by applied_at, then migration_id) of its children.  The
    parent's own rows have no ``from_branch``; a key stands once in a table.
    (parent_id, table_name, row_key, from_branch)."""
    seeds = seed_rows(recorded)
    key = ["parent_id", "table_name", "row_key"]
    open_ = branches.filter((F.col("status") == "active") & (F.col("branch_id") != 0))
    parents = branches.select(F.col("name").alias("parent_branch"), F.col("branch_id").alias("parent_id"))
    links = open_.select("branch_id", "name", "parent_branch").join(parents, "parent_branch")
    own = (seeds.join(links.select(F.col("parent_id").alias("branch_id")).distinct(), "branch_id", "left_semi")
           .select(F.col("branch_id").alias("parent_id"), "table_name", "row_key", F.lit(0).alias("late"),
                   "applied_at", "migration_id", F.lit(None).cast("string").alias("from_branch")))
    incoming = (seeds.join(links, "branch_id")
                .select("parent_id", "table_name", "row_key", F.lit(1).alias("late"), "applied_at", "migration_id",
                        F.col("name").alias("from_branch")))
    first = F.min_by("from_branch", F.struct("late", "applied_at", "migration_id", "from_branch"))
    return own.unionByName(incoming).groupBy(*key).agg(first.alias("from_branch"))


VALUE_TUPLE = (r"\(((?:[^()']+|'[^']*(?:''[^']*)*'|\((?:[^()']+|'[^']*(?:''[^']*)*'|\([^()]*\))*\))*)\)")
INSERT_COLUMNS = r"(?is)\bINSERT\s+INTO\s+[\w.\"]+\s*\(([^)]*)\)\s*VALUES"


def seed_tuples(recorded: DataFrame) -> DataFrame:
    """The rows that seed changes insert, with all their values as written:
    branch_id, table_name, columns (empty: the table's own order), row_values,
    row_no (within the change), applied_at, migration_id.  A seed change of
    another form gives one row without values, so that it is seen."""
    sql = F.col("sql_text")
    table = F.regexp_replace(F.lower(F.translate(F.regexp_extract(sql, INSERT_VALUES, 1), '"', "")), r"^.*\.", "")
    names = F.regexp_extract_all(F.lower(F.regexp_extract(sql, INSERT_COLUMNS, 1)), F.lit(r"\w+"), F.lit(0))
    tuples = F.regexp_extract_all(F.regexp_extract(sql, INSERT_VALUES, 2), F.lit(VALUE_TUPLE), F.lit(1))
    return (recorded.filter(F.col("type") == "seed")
            .select("branch_id", F.nullif(table, F.lit("")).alias("table_name"), names.alias("columns"),
                    F.posexplode_outer(tuples).alias("row_no", "_tuple"), "applied_at", "migration_id")
            .withColumn("row_values", F.transform(F.regexp_extract_all("_tuple", F.lit(ITEM), F.lit(0)), trim_ws)).drop("_tuple"))


def merge_seed_values(branches: DataFrame, recorded: DataFrame) -> DataFrame:
    """The rows that the parents' tables gain when every open branch merges
    its seed rows: whole rows, of each key (the first value) that the parent
    lacks the first by applied_at, migration_id, row_no.
    (parent_id, table_name, row_key, columns, row_values, from_branch)."""
    rows = seed_tuples(recorded).withColumn("row_key", F.regexp_replace(F.get("row_values", F.lit(0)), "^'|'$", ""))
    key = ["parent_id", "table_name", "row_key"]
    parents = branches.select(F.col("name").alias("parent_branch"), F.col("branch_id").alias("parent_id"))
    links = (branches.filter((F.col("status") == "active") & (F.col("branch_id") != 0))
             .select("branch_id", "name", "parent_branch").join(parents, "parent_branch").drop("parent_branch"))
    held = rows.select(F.col("branch_id").alias("parent_id"), "table_name", "row_key").distinct()
    first = F.min_by(F.struct("columns", "row_values", F.col("name").alias("from_branch")),
                     F.struct("applied_at", "migration_id", "row_no"))
    incoming = rows.join(links, "branch_id").groupBy(*key).agg(first.alias("r"))
    return (incoming.join(held.withColumnsRenamed({k: f"_{k}" for k in key}),
                          [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left_anti").select(*key, "r.*"))
