"""Keys and foreign keys found in the data of a set of tables.

Files declare no constraints, so they are looked for:

1. one pass per table profiles its columns (nulls, distinct sketch, range);
2. keys level by level: single columns, then sets of columns.  A set is tried
   only if no subset of it is a key, none of its columns holds NULLs, the
   product of its columns' sketches reaches the number of rows, and a sketch
   of the set itself does.  What is left is counted exactly, all tables and
   sets in one shuffle;
3. inclusions by an inverted index: the values of the columns that could refer
   or be referred to are shuffled once (combined before the shuffle, so a value
   of a third of all rows is one row a task), to a word of bits per column.  A
   column is included in those whose words hold all bits of its own, block by
   block.  No pair of columns is joined.

What is shuffled are blocks: numbers and dates (a set of them as the number
of the combination) stand as bits of words of ``BITS`` consecutive ones, so
that dense keys take a fraction of a byte a row; texts, and sets whose ranges
don't fit a bigint, as hashes of 128 bits.  Both searches look at one in
``SLICES`` of the blocks first, with all their rows: a repeated or lacking
value there settles a set or pair, and only the others, the keys and
inclusions nearly all, are searched whole.

Sketches only leave out sets that are short of the rows by more than
``SLACK``, seven times their standard error.  The driver holds one row per
column or column set (catalog size), never data.  NULLs of a referring column
are ignored; an empty table has no keys and refers to nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKETCH_ERROR = 0.02
SLACK = 0.15
MAX_COLUMNS = 2          # widest key looked for
SETS_PER_PASS = 100      # sketches in one aggregate
SLICES = 64              # one in so many places refutes most sets and pairs
BITS = 64                # numbers per word of a block
PAIRS = 16               # pairs of columns per aggregate
TEXT_RANGE = 64          # characters of a text's range that are compared

Key = tuple[str, tuple[str, ...]]


@dataclass(frozen=True)
class ColumnProfile:
    table: str
    column: str
    position: int
    kind: str
    n_rows: int
    n_nulls: int
    n_distinct: int        # by sketch
    low: object
    high: object


@dataclass(frozen=True)
class Inclusion:
    table: str
    column: str
    ref_table: str
    ref_column: str


def kind_of(dtype: T.DataType) -> str | None:
    """The kinds of columns that can be keys; values of one kind compare."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return type(dtype).typeName()
    return None


def key_columns(df: DataFrame) -> dict[str, str]:
    return {f.name: k for f in df.schema.fields if (k := kind_of(f.dataType))}


def _name(c: str) -> Column:
    return F.col(f"`{c.replace('`', '``')}`")


def _number(c: str, kind: str) -> Column:
    """A bigint that orders like the column, for range comparisons."""
    x = _name(c)
    if kind == "integer":
        return x.cast("bigint")
    if kind == "date":
        return F.unix_date(x).cast("bigint")
    if kind == "timestamp":
        return F.unix_micros(x)
    if kind == "timestamp_ntz":
        from ..functions.text import ntz_micros
        return ntz_micros(x)
    return F.lit(None).cast("bigint")


def _sketch(c: Column) -> Column:
    return F.approx_count_distinct(c, SKETCH_ERROR)


def profiles(tables: Mapping[str, DataFrame]) -> list[ColumnProfile]:
    """One profile per possible key column, all tables in one job."""
    parts = []
    for t, df in tables.items():
        cols = key_columns(df)
        if not cols:
            continue
        wide = df.agg(F.count(F.lit(1)).alias("n"), *[
            F.struct(F.count_if(_name(c).isNull()).alias("nulls"), _sketch(_name(c)).alias("n_distinct"),
                     F.min(_number(c, k)).alias("low"), F.max(_number(c, k)).alias("high"),
                     *[f(F.substring(_name(c), 1, TEXT_RANGE) if k == "text" else F.lit(None).cast("string")).alias(a)
                       for f, a in ((F.min, "low_text"), (F.max, "high_text"))]).alias(f"c{i}")
            for i, (c, k) in enumerate(cols.items())])
        rows = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(c).alias("column"), F.lit(i).alias("position"),
                                  F.lit(k).alias("kind"), F.col("n"), F.col(f"c{i}").alias("p"))
                         for i, (c, k) in enumerate(cols.items())])
        parts.append(wide.select(F.explode(rows).alias("r")).select("r.*"))
    if not parts:
        return []
    return [ColumnProfile(r.table, r.column, r.position, r.kind, r.n, r.p.nulls, r.p.n_distinct,
                          r.p.low_text if r.kind == "text" else r.p.low, r.p.high_text if r.kind == "text" else r.p.high)
            for r in reduce(DataFrame.unionByName, parts).collect()]


def set_sketches(tables: Mapping[str, DataFrame], sets: Iterable[Key]) -> dict[Key, int]:
    """Distinct sketches of column sets, ``SETS_PER_PASS`` of a table a pass."""
    by_table: dict[str, list[tuple[str, ...]]] = {}
    for t, cols in sets:
        by_table.setdefault(t, []).append(cols)
    parts, order = [], []
    for t, all_sets in by_table.items():
        for at in range(0, len(all_sets), SETS_PER_PASS):
            some = all_sets[at:at + SETS_PER_PASS]
            wide = tables[t].agg(F.array(*[_sketch(F.struct(*map(_name, cols))) for cols in some]).alias("n"))
            parts.append(wide.select(F.lit(len(order)).alias("pass"), "n"))
            order.append((t, some))
    if not parts:
        return {}
    got = {r["pass"]: r.n for r in reduce(DataFrame.unionByName, parts).collect()}
    return {(t, cols): n for i, (t, some) in enumerate(order) for cols, n in zip(some, got[i], strict=True)}


def _hashes(cols: Sequence[Column]) -> list[Column]:
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("second"), *cols).alias("k2")]


def _place(number: Column) -> list[Column]:
    """A number as the block of ``BITS`` consecutive ones that it lies in, and its bit there."""
    at = F.pmod(number, F.lit(BITS).cast("bigint"))
    return [(number - at).alias("k1"), F.lit(0).cast("bigint").alias("k2"),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int")).alias("w")]


def _hashed(cols: Sequence[Column]) -> list[Column]:
    return [*_hashes(cols), F.lit(1).cast("bigint").alias("w")]


def _set_place(cols: Sequence[str], own: Mapping[str, ColumnProfile]) -> list[Column]:
    """Where a combination of values stands: its number among all that the
    columns' ranges allow, if these fit a bigint, else its hash."""
    number, size = F.lit(0).cast("bigint"), 1
    for c in cols:
        p = own[c]
        if p.kind == "text":
            return _hashed([_name(c) for c in cols])
        span = p.high - p.low + 1
        size *= span
        if size >= 1 << 62:
            return _hashed([_name(c) for c in cols])
        number = number * F.lit(span).cast("bigint") + (_number(c, p.kind) - F.lit(p.low).cast("bigint"))
    return _place(number)


def _slice(rows: DataFrame, slices: int) -> DataFrame:
    """All rows of one in ``slices`` of the places (blocks or hashes)."""
    return rows.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(slices).cast("bigint")) == 0) if slices > 1 else rows


def set_blocks(tables: Mapping[str, DataFrame], sets: Sequence[Key], columns: Sequence[ColumnProfile],
               slices: int = 1) -> DataFrame:
    """(s, k1, k2, n, w) per column set (its index) and place: the rows there
    and the bits that they set, of one in ``slices`` of the places."""
    parts = []
    for t in dict.fromkeys(t for t, _ in sets):
        own = {p.column: p for p in columns if p.table == t}
        placed = F.array(*[F.struct(F.lit(i).alias("s"), *_set_place(cols, own)) for i, (u, cols) in enumerate(sets) if u == t])
        parts.append(_slice(tables[t].select(F.explode(placed).alias("v")).select("v.*"), slices))
    return (reduce(DataFrame.unionByName, parts).groupBy("s", "k1", "k2")
            .agg(F.count(F.lit(1)).alias("n"), F.bit_or("w").alias("w")))


def repeated_sets(tables: Mapping[str, DataFrame], sets: Sequence[Key], columns: Sequence[ColumnProfile],
                  slices: int = 1) -> set[Key]:
    """Which of the column sets (of columns without NULLs) hold some
    combination of values twice, within one in ``slices`` of the places: one
    shuffle for all sets of all tables, of a row per block that a task met."""
    if not sets:
        return set()
    twice = set_blocks(tables, sets, columns, slices).where(F.col("n") > F.bit_count("w")).select("s").distinct()
    return {sets[r.s] for r in twice.collect()}


def find_keys(tables: Mapping[str, DataFrame], columns: Sequence[ColumnProfile],
              max_columns: int = MAX_COLUMNS) -> list[Key]:
    """The minimal keys of every table: column sets (in table order) without
    NULLs whose values together differ from row to row."""
    whole = {(p.table, p.column): p for p in columns if p.n_rows and not p.n_nulls}
    found: list[Key] = []
    for width in range(1, max_columns + 1):
        tries: list[Key] = []
        for t in dict.fromkeys(t for t, _ in whole):
            own = [c for u, c in whole if u == t]
            known = [set(cols) for u, cols in found if u == t]
            for cols in combinations(own, width):
                size, reach = whole[t, cols[0]].n_rows, 1
                for c in cols:
                    reach *= whole[t, c].n_distinct
                if reach >= (1 - SLACK) * size and not any(k <= set(cols) for k in known):
                    tries.append((t, cols))
        if width > 1:
            sketched = set_sketches(tables, tries)
            tries = [k for k in tries if sketched[k] >= (1 - SLACK) * whole[k[0], k[1][0]].n_rows]
        for slices in (SLICES, 1):
            twice = repeated_sets(tables, tries, columns, slices)
            tries = [k for k in tries if k not in twice]
        found += tries
    return found


def inclusions(tables: Mapping[str, DataFrame], columns: Sequence[ColumnProfile],
               referred: Iterable[tuple[str, str]]) -> list[Inclusion]:
    """Columns whose values all occur in a ``referred`` column of another table.

    A pair is possible if the kinds are equal, the range lies inside and the
    sketch isn't larger; only columns of possible pairs are shuffled."""
    by_name = {(p.table, p.column): p for p in columns}
    targets = [by_name[r] for r in referred]
    possible: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for p in columns:
        if p.n_rows == p.n_nulls:
            continue
        inside = [(q.table, q.column) for q in targets
                  if q.table != p.table and q.kind == p.kind and q.low <= p.low and p.high <= q.high
                  and p.n_distinct * (1 - SLACK) <= q.n_distinct]
        if inside:
            possible[p.table, p.column] = inside
    for slices in (SLICES, 1):
        broken = broken_inclusions(tables, by_name, possible, slices)
        possible = {c: left for c, refs in possible.items() if (left := [r for r in refs if (c, r) not in broken])}
    return sorted((Inclusion(*c, *r) for c, refs in possible.items() for r in refs),
                  key=lambda x: (x.table, x.column, x.ref_table, x.ref_column))


def broken_inclusions(tables: Mapping[str, DataFrame], by_name: Mapping[tuple[str, str], ColumnProfile],
                      possible: Mapping[tuple[str, str], Sequence[tuple[str, str]]],
                      slices: int = 1) -> set[tuple[tuple[str, str], tuple[str, str]]]:
    """Pairs of a column and one of its ``possible`` targets that lacks some of
    its values, within one in ``slices`` of the places."""
    taking_part = sorted({*possible, *(r for rs in possible.values() for r in rs)})
    if not taking_part:
        return set()
    at = {c: i for i, c in enumerate(taking_part)}
    kinds = sorted({by_name[c].kind for c in taking_part})
    parts = []
    for t in dict.fromkeys(t for t, _ in taking_part):
        values = F.array(*[
            F.struct(F.lit(at[u, c]).alias("c"), F.lit(kinds.index(k)).alias("kind"),
                     *(_hashed([_name(c)]) if k == "text" else _place(_number(c, k))), _name(c).isNotNull().alias("present"))
            for u, c in taking_part if u == t for k in (by_name[u, c].kind,)])
        rows = tables[t].select(F.explode(values).alias("v")).select("v.*").where("present").drop("present")
        parts.append(_slice(rows, slices))
    held = (reduce(DataFrame.unionByName, parts).groupBy("kind", "k1", "k2")
            .agg(*[F.bit_or(F.when(F.col("c") == i, F.col("w")).otherwise(0)).alias(f"w{i}") for i in at.values()]))
    pairs = [(c, r) for c, refs in possible.items() for r in refs]
    lacking = held.agg(*[
        F.bit_or(reduce(Column.bitwiseOR, [
            F.when(F.col(f"w{at[c]}").bitwiseAND(F.bitwise_not(f"w{at[r]}")) != 0, F.lit(1 << i).cast("bigint")).otherwise(0)
            for i, (c, r) in enumerate(pairs[first:first + PAIRS])])).alias(f"p{first}")
        for first in range(0, len(pairs), PAIRS)]).first()
    return {pair for i, pair in enumerate(pairs) if (lacking[f"p{i - i % PAIRS}"] or 0) >> i % PAIRS & 1}


def alike(column: str, ref_column: str) -> bool:
    """Names that say the same once a short table prefix (``o_``) is off."""
    def bare(c: str) -> str:
        head, mark, rest = c.lower().partition("_")
        return rest if mark and len(head) <= 2 else c.lower()
    return bare(column) == bare(ref_column)


CATALOG = ("table_name string, kind string, columns string, is_primary boolean, ref_table string, ref_column string")


def key_catalog(tables: Mapping[str, DataFrame], max_columns: int = MAX_COLUMNS) -> DataFrame:
    """The key catalog of the tables: rows of kind ``key`` (minimal keys;
    ``is_primary`` marks one per table: fewest columns, integers first, then
    table order), ``foreign`` (a column included in another table's
    one-column key of a like name) and ``included`` (of another name)."""
    spark = next(iter(tables.values())).sparkSession
    columns = profiles(tables)
    keys = find_keys(tables, columns, max_columns)
    place = {(p.table, p.column): (p.kind != "integer", p.position) for p in columns}
    best: dict[str, tuple[str, ...]] = {}
    for t, cols in sorted(keys, key=lambda k: (len(k[1]), [place[k[0], c] for c in k[1]])):
        best.setdefault(t, cols)
    rows: list[tuple] = [(t, "key", ",".join(cols), best[t] == cols, None, None) for t, cols in keys]
    singles = [(t, cols[0]) for t, cols in keys if len(cols) == 1]
    rows += [(x.table, "foreign" if alike(x.column, x.ref_column) else "included", x.column, None, x.ref_table, x.ref_column)
             for x in inclusions(tables, columns, singles)]
    return spark.createDataFrame(rows, CATALOG)


def cursor_columns(catalog: DataFrame) -> DataFrame:
    """The columns that page through each table: its primary key."""
    return catalog.where("is_primary").select("table_name", F.col("columns").alias("cursor_columns"))


def dependency_order(names: Sequence[str], catalog: DataFrame) -> DataFrame:
    """Load order by the foreign keys found: (table_name, level), level 0
    refers to nothing and each other level to lower ones; tables in a circle
    share the level after all that can be ordered."""
    spark = catalog.sparkSession
    refers: dict[str, set[str]] = {t: set() for t in names}
    for r in catalog.where("kind = 'foreign'").select("table_name", "ref_table").distinct().collect():
        refers[r.table_name].add(r.ref_table)
    level: dict[str, int] = {}
    while len(level) < len(refers):
        ready = [t for t in refers if t not in level and refers[t] <= level.keys()]
        depth = 1 + max(level.values(), default=-1)
        for t in ready or [t for t in refers if t not in level]:
            level[t] = depth
    return spark.createDataFrame(sorted(level.items()), "table_name string, level int")
