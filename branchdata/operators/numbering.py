"""Exact row numbering that stays balanced when one group is huge.

``row_number().over(partitionBy(g).orderBy(o))`` sends a whole group to one
task.  If one branch holds a third of all changes, that task holds a third
of the data.  ``number_rows`` therefore splits the work in two:

* groups below a size threshold keep the plain window (one shuffle);
* the few groups above it (at most ``max_hot`` keys: a proven bound, so the
  key list is broadcast) are cut into ``pieces`` contiguous ranges of the
  first order column, at splitters read off a mergeable quantile sketch, so
  pieces hold like numbers of rows however the keys lie; a single value that
  spans several splitters is cut further on the second order column.  Each
  piece is numbered by its own window task; piece sizes are summed into
  offsets over a table of about ``max_hot * pieces`` rows, and offset + local
  number is the exact position in the group.

Splitters only decide where pieces end: the numbers are exact for any.  They
are one aggregate's result joined to the rows, so all consumers of a plan see
the same pieces.  The same range path numbers a whole table with no group (a
global order), which the load pager needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS_CONF = "branchdata.hotGroupRows"
DEFAULT_HOT_ROWS = 2_000_000

_RANGEABLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
              T.DoubleType, T.DecimalType, T.DateType, T.TimestampType,
              T.TimestampNTZType, T.StringType)


def _cols(items) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in items]


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _as_number(c: Column, dtype) -> Column:
    """A number that orders like the column, in every session time zone."""
    if isinstance(dtype, T.TimestampNTZType):
        from ..functions.text import ntz_micros
        return ntz_micros(c).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dtype, T.StringType):      # the first six bytes: texts order by their bytes
        head = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return c.cast("double")


def _rangeable(df: DataFrame, order_cols: Sequence) -> str | None:
    first = order_cols[0]
    if not isinstance(first, str):
        return None
    dtype = df.schema[first].dataType
    return first if isinstance(dtype, _RANGEABLE) else None


def _second_rangeable(df: DataFrame, order_cols: Sequence) -> str | None:
    if len(order_cols) < 2 or not isinstance(order_cols[1], str):
        return None
    dtype = df.schema[order_cols[1]].dataType
    return order_cols[1] if isinstance(dtype, _RANGEABLE) else None


SKETCH_ACCURACY = 20      # of the quantile sketch, per piece


def splitters(x: Column, pieces: int) -> Column:
    """Aggregate: the values that cut ``x`` into ``pieces`` of like size."""
    if pieces < 2:
        return F.array().cast("array<double>")
    return F.percentile_approx(x, [i / pieces for i in range(1, pieces)], SKETCH_ACCURACY * pieces)


def count_below(splits: Column, x: Column, pieces: int, or_equal: bool = False) -> Column:
    """How many of the sorted splitters lie below ``x`` (or are equal to it), by bisection."""
    steps = F.array(*[F.lit(1 << b) for b in range(max(pieces - 1, 1).bit_length() - 1, -1, -1)])

    def step(at: Column, size: Column) -> Column:
        value = F.get(splits, at + size - 1)
        return F.when(value <= x if or_equal else value < x, at + size).otherwise(at)
    return F.aggregate(steps, F.lit(0), step)


def _piece(x: Column, splits: Column, x2: Column | None, splits2: Column | None, pieces: int) -> Column:
    """A row's piece.  A value of ``x`` that holds several splitters stands at
    the end of its piece and is cut into as many on the second column."""
    below = count_below(splits, x, pieces)
    if x2 is None:
        return F.coalesce(below, F.lit(-1)).cast("bigint")
    spans = count_below(splits, x, pieces, or_equal=True) - below
    second = F.coalesce(1 + F.floor(count_below(splits2, x2, pieces) * spans / pieces), F.lit(1))   # NULLs come first
    return F.coalesce(below * (pieces + 1) + F.when(spans > 1, second).otherwise(0), F.lit(-1)).cast("bigint")


def ranged_numbers(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                   out: str = "rn", pieces: int | None = None, few_groups: bool = False) -> DataFrame:
    """Number rows 1..n per group (or over the whole frame when
    ``group_cols`` is empty; bigint) in ``pieces`` balanced tasks per group.

    ``order_cols`` must give a total order inside a group and start with a
    numeric, date, timestamp or text column (the range column; a text counts
    by its first six bytes); the second may be one of these types too.
    ``few_groups``: the caller knows that the groups are few (a broadcast of
    their splitters is bounded); else joins are left to AQE.
    """
    pieces = pieces or _partitions(df)
    group_cols = list(group_cols)
    first = _rangeable(df, order_cols)
    if first is None:
        raise ValueError("ranged numbering needs a numeric, date, timestamp or text first order column")
    second = _second_rangeable(df, order_cols)
    x = _as_number(F.col(first), df.schema[first].dataType)
    x2 = _as_number(F.col(second), df.schema[second].dataType) if second else None
    cuts = {"_cuts": splitters(x, pieces), **({"_cuts2": splitters(x2, pieces)} if second else {})}
    if not group_cols:       # one group, under a key that the optimiser can't fold away
        every = df.withColumn("_all", F.pmod(F.xxhash64(first), F.lit(1)))
        return ranged_numbers(every, ["_all"], order_cols, out, pieces, few_groups=True).drop("_all")
    small = F.broadcast if few_groups else (lambda d: d)
    base = df.join(small(df.groupBy(*group_cols).agg(*[c.alias(n) for n, c in cuts.items()])), group_cols, "inner")
    splits = {n: F.col(n) for n in cuts}
    cut = (base.withColumn("_piece", _piece(x, splits["_cuts"], x2, splits.get("_cuts2"), pieces))
           .select(*df.columns, "_piece"))
    local_w = Window.partitionBy(*group_cols, "_piece").orderBy(*_cols(order_cols))
    numbered = cut.withColumn("_local", F.row_number().over(local_w))
    sizes = cut.groupBy(*group_cols, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*group_cols).orderBy("_piece")
              .rowsBetween(Window.unboundedPreceding, -1))
    # about #groups x pieces rows
    offsets = sizes.select(*group_cols, "_piece",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (numbered.join(small(offsets), [*group_cols, "_piece"])
                    .select(*df.columns, (F.col("_local") + F.col("_off")).cast("bigint").alias(out)))


def hot_groups(df: DataFrame, group_cols: Sequence[str], hot_rows: int | None = None,
               max_hot: int | None = None) -> DataFrame:
    """Keys of groups with at least ``hot_rows`` rows, largest first, at most
    ``max_hot`` keys.  A group past the cap is smaller than every kept one,
    so it holds at most 1/max_hot of the rows and the plain window copes;
    no row is dropped either way."""
    spark = df.sparkSession
    hot_rows = hot_rows or int(spark.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))
    max_hot = max_hot or _partitions(df)
    return (df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_cnt"))
              .filter(F.col("_cnt") >= hot_rows)
              .orderBy(F.desc("_cnt"), *group_cols)
              .limit(max_hot)
              .select(*group_cols))


def collect_hot(df: DataFrame, group_cols: Sequence[str], hot_rows: int | None = None,
                max_hot: int | None = None) -> DataFrame | None:
    """Hot keys as a small broadcast frame, or None when there are none.
    At most ``max_hot`` keys reach the driver (a proven bound)."""
    keys = hot_groups(df, group_cols, hot_rows, max_hot).collect()
    if not keys:
        return None
    schema = df.select(*group_cols).schema
    return F.broadcast(df.sparkSession.createDataFrame([tuple(k) for k in keys], schema))


DETECT = object()   # sentinel: find the hot keys here


def number_rows(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                out: str = "rn", hot_rows: int | None = None,
                max_hot: int | None = None, hot=DETECT) -> DataFrame:
    """Exact ``row_number()`` per group (1-based, int), balanced for hot groups.

    The hot keys are found first (one aggregate over the group columns; at
    most ``max_hot`` keys come back to the driver, a proven bound).  Without
    hot groups the plan is the plain window.
    """
    group_cols = list(group_cols)
    if not group_cols:
        return ranged_numbers(df, [], order_cols, out)
    window = Window.partitionBy(*group_cols).orderBy(*_cols(order_cols))
    plain = df.select(*df.columns, F.row_number().over(window).cast("int").alias(out))
    if _rangeable(df, order_cols) is None:
        return plain
    if hot is DETECT:       # caller may pass keys found on a cheaper input
        hot = collect_hot(df, group_cols, hot_rows, max_hot)
    if hot is None:
        return plain
    cold = (df.join(hot, group_cols, "left_anti")
              .select(*df.columns, F.row_number().over(window).cast("int").alias(out)))
    warm = ranged_numbers(df.join(hot, group_cols, "left_semi"), group_cols, order_cols, out, few_groups=True)
    warm = warm.withColumn(out, F.col(out).cast("int"))     # as row_number(); out of range raises
    return cold.unionByName(warm)
