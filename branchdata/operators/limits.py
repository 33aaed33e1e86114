"""The first n rows of a total order for any n, without a task that holds them.

``orderBy().limit(n)`` brings n rows together in one task.  Here the n-th key
is found instead, by counting rows between splitters of a quantile sketch and
narrowing down on the range that holds it (a few aggregates, each of one row a
range), and the result is a plain filter up to that key, spread like the
table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import SKETCH_ACCURACY, _as_number, _partitions, count_below

SMALL = 100_000          # rows among which the n-th is taken by sorting
MOST_ROUNDS = 60


def _lower(key: Sequence[str], value: Sequence) -> Column:
    """key < value, column by column."""
    first = F.col(key[0])
    less = first < F.lit(value[0])
    return less if len(key) == 1 else less | ((first == F.lit(value[0])) & _lower(key[1:], value[1:]))


def nth_key(df: DataFrame, key: Sequence[str], n: int, small: int = SMALL) -> tuple | None:
    """The key of the n-th row (from 1) in ascending order of ``key`` (no
    NULLs); None if there are fewer rows."""
    key, rows, fixed = list(key), df.select(*key), []
    left = rows.count()
    if n > left:
        return None
    pieces = max(_partitions(df), 2)
    column = 0
    for _ in range(MOST_ROUNDS):
        if left <= small or column == len(key):
            row = rows.orderBy(*key).offset(n - 1).limit(1).first()
            return tuple(row)
        name = key[column]
        x = _as_number(F.col(name), rows.schema[name].dataType)
        splits = sorted(set(rows.agg(F.percentile_approx(x, [i / pieces for i in range(1, pieces)],
                                                         SKETCH_ACCURACY * pieces)).first()[0]))
        below = count_below(F.lit(splits), x, len(splits) + 1)
        ranges = sorted(rows.groupBy(below.alias("piece")).agg(
            F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).collect())
        for r in ranges:                                     # at most one row a piece
            if n <= r.n:
                break
            n -= r.n
        left = r.n
        rows = rows.where((F.col(name) >= F.lit(r.low)) & (F.col(name) <= F.lit(r.high)))
        if r.low == r.high:
            fixed.append(r.low)
            column += 1
        elif len(ranges) == 1:                               # texts that begin alike: sort what is left
            small = left
    raise RuntimeError("the key range didn't narrow down")


def first_rows(df: DataFrame, key: Sequence[str], n: int, small: int = SMALL) -> DataFrame:
    """The first ``n`` rows of ``df`` by ``key`` (NULLs last).  Rows that are
    equal in the whole key are told apart by a hash of the row; which of equal
    rows are taken is not defined."""
    key = list(key)
    if n <= 0:
        return df.limit(0)
    full = " AND ".join(f"`{k}` IS NOT NULL" for k in key)
    whole = df.where(full)
    last = nth_key(whole, key, n, small)
    if last is None:                                         # all of them, then of the rows with a NULL
        rest = n - whole.count()
        return whole.unionByName(df.where(f"NOT ({full})").orderBy(*[F.col(k).asc_nulls_last() for k in key]).limit(rest))
    before = whole.where(_lower(key, last))
    same = whole.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(key, last)]))
    more = n - before.count()
    return before.unionByName(same if same.count() <= more else same.orderBy(F.xxhash64(*df.columns)).limit(more))
