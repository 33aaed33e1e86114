"""Pieces of like size whatever the keys: one group of 40 % of the rows, an
extreme key, single values that hold much of a group; numbers stay exact."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from branchdata.operators import numbering as N
from branchdata.operators.scan import pieced_scan, plain_scan


def _rows(spark, n=4000):
    rng = random.Random(4)
    keys = [rng.randrange(1000) for _ in range(n)]
    keys[0], keys[1] = 10 ** 12, None                            # one extreme key, one NULL
    return spark.createDataFrame([(0 if i % 5 < 2 else i % 50, k if i % 7 else 500, i) for i, k in enumerate(keys)],
                                 "g int, k long, id long").repartition(4)


@pytest.mark.parametrize("order", [["k", "id"], ["id"], ["g", "id"]])
@pytest.mark.parametrize("groups", [["g"], []])
def test_numbers_equal_the_window(spark, order, groups):
    rows = _rows(spark)
    w = Window.partitionBy(*(groups or [F.lit(1)])).orderBy(*order)
    want = rows.withColumn("rn", F.row_number().over(w).cast("bigint"))
    for pieces in (1, 2, 7, 16):
        got = N.ranged_numbers(rows, groups, order, pieces=pieces)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("order", [["k", "id"], ["g", "id"]])
def test_largest_piece_under_twice_the_mean(spark, order):
    rows, pieces = _rows(spark).where("k is not null"), 16
    x, x2 = (N._as_number(F.col(c), rows.schema[c].dataType) for c in order)
    cuts = rows.select(N.splitters(x, pieces).alias("a"), N.splitters(x2, pieces).alias("b")).first()
    piece = N._piece(x, F.array(*map(F.lit, cuts.a)), x2, F.array(*map(F.lit, cuts.b)), pieces)
    sizes = [r["n"] for r in rows.groupBy(piece.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 2 * sum(sizes) / pieces and len(sizes) <= 2 * pieces


def test_pieced_scan_with_an_extreme_key(spark):
    rows = _rows(spark).withColumn("o", F.when(F.col("id") == 7, 10 ** 12).otherwise(F.col("id")))
    lasts, sums = {"l": F.when(F.col("id") % 3 == 0, F.col("id"))}, {"s": F.col("id")}
    want = plain_scan(rows, ["g"], "o", lasts, sums)
    got = pieced_scan(rows, ["g"], "o", lasts, sums, piece_cols=["g"], pieces=8, checkpoint=False)
    assert got.select(*want.columns).exceptAll(want).count() == 0
