"""The balanced operators agree with the plain single-task windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from branchdata.operators.numbering import number_rows, ranged_numbers
from branchdata.operators.scan import pieced_scan, plain_scan


def _skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = 0 if rnd.random() < 0.4 else rnd.randint(1, 30)      # one group holds ~40%
        v = rnd.choice([None, None, rnd.randint(0, 9)])
        rows.append((g, i, rnd.randint(0, 500), v))
    return spark.createDataFrame(rows, "g long, id long, t long, v int")


def test_number_rows_hot_path_equals_window(spark):
    df = _skewed(spark)
    spark.conf.set("branchdata.hotGroupRows", "100")
    try:
        got = number_rows(df, ["g"], ["t", "id"], "rn")
    finally:
        spark.conf.unset("branchdata.hotGroupRows")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("t", "id")).cast("int"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_global_numbering_equals_window(spark):
    df = _skewed(spark)
    got = ranged_numbers(df, [], ["t", "id"], "rn")
    want = df.withColumn("rn", F.row_number().over(Window.orderBy("t", "id")).cast("int"))
    assert got.exceptAll(want).count() == 0 and got.count() == df.count()


def test_pieced_scan_equals_plain_scan(spark):
    df = _skewed(spark).withColumn("seq", F.col("id").cast("int"))
    lasts = {"last_v": F.col("v")}
    sums = {"sum_v": F.col("v")}
    a = plain_scan(df, ["g"], "seq", lasts, sums)
    b = pieced_scan(df, ["g"], "seq", lasts, sums, piece_cols=["g"], pieces=7, checkpoint=False)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_pieces_follow_wall_clock_in_any_time_zone(spark):
    """Timestamps without time zone inside a daylight-saving gap keep their
    order in the pieced path, whatever the session time zone."""
    from datetime import datetime, timedelta
    t0 = datetime(2024, 3, 10, 1, 0)
    rows = [(0, i, t0 + timedelta(minutes=7 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "g long, id long, s timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    spark.conf.set("branchdata.hotGroupRows", "10")
    try:
        got = number_rows(df, ["g"], ["s", "id"], "rn")
        want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("s", "id")).cast("int"))
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
        spark.conf.unset("branchdata.hotGroupRows")


def test_constant_first_order_column_is_cut_on_the_second(spark):
    """A hot group whose timestamps are all equal is still numbered exactly
    (pieces then come from the second order column)."""
    from datetime import datetime
    rows = [(0, i, datetime(2024, 1, 1)) for i in range(500)] + [(1, i, datetime(2024, 1, 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "g long, id long, s timestamp_ntz")
    spark.conf.set("branchdata.hotGroupRows", "100")
    try:
        got = number_rows(df, ["g"], ["s", "id"], "rn")
        plan = got._jdf.queryExecution().analyzed().toString()
        assert "_cuts2" in plan
        want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("s", "id")).cast("int"))
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    finally:
        spark.conf.unset("branchdata.hotGroupRows")
