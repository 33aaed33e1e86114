"""The append-only history store: batches committed once, current state by key."""

import pytest
from pyspark.sql import functions as F

from branchdata.sources.history_store import HistoryStore


def test_batches_and_current_state(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"))
    assert store.rows("branches") is None and store.current("tags") is None
    first = spark.createDataFrame([(1, "a"), (2, "b")], "branch_id long, status string")
    second = spark.createDataFrame([(2, "merged", "x"), (3, "c", None)], "branch_id long, status string, note string")
    assert store.append("branches", first, "one") and store.append("branches", second, "two")
    assert not store.append("branches", first.withColumn("status", F.lit("zz")), "one")      # sent again: nothing changes
    assert sorted(map(tuple, store.current("branches").select("branch_id", "status", "note").collect())) == [
        (1, "a", None), (2, "merged", "x"), (3, "c", None)]
    assert store.rows("branches").count() == 4
    changes = spark.createDataFrame([(1, 1), (1, 1)], "branch_id long, sequence int")
    store.append("changes", changes, "b")
    assert store.current("changes").count() == 2                                             # events have no key


def test_unfinished_batch_is_not_seen(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"))
    rows = spark.createDataFrame([(1, "t", 5)], "branch_id long, tag string, tag_sequence int")
    rows.write.parquet(str(tmp_path / "h" / "tags" / "batches" / "lost"))                    # written, never committed
    assert store.rows("tags") is None
    assert store.append("tags", rows, "lost") and store.current("tags").count() == 1
    with pytest.raises(ValueError):
        store.append("nothing", rows, "x")
    with pytest.raises(ValueError):
        store.append("tags", rows, "../x")
