"""Keyed resume: stopped, killed and restarted loads hold each row once; live
counts survive a batch that runs twice."""

import random

import pytest
from pyspark.sql import functions as F

from branchdata.sources.store import BranchStore
from branchdata.streaming import keyed as KL
from branchdata.streaming import loads as SL
from conftest import SF001


def _load(store, rows, key, **kw):
    return KL.KeyedLoad(store, "b", "t", rows, key, rows_per_page=kw.pop("rows_per_page", 7), pages_per_batch=2, **kw)


def _same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("key", [("name",), ("grp", "name"), ("grp", "no"), ("day", "name")])
def test_stop_and_go_on(spark, tmp_path, key):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i % 3, i, f"n{rng.randrange(40):03d}é", f"x{i}") for i in range(120)],
                                 "grp int, no int, name string, note string")
    rows = rows.withColumn("day", F.expr("date'2024-01-01' + cast(no / 30 as int)"))       # names repeat: keys needn't be unique
    store = BranchStore(spark, str(tmp_path / "s"))
    load = _load(store, rows, key, masks={"t.note": "-"})
    assert load.cursor() is None and load.run(max_batches=2) == "paused"
    at = load.cursor()
    assert store.events().orderBy(F.desc("seq")).first()["status"] == "paused" and at is not None
    with pytest.raises(FileNotFoundError):
        store.read("b", "t")                                   # nothing to see before it is whole
    again = _load(store, rows, key, masks={"t.note": "-"})
    assert again.run(max_batches=1) == "paused" and again.cursor() >= at
    assert again.run() == "ready" and again.run() == "ready"
    _same(store.read("b", "t"), rows.withColumn("note", F.lit("-")))


def test_killed_between_write_and_commit(spark, tmp_path, monkeypatch):
    rows = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    store = BranchStore(spark, str(tmp_path / "s"))
    load, batch, calls = _load(store, rows, ("k",)), KL.KeyedLoad._batch, []

    def fails_after_write(self, first, last):
        calls.append(first)
        if len(calls) == 3:
            batch(self, first, last).write.parquet(f"{self.target}/pages_{first:09d}_{last:09d}")
            raise RuntimeError("lost")
        return batch(self, first, last)
    monkeypatch.setattr(KL.KeyedLoad, "_batch", fails_after_write)
    with pytest.raises(Exception):
        load.run()
    assert store.events().where("status = 'failed'").count() == 1
    assert load.run() == "ready"
    assert calls[2] == calls[3]                                  # the lost batch ran again, in the same folder
    _same(store.read("b", "t"), rows)


def test_null_key_and_empty_table(spark, tmp_path):
    store = BranchStore(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="NULL"):
        _load(store, spark.createDataFrame([(1, 1), (None, 2)], "k int, v int"), ("k",)).run()
    none = spark.createDataFrame([], "k int, v int")
    assert _load(store, none, ("k",), name="empty").run() == "ready"
    assert store.read("b", "t").count() == 0


def test_live_counts_after_a_lost_batch(spark, tmp_path, monkeypatch):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ev.repartition(6).write.parquet(src)
    counts, lost = SL.live_counts, []

    def lose_once(*a):
        if not lost:                                             # after the batch's counts were written
            lost.append(1)
            raise RuntimeError("lost")
        return counts(*a)
    monkeypatch.setattr(SL, "live_counts", lose_once)
    run = dict(watermark="30 days", files_per_batch=1, merge_every=2)
    with pytest.raises(Exception):
        SL.activity_counts(spark, src, ev.schema, out, str(tmp_path / "c"), **run)
    between = counts(spark, out)                                 # a reader between the runs
    assert 0 < between.agg(F.sum("events")).first()[0] < ev.count()
    SL.activity_counts(spark, src, ev.schema, out, str(tmp_path / "c"), **run)
    _same(counts(spark, out), ev.groupBy(F.col("user_id").alias("branch_id"), "event_type").agg(F.count(F.lit(1)).alias("events")))
    assert counts(spark, str(tmp_path / "nothing")).count() == 0
