"""Versions of an index in layers: what they hold, what they write, and what a writer that stopped leaves."""

from __future__ import annotations

import os

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vecmill import catalogue
from vecmill.operators import layers, maintenance
from vecmill.operators.index import Index, IndexConfig, build
from vecmill.streaming import workload


def where(index):
    return sorted((r["id"], r["cluster"]) for r in index.postings.select("id", "cluster").collect())


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    v = catalogue.vectors(spark, SMALL)
    path = str(tmp_path)
    index = build(v.where("id >= 20"), IndexConfig())
    held = layers.save(index, path, 0)
    first = size(f"{path}/layers")
    now, plain = layers.load(spark, path, 0)[0], index
    for number, ids in enumerate(((0, 6), (6, 12), (12, 20)), 1):
        batch, gone = v.where(F.col("id").between(ids[0], ids[1] - 1)), v.where(F.col("id").isin(50 + number, 4 * number)).select("id")
        before = size(f"{path}/layers")
        held = layers.save(maintenance.deleted(maintenance.inserted(now, batch), gone), path, number, held)
        assert 0 < size(f"{path}/layers") - before < first / 8
        now, again = layers.load(spark, path, number)
        plain = maintenance.deleted(maintenance.inserted(plain, batch), gone)
        assert again == held and where(now) == where(plain)
    assert len(held) == 7 and (now.centroids, now.split_above) == (index.centroids, index.split_above)
    # an id that comes back after it has gone; unknown and null ids
    back = layers.save(maintenance.inserted(maintenance.deleted(now, spark.createDataFrame([(4,), (None,), (10**9,)], "id long")), v.where("id = 4")), path, 9, held)
    assert len(back) == 1  # nine layers would be too many: all anew
    assert where(layers.load(spark, path, 9)[0]) == sorted({*where(plain), *((r["id"], r["cluster"]) for r in maintenance.inserted(plain, v.where("id = 4")).postings.where("id = 4").collect())})


@pytest.mark.parametrize("name", ["lire", "scdkm", "memonly"])
def test_splits_and_merges_write_the_partitions_that_they_touch(spark, tmp_path, name):
    index, rest, n = catalogue.half_indexed(spark, SMALL)
    index = Index(index.postings, index.centroids, index.config, 20, 9)
    path = str(tmp_path)
    held = layers.save(index, path, 0)
    now = layers.load(spark, path, 0)[0]
    gone = rest.where("place < 5").select("id")
    after = maintenance.policy(name)(now, rest.where("place < 60"), gone)
    wanted = where(maintenance.policy(name)(index, rest.where("place < 60"), gone))
    held = layers.save(after, path, 1, held)
    read, _ = layers.load(spark, path, 1)
    assert where(read) == wanted and read.counters.get("splits", 0) >= 1 and read.centroids.keys() == after.centroids.keys()
    assert len({i for i, _ in wanted}) == len(wanted) == index.postings.count() + 55


def test_a_writer_that_stopped_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    index, rest, _ = catalogue.half_indexed(spark, SMALL)
    held = layers.save(index, path, 0)
    now = layers.load(spark, path, 0)[0]
    wrote = layers._write

    def stops(*a):
        wrote(*a)
        raise RuntimeError("stopped")

    monkeypatch.setattr(layers, "_write", stops)
    for step in (lambda: layers.compacted(spark, path, 0, 1), lambda: layers.save(maintenance.inserted(now, rest), path, 1, held)):
        with pytest.raises(RuntimeError, match="stopped"):
            step()
        assert layers.load(spark, path, 1) is None and where(layers.load(spark, path, 0)[0]) == where(index)
    monkeypatch.setattr(layers, "_write", wrote)
    os.makedirs(f"{path}/versions/1")  # begun, not ended
    assert layers.load(spark, path, 1) is None and where(workload.latest(spark, path, index.config)) == where(index)
    layers.save(maintenance.inserted(now, rest.where("place < 9")), path, 1, held)
    layers.compacted(spark, path, 1, 2)
    last, of = layers.load(spark, path, 2)
    assert len(of) == 1 and where(last) == where(maintenance.inserted(index, rest.where("place < 9")))
    assert layers.vacuum(spark, path, 2) == 4 and where(layers.load(spark, path, 2)[0]) == where(last)
    assert sorted(os.listdir(f"{path}/layers")) == [of[0].name]


def test_an_index_without_members(spark, tmp_path):
    index, _, _ = catalogue.half_indexed(spark, SMALL)
    path = str(tmp_path)
    held = layers.save(index, path, 0)
    now = layers.load(spark, path, 0)[0]
    layers.save(maintenance.deleted(now, now.postings.select("id")), path, 1, held)
    empty, _ = layers.load(spark, path, 1)
    assert empty.postings.count() == 0 and empty.centroids == index.centroids
