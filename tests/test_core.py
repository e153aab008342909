"""Odd rows and large values in the core, and every source and sink."""

from __future__ import annotations

import io
import json
import tarfile

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vecmill import catalogue
from vecmill.functions import arrow
from vecmill.operators import kmeans, knn, probing, quality
from vecmill.operators.index import IndexConfig, build, read, search, write
from vecmill.plans import reports
from vecmill.sources import vectors as sources

VECTORS = "id long, vec array<double>"


def test_sums_of_large_values(spark):
    rows = [(1, [1e7, -2e10, 0.25])] * 2000 + [(2, [3e13, 1e-9, -0.5])] * 3
    got = {r["cluster"]: (r["n"], r["a"]) for r in kmeans.statistics(spark.createDataFrame(rows, "cluster long, vec array<double>")).collect()}
    assert got[1] == (2000, [2e10, -4e13, 500.0]) and got[2][0] == 3
    assert np.allclose(got[2][1], [9e13, 3e-9, -1.5], rtol=1e-15, atol=0)


def test_null_and_ragged_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [3.0, 0.0]), (4, None)], VECTORS)
    q = v.select(F.col("id").alias("qid"), "vec")
    assert [tuple(r) for r in knn.nearest(v, {0: [0.0, 0.0], 1: [3.0, 0.0]}).select("id", "cluster").orderBy("id").collect()] == [(1, 0), (3, 1)]
    assert sorted((r["qid"], r["id"]) for r in knn.exact(q, v, 5).collect()) == [(1, 1), (1, 3), (3, 1), (3, 3)]
    index = build(v, IndexConfig(nlist=2))
    assert sorted(r["id"] for r in index.postings.collect()) == [1, 3] and search(q, index, 5, 2).count() == 4
    ragged = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0]), (3, [1.0, 2.0, 3.0])], VECTORS).coalesce(1)
    with pytest.raises(Exception, match="unlike lengths"):
        knn.nearest(ragged, {0: [0.0, 0.0]}).collect()
    empty = v.where("id < 0")
    assert knn.exact(q, empty, 3).count() == 0 and knn.exact(q.where("qid < 0"), v, 3).count() == 0


def test_a_scan_and_blocks_give_the_same_neighbours(spark, monkeypatch):
    v = catalogue.vectors(spark, SMALL)
    v = v.union(v.select(F.col("id") + 10_000, "vec"))  # ties
    q = v.select(F.col("id").alias("qid"), "vec")
    one = lambda: sorted((r["qid"], r["rank"], r["id"]) for r in knn.exact(q, v, 4, exclude_self=True).collect())
    scanned = one()
    monkeypatch.setattr(knn, "QUERY_BLOCK", 300)
    monkeypatch.setattr(knn, "BASE_BLOCK", 200)
    assert scanned == one() and len(scanned) == 4 * q.count()
    for queries, base, chunk in ((150, 77, 13), (7, 90, 50)):
        monkeypatch.setattr(knn, "QUERY_BLOCK", queries)
        monkeypatch.setattr(knn, "BASE_BLOCK", base)
        monkeypatch.setattr(knn, "CHUNK", chunk)
        some = q.where("qid % 10 = 3") if queries == 7 else q
        asked = {r["qid"] for r in some.collect()}
        assert [r for r in scanned if r[0] in asked] == sorted((r["qid"], r["rank"], r["id"]) for r in knn.exact(some, v, 4, exclude_self=True).collect())


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_rows_that_are_nearest_against_all_pairs(metric):
    """Ties between ids, thousands of equal rows, more wanted than there are: as all pairs ranked by (distance, id)."""
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 24)), rng.normal(size=(300, 24))
    for base in (np.vstack([y, y, y[:90]]), np.vstack([y, np.repeat(x[:1], 3000, 0)]), y[:3], np.zeros((50, 24))):
        ids = rng.permutation(len(base))
        d = np.array([arrow.paired(np.repeat(a[None], len(base), 0), base, metric) for a in x])
        order = np.lexsort((np.broadcast_to(ids, d.shape), d))[:, :7]
        for some in (x, x[:1]):
            got, near = arrow.nearest(some, base, ids, 7, metric)
            assert (near == ids[order][: len(some)]).all() and (got == np.take_along_axis(d, order, 1)[: len(some)]).all()


def test_ties_between_centroids_and_a_lone_one(spark):
    m = np.random.default_rng(1).normal(size=(500, 48))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], VECTORS).repartition(7)
    twins = {c: m[c % 20].tolist() for c in range(60)}
    assert all(r["cluster"] < 20 and r["cluster2"] == r["cluster"] + 20 and r["distance"] == r["distance2"] for r in knn.nearest(v, twins, second=True).collect())
    assert {(r["cluster"], r["cluster2"]) for r in knn.nearest(v, {5: m[0].tolist()}, second=True).collect()} == {(5, None)}


def test_few_queries_leave_the_base_where_it_is(spark):
    plan = knn._scanned([], catalogue.vectors(spark, SMALL), 3, "l2", False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_npy_and_records(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "m.npy", m)
    got = sources.read(spark, str(tmp_path / "m.npy"), "npy", most=3).orderBy("id").collect()
    assert [(r["id"], r["vec"]) for r in got] == [(i, m[i].tolist()) for i in range(3)]
    with pytest.raises(ValueError):
        sources.read(spark, "x", "hdf5")
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name, body in (("a.bin", m.tobytes()), ("odd.bin", b"12345"), ("a.txt", m.tobytes())):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    rows = sources.records(spark, str(tmp_path / "a.tar"), 3).orderBy("place").collect()
    assert [(r["member"], r["place"], r["vec"]) for r in rows] == [("a.bin", i, m[i].tolist()) for i in range(4)]


def test_datasets_and_results(spark, tmp_path):
    v = catalogue.vectors(spark, SMALL)
    train, queries = sources.train_and_queries(v, 100, 5)
    truth = sources.truth(train, queries, None, 3)
    assert train.count() == 100 and [r["qid"] for r in queries.orderBy("qid").collect()] == [0, 1, 2, 3, 4]
    assert sources.truth(train, queries, truth, 3).exceptAll(truth).isEmpty()
    assert sources.truth(train.where("id < 50"), queries, truth, 3).where("id >= 50").isEmpty()
    at = str(tmp_path / "set")
    sources.write_dataset(train, queries, truth, at)
    sources.write_dataset(train.limit(1), queries, truth, at)
    assert spark.read.parquet(f"{at}/train").count() == 100
    sources.write_dataset(train.limit(1), queries, truth, at, overwrite=True)
    assert spark.read.parquet(f"{at}/train").count() == 1
    table = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "method string, recall double")
    sources.write_report(table, str(tmp_path / "csv"))
    sources.write_report(table, str(tmp_path / "json"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2 == spark.read.json(str(tmp_path / "json")).count()
    for name, rows in (("one.json", [{"method": "a", "x": 1}, {"method": "b", "x": 2}]), ("two.json", [{"method": "b", "x": 3}])):
        (tmp_path / name).write_text(json.dumps(rows))
    got = sources.read_results(spark, [str(tmp_path / "one.json"), str(tmp_path / "two.json")], ["method"]).collect()
    assert {r["method"]: r["x"] for r in got} == {"a": 1, "b": 3}
    more = spark.createDataFrame([("b", 9.0), ("c", 3.5)], "method string, recall double")
    assert {r["method"]: r["recall"] for r in reports.appended(table, more, ["method"]).collect()} == {"a": 1.5, "b": 2.5, "c": 3.5}
    assert tuple(table.agg(*quality.distribution("recall")).first()) == (1.5, 1.75, 2.0, 2.25, 2.4, 2.5)


def test_an_index_read_back_answers_alike(spark, tmp_path):
    v, q = catalogue.vectors(spark, SMALL), catalogue.asked(spark, SMALL)
    index = build(v, IndexConfig()).counted(splits=2)
    write(index, str(tmp_path / "index"))
    again = read(spark, str(tmp_path / "index"))
    assert again.counters == {"splits": 2} and again.split_above == index.split_above
    assert search(q, again, 5, 4).exceptAll(search(q, index, 5, 4)).isEmpty()


def test_known_neighbours_bound_the_next(monkeypatch):
    """Blocks that come after others look only for what is nearer, ties and copies included; chunks of any size give the same."""
    rng = np.random.default_rng(1)
    for n, nq, k, metric, chunk in ((900, 60, 10, "l2", 100), (900, 250, 7, "ip", 64), (30, 5, 40, "ip", 8), (400, 20, 1, "l2", 1000)):
        monkeypatch.setattr(knn, "CHUNK", chunk)
        monkeypatch.setattr(probing, "CHUNK", chunk)
        base, q = rng.normal(size=(n, 3)).round(1), rng.normal(size=(nq, 3)).round(1)
        base[rng.integers(0, n, n // 3)] = base[0]
        ids, rows = rng.permutation(n) * 3, np.arange(nq)
        exact, probed = knn._Best(q, k, metric), probing.Best(nq, k)
        for own in np.split(np.arange(n), [n // 3]):
            exact.add(ids[own], base[own])
            probed.add(rows, q, ids[own], base[own], metric)
        for i in range(nq):
            d = arrow.paired(np.broadcast_to(q[i], base.shape), base, metric)
            near = np.lexsort((ids, d))[:k]
            m = len(near)
            for best in (exact, probed):
                assert (best.ids[i, :m] == ids[near]).all() and (best.d[i, :m] == d[near]).all()


def test_blocks_of_queries_grow_with_the_slices(spark):
    """Every slice is sent to each block of queries: 31 blocks of 2,000 queries are too many where 31 slices make meetings enough."""
    assert arrow.blocks(61_500, 31, 2_000, 20_000, 96) == 4 and arrow.blocks(5_128, 3, 2_000, 20_000, 96) == 3
    assert arrow.blocks(10**6, 1000, 2_000, 20_000, 96) == 50 and arrow.blocks(0, 0, 2_000, 20_000, 96) == 1
    plan = catalogue.queries()["boundary_vs_random"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan  # the neighbours are searched once, not again for each use
