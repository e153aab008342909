"""Places and percentiles in slices, against the same by hand; which plans shuffle the index."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vecmill import catalogue
from vecmill.functions import ranks
from vecmill.operators import index as ivf
from vecmill.operators import knn, maintenance, probing


def table(spark):
    """A group with most rows, a null group, a group of one, many equal values and nulls."""
    rng = np.random.default_rng(2)
    groups = ["hot"] * 700 + [None] * 90 + ["few"] * 9 + ["one"]
    rows = [(g, None if rng.random() < 0.05 else float(rng.choice([0.0, 0.0, 1.5, rng.normal()])), i) for i, g in enumerate(groups)]
    return rows, spark.createDataFrame(rows, "g string, x double, i long").repartition(6)


@pytest.mark.parametrize("size", [200_000, 60, 7])
def test_places_in_slices(spark, size, monkeypatch):
    monkeypatch.setattr(ranks, "SLICE_ROWS", size)
    rows, df = table(spark)
    found = {r["i"]: r for r in ranks.numbered(df, ["g"], ["x", "i"]).collect()}
    assert len(found) == len(rows)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [found[i]["place"] for _, _, i in own] == list(range(len(own))) and {found[i]["total"] for _, _, i in own} == {len(own)}


@pytest.mark.parametrize("size", [200_000, 60, 7])
def test_percentiles_in_slices(spark, size, monkeypatch):
    monkeypatch.setattr(ranks, "SLICE_ROWS", size)
    rows, df = table(spark)
    at = {"low": 0.0, "p5": 0.05, "p50": 0.5, "p99": 0.99, "high": 1.0}
    found = {r["g"]: r for r in ranks.percentiles(df, ["g"], "x", at).collect()}
    for g, r in found.items():
        x = [v for h, v, _ in rows if h == g and v is not None]
        assert np.allclose([r[n] for n in at], np.quantile(x, list(at.values())), rtol=0, atol=1e-12)
    whole = ranks.percentiles(df, [], "x", at).first()
    assert np.allclose(list(whole), np.quantile([v for _, v, _ in rows if v is not None], list(at.values())), rtol=0, atol=1e-12)
    assert ranks.percentiles(df.where("x is null"), ["g"], "x", at).count() == 0


def test_parts_are_those_of_ntile(spark):
    from pyspark.sql.window import Window

    for n in (1, 5, 12, 13, 37):
        t = spark.range(n).select("id", (F.ntile(12).over(Window.orderBy("id")).cast("long") == ranks.part_of(F.col("id"), F.lit(n), 12)).alias("same"))
        assert t.where("not same").isEmpty()


def test_a_hot_partition_is_numbered_in_slices(spark, monkeypatch):
    v = catalogue.vectors(spark, SMALL)
    postings = v.select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).cast("long").alias("cluster"), "vec")
    wanted = sorted(map(tuple, ivf.in_order(postings).select("id", "cluster", "pos", "n").collect()))
    monkeypatch.setattr(ranks, "SLICE_ROWS", 20)
    assert sorted(map(tuple, ivf.in_order(postings).select("id", "cluster", "pos", "n").collect())) == wanted
    halved = maintenance.halves(postings).groupBy("cluster", "side").count().collect()
    n = {(r["cluster"], r["side"]): r["count"] for r in halved}
    assert all(n[c, 1] - n[c, 0] in (0, 1) for c in (0, 1))


def test_updates_and_repairs_leave_the_postings_where_they_are(spark):
    index, rest, _ = catalogue.half_indexed(spark, SMALL)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(maintenance.inserted(index, rest).postings).replace("BroadcastExchange", "")
    gone = maintenance.deleted(index, spark.range(30)).postings
    assert "Exchange hashpartitioning" not in plan(gone.select("vec", "id")) .split("BroadcastExchange")[0]
    big = catalogue.largest(index)
    for after in (maintenance.split(index, [big])[0], maintenance.repaired(index, [big]), maintenance.lire_split(index, [big])):
        assert "Exchange" not in plan(after.postings) and after.postings.count() == index.postings.count()


# ---------------------------------------------------------------- search in slices and with bounds
def plain_search(postings, centroids, q, k, nprobe):
    near = sorted(centroids, key=lambda c: (((np.array(centroids[c]) - q) ** 2).sum(), c))[:nprobe]
    return sorted((((np.array(r["vec"]) - q) ** 2).sum(), r["id"]) for r in postings if r["cluster"] in near)[:k]


@pytest.mark.parametrize("few", [2000, 4])
def test_probed_search_of_a_hot_partition(spark, few, monkeypatch):
    """Nine in ten members in one partition; queries sent to the members, or slices that meet blocks of queries."""
    monkeypatch.setattr(probing, "FEW", few)
    monkeypatch.setattr(probing, "SLICE", 15)
    monkeypatch.setattr(probing, "CHUNK", 7)
    v = catalogue.vectors(spark, SMALL).where("id < 200")
    centroids = {c: r["vec"] for c, r in enumerate(v.where("id in (3, 77, 120, 199)").collect())}
    postings = v.select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 4).otherwise(2).cast("long").alias("cluster"), "vec")
    index = ivf.Index(postings, centroids, ivf.IndexConfig(), 1e9, 0)
    q, rows = v.where("id % 20 = 1").select(F.col("id").alias("qid"), "vec"), postings.collect()
    found = ivf.search(q.union(spark.createDataFrame([(-1, None)], "qid long, vec array<double>")), index, 6, 2).collect()
    swept = ivf.sweep(q, index, 6, [1, 3]).collect()
    for r in q.collect():
        want = [i for _, i in plain_search(rows, centroids, np.array(r["vec"]), 6, 2)]
        assert [x["id"] for x in sorted(found, key=lambda x: x["rank"]) if x["qid"] == r["qid"]] == want
        for n in (1, 3):
            want = [i for _, i in plain_search(rows, centroids, np.array(r["vec"]), 6, n)]
            assert [x["id"] for x in sorted(swept, key=lambda x: x["rank"]) if (x["qid"], x["nprobe"]) == (r["qid"], n)] == want
    assert len({r["qid"] for r in found}) > 5 and -1 not in {r["qid"] for r in found}


def test_few_queries_leave_the_members_where_they_are(spark):
    index = ivf.build(catalogue.vectors(spark, SMALL), ivf.IndexConfig())
    asked = spark.createDataFrame([(0, 3, 0), (50, 5, 0)], "qid long, cluster long, level long")
    found = probing.among(asked, catalogue.asked(spark, SMALL), index.postings, dict, 4, "l2")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert probing.among(asked.limit(0), catalogue.asked(spark, SMALL), index.postings, dict, 4, "l2").count() == 0


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_bounds_exclude_partitions_and_lose_no_neighbour(spark, metric):
    rng = np.random.default_rng(9)
    centres = 20 * rng.normal(size=(20, 6))
    x = np.vstack([centres[rng.integers(0, 20, 600)] + rng.normal(size=(600, 6)), np.repeat(centres[:1], 30, 0)])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>").repartition(5)
    q = v.where("id % 9 = 0").select((F.col("id") + 10_000).alias("qid"), F.transform("vec", lambda a: a + 0.25).alias("vec"))
    index = ivf.build(v, ivf.IndexConfig(nlist=20, metric=metric, seeding="spread"))
    for k in (5, 700):
        found, asked = ivf.bounded(q, index, k)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, knn.exact(q, v, k, metric).collect()))
        met = asked.join(index.sizes(), "cluster").agg(F.sum("n")).first()[0]
        assert met < (0.35 if k == 5 else 1.01) * q.count() * v.count()
    nothing = index.changed(gone=v.select("id"))
    assert ivf.bounded(q, nothing, 3)[0].count() == 0
