"""Seeds far from each other, and inserts one by one against a plain replay."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vecmill import catalogue
from vecmill.operators import kmeans, knn, maintenance, serial
from vecmill.operators.index import Index, IndexConfig, build

VECTORS = "id long, vec array<double>"


# ---------------------------------------------------------------- seeds
def test_seeds_lie_apart_and_lower_the_error(spark):
    rng = np.random.default_rng(6)
    centres = 10 * rng.normal(size=(12, 8))
    x = centres[np.sort(rng.choice(12, 900, p=[0.45] + [0.05] * 11))] + 0.1 * rng.normal(size=(900, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], VECTORS).repartition(7)
    start = kmeans.seeds(v, 12)
    assert start == kmeans.seeds(v.repartition(3), 12) and len(start) == 12
    reached = {int(((centres - np.array(c)) ** 2).sum(1).argmin()) for c in start.values()}
    assert len(reached) >= 11
    error = lambda seeds: kmeans.sse(knn.nearest(v, kmeans.lloyd(v, seeds, 3))).first()[0]
    assert error(start) < 0.2 * error(kmeans.first_seeds(v, 12))
    index = build(v, IndexConfig(nlist=12, seeding="spread"))
    assert len(index.centroids) == 12 and index.postings.count() == 900


def test_seeds_of_few_and_equal_vectors(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(60)] + [(100, None), (None, [9.0, 9.0])]
    v = spark.createDataFrame(rows, VECTORS)
    assert sorted(kmeans.seeds(v, 8).values()) == [[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]]
    assert kmeans.seeds(v.where("id < 0"), 8) == {} and len(kmeans.seeds(v, 2)) == 2
    with pytest.raises(ValueError):
        IndexConfig(seeding="random")


# ---------------------------------------------------------------- inserts one by one
def replay(index: Index, x: np.ndarray, ids: list[int], above: float | None = None) -> tuple[dict[int, int], int]:
    """Where each vector goes, in plain loops, up to and with the first that takes a partition above a bound."""
    held = kmeans.whole_sums(index.postings)
    n = {c: held.get(c, (0, None))[0] for c in index.centroids}
    sums = {c: list(held[c][1]) if c in held else [0] * x.shape[1] for c in index.centroids}
    cents = {c: list(v) for c, v in index.centroids.items()}
    out = {}
    for i, v in zip(ids, x.tolist(), strict=True):
        far = {c: -sum(a * b for a, b in zip(v, w, strict=True)) if index.config.metric == "ip" else sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) for c, w in cents.items()}
        c = min(sorted(far), key=lambda k: far[k])
        n[c] += 1
        sums[c] = [s + int(np.floor(a * 1e9 + 0.5)) for s, a in zip(sums[c], v, strict=True)]
        cents[c] = [s / 1e9 / n[c] for s in sums[c]]
        out[i] = c
        if above is not None and n[c] > above and n[c] >= 4:
            break
    return out, cents


@pytest.mark.parametrize(("metric", "block"), [("l2", 1024), ("l2", 16), ("ip", 11)])
def test_a_stream_one_by_one_equals_a_replay(spark, monkeypatch, metric, block):
    monkeypatch.setattr(serial, "BLOCK", block)
    monkeypatch.setattr(serial, "PER_PARTITION", 0)
    rng = np.random.default_rng(3)
    # coordinates of quarters: ties between centroids are exact; later vectors drift, so that partitions move
    base = [(i, (rng.integers(-4, 5, 4) / 4).tolist()) for i in range(40)]
    index = build(spark.createDataFrame(base, VECTORS), IndexConfig(nlist=5, rounds=1, metric=metric))
    index = Index(index.postings, {**index.centroids, 9: [0.25, 0.0, 0.0, 0.0], 11: [0.25, 0.0, 0.0, 0.0]}, index.config, 1e9, 0)
    x = rng.integers(-4, 5, (150, 4)) / 4 + (np.arange(150) // 30)[:, None] / 4
    stream = spark.createDataFrame([(int(149 - i), 1000 + i, v.tolist()) for i, v in enumerate(x)] + [(7, 5000, None)], "seq long, id long, vec array<double>").repartition(5)
    wanted, cents = replay(index, x[::-1], [1000 + i for i in reversed(range(150))])
    after = serial.one_by_one(index, stream)
    got = {r["id"]: r["cluster"] for r in after.postings.where("id >= 1000").collect()}
    assert got == wanted and after.counters["inserts"] == 150
    assert all(np.allclose(after.centroids[c], cents[c], rtol=1e-12, atol=1e-12) for c in cents)
    assert after.counters["waves"] <= (1 if block == 1024 else -(-150 // block)) + 1
    assert after.postings.count() == 190
    # not what centroids that stay give
    assert got != {r["id"]: r["cluster"] for r in maintenance.inserted(index, stream.where("vec is not null")).postings.where("id >= 1000").collect()}


def test_waves_are_few_on_the_shipped_table(spark, monkeypatch):
    monkeypatch.setattr(serial, "BLOCK", 10)
    monkeypatch.setattr(serial, "PER_PARTITION", 0)
    index, rest, n = catalogue.half_indexed(spark, SMALL)
    after = serial.one_by_one(index, rest.withColumn("seq", F.col("id")))
    assert after.counters["inserts"] == n and after.counters["waves"] <= 12  # of 25 blocks
    assert serial.one_by_one(index, rest.where("id < 0").withColumn("seq", F.col("id"))).counters == {}


def test_splits_happen_at_the_insert_that_causes_them(spark, monkeypatch):
    monkeypatch.setattr(serial, "BLOCK", 8)
    monkeypatch.setattr(serial, "PER_PARTITION", 0)
    index, rest, n = catalogue.half_indexed(spark, SMALL)
    above = max(r["n"] for r in index.sizes().collect())
    index = Index(index.postings, index.centroids, index.config, above, 0)
    stream = rest.where("place < 24").withColumn("seq", F.col("id"))
    after = serial.one_by_one(index, stream, serial.split_at_once)
    rows = stream.orderBy("id").collect()
    x, ids = np.array([r["vec"] for r in rows]), [r["id"] for r in rows]
    plain, done, splits = index, 0, 0
    while done < len(ids):
        where, cents = replay(plain, x[done:], ids[done:], above)
        fresh = spark.createDataFrame([(i, c, x[ids.index(i)].tolist()) for i, c in where.items()], "id long, cluster long, vec array<double>")
        grown = plain.changed(fresh)
        plain = Index(grown.postings, cents, plain.config, above, 0)
        full = [r["cluster"] for r in plain.sizes().where(F.col("n") > above).collect() if r["cluster"] in set(where.values())]
        done += len(where)
        if full:
            plain = maintenance.split(plain, full)[0]
            splits += 1
    assert after.counters.get("splits", 0) == splits >= 1
    assert sorted(map(tuple, after.postings.select("id", "cluster").collect())) == sorted(map(tuple, plain.postings.select("id", "cluster").collect()))


def test_sums_that_would_overflow_are_refused(spark):
    index = build(spark.createDataFrame([(i, [float(i), 0.0]) for i in range(8)], VECTORS), IndexConfig(nlist=2))
    with pytest.raises(ValueError, match="too large"):
        serial.one_by_one(index, spark.createDataFrame([(1, 100, [1e12, 0.0])], "seq long, id long, vec array<double>"))
