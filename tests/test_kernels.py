"""The order-dependent kernels and the index's upkeep: invariants, and plain sums."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vecmill import catalogue
from vecmill.operators import kernels, knn, maintenance, quality
from vecmill.operators.index import Index, IndexConfig, build, search
from vecmill.plans import reports
from vecmill.streaming import workload


def objective(x, at):
    return sum(float((x[at == c].sum(0) ** 2).sum()) / (at == c).sum() for c in np.unique(at))


@pytest.mark.parametrize("seed", range(6))
def test_descent_never_lowers_the_objective(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 5)) + 3 * rng.integers(0, 3, (40, 1))
    side = (np.arange(40) >= 20).astype(int)
    last = objective(x, side)
    for passes in range(1, 5):
        now = objective(x, kernels.local(x, side, 2, passes))
        assert now >= last - 1e-9
        last = now
    for to in (kernels.two_way(x, side), kernels.two_means(x, side, 10)):
        assert set(to) == {0, 1} and objective(x, to) >= objective(x, side) - 1e-9
    three = rng.integers(0, 3, 40)
    assert objective(x, kernels.local(x, three, 3)) >= objective(x, three) - 1e-9


def test_ghosts_and_adoption():
    x = np.array([[0.0, 0], [1, 0], [9, 0], [10, 0]])
    side = np.array([0, 1, 0, 1])
    assert kernels.two_way(x, side).tolist() == kernels.two_way(x, side, ghosts=np.zeros((0, 2))).tolist()
    assert set(kernels.two_way(x, side, ghosts=np.array([[0.5, 0], [9.5, 0]]))) <= {0, 1}
    at = kernels.adopting(np.vstack([x, [[9.5, 0], [0.2, 0]]]), np.array([0, 0, 1, 1, 2, 2]))
    assert at[4] == 1 and set(at[:4]) <= {0, 1}
    same = np.ones((6, 3))
    assert len(kernels.two_means(same, np.array([0, 0, 0, 1, 1, 1]), 5)) == 6


def toy(spark, vectors, cluster, centroids, **config):
    rows = [(i, c, 0, [float(a) for a in v]) for i, (v, c) in enumerate(zip(vectors, cluster, strict=True))]
    postings = spark.createDataFrame(rows, "id long, cluster long, pos long, vec array<double>")
    return Index(postings, centroids, IndexConfig(**config), 1e9, 0)


def test_violations_of_a_toy_index(spark):
    index = toy(spark, [(0.1, 0), (9.9, 0)], [0, 0], {0: [0.0, 0.0], 1: [10.0, 0.0]})
    assert tuple(quality.violations(index).first()) == (2, 1, 0.5)


def test_full_probe_finds_everything_and_recall_rises(spark):
    v, q = catalogue.vectors(spark, SMALL), catalogue.asked(spark, SMALL)
    index = build(v, IndexConfig())
    truth = knn.exact(q, v, 10)
    at = [quality.recall(search(q, index, 10, p), truth, 10).agg(F.avg("recall")).first()[0] for p in (1, 4, 16)]
    assert at == sorted(at) and at[-1] == 1.0


@pytest.mark.parametrize("name", ["Frozen", "LIRE", "SPFresh", "Mem-only", "update_centroids", "Local-CDKM"])
def test_policies_keep_every_live_vector_once(spark, name):
    index, rest, _ = catalogue.half_indexed(spark, SMALL)
    index = Index(index.postings, index.centroids, index.config, 25, 8)
    gone = rest.where("place < 20").select("id")
    after = maintenance.policy(name)(index, rest, gone)
    ids = [r["id"] for r in after.postings.select("id").collect()]
    assert sorted(ids) == sorted(r["id"] for r in catalogue.vectors(spark, SMALL).join(gone, "id", "left_anti").select("id").collect())
    assert {r["cluster"] for r in after.sizes().collect()} <= set(after.centroids)


def members(spark, groups):
    rows = [(1000 * g + i, g, 0, i, at, [float(a) for a in v]) for g, (x, side) in groups.items() for i, (v, at) in enumerate(zip(x, side.tolist(), strict=True))]
    return spark.createDataFrame(rows, "id long, grp long, first long, pos long, place long, vec array<double>")


def test_blocks_of_large_groups_raise_their_worth_and_keep_their_members(spark, monkeypatch):
    """Groups of one block and of several together: passes of whole groups, or none that lowers what is sought."""
    rng = np.random.default_rng(3)
    groups = {g: (rng.normal(size=(n, 4)) + 6 * (np.arange(n) % 2)[:, None], (np.arange(n) >= n // 2).astype(int)) for g, n in ((1, 30), (2, 170))}
    one = {r["id"]: r["place"] for r in maintenance.improved(members(spark, groups), kernels.two_way, 2, 5).collect()}
    monkeypatch.setattr(maintenance, "BLOCK", 40)
    for kernel, passes in ((kernels.two_way, 5), (kernels.two_means, 10)):
        found = {r["id"]: r["place"] for r in maintenance.improved(members(spark, groups), kernel, 2, passes).collect()}
        assert set(found) == set(one)
        for g, (x, side) in groups.items():
            at = np.array([found[1000 * g + i] for i in range(len(x))])
            assert objective(x, at) >= objective(x, side)
            assert objective(x, at) == pytest.approx(objective(x, kernel(x, side, passes)), rel=1e-3)
    x, side = groups[1]  # a group of one block isn't touched by the others' blocks
    assert [one[1000 + i] for i in range(30)] == kernels.two_way(x, side).tolist()
    none = {r["id"]: r["place"] for r in maintenance.improved(members(spark, groups), kernels.two_way, 2, 0).collect()}
    assert all(none[1000 * g + i] == p for g, (_, s) in groups.items() for i, p in enumerate(s.tolist()))


def test_repairs_in_blocks_keep_every_vector_once(spark, monkeypatch):
    monkeypatch.setattr(maintenance, "BLOCK", 15)
    index = build(catalogue.vectors(spark, SMALL), IndexConfig(nlist=4))
    big = catalogue.largest(index)
    split, new = maintenance.split(index, [big])
    ids = sorted(r["id"] for r in index.postings.select("id").collect())
    repaired = [maintenance.local_repair(split, (big, new[big]), 2), maintenance.local_repair(split, (big, new[big]), 2, live_means=True)]
    for after in (*repaired, maintenance.boundary_split(index, big), maintenance.sampled_repair(index, big)):
        assert sorted(r["id"] for r in after.postings.select("id").collect()) == ids


def test_unknown_names(spark):
    with pytest.raises(ValueError):
        maintenance.policy("nothing")
    with pytest.raises(ValueError):
        IndexConfig(metric="cosine")


def test_stream_of_operations_equals_one_batch(spark, tmp_path):
    index, rest, _ = catalogue.half_indexed(spark, SMALL)
    ops = rest.select(F.col("place").alias("seq"), F.lit(0).alias("batch"), F.lit("insert").alias("op"), "id", "vec")
    ops.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(workload.OPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    wanted = sorted(map(tuple, maintenance.inserted(index, rest).postings.select("id", "cluster").collect()))
    for state in ("state", "lost"):  # the second run comes with the same batches again, and they change nothing
        workload.follow(stream, index, str(tmp_path / "versions"), str(tmp_path / state)).awaitTermination()
        last = workload.version(spark, str(tmp_path / "versions"), 2, index.config)
        assert sorted(map(tuple, last.postings.select("id", "cluster").collect())) == wanted
        assert (last.split_above, last.merge_below, last.centroids) == (index.split_above, index.merge_below, index.centroids)
    assert workload.version(spark, str(tmp_path / "versions"), 3, index.config) is None


def test_periods_of_upkeep(spark):
    index, rest, n = catalogue.half_indexed(spark, SMALL, IndexConfig(rebuild_every=n_ops(SMALL, spark) + 1))
    none = rest.where("place < 0").select("id")
    once = maintenance.policy("rebuild")(index, rest, none)
    assert once.centroids == index.centroids and once.counters["operations"] == n
    twice = maintenance.policy("rebuild")(once, rest.withColumn("id", F.col("id") + 1_000_000), none)
    assert twice.centroids != index.centroids and twice.counters["operations_done"] == 1


def n_ops(path, spark):
    return workload.offsets(catalogue.vectors(spark, path))[2]


def test_mixed_log_quotas(spark):
    rows = workload.mixed_log(50, 30, (0.45, 0.45, 0.1), 400, 50, spark).collect()
    n = {op: sum(r["op"] == op for r in rows) for op in ("insert", "query", "delete")}
    assert n["insert"] == 180 and n["query"] == 180 and n["delete"] <= 40 and len({r["seq"] for r in rows}) == len(rows)


def test_best_within_budget(spark):
    c = spark.createDataFrame([("cheap", 0.1, 0.7, 10.0), ("best", 0.2, 0.9, 8.0), ("dear", 0.5, 0.95, 7.0)], "method string, cost double, recall double, qps double")
    b = spark.createDataFrame([(0.25,), (0.01,)], "budget double")
    assert {r["budget"]: r["method"] for r in reports.best_within(c, b).collect()} == {0.25: "best", 0.01: None}
