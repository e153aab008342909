"""Upkeep until nothing is due, against plain replays of each policy."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vecmill import catalogue
from vecmill.operators import kernels, maintenance
from vecmill.operators.index import Index, IndexConfig, build


class Plain:
    """An index in dicts, kept by loops."""

    def __init__(self, index, above, below):
        rows = index.postings.collect()
        self.x = {r["id"]: np.array(r["vec"]) for r in rows}
        self.at = {r["id"]: r["cluster"] for r in rows}
        self.cents = {c: np.array(v) for c, v in index.centroids.items()}
        self.above, self.below = above, below

    def members(self, c):
        return sorted(i for i, k in self.at.items() if k == c)

    def sizes(self):
        out = {}
        for c in self.at.values():
            out[c] = out.get(c, 0) + 1
        return out

    def refresh(self, clusters):
        for c in clusters:
            if ids := self.members(c):
                self.cents[c] = sum(np.floor(self.x[i] * 1e9 + 0.5) for i in ids) / 1e9 / len(ids)

    def order(self, v, leave=()):
        return sorted((c for c in self.cents if c not in leave), key=lambda c: (((self.cents[c] - v) ** 2).sum(), c))

    def update(self, new, gone):
        at = {i: self.order(v)[0] for i, v in new.items()}
        self.x |= new
        self.at |= at
        self.refresh(list(self.cents))
        for i in gone:
            self.at.pop(i, None)
        self.refresh(list(self.cents))

    def split(self, which, kernel, passes):
        new = {c: max(self.cents) + 1 + i for i, c in enumerate(sorted(which))}
        for c, n in new.items():
            ids = self.members(c)
            side = kernel(np.stack([self.x[i] for i in ids]), (np.arange(len(ids)) >= len(ids) // 2).astype(int), passes)
            self.at |= {i: n for i, s in zip(ids, side, strict=True) if s == 1}
            self.cents[n] = self.cents[c]
        self.refresh([*new, *new.values()])
        return new

    def lire(self, which, rounds):
        new = self.split(which, kernels.two_means, rounds)
        touched = {x for c, n in new.items() for x in (c, n, *self.order(self.cents[c], (c, n))[:5])}
        self.at |= {i: self.order(self.x[i])[0] for i, c in self.at.items() if c in touched}
        self.refresh(touched)

    def merge(self):
        to = {}
        small = {c: n for c, n in sorted(self.sizes().items()) if n < self.below}
        for c in small:
            t = self.order(self.cents[c], (c,))[0]
            if c not in to.values():
                to[c] = to.get(t, t)
        self.at |= {i: to[c] for i, c in self.at.items() if c in to}
        self.refresh(set(to.values()))

    def keep(self, step):
        stuck = set()
        while which := sorted(c for c, n in self.sizes().items() if n > self.above and n >= 4 and c not in stuck):
            before = self.sizes()
            step(which)
            stuck |= {c for c in which if self.sizes().get(c, 0) >= before[c]}
        while True:
            before = len(self.sizes())
            self.merge()
            if len(self.sizes()) >= before:
                return


STEPS = {"scdkm": lambda p: lambda which: p.split(which, kernels.two_way, 5), "lire": lambda p: lambda which: p.lire(which, 10), "memonly": lambda p: lambda which: p.lire(which, 0)}


@pytest.mark.parametrize("name", STEPS)
def test_policies_against_plain_replays(spark, name):
    index, rest, n = catalogue.half_indexed(spark, SMALL)
    index = Index(index.postings, index.centroids, index.config, 15, 7)
    new, gone = rest.where("place < 90"), rest.where("place < 9").select("id")
    after = maintenance.policy(name)(index, new, gone)
    plain = Plain(index, 15, 7)
    plain.update({r["id"]: np.array(r["vec"]) for r in new.collect()}, [r["id"] for r in gone.collect()])
    plain.keep(STEPS[name](plain))
    assert {r["id"]: r["cluster"] for r in after.postings.select("id", "cluster").collect()} == plain.at
    assert after.centroids.keys() == plain.cents.keys() and all(np.allclose(after.centroids[c], v, atol=1e-12) for c, v in plain.cents.items())
    assert after.counters["splits"] >= 8


def test_no_partition_stays_above_its_bound(spark):
    rows = [(i, [float(i % 97), float(i % 13), float(i % 5)]) for i in range(400)]
    index = build(spark.createDataFrame(rows, "id long, vec array<double>"), IndexConfig(nlist=2))
    for name in ("scdkm", "localcdkm"):
        after = maintenance.POLICIES[name](Index(index.postings, index.centroids, index.config, 50, 1))
        assert max(r["n"] for r in after.sizes().collect()) <= 50 and after.postings.count() == 400
    # equal vectors can't be told apart: their partition stays, and every pass ends
    same = build(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "id long, vec array<double>"), IndexConfig(nlist=1))
    for name in ("lire", "scdkm"):
        after = maintenance.POLICIES[name](Index(same.postings, same.centroids, same.config, 10, 3))
        assert after.postings.count() == 40 and after.counters["splits"] == 1


def test_rounds_of_groups_that_share_nothing():
    assert maintenance.coloured([[1, 2], [3, 4], [2, 3], [5, 1], [6]]) == [[[1, 2], [3, 4], [6]], [[2, 3], [5, 1]]]
    assert maintenance.coloured([]) == []


def test_repairs_side_by_side_equal_serial_ones(spark):
    index = build(catalogue.vectors(spark, SMALL), IndexConfig(nlist=12))
    which = sorted(r["cluster"] for r in index.sizes().orderBy(F.desc("n")).limit(4).collect())
    after = maintenance.local_split(index, which, n=2)
    serial, new = maintenance.split(index, which)
    rounds = maintenance.coloured(maintenance.neighbourhoods(serial, sorted(new.items()), 2))
    assert 1 <= len(rounds) <= 4 and any(len(r) > 1 for r in rounds)
    for groups in rounds:
        for g in groups:
            serial = maintenance.local_repairs(serial, [g])
    placed = lambda index: sorted(map(tuple, index.postings.select("id", "cluster").collect()))
    assert placed(after) == placed(serial) and after.centroids == serial.centroids


def test_deletes_rebalance(spark):
    index, rest, _ = catalogue.half_indexed(spark, SMALL, IndexConfig(rebalance_every=1000))
    none, few = rest.where("place < 0").select("id"), rest.where("place < 3").select("id")
    assert maintenance.policy("dedrift")(index, rest, none).counters.get("rebalanced", 0) == 0
    once = maintenance.policy("dedrift")(index, rest, few)
    assert once.counters["rebalanced"] == 1 and once.counters["deletes_done"] == 3
    assert maintenance.policy("dedrift")(once, rest.where("place < 0"), none).counters["rebalanced"] == 1
