"""Places in posting lists against lists in Python, and what is observed of a stream."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vecmill import catalogue
from vecmill.operators import maintenance, positions
from vecmill.streaming import workload

OPS = "seq long, op string, id long, cluster long"


def plain(lists, ops):
    for _, op, i, c in sorted(ops):
        at = next((k for k, xs in lists.items() if i in xs), None)
        if op == "insert" and at is None:
            lists.setdefault(c, []).append(i)
        elif op == "delete" and at is not None:
            xs = lists[at]
            xs[xs.index(i)] = xs[-1]
            xs.pop()
    return sorted((i, c, p) for c, xs in lists.items() for p, i in enumerate(xs))


@pytest.mark.parametrize("seed", range(3))
def test_holes_are_filled_by_the_last(spark, seed):
    """Deletes of old, new, moved, unknown and last members; ids that come back in the same list; a hot and an emptied list."""
    rng = np.random.default_rng(seed)
    lists = {0: list(range(60)), 1: list(range(60, 66)), 2: [66], 4: [67, 68]}
    home = {i: c for c, xs in lists.items() for i in xs} | {i: int(rng.choice([0, 1, 3])) for i in range(69, 120)}
    places = spark.createDataFrame([(i, c, p) for c, xs in lists.items() for p, i in enumerate(xs)], positions.PLACES).repartition(4)
    seq = 0
    for _ in range(2):
        batch = []
        for _ in range(60):
            i = int(rng.integers(0, 125))
            op = "insert" if rng.random() < 0.45 else "delete"
            batch.append((seq, op, i, home.get(i, 1)))
            seq += 1
        batch += [(seq, "delete", 67, None), (seq + 1, "delete", 68, None)]
        seq += 2
        places = positions.updated(places, spark.createDataFrame(batch, OPS).repartition(3))
        assert sorted(map(tuple, places.select("id", "cluster", "pos").collect())) == plain(lists, batch)


def test_an_empty_batch_and_halves_by_place(spark):
    index, _, _ = catalogue.half_indexed(spark, SMALL)
    turned = index.postings.select("id", "cluster").withColumn("pos", F.col("id") * 0)
    from pyspark.sql.window import Window

    places = turned.withColumn("pos", (F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("id"))) - 1).cast("long"))
    same = positions.updated(places, spark.createDataFrame([], OPS))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, places.collect()))
    by_id = {(r["id"], r["side"]) for r in maintenance.halves(index.postings).collect()}
    by_place = {(r["id"], r["side"]) for r in maintenance.halves_by_place(index.postings, places).collect()}
    assert {i for i, _ in by_id} == {i for i, _ in by_place} and by_id != by_place


def test_a_stream_is_observed(spark, tmp_path):
    index, rest, n = catalogue.half_indexed(spark, SMALL)
    index = workload.replace(index, split_above=24, merge_below=6)
    fresh = rest.select(F.col("place").alias("seq"), F.floor(F.col("place") / (n // 3 + 1)).cast("int").alias("batch"), F.lit("insert").alias("op"), "id", "vec")
    ask = catalogue.asked(spark, SMALL).select(F.col("qid").alias("seq"), (F.col("qid") / 50 % 2).cast("int").alias("batch"), F.lit("query").alias("op"), F.col("qid").alias("id"), "vec")
    old = rest.where("place < 12").select(F.col("place").alias("seq"), F.lit(2).alias("batch"), F.lit("delete").alias("op"), "id", F.lit(None).cast("array<double>").alias("vec"))
    log = fresh.union(ask).union(old)
    for i in range(3):
        log.where(F.col("batch") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    heard = workload.Progress()
    spark.streams.addListener(heard)
    stream = spark.readStream.schema(workload.OPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for state in ("state", "lost"):  # batches that come again are measured once
        workload.follow(stream, index, str(tmp_path / "out"), str(tmp_path / state), "scdkm", workload.Measure(5, 4)).awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(heard)
    rows = workload.measures(spark, str(tmp_path / "out")).orderBy("batch").collect()
    now = index
    for i, r in enumerate(rows):
        now = workload.apply_batch(now, log.where(F.col("batch") == i), "scdkm")
        wanted = workload.measured(now, log.where(F.col("batch") == i), i, workload.Measure(5, 4)).first()
        assert r == wanted and (r["recall"] is None) == (i == 2)
    assert len(rows) == 3 and rows[2]["splits"] > 0 and rows[2]["deletes"] == 12
    table = heard.table(spark).orderBy("batch").collect()
    assert len(table) >= 3 and all(t["per_second"] > 0 for t in table)
    assert [(t["inserts"], t["deletes"], t["queries"]) for t in table[:1]] and sum(t["deletes"] or 0 for t in table) >= 12


def test_halves_of_ids_with_gaps(spark):
    v = catalogue.vectors(spark, SMALL).where("id < 60")
    apart = v.withColumn("id", F.col("id") * 7 + 3)
    first, rest, n = workload.offsets(v)
    one, two, m = workload.offsets(apart)
    assert n == m == 30 and [r["id"] * 7 + 3 for r in first.orderBy("id").collect()] == [r["id"] for r in one.orderBy("id").collect()]
    assert [(r["id"] * 7 + 3, r["place"]) for r in rest.orderBy("id").collect()] == [(r["id"], r["place"]) for r in two.orderBy("id").collect()]
    assert workload.offsets(v.where("id < 0"))[2] == 0
