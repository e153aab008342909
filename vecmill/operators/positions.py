"""Places in posting lists whose deletes move the last member into the hole.

An insert goes to its list's end; a delete's place is taken by what then stands last. A batch touches its own members and as
many at the end of each list as it deletes there: only these come together, a list at a time, and the rest stays.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = "id long, cluster long, pos long"


def replayed(rows: pa.Table) -> pa.Table:
    """Places after a list's operations, of the members that come to stand elsewhere and of the new ones; a member that goes has none (null)."""
    at = {r["pos"]: r["id"] for r in rows.to_pylist() if r["op"] == "held"}
    where = {i: p for p, i in at.items()}
    before = dict(where)
    n = rows["n"][0].as_py()
    ops = sorted((r["seq"], r["op"], r["id"]) for r in rows.to_pylist() if r["op"] != "held")
    for _, op, i in ops:
        if op == "insert" and i not in where:
            at[n], where[i] = i, n
            n += 1
        elif op == "delete" and i in where:
            n -= 1
            hole, last = where.pop(i), at.pop(n)
            if last != i:
                at[hole], where[last] = last, hole
    gone = [i for i in before if i not in where]
    moved = [(i, p) for i, p in where.items() if before.get(i) != p]
    cluster = rows["cluster"][0].as_py()
    return pa.table([pa.array([i for i, _ in moved] + gone, pa.int64()), pa.array([cluster] * (len(moved) + len(gone)), pa.int64()), pa.array([p for _, p in moved] + [None] * len(gone), pa.int64())], ["id", "cluster", "pos"])


def updated(places: DataFrame, ops: DataFrame) -> DataFrame:
    """PLACES after a batch of operations (seq, op, id, cluster), one after the other by seq.

    ``op`` is insert, into ``cluster``, or delete, from where the id is (its cluster isn't read). Deletes of unknown ids
    don't matter; an id that has gone may come again, and one that is there isn't inserted twice. A task holds the touched
    members of one list: three rows for each operation of the batch at most.
    """
    places = places.select("id", "cluster", "pos")
    new = ops.where("op = 'insert'").select("seq", "op", "id", F.col("cluster").cast("long").alias("cluster"))
    held = places.select("id", F.col("cluster").alias("_of"))
    inside = new.groupBy("id").agg(F.max_by("cluster", "seq").alias("_new"))
    gone = ops.where("op = 'delete'").select("seq", "op", "id").join(held, "id", "left").join(inside, "id", "left")
    gone = gone.withColumn("cluster", F.explode(F.array_distinct(F.array_compact(F.array("_of", "_new"))))).select("seq", "op", "id", "cluster")
    batch = new.union(gone)
    sizes = places.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    deletes = gone.groupBy("cluster").agg(F.count(F.lit(1)).alias("lost"))
    lists = batch.select("cluster").distinct().join(sizes, "cluster", "left").join(deletes, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("lost", F.lit(0)).alias("lost"))
    named = batch.select("id", "cluster").distinct().withColumn("_asked", F.lit(True))
    touched = places.join(F.broadcast(lists), "cluster").join(named, ["id", "cluster"], "left").where(F.col("_asked").isNotNull() | (F.col("pos") >= F.col("n") - F.col("lost")))  # lists: a row for each partition
    null = F.lit(None).cast("long")
    rows = touched.select("cluster", "n", "id", "pos", F.lit("held").alias("op"), null.alias("seq"))
    rows = rows.union(batch.join(F.broadcast(lists), "cluster").select("cluster", "n", "id", null.alias("pos"), "op", "seq"))
    found = rows.groupBy("cluster").applyInArrow(replayed, PLACES)
    stay = places.join(found.select("id", "cluster"), ["id", "cluster"], "left_anti")
    return stay.select("id", "cluster", "pos").union(found.where("pos is not null"))
