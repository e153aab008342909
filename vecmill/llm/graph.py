"""Connected components of an edge table, by alternating large and small stars, and one row of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, remove_stored, skew_join, stored


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node that is reachable) of every node of ``edges`` (a long, b long).

    Edges are undirected; repeated edges and loops are allowed, loops add no node. Each round takes partial minima of a
    node's edges and joins them back; nodes with very many edges, such as the root of a large component, are joined apart
    (``skew_join``). The edge table never grows, and each round's table replaces the last in the shared scratch folder.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stored(pairs)
    seen = None
    while (state := tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != seen:
        seen = state
        if not state[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (skew_join(both, least, "u") if state[0] > HOT_ROWS else both.join(least, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (skew_join(large, low, "u") if state[0] > HOT_ROWS else large.join(low, "u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, stored(small)
        remove_stored(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, all columns: the one with the smallest doc_id.

    ``found`` has doc_id (long), raw (xxhash64 of the text as it is) and component of every row. A row is told by both, as a
    doc_id may stand at texts of several components. Among a component's texts of that doc_id the one of the least hash
    stays, and where it has no doc_id but null, one null row. Rows that repeat a doc_id and its text count once.
    """
    found = stored(found)
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("row")
    stay = found.groupBy("component").agg(row).select(F.col("row.doc_id").alias("id"), F.col("row.raw").alias("raw"))
    is_in = lambda rows: docs["doc_id"].cast("long").eqNullSafe(rows["id"]) & (F.xxhash64(docs["text"].cast("string")) == rows["raw"])
    kept = docs.join(stay, is_in(stay), "left_semi")
    repeated = found.groupBy(F.col("doc_id").alias("id"), "raw").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, is_in(repeated), "left_anti").union(kept.join(repeated, is_in(repeated), "left_semi").dropDuplicates(["doc_id", "text"]))
