"""What the operators share: scratch tables, Arrow text access, batches of documents."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import remove_stored, scratch_path, stored, stored_by  # noqa: F401  (shared with the other operators)

#: Bytes of text that one batch holds on average.
BATCH_BYTES = 6_000_000

def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id (long) and text (string): other columns, whatever their names, don't travel."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def volume(docs: DataFrame) -> tuple[int, int]:
    """Rows and UTF-8 bytes of text."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).first()
    return r["n"], r["b"] or 0


def n_batches(rows: int, size: int, target: int = BATCH_BYTES) -> int:
    """Batches of about ``target`` bytes, each row counting 100 bytes besides its text."""
    return max(1, math.ceil((size + 100 * rows) / target))


def hash_batches(docs: DataFrame, n: int) -> DataFrame:
    """Column ``batch`` in 0..n-1 from the row's content."""
    return docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("long"))


def range_batches(docs: DataFrame, n: int) -> DataFrame:
    """Column ``batch``, rising with doc_id; rows of one doc_id share a batch; a null doc_id goes to batch 0.

    The n - 1 bounds are approximate quantiles. A row finds its batch in two steps of about sqrt(n) comparisons.
    """
    bounds = []
    if n > 1:
        found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("q")).first()["q"]
        bounds = sorted(set(found or []))
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<long>") if xs else F.expr("cast(array() as array<long>)")
    heads = longs([p[0] for p in parts[1:]])
    above = lambda a: F.size(F.filter(a, lambda b: b < F.col("doc_id")))
    coarse = above(heads)
    fine = F.element_at(F.array(*map(longs, parts)), (F.col("_coarse") + 1).cast("int"))
    out = docs.withColumn("_coarse", coarse)
    return out.withColumn("batch", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.col("_coarse") * step + above(fine)).cast("long")).drop("_coarse")


#: Keys with more rows than this, and than this part of the table, are joined apart.
HOT_ROWS, HOT_PART = 100_000, 1000


def skew_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on one column whose values are distinct in ``right``, where some may hold much of ``left``.

    The rows of ``right`` for such keys, HOT_PART at most, are broadcast, so that no task gets all of a hot key's rows.
    """
    n = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS)
    rows = n.select(key, "n").orderBy(F.desc("n")).limit(HOT_PART).collect()
    hot = [r[key] for r in rows if r[key] is not None]
    if not hot:
        return left.join(right, key)
    mine = F.col(key).isin(hot)
    return left.where(~mine).join(right.where(~mine), key).unionByName(left.where(mine).join(F.broadcast(right.where(mine)), key))


def strings(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values, one after the other, and the offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def runs_of_docs(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cut documents, in order, into runs of about ``most`` units; a larger document stands alone."""
    out, i, total = [], 0, 0
    for j, s in enumerate(sizes.tolist()):
        if j > i and total + s > most:
            out.append((i, j))
            i, total = j, 0
        total += s
    if i < len(sizes):
        out.append((i, len(sizes)))
    return out
