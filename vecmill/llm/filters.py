"""What each of five filters removes, in every order in which they can be applied.

A document's failures are five bits. A table of 32 failures by 120 orders names the step at which each order removes it;
tasks look their documents up in it and count removals by part, order, step and label, and Spark sums the arrays of all
tasks: 120 rows for each part and task leave a task, whatever the number of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, strings

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: The filter of each order's steps.
AT_STEP = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
#: Failing combination of filters (bit i: the i-th fails) x order -> step (from 0) that removes; 5 where none does.
FIRST = np.array([[next((s for s, f in enumerate(o) if mask >> FILTERS.index(f) & 1), 5) for o in ORDERS] for mask in range(32)])
#: Failure conditions: fewest words, least share of distinct words (%), most capitals (%), characters that none may hold.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, FORBIDDEN = 200, 50, 3, b"#$%&*|"
_CAPITALS, _CONTINUATIONS = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
#: Kinds of documents that are counted: neither good nor toxic, good, toxic, both.
KINDS = 4
#: Parts whose counts a task holds before it sends them on.
HELD_PARTS = 1_000
#: What a task counts for each order: of each step, documents removed, good ones, toxic ones, failing its filter, failing it alone.
COUNTS = ("removed", "good_lost", "toxic_lost", "fails", "unique_fails")
_COUNTED = "part string, filter_order string, n long, " + ", ".join(f"{c} array<long>" for c in COUNTS)


def text_failures(column: pa.Array) -> np.ndarray:
    """Bits of the filters A to D for each text; null is empty."""
    data, off = strings(column)
    raw, n = data.tobytes(), len(off) - 1
    words, distinct, capitals, points, forbidden = np.zeros((5, n), np.int64)
    without = lambda t, those: len(t) - len(t.translate(None, those))
    for i, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        text = raw[a:z]
        found = text.split()  # at space, tab, line feed, vertical tab, form feed and carriage return
        words[i], distinct[i] = len(found), len(set(found))
        capitals[i], points[i], forbidden[i] = without(text, _CAPITALS), len(text.translate(None, _CONTINUATIONS)), without(text, FORBIDDEN)
    failing = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, forbidden > 0]
    return sum(f.astype(np.int64) << i for i, f in enumerate(failing))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part (lang), mask (bits of A to D) and digest (SHA-256 of the text) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = strings(batch.column(1))
            raw = data.tobytes()
            digests = [hashlib.sha256(raw[a:z]).digest() for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(text_failures(batch.column(1))), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    return own.mapInArrow(run, "doc_id long, part string, mask long, digest binary")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, mask (bits of A to E) and kind (1: good, 2: toxic, 3: both, else 0) of each document.

    The digests are written once, and so are the texts that stand under several doc_ids and the labelled documents: Spark
    splits the rows of a large key (a text in many copies, the null doc_id) only where both sides of a join are plain tables.
    """
    table = stored(judged(docs))
    repeated = table.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    flag = lambda c: F.max(F.when(F.col(c).cast("long") == 1, 1).otherwise(0))
    kinds = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((flag("quality") + 2 * flag("toxic")).alias("kind")).where("doc_id is not null and kind > 0")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    mask = F.col("mask") + F.when(again, 1 << 4).otherwise(0)
    both = table.join(stored(kinds), "doc_id", "left").join(stored(repeated), "digest", "left")
    return both.select("doc_id", "part", mask.cast("long").alias("mask"), F.coalesce("kind", F.lit(0)).cast("long").alias("kind"))


def removals(cells: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS, each orders x steps, of a part with so many documents of each mask and kind (32 x KINDS)."""
    n_orders, n_steps = AT_STEP.shape
    masks, kinds = np.nonzero(cells)
    step = FIRST[masks]
    at = (np.arange(n_orders) * (n_steps + 1) + step) * KINDS + kinds[:, None]
    weight = np.broadcast_to(cells[masks, kinds][:, None], at.shape)
    lost = np.bincount(at.ravel(), weight.ravel(), n_orders * (n_steps + 1) * KINDS).reshape(n_orders, n_steps + 1, KINDS)[:, :n_steps]
    of_mask = cells.sum(1)
    fails = np.array([of_mask[(np.arange(32) >> f & 1) == 1].sum() for f in range(n_steps)])
    alone = np.array([of_mask[1 << f] for f in range(n_steps)])
    found = {"removed": lost.sum(2), "good_lost": lost[:, :, 1] + lost[:, :, 3], "toxic_lost": lost[:, :, 2] + lost[:, :, 3], "fails": fails[AT_STEP], "unique_fails": alone[AT_STEP]}
    return {c: found[c].astype(np.int64) for c in COUNTS}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def sent() -> pa.RecordBatch:
        longs = pa.list_(pa.int64())
        out = [removals(cells) for cells in held.values()]
        columns = [pa.array(np.repeat(list(held), len(ORDERS)).tolist(), pa.string()), pa.array(ORDERS * len(held), pa.string()), pa.array(np.repeat([int(c.sum()) for c in held.values()], len(ORDERS)), pa.int64())]
        columns += [pa.array([row for x in out for row in x[c]], longs) for c in COUNTS]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "n", *COUNTS])

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        cell = batch.column(1).to_numpy() * KINDS + batch.column(2).to_numpy()
        counts = np.bincount(parts.indices.to_numpy() * 32 * KINDS + cell, minlength=len(parts.dictionary) * 32 * KINDS).reshape(-1, 32, KINDS)
        for part, own in zip(parts.dictionary.to_pylist(), counts, strict=True):
            held[part] = held[part] + own if part in held else own
        if len(held) > HELD_PARTS:
            yield sent()
    if held:
        yield sent()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step (1 to 5) and counts of what each filter does at its place in each of the 120 orders.

    kept, removed, redundant (fails the filter, removed before), unique_fails (fails this filter only), good_lost and
    toxic_lost (removed here), and shapley (what the filter removes, summed over all orders).

    A null text is empty, a null lang is the part of the empty one. A null doc_id is neither smaller nor larger than
    another and has no label; rows that repeat a doc_id and its text are no copies of each other, but each counts. A
    document is good or toxic if any of its rows in ``labels`` says so; null labels, and other columns of either table,
    don't matter. An empty documents table has no parts and gives no rows, empty labels give zeros.
    """
    counted = failures(docs, labels).select("part", "mask", "kind").mapInArrow(_counted, _COUNTED)
    steps = range(len(FILTERS))
    whole = counted.groupBy("part", "filter_order").agg(F.sum("n").alias("n"), *(F.sum(F.col(c)[s]).alias(f"{c}{s}") for c in COUNTS for s in steps))
    up_to = lambda s: sum((F.col(f"removed{i}") for i in range(s + 1)), F.lit(0).cast("long"))

    def row(s: int) -> Column:
        return F.struct(F.lit(s + 1).alias("step"), (F.col("n") - up_to(s)).alias("kept"), *(F.col(f"{c}{s}").alias(c) for c in COUNTS))

    rows = whole.select("part", "filter_order", F.explode(F.array(*map(row, steps))).alias("r")).select("part", "filter_order", "r.*")
    every = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))  # 120 rows for each part and filter
    return rows.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(every).alias("shapley"))
