"""Compression of vectors into codes of eight entries, with codebooks learned in whole numbers.

Every round sends the codebooks (8 x 16 rows) to the tasks; each takes the distances of a batch to all entries of a part by
the expansion of norms, with matrix products of 64-bit integers, and sends on one sum for each entry that it uses. What
comes to the driver in a round is a row for each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Parts of a vector, entries of a codebook, rounds, and the units of a component's 1.
PARTS, ENTRIES, ROUNDS, UNIT = 8, 16, 6, 4096
#: Components below this many units, over the root of their number, keep a vector's products and errors inside 62 bits.
LARGEST = 2.0**30
#: Labels whose sums are sent to all tasks; more are joined.
FEW_LABELS = 50_000

#: entries x width for each part
Books = list[np.ndarray]


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label (a string; null stays null) and x, the components in whole units, of vectors without null or non-finite components."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = e.isNotNull() & ~F.coalesce(bad, F.lit(True))
    large = F.array_max(F.transform(e, F.abs)) * UNIT >= LARGEST / F.sqrt(F.size(e))
    unlike = (F.size(e) == 0) | (F.size(e) % PARTS != 0)
    told = F.raise_error(F.lit(f"a vector's length is no multiple of {PARTS}, or a component is too large for 64 bits"))
    x = F.when(unlike | large, told.cast("array<int>")).otherwise(F.transform(e, lambda v: F.floor(v * UNIT).cast("int")))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows x components; rows of unlike lengths are refused."""
    if not len(column):
        return np.zeros((0, 0), np.int64)
    flat = column.flatten().to_numpy().astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(flat) and (sizes != sizes[0]).any():
        raise ValueError("vectors of unlike lengths")
    return flat.reshape(len(column), -1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lower of equals, and its squared distance: |x|^2 + |c|^2 - 2xc in whole numbers."""
    d = (x * x).sum(1)[:, None] + (book * book).sum(1) - 2 * (x @ book.T)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def parts(x: np.ndarray, books: Books) -> list[np.ndarray]:
    if x.shape[1] != PARTS * books[0].shape[1]:
        raise ValueError("vectors of unlike lengths")
    return np.split(x, PARTS, axis=1)


def first_books(vectors: DataFrame) -> Books:
    """The parts of the vectors of the smallest vec_ids, in order; equal ids go by their components, null ones come last."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    if len({len(r["x"]) for r in rows}) > 1:
        raise ValueError("vectors of unlike lengths")
    x = np.array([r["x"] for r in rows], np.int64)
    return np.split(x, PARTS, axis=1) if x.size else []


def improved(vectors: DataFrame, books: Books) -> Books:
    """Entries at the rounded-down means of the parts that were nearest to them; an unused one stays."""
    sent, width = vectors.sparkSession.sparkContext.broadcast(books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            for p, (own, book) in enumerate(zip(parts(matrix(batch.column(0)), sent.value), sent.value, strict=True)):
                at, _ = nearest(own, book)
                n[p] += np.bincount(at, minlength=ENTRIES)
                np.add.at(sums[p], at, own)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = vectors.select("x").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    merged = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
    out = [b.copy() for b in books]
    for r in merged.collect():  # PARTS x ENTRIES rows at most
        out[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
    sent.unpersist()
    return out


def learned(vectors: DataFrame, rounds: int = ROUNDS) -> Books:
    """Codebooks of ``kept`` vectors after so many rounds over all of them; none where there is no vector."""
    books = first_books(vectors)
    for _ in range(rounds if books else 0):
        books = improved(vectors, books)
    return books


def books_digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encoded(vectors: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances in units, summed over parts) of ``kept`` vectors."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            code, error = np.zeros((len(batch), PARTS), np.uint8), np.zeros(len(batch), np.int64)
            for p, (own, book) in enumerate(zip(parts(matrix(batch.column(2)), sent.value), sent.value, strict=True)):
                at, d = nearest(own, book)
                code[:, p] = at
                error += d
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "x").mapInArrow(run, "vec_id long, label string, code string, error long")


def decoded(codes: DataFrame, books: Books) -> DataFrame:
    """vec_id and vec, the vector that each code stands for, in the scale of the original components."""
    table = F.array(*(F.array(*(F.array(*(F.lit(float(v) / UNIT) for v in row)) for row in b)) for b in books))
    place = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.select("vec_id", F.flatten(F.array(*(table[p][place(p)] for p in range(len(books))))).alias("vec"))


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors of all vectors of the label, null labels together) and codebooks_sha256.

    Vectors that are null, or hold null or non-finite components, are left out; an empty table gives no rows. Repeated rows
    and vec_ids give a row each. Ties go to the lower entry; fewer vectors than entries make smaller codebooks. Lengths
    that differ or aren't a multiple of 8, and components that would leave 64 bits (32,768 or more in 64 dimensions, 4,096 or
    more in 4,096), are refused with an error. Other columns don't matter.
    """
    x = stored(kept(vectors))  # whole numbers, read in every round
    books = learned(x)
    if not books:
        return x.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).where("false")
    found = stored(encoded(x, books).withColumn("label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("null"))))
    totals = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    few = len(totals.select("label").limit(FEW_LABELS + 1).collect()) <= FEW_LABELS
    both = found.join(F.broadcast(totals) if few else totals, "label")
    return both.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
