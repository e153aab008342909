"""Shards along a Hilbert curve through several metadata dimensions, with DataFrame functions only.

Each dimension (size, source, language) is quantised to BITS bits in the order of its values, at quantiles of the rows;
a few different values spread over the whole range, so that the curve's long steps separate them. The cell's place on the curve orders the cells, doc_id orders the rows of a cell, and the whole order
is cut into runs whose row counts differ by one at most (law ``rows``). A shard then spans a compact box of cells, so that
a filter on any of the dimensions skips most files.

No task orders more than a slice of a cell: slices follow quantiles of doc_id, rows are numbered inside their slice, and
the counts of the slices and cells before it make the number global.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranks import numbered
from .common import range_batches, stored

BITS = 4
SHARDS = 40
#: Rows of a slice, on average, and the most slices; beyond them slices grow with the table.
SLICE_ROWS, SLICES = 500, 20_000


def hilbert(cell: Column, dims: int, bits: int) -> Column:
    """Place on the Hilbert curve of an array of ``dims`` integers of ``bits`` bits (Skilling's transform, AIP 2004)."""
    n = F.lit(dims)

    def unfold(x: Column, k: Column) -> Column:
        q = F.expr("1L") * F.pow(F.lit(2), F.lit(bits - 1) - F.floor(k / n)).cast("long")
        i = (k % n).cast("int")
        x0, xi = x[0], F.element_at(x, i + 1)
        swap = x0.bitwiseXOR(xi).bitwiseAND(q - 1)
        return F.transform(x, lambda v, j: F.when(xi.bitwiseAND(q) != 0, F.when(j == 0, v.bitwiseXOR(q - 1)).otherwise(v)).when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v))

    x = F.aggregate(F.sequence(F.lit(0), F.lit((bits - 1) * dims - 1)), cell.cast("array<long>"), unfold) if bits > 1 else cell.cast("array<long>")
    gray = lambda y: F.transform(y, lambda v, j: F.aggregate(F.slice(y, 1, j + 1), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)))
    tail = lambda y: F.aggregate(F.sequence(F.lit(1), F.lit(max(1, bits - 1))), F.lit(0).cast("long"), lambda t, b: F.when(F.element_at(y, dims).bitwiseAND(F.pow(F.lit(2), b).cast("long")) != 0, t.bitwiseXOR(F.pow(F.lit(2), b).cast("long") - 1)).otherwise(t))

    def place(y: Column) -> Column:
        bit = lambda k: F.floor(F.element_at(y, (k % n).cast("int") + 1) / F.pow(F.lit(2), F.lit(bits - 1) - F.floor(k / n))).cast("long") % 2
        return F.aggregate(F.sequence(F.lit(0), F.lit(bits * dims - 1)), F.lit(0).cast("long"), lambda d, k: d * 2 + bit(k))

    # each step is bound once, as a lambda's argument, so that no expression is copied
    once = lambda value, f: F.transform(F.array(value), f)[0]
    return once(x, lambda a: once(gray(a), lambda y: once(tail(y), lambda t: place(F.transform(y, lambda v: v.bitwiseXOR(t))))))


def _cuts(docs: DataFrame, value: Column) -> list[str]:
    """Whole values at the quantiles of the rows in the order of their strings, 2**BITS - 1 at most.

    Different values are counted first, and numbered in slices of their order, each standing for its rows.
    """
    counts = docs.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    places = numbered(counts, [], ["value"], weight=F.col("rows"))
    n = 1 << BITS
    at = lambda i: F.lit(i / n) * F.col("total")
    cuts = [F.max(F.when((F.col("place") < at(i)) & (at(i) <= F.col("place") + F.col("rows")), F.col("value"))) for i in range(1, n)]
    return sorted({c for c in places.agg(*cuts).first() if c is not None}, key=str.encode)


def _cell(dimensions: list[tuple[Column, list]]) -> Column:
    """For each dimension how many of its bounds lie below its value, spread over the range of BITS bits."""
    below = lambda x, bounds: F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < x))
    step = lambda x, bounds: F.floor(below(x, bounds) * F.lit((1 << BITS) / (len(bounds) + 1))) if bounds else F.lit(0)
    return F.array(*(step(x, bounds).cast("long") for x, bounds in dimensions))


def assigned(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null) and curve of every document.

    A null text has size 16 and the checksum of the empty string. Null lang and source count as empty strings, and are
    not needed as columns. A null doc_id comes first in its cell; rows of one doc_id stay in one slice, ordered by
    checksum and size, and rows equal in all of these take any order. An empty table gives no rows. Fewer rows than
    shards leave shards empty.
    """
    column = lambda c: F.col(f"`{c}`") if c in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 16
    named = {n: F.coalesce(column(n).cast("string"), F.lit("")) for n in ("source", "lang")}
    cuts = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    rows, sizes = docs.agg(F.count(F.lit(1)), F.percentile_approx(size, cuts, 10_000)).first()
    meta = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *(x.alias(f"by_{n}") for n, x in named.items()))
    cell = _cell([(F.col("size"), sorted(set(sizes or []))), *((F.col(f"by_{n}"), _cuts(docs, x)) for n, x in named.items())])
    meta = meta.select("doc_id", "size", "text_crc32", cell.alias("cell"))
    meta = stored(range_batches(meta, max(1, min(SLICES, rows // SLICE_ROWS))).withColumnRenamed("batch", "slice"))

    counts = meta.groupBy("cell", "slice").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n")).withColumn("curve", hilbert(F.col("cell"), 3, BITS))
    before_cell = cells.select("cell", "curve", (F.sum("n").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("cell_start"))
    in_cell = Window.partitionBy("cell").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.withColumn("slice_start", F.sum("n").over(in_cell) - F.col("n")).join(F.broadcast(before_cell), "cell")  # at most 8**BITS cells
    own = F.row_number().over(Window.partitionBy("cell", "slice").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")) - 1
    ranked = meta.withColumn("own", own).join(starts, ["cell", "slice"]).withColumn("rank", F.col("own") + F.col("slice_start") + F.col("cell_start"))
    total = F.lit(max(1, rows)).cast("long")
    shard = F.expr(f"rank * {shards} div {max(1, rows)}")
    out = ranked.withColumn("shard_", shard)
    slot = F.col("rank") - F.floor((F.col("shard_") * total + (shards - 1)) / F.lit(shards)).cast("long")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard_").cast("int").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents, all columns, as one folder of Parquet for each shard, in the order of the curve.

    Rows of one doc_id, size and checksum are interchangeable: they are paired off with that many places.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = ["_id", "_size", "_crc"]
    copy = F.row_number().over(Window.partitionBy(*same).orderBy(*same))
    own = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_size": F.octet_length(text).cast("long") + 16, "_crc": F.crc32(text.cast("binary"))}).withColumn("_copy", copy)
    place = assigned(docs, shards).select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).withColumn("_copy", copy)
    theirs = place.withColumnsRenamed({c: "r" + c for c in [*same, "_copy"]})
    both = [F.col(c).eqNullSafe(F.col("r" + c)) for c in [*same, "_copy"]]
    placed = own.join(theirs, both[0] & both[1] & both[2] & both[3]).select(*(f"`{c}`" for c in docs.columns), "_shard", "_slot")
    placed.repartitionByRange(shards, "_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_slot").withColumnRenamed("_shard", "shard").write.partitionBy("shard").parquet(path)
