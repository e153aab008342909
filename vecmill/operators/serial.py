"""Inserts one by one: every vector is judged by centroids that all before it have moved.

The stream is cut into blocks. A wave replays all blocks side by side, each from the sums that the blocks before it came to
in the wave before; the sums before a block are prefix sums over blocks. What comes before the first block whose own sums
change is final, so the waves end where a single pass would, whatever the number of blocks; they are few, because a few
changed members hardly move a centroid. Sums are whole numbers (``kmeans.UNIT``), so that they don't depend on blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrow import matrix
from ..functions.ranks import numbered
from ..sources.scratch import stored
from . import kmeans, maintenance
from .index import Index

#: Vectors of a block: so many, or so many for each partition, so that the sums before blocks stay small beside the vectors.
BLOCK, PER_PARTITION = 1024, 8
#: Sums of whole numbers stay below this.
LARGEST = 2**62

_STATE = "block long, cluster long, n long, sums array<long>"


@dataclass
class State:
    """Centroids in order of cluster, and members and whole-number sums of each; a partition that nothing joined keeps its centroid."""

    names: np.ndarray
    centroids: np.ndarray
    n: np.ndarray
    sums: np.ndarray

    def joined(self, n: np.ndarray, sums: np.ndarray) -> State:
        """After so many more members with these sums; partitions without any stay as they are."""
        some = n > 0
        out = State(self.names, self.centroids.copy(), self.n + n, self.sums + sums)
        out.centroids[some] = out.sums[some] / kmeans.UNIT / out.n[some][:, None]
        return out

    def take(self, x: np.ndarray, whole: np.ndarray, metric: str) -> int:
        """The place of the nearest centroid (the smaller cluster of equals), which the vector joins and moves."""
        if metric == "ip":
            c = int(np.argmax((self.centroids * x).sum(1)))
        else:
            c = int(np.argmin(((self.centroids - x) ** 2).sum(1)))
        self.n[c] += 1
        self.sums[c] += whole
        self.centroids[c] = self.sums[c] / kmeans.UNIT / self.n[c]
        return c


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(x * kmeans.UNIT + 0.5).astype(np.int64)


def _start(index: Index, stream: DataFrame) -> State:
    names = np.array(sorted(index.centroids), np.int64)
    centroids = np.array([index.centroids[c] for c in names.tolist()], np.float64)
    n, sums = np.zeros(len(names), np.int64), np.zeros(centroids.shape, np.int64)
    most = stream.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("vec", F.abs))).alias("x")).first()
    held = kmeans.whole_sums(index.postings)
    for c, (count, s) in held.items():
        at = int(np.searchsorted(names, c))
        n[at], largest = count, max(map(abs, s), default=0)
        if largest + (most["n"] + 1) * (most["x"] or 0) * kmeans.UNIT >= LARGEST:
            raise ValueError("coordinates are too large to sum one by one")
        sums[at] = s
    if (most["n"] + 1) * (most["x"] or 0) * kmeans.UNIT >= LARGEST:
        raise ValueError("coordinates are too large to sum one by one")
    return State(names, centroids, n, sums)


def _before(contributions: DataFrame) -> DataFrame:
    """STATE of each block: what the blocks before it add to each partition."""
    run = Window.partitionBy("cluster", "at").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = contributions.select("block", "cluster", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "x"))
    sums = rows.withColumn("x", F.coalesce(F.sum("x").over(run), F.lit(0)))
    return sums.groupBy("block", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda z: z["x"]).alias("z")).select("block", "cluster", F.col("z")[0].alias("n"), F.slice("z", 2, F.size("z")).alias("sums"))


def _replay(rows: DataFrame, before: DataFrame | None, start: State, metric: str, split_above: float | None, want: str) -> DataFrame:
    """What each block adds to each partition, and where it first takes one above the bound (``sums``), or the partition of each vector (``places``)."""
    sent = rows.sparkSession.sparkContext.broadcast(start)  # a row for each partition of the index

    def run(key: tuple, block: pa.Table, earlier: pa.Table) -> pa.Table:
        first = sent.value
        n, sums = np.zeros_like(first.n), np.zeros_like(first.sums)
        at = np.searchsorted(first.names, earlier["cluster"].to_numpy())
        if len(at):
            n[at] = earlier["n"].to_numpy()
            sums[at] = np.array(earlier["sums"].to_pylist(), np.int64)
        now = first.joined(n, sums)
        block = block.sort_by("place")
        x, places, took, over = matrix(block["vec"]), block["place"].to_pylist(), [], None
        origin_n, origin = now.n.copy(), now.sums.copy()
        for row, w, place in zip(x, whole(x), places, strict=True):
            took.append(now.take(row, w, metric))
            if over is None and split_above is not None and now.n[took[-1]] > split_above and now.n[took[-1]] >= 4:
                over = place
        if want == "places":
            return pa.table([block["id"], pa.array(first.names[took], pa.int64()), block["place"], block["vec"]], ["id", "cluster", "place", "vec"])
        return pa.table([pa.array(np.full(len(first.names), key[0].as_py())), pa.array(first.names), pa.array(now.n - origin_n), pa.array(list(now.sums - origin), pa.list_(pa.int64())), pa.array([over] * len(first.names), pa.int64())], ["block", "cluster", "n", "sums", "over"])

    schema = "id long, cluster long, place long, vec array<double>" if want == "places" else f"{_STATE}, over long"
    none = rows.sparkSession.createDataFrame([], _STATE)
    return rows.groupBy("block").cogroup((before if before is not None else none).groupBy("block")).applyInArrow(run, schema)


def waves(rows: DataFrame, start: State, metric: str = "l2", split_above: float | None = None) -> tuple[DataFrame, int | None, int]:
    """Of numbered vectors (block, place, id, vec): id, cluster, place and vec of each up to the first that takes a partition above the bound; that place; the waves.

    Blocks before the first one that changed aren't replayed again.
    """
    contributions, final, count = None, -1, 0
    while True:
        count += 1
        before = None if contributions is None else _before(contributions)
        again = rows.where(F.col("block") > final)
        found = _replay(again, before if before is None else before.where(F.col("block") > final), start, metric, split_above, "sums")
        if contributions is not None and final >= 0:
            found = contributions.where(F.col("block") <= final).union(found)
        found = stored(found)
        if contributions is None:
            changed = found.agg(F.min("block")).first()[0]
        else:
            old = contributions.select(*(F.col(c).alias(f"old_{c}") for c in ("block", "cluster", "n", "sums")))
            same = (F.col("n") == F.col("old_n")) & (F.col("sums") == F.col("old_sums"))
            changed = found.join(old, (F.col("block") == F.col("old_block")) & (F.col("cluster") == F.col("old_cluster"))).where(~same).agg(F.min("block")).first()[0]
        contributions = found
        over = found.where(F.col("block") <= changed if changed is not None else F.lit(True)).agg(F.min("over")).first()[0]
        if changed is None or over is not None:
            break
        final = changed
    last = rows if over is None else rows.where(F.col("place") <= over)
    before = _before(contributions)
    if over is not None:
        before = before.join(last.select("block").distinct(), "block", "left_semi")
    return stored(_replay(last, before, start, metric, None, "places")), over, count


def one_by_one(index: Index, stream: DataFrame, split: Callable[[Index, list[int]], Index] | None = None) -> Index:
    """New vectors (seq, id, vec) in order of seq, then id: each in its nearest partition, whose centroid moves before the next is judged.

    ``split`` (index, partitions) is called at once when a partition comes to more than the index's bound, and the inserts after
    that one are judged by the centroids that it leaves. Counters: waves and inserts. Null vectors are left out; an empty
    stream changes nothing; coordinates whose sums leave 62 bits are refused.
    """
    rows = stored(numbered(stream.where("vec is not null").select("seq", "id", "vec"), [], ["seq", "id"]).select("place", "id", "vec"))
    left = rows
    while not left.isEmpty():
        start = _start(index, left)
        size = max(BLOCK, PER_PARTITION * len(start.names))
        first = left.agg(F.min("place")).first()[0]
        cut = left.withColumn("block", F.floor((F.col("place") - first) / size).cast("long"))
        taken, over, count = waves(cut, start, index.config.metric, None if split is None else index.split_above)
        fresh = taken.select("id", "cluster", "vec")
        added = kmeans.whole_sums(fresh)
        at = np.searchsorted(start.names, list(added))
        n, sums = np.zeros_like(start.n), np.zeros_like(start.sums)
        for place, (c, s) in zip(at.tolist(), added.values(), strict=True):
            n[place], sums[place] = c, s
        now = start.joined(n, sums)
        after = replace(index.changed(fresh), centroids=dict(zip(now.names.tolist(), now.centroids.tolist(), strict=True)))
        index = after.counted(waves=count, inserts=int(n.sum()))
        if over is None:
            break
        full = now.names[(now.n > index.split_above) & (n > 0)].tolist()
        index = split(index, full)
        left = rows.where(F.col("place") > over)
    return index


def split_at_once(index: Index, which: list[int]) -> Index:
    """The default of policies that split by coordinate descent."""
    return maintenance.split(index, which)[0]
