"""SimHash near-duplicates with vantage-point trees.

A bounded sample of fingerprints grows a tree: each node keeps a vantage point and cuts the distances to it into rings;
the leaves are shards. A fingerprint lives in the one leaf its distances lead to, and also visits, as a query, each
earlier leaf that the triangle inequality can't exclude: if d(x, y) <= r, their distances to any vantage point differ by
r at most. Inside a leaf the same bounds, with new vantage points, prune down to small blocks that are compared bit by
bit. A leaf returns a spanning forest of its links, never all pairs, and the forests' components are joined on Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import id_and_text, skew_join, stored
from .graph import components

#: Fingerprints from which the tree grows: some for each leaf, within these bounds (32 MB at most).
PER_LEAF, LEAST_SAMPLE, MOST_SAMPLE = 32, 4096, 1 << 22
#: Fingerprints that live in one leaf, about; a leaf that holds more is dealt out in blocks of that size.
LEAF = 8192
#: Pairs below which a block is compared directly.
DIRECT = 200_000
RADIUS = 2


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of ``shingle``-word shingles, repeats included; zero where there are no words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate([[0], np.cumsum(sizes)])
    digest = xxhash.xxh64_intdigest
    spans = zip(start[: len(words) - shingle + 1].tolist(), (start[shingle:] - 1).tolist(), strict=True)
    h = np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        part = bits[: len(bits) // 255 * 255].view("<u8").reshape(-1, 255, 8).sum(1, dtype=np.uint64)  # eight counters of a byte in each word
        ones += part.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64) + bits[len(bits) // 255 * 255 :].sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, raw: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long); if asked for, also raw (hash of the text as it is)."""
    more = ["raw"] if raw else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["doc_id", *more]), pa.array(fps.view(np.int64))], ["doc_id", *more, "fp"])

    own = id_and_text(docs)
    return (own.withColumn("raw", F.xxhash64("text")) if raw else own).mapInArrow(run, "doc_id long, raw long, fp long" if raw else "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """Vantage points and ring bounds down to the leaves."""

    def __init__(self, sample: np.ndarray, rows: int, radius: int = RADIUS):
        self.radius, self.leaves = radius, 0
        levels = 2 + max(1, rows // LEAF).bit_length()  # as deep as so many rows need
        self.root = self._grow(np.unique(sample), rows / max(1, len(sample)), levels, np.random.default_rng(5))

    def _grow(self, points: np.ndarray, weight: float, levels: int, rng: np.random.Generator):
        if len(points) * weight > LEAF and levels and len(points) >= 16:
            some = rng.choice(points, min(24, len(points)), replace=False)
            spread = [np.std(distance(points[:512], p)) for p in some]
            vantage = some[int(np.argmax(spread))]
            d = distance(points, vantage)
            cut = int(np.median(d))
            cut += cut == d.min()
            if (d < cut).any() and (d >= cut).any():
                return vantage, cut, self._grow(points[d < cut], weight, levels - 1, rng), self._grow(points[d >= cut], weight, levels - 1, rng)
        self.leaves += 1
        return self.leaves - 1

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, leaf, lives there) for the leaf where each fingerprint lives and the earlier ones that it visits."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def down(node, index: np.ndarray, home: np.ndarray) -> None:
            if not len(index):
                return
            if isinstance(node, int):
                out.append((index, np.full(len(index), node), home))
                return
            vantage, cut, inner, outer = node
            d = distance(fps[index], vantage).astype(np.int64)
            left = d < cut + self.radius
            down(inner, index[left], home[left] & (d[left] < cut))
            right = d >= cut - self.radius
            down(outer, index[right], home[right] & (d[right] >= cut))

        down(self.root, np.arange(len(fps)), np.ones(len(fps), bool))
        index, leaf, home = (np.concatenate([o[i] for o in out]) for i in range(3)) if out else (np.zeros(0, np.int64),) * 3
        own = np.zeros(len(fps), np.int64)
        own[index[home]] = leaf[home]
        use = home | (leaf < own[index])
        return index[use], leaf[use], home[use]


class Forest:
    """Union of links, an array of them at a time."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.up[a] != self.up[b]
        if new.any():
            self.waiting.append((a[new], b[new]))
            self.size += int(new.sum())
            if self.size > 300_000:
                self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        a, b = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.size = [], 0
        while len(a):
            ra, rb = self.up[a], self.up[b]
            new = ra != rb
            a, b, ra, rb = a[new], b[new], ra[new], rb[new]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))
            while (nxt := self.up[self.up]).tobytes() != self.up.tobytes():
                self.up = nxt


def link(fps: np.ndarray, home: np.ndarray, query: np.ndarray, forest: Forest, radius: int, rng: np.random.Generator, levels: int = 6) -> None:
    """Put every pair of a home and a query (indices into fps) within the radius into the forest."""
    if not len(home) or not len(query):
        return
    if len(home) * len(query) <= DIRECT or not levels:
        step = max(1, 4 * DIRECT // len(query))
        for i in range(0, len(home), step):
            h, q = np.nonzero(distance(fps[home[i : i + step], None], fps[query][None, :]) <= radius)
            forest.add(home[i : i + step][h], query[q])
        return
    vantage = fps[home[rng.integers(len(home))]]
    dh, dq = distance(fps[home], vantage).astype(np.int64), distance(fps[query], vantage).astype(np.int64)
    oh, oq = np.argsort(dh, kind="stable"), np.argsort(dq, kind="stable")
    dh, dq, home, query = dh[oh], dq[oq], home[oh], query[oq]
    for ring in np.unique(dh).tolist():
        a, b = np.searchsorted(dh, [ring, ring + 1])
        c, d = np.searchsorted(dq, [ring - radius, ring + radius + 1])
        link(fps, home[a:b], query[c:d], forest, radius, rng, levels - 1 if b - a < len(home) or d - c < len(query) else 0)


def linked(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct values of fp whose components are those of all links within the radius."""
    rows = fps.count()
    size = min(MOST_SAMPLE, max(LEAST_SAMPLE, PER_LEAF * rows // LEAF))
    want = min(1.0, size / max(1, rows))
    picked = fps.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1 << 40)) < F.lit(int(want * (1 << 40)) + 1)).limit(2 * size).toPandas()
    tree = Tree(picked["fp"].to_numpy(np.int64).view(np.uint64), rows, radius)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, leaf, home = tree.route(batch.column("fp").to_numpy().view(np.uint64))
            lives, all_ = np.bincount(leaf[home], minlength=tree.leaves), np.bincount(leaf, minlength=tree.leaves)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(tree.leaves)), pa.array(lives), pa.array(all_)], ["leaf", "lives", "all"])

    # a row for each leaf; the leaves are bounded by the sample
    found = fps.mapInArrow(sizes, "leaf long, lives long, all long").groupBy("leaf").agg(F.sum("lives").alias("lives"), F.sum("all").alias("all")).collect()
    home_blocks, query_blocks = np.ones(tree.leaves, np.int64), np.ones(tree.leaves, np.int64)
    for r in found:
        home_blocks[r["leaf"]] = max(1, -(-r["lives"] // LEAF))
        query_blocks[r["leaf"]] = max(1, -(-r["all"] // (8 * LEAF)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy()
            index, leaf, home = tree.route(values.view(np.uint64))
            mixed = (values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own = mixed[index].astype(np.int64)
            rows = []
            for mine, ours, theirs, lives in ((home, home_blocks, query_blocks, True), (np.ones(len(home), bool), query_blocks, home_blocks, False)):
                i, l = index[mine], leaf[mine]
                times = theirs[l]
                other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                block, l, i = np.repeat(own[mine] % ours[l], times), np.repeat(l, times), np.repeat(i, times)
                rows.append((l, block if lives else other, other if lives else block, values[i], np.full(len(i), lives)))
            columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["leaf", "hb", "qb", "fp", "lives"])

    def compared(rows: pa.Table) -> pa.Table:
        values, where = np.unique(rows["fp"].to_numpy(), return_inverse=True)
        lives = rows["lives"].to_numpy(zero_copy_only=False)
        forest = Forest(len(values))
        link(values.view(np.uint64), np.unique(where[lives]), np.unique(where[~lives]), forest, radius, np.random.default_rng(len(values)))
        forest.settle()
        tied = np.flatnonzero(forest.up != np.arange(len(values)))
        return pa.table([pa.array(values[tied]), pa.array(values[forest.up[tied]])], ["a", "b"])

    return fps.mapInArrow(dealt, "leaf long, hb long, qb long, fp long, lives boolean").groupBy("leaf", "hb", "qb").applyInArrow(compared, "a long, b long")


def _classes(own: DataFrame, radius: int) -> DataFrame:
    """fp, low (its smallest doc_id) and component (its smallest fingerprint) of each fingerprint of ``own``."""
    fps = stored(own.groupBy("fp").agg(F.min("doc_id").alias("low")))
    root = components(linked(fps.select("fp"), radius)).select(F.col("node").alias("fp"), "component")
    return fps.join(root, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id of the component) of every whole text.

    A null, empty or blank text has fingerprint zero, which links like any other. Repeated rows and texts share their
    fingerprint and so their component. A null doc_id gets a row and its component the smallest of the others (null
    where there are none). An empty table gives no rows; other columns don't matter.
    """
    own = stored(fingerprints(docs))
    known = _classes(own, radius)
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    # most components are one fingerprint: only the linked ones are joined again
    classes = known.join(lowest, "component").select("fp", "component_id")
    return skew_join(own, classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of ``near_duplicates``, all columns (``graph.one_of_each``)."""
    own = stored(fingerprints(docs, raw=True))
    return graph.one_of_each(docs, skew_join(own, _classes(own, RADIUS).select("fp", "component"), "fp").select("doc_id", "raw", "component"))
