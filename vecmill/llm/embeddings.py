"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation is learned, on a bounded sample, that brings the centred unit vectors close to the corners of a cube; the
signs are a balanced binary code. The code's pieces are the keys of several tables: two vectors are candidates if some
piece differs in at most one bit. Pieces get longer with the table, so that buckets stay small, and more rotations give
more pieces where those of one miss too many pairs. Candidates are reranked in their bucket with the original vectors in
double precision, exactly where that is too near to the threshold. A pair that meets in several tables counts in the
first. Equal vectors are one before all this.

Buckets return each vector's number of links and a spanning forest, never pairs. A bucket of over BLOCK vectors is dealt
out as pairs of blocks, so a hot bucket fills no task; nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import skew_join, stored
from .graph import components
from .simhash import Forest
from .words import mix

#: Distinct vectors that the rotation is learned from (a documented bound) and rounds of learning.
SAMPLE, ROUNDS = 16_384, 40
#: Bits of a rotation's code, at most, and rotations.
CODE, ROTATIONS = 64, 12
#: Vectors of a bucket that pieces aim at, and their shortest and longest length in bits.
FILL, LEAST, MOST = 200, 8, 26
#: Vectors of one block of a bucket; rows that one task handles at a time, about.
BLOCK, TASK_ROWS = 4096, 30_000
#: Part of the pairs at the threshold that the tables may miss, and pairs made from the sample to measure it on.
MISS, PAIRS = 0.02, 8192
#: Cosines that are nearer to the threshold than this are decided exactly.
NEAR = 1e-9


#: A table: the rotation, and the first bit and the length of its piece.
Tables = list[tuple[int, int, int]]


def plan(rows: int, coder: Coder, vectors: np.ndarray, cosine: float) -> tuple[Tables, int]:
    """The tables of vectors of one dimension and the radius of a lookup.

    Pieces are about log2(rows / FILL) bits long, so that a bucket holds about FILL vectors at any size. The radius is 0
    or 1, whichever needs fewer lookups for finding all but MISS of some pairs at the threshold (``Coder.differ``); shorter
    pieces are taken only where ROTATIONS rotations don't reach that.
    """
    d = vectors.shape[1]
    bits = min(CODE, d)
    want = round(math.log2(max(2, rows / FILL)))
    best: tuple[float, Tables, int] | None = None
    for size in range(min(bits, MOST, max(LEAST, want)), 0, -1):
        for radius in (0, 1):
            missed, tables = np.ones(PAIRS, bool), []
            for r in range(ROTATIONS):
                differ = coder.differ(vectors, cosine, r)
                for piece in np.array_split(np.arange(bits), max(1, round(bits / size))):
                    tables.append((r, int(piece[0]), len(piece)))
                    missed &= differ[:, piece].sum(1) > radius
                    if missed.mean() <= MISS:
                        break
                if missed.mean() <= MISS:
                    lookups = len(tables) * (1 + radius * size / 2)
                    if best is None or lookups < best[0]:
                        best = lookups, tables, radius
                    break
        if best:
            return best[1:]
    return [(0, b, 1) for b in range(bits)], 1


def learn(unit: np.ndarray, bits: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of iterative quantisation: principal directions, then the rotation nearest to the signs."""
    mean = unit.mean(0)
    x = unit - mean
    _, vectors = np.linalg.eigh(x.T @ x)
    w = vectors[:, ::-1][:, :bits]
    v = x @ w
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(w.shape[1],) * 2))
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (left @ right).T
    return mean, w @ rotation


def units(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _unpack(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, dim and vec (binary doubles; null where the vector is null, empty, zero or has null or non-finite parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("embedding").to_pylist():
                x = np.array(v, np.float64) if v else np.zeros(1)  # null parts become nan
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([len(x) // 8 if x else None for x in out], pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "vec"])

    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.mapInArrow(run, "vec_id long, dim int, vec binary")


class Coder:
    """Codes of vectors of any dimension by several rotations; a dimension that the sample lacks gets random ones."""

    def __init__(self, sample: dict[int, np.ndarray]):
        self.sample = {d: units(v) for d, v in sample.items() if len(v) > 1}
        self.of: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.pairs: dict[tuple[int, float], tuple[np.ndarray, np.ndarray]] = {}
        self.apart: dict[tuple[int, float, int], np.ndarray] = {}

    def rotation(self, d: int, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean and projection of the r-th rotation of dimension d."""
        if (d, r) not in self.of:
            if d in self.sample:
                self.of[d, r] = learn(self.sample[d], min(CODE, d), 11 + r)
            else:
                self.of[d, r] = np.zeros(d), np.linalg.qr(np.random.default_rng((d, r)).normal(size=(d, d)))[0][:, :CODE]
        return self.of[d, r]

    def learned(self) -> Coder:
        """What tasks need: the rotations without the sample."""
        out = Coder({})
        out.of = dict(self.of)
        return out

    def codes(self, vectors: np.ndarray, r: int = 0) -> np.ndarray:
        mean, w = self.rotation(vectors.shape[1], r)
        bits = np.zeros((len(vectors), CODE), bool)
        bits[:, : w.shape[1]] = (units(vectors) - mean) @ w >= 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]

    def differ(self, vectors: np.ndarray, cosine: float, r: int = 0) -> np.ndarray:
        """A row of CODE flags for each pair: bits of a rotation that differ between a vector and one turned, at random, to the cosine.

        Half of the turns go any way; the others go where another vector of the sample lies.
        """
        key = vectors.shape[1], cosine
        if key not in self.pairs:
            rng = np.random.default_rng(13)
            unit = units(vectors)
            unit = unit[rng.integers(len(unit), size=PAIRS)]
            way = rng.normal(size=unit.shape)
            way[PAIRS // 2 :] = unit[rng.permutation(PAIRS)[PAIRS // 2 :]] + 1e-6 * way[PAIRS // 2 :]
            way -= (way * unit).sum(1, keepdims=True) * unit
            way /= np.sqrt((way * way).sum(1, keepdims=True)) + 1e-300
            self.pairs[key] = unit, cosine * unit + math.sqrt(max(0.0, 1 - cosine * cosine)) * way
        if (*key, r) not in self.apart:
            x, y = self.pairs[key]
            codes = self.codes(x, r) ^ self.codes(y, r)
            self.apart[*key, r] = np.unpackbits(codes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        return self.apart[*key, r]


def pieces_of(vectors: np.ndarray, coder: Coder, tables: Tables) -> np.ndarray:
    """The piece of each vector (row) in each table (column)."""
    codes = {r: coder.codes(vectors, r) for r in {t[0] for t in tables}}
    return np.stack([((codes[r] >> np.uint64(first)) & np.uint64((1 << size) - 1)).astype(np.int64) for r, first, size in tables], axis=1)


def memberships(pieces: np.ndarray, tables: Tables, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, table, key, lives there): each row's own bucket of every table and, with radius 1, those one cleared bit away."""
    rows, at, keys, lives = [], [], [], []
    for t, (_, _, size) in enumerate(tables):
        own = pieces[:, t]
        for b in range(-1, size if radius else 0):
            mine = np.arange(len(own)) if b < 0 else np.flatnonzero(own >> b & 1)
            rows.append(mine)
            at.append(np.full(len(mine), t))
            keys.append(own[mine] if b < 0 else own[mine] ^ (1 << b))
            lives.append(np.full(len(mine), b < 0))
    return tuple(np.concatenate(x) for x in (rows, at, keys, lives))


def reaches(x: np.ndarray, y: np.ndarray, cosine: float) -> bool:
    """Whether the cosine of two vectors is at least a positive ``cosine``, in exact arithmetic."""
    a, b = ([Fraction(v) for v in w.tolist()] for w in (x, y))
    dot = sum(p * q for p, q in zip(a, b, strict=True))
    return dot > 0 and dot * dot >= Fraction(cosine) ** 2 * sum(p * p for p in a) * sum(q * q for q in b)


def _compare(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, table: int, radius: int, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (i, j) of vectors that this table brings together and no earlier one; with ``same``, i < j. px, py: their pieces."""
    ux, uy = units(x), units(y)
    for a in range(0, len(x), 512):
        near = ux[a : a + 512] @ uy.T
        if same:
            near[np.arange(len(y))[None, :] <= a + np.arange(len(near))[:, None]] = -2
        i, j = np.nonzero(near >= cosine - NEAR)
        close = near[i, j] < cosine + NEAR
        i += a
        keep = np.bitwise_count(px[i, table] ^ py[j, table]) <= radius
        for t in range(table):
            keep &= np.bitwise_count(px[i, t] ^ py[j, t]) > radius
        for k in np.flatnonzero(keep & close).tolist():
            keep[k] = reaches(x[i[k]], y[j[k]], cosine)
        yield i[keep], j[keep]


def near_duplicates(embeddings: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row for each vector, whatever its label.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    lengths don't link with each other. Equal vectors link, repeated vec_ids included. A component's id is its smallest
    vec_id that isn't null. An empty table gives no rows; other columns don't matter.
    """
    base = stored(valid_vectors(embeddings).withColumn("node", F.when(F.col("vec").isNotNull(), F.xxhash64("dim", "vec"))))
    distinct = base.where("vec is not null").groupBy("node", "dim", "vec").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    distinct = stored(distinct)
    rows = distinct.count()
    share = min(1.0, SAMPLE / max(1, rows))
    picked = distinct.where(F.pmod("node", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)).select("dim", "vec").limit(2 * SAMPLE).toPandas()
    sample = {int(d): np.frombuffer(b"".join(g["vec"]), np.float64).reshape(-1, int(d)) for d, g in picked.groupby("dim") if len(g) > 1}
    learner = Coder(sample)
    plans = {d: plan(rows, learner, v, cosine) for d, v in sample.items()}
    coder = learner.learned()
    plan_of = lambda d: plans.get(d) or ([(0, b, 1) for b in range(min(CODE, d))], 1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, tuple[np.ndarray, ...]]]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                tables, radius = plan_of(d)
                yield part, d, radius, memberships(pieces_of(_unpack(part.column("vec"), d), coder, tables), tables, radius)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, d, _, (_, table, key, lives) in placed(batches):
            bucket, where = np.unique(table << 32 | key, return_inverse=True)
            dim = np.full(len(bucket), d, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(dim), pa.array(bucket), pa.array(np.bincount(where, lives).astype(np.int64)), pa.array(np.bincount(where, ~lives).astype(np.int64))], ["dim", "bucket", "lives", "asks"])

    # only buckets of several blocks come to the driver: at most a row for each BLOCK memberships
    counts = distinct.select("dim", "vec").mapInArrow(sizes, "dim int, bucket long, lives long, asks long").groupBy("dim", "bucket").agg(F.sum("lives").alias("lives"), F.sum("asks").alias("asks"))
    large: dict[int, np.ndarray] = {}
    for r in counts.where((F.col("lives") > BLOCK) | (F.col("asks") > BLOCK)).orderBy("dim", "bucket").collect():
        large.setdefault(r["dim"], []).append((r["bucket"], -(-r["lives"] // BLOCK), -(-r["asks"] // BLOCK)))
    large = {d: np.array(v, np.int64) for d, v in large.items()}
    most = max((len(t) * (1 + radius * t[0][2] / 2) for t, radius in plans.values()), default=1)
    parts = max(1, int(rows * max(1, most)) // TASK_ROWS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, d, radius, (row, table, key, lives) in placed(batches):
            n_live, n_ask = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)  # blocks of a large bucket; 0: a small one
            if d in large:
                bucket = table << 32 | key
                at = np.minimum(np.searchsorted(large[d][:, 0], bucket), len(large[d]) - 1)
                big = large[d][at, 0] == bucket
                n_live[big], n_ask[big] = large[d][at[big], 1], large[d][at[big], 2]
            mixed = mix(part.column("node").to_numpy().view(np.uint64))[row]
            own = (mixed % np.maximum(np.where(lives, n_live, n_ask), 1).astype(np.uint64)).astype(np.int64)
            # a vector that lives in a large bucket meets all its blocks and those that ask; one that asks meets those that live there
            times = np.where(n_live + n_ask == 0, 1, n_live + np.where(lives & (radius > 0), n_ask, 0))
            which = np.repeat(np.arange(len(row)), times)
            other = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            small, live, mine, n = (n_live + n_ask == 0)[which], lives[which], own[which], n_live[which]
            among = live & ~small & (other < n)
            a = np.where(small, 0, np.where(among, np.minimum(mine, other), np.where(live, mine, other)))
            b = np.where(small, 0, np.where(among, np.maximum(mine, other), np.where(live, other - n, mine) + (1 << 30)))
            # sides: 0 compared among themselves, and with 2; 1 and 2 with each other
            side = np.where(small, np.where(live, 0, 2), np.where(among, np.where(mine == other, 0, np.where(mine < other, 1, 2)), np.where(live, 1, 2)))
            slot = mix(mix(((table << 32 | key)[which]).astype(np.uint64)) + mix((a << 31 | b).astype(np.uint64)))
            take = part.take(pa.array(row[which]))
            columns = [pa.array((slot % np.uint64(parts)).astype(np.int64)), pa.array(slot.view(np.int64)), pa.array(table[which].astype(np.int32)), pa.array(side.astype(np.int32)), take.column("dim"), take.column("node"), take.column("n"), take.column("vec")]
            yield pa.RecordBatch.from_arrays(columns, ["part", "slot", "table", "side", "dim", "node", "n", "vec"])

    def compared(rows: pa.Table) -> pa.Table:
        nodes, number = np.unique(rows["node"].to_numpy(), return_inverse=True)
        links, forest = np.zeros(len(nodes), np.int64), Forest(len(nodes))
        slot, side, dims, table = (rows[c].to_numpy() for c in ("slot", "side", "dim", "table"))
        times = rows["n"].to_numpy()
        for d in np.unique(dims).tolist():
            tables, radius = plan_of(d)
            mine = np.flatnonzero(dims == d)
            mine = mine[np.lexsort((side[mine], table[mine], slot[mine]))]
            vec = _unpack(rows["vec"].take(pa.array(mine)), d)
            piece = pieces_of(vec, coder, tables)
            edges = [0, *(np.flatnonzero((np.diff(slot[mine]) != 0) | (np.diff(table[mine]) != 0)) + 1).tolist(), len(mine)]
            for a, z in zip(edges, edges[1:], strict=False):
                s = side[mine[a:z]]
                sets = [np.flatnonzero(s == k) + a for k in range(3)]
                for left, right, same in ((sets[0], sets[0], True), (sets[0], sets[2], False), (sets[1], sets[2], False)):
                    if not len(left) or not len(right):
                        continue
                    for i, j in _compare(vec[left], vec[right], piece[left], piece[right], int(table[mine[a]]), radius, cosine, same):
                        x, y = mine[left[i]], mine[right[j]]
                        np.add.at(links, number[x], times[y])
                        np.add.at(links, number[y], times[x])
                        forest.add(number[x], number[y])
        forest.settle()
        some = np.flatnonzero(links)
        return pa.table([pa.array(nodes[some]), pa.array(nodes[forest.up[some]]), pa.array(links[some])], ["node", "root", "links"])

    found = stored(distinct.select("node", "dim", "n", "vec").mapInArrow(dealt, "part long, slot long, table int, side int, dim int, node long, n long, vec binary").groupBy("part").applyInArrow(compared, "node long, root long, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = distinct.select("node", "low", "n").join(links, "node", "left").join(roots, "node", "left")
    known = known.select("node", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    info = known.join(lowest, "component").select("node", "n_links", "component_id")
    valid = base.select("vec_id", "node").where("node is not null")
    out = skew_join(valid, info, "node").select("vec_id", "n_links", "component_id")
    # what links with nothing needs no join
    out = out.union(base.where("node is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
