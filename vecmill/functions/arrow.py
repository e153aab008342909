"""Arrow columns of vectors as matrices, for the operators that multiply matrices inside tasks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs whose distances are taken at a time.
PAIRS = 100_000


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of one length as a matrix of doubles; lists that are null or of unlike lengths are refused."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if len(column):
        lengths = pc.min_max(pc.fill_null(pc.list_value_length(column), -1)).as_py()
        if lengths["min"] < 0 or lengths["min"] != lengths["max"]:
            raise ValueError(f"vectors of unlike lengths or null: {lengths}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists(m: np.ndarray) -> pa.Array:
    """A matrix as a column of array<double>."""
    m = np.ascontiguousarray(m, np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(1, m.shape[1]), dtype=np.int32)), pa.array(m.ravel()))


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Squared L2 distances, or negative inner products, of all rows of x to all of y by one matrix product.

    The last bits of a pair's distance depend on the shapes of x and y: what is ranked is taken anew by ``paired``.
    """
    inner = x @ y.T
    if metric == "ip":
        return -inner
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * inner, 0)


def paired(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of x to the rows of y beside them, summed coordinate by coordinate: the same wherever a pair is met."""
    out = np.zeros(len(x))
    for a in range(0, len(x), PAIRS):
        p, q, part = x[a : a + PAIRS].T, y[a : a + PAIRS].T, out[a : a + PAIRS]
        for u, v in zip(p, q, strict=True):
            part += u * v if metric == "ip" else (u - v) ** 2
    return -out if metric == "ip" else out


def _first_copies(y: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The rows of y without those that k equal ones of smaller ids stand before."""
    same = np.unique(np.ascontiguousarray(y + 0.0).view(np.dtype((np.void, y.dtype.itemsize * y.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, same))
    held = same[order]
    place = np.arange(len(held)) - np.searchsorted(held, held)
    return np.sort(order[place < k])


def nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, metric: str, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distance and id of the k nearest rows of y (all, if fewer) to each row of x, best first; ties go to the smaller id.

    A matrix product leaves the rows that its rounding can't tell from the k-th; their distances are ``paired``, so that the
    result doesn't depend on what else is in x and y. Of equal rows of y only the first k in order of id take part. Where
    ``limit`` gives a row of x the distance of the k-th that is known already, what is farther may be left out; places without
    a row of y come last, with the largest id and a distance that isn't a number.
    """
    m = min(k, len(y))
    if not m or not len(x):
        return np.zeros((len(x), m)), np.zeros((len(x), m), np.int64)

    def near() -> tuple[np.ndarray, np.ndarray]:
        if m == len(y) and limit is None:
            return np.divmod(np.arange(len(x) * m), m)
        d = distances(x, y, metric)
        reach = np.sqrt((x * x).sum(1)) + np.sqrt((y * y).sum(1).max())
        rounding = (4 * x.shape[1] + 32) * np.finfo(float).eps * reach**2
        if limit is not None and not np.isnan(limit).any():
            rows, at = np.divmod(np.flatnonzero(~(d > (limit + rounding)[:, None])), len(y))
            if len(rows) <= 4 * m * len(x) + 1000:
                return rows, at
        last = np.partition(d, m - 1, axis=1)[:, m - 1]
        if limit is not None:
            last = np.fmin(last, limit)
        return np.divmod(np.flatnonzero(~(d > (last + rounding)[:, None])), len(y))

    rows, at = near()
    if len(rows) > 4 * m * len(x) + 1000 and m < len(y) and x.shape[1]:
        own = _first_copies(y, ids, k)
        if len(own) < len(y):
            y, ids = y[own], ids[own]
            rows, at = near()
    d = np.empty(len(rows))
    for a in range(0, len(rows), PAIRS):
        d[a : a + PAIRS] = paired(x[rows[a : a + PAIRS]], y[at[a : a + PAIRS]], metric)
    order = np.lexsort((ids[at], d, rows))
    first = np.searchsorted(rows[order], np.arange(len(x)))
    if limit is None:
        pick = order[first[:, None] + np.arange(m)]
        return d[pick], ids[at[pick]]
    place = np.arange(len(order)) - first[rows[order]]
    order, place = order[place < m], place[place < m]
    best, near_ids = np.full((len(x), m), np.nan), np.full((len(x), m), np.iinfo(np.int64).max)
    best[rows[order], place], near_ids[rows[order], place] = d[order], ids[at[order]]
    return best, near_ids


def blocks(queries: int, slices: int, least: int, most: int, tasks: int) -> int:
    """Blocks of ``least`` to ``most`` queries: each takes every slice's rows once more, so no more than that and ``tasks`` for all slices ask for."""
    return max(1, math.ceil(queries / most), min(math.ceil(queries / least), math.ceil(tasks / max(1, slices))))
