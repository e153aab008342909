"""Substring dedup with fixed-block anchors.

Reference side: each document's words are cut into non-overlapping blocks of BLOCK words. Probing side: every rolling
window of BLOCK words. A repeat of WINDOW = 2 * BLOCK - 1 words contains a whole block wherever it stands, so a batch of
documents asks the corpus about its rolling windows and marks those that are its blocks; a key that two batches hold, one
of them as a block, is a hit. Hits are then extended: the WINDOW-word windows around hits, and no others, are asked for
with the smallest doc_id that holds each in the batch, and those that a smaller doc_id also holds elsewhere are repeats,
whose union is the maximal exact repeats. Batches follow a hash of the rows, so that neither repeated nor absent doc_ids
fill one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words
from .common import hash_batches, id_and_text, n_batches, strings, volume
from .exchange import ASK, ASK_NAMES, answered, ask, collect_answers, range_bits, spread, table

BLOCK = 7
WINDOW = 2 * BLOCK - 1
_ANCHOR, _REPEAT = 1, 2


class Batch:
    """A batch's words; windows that cross from one document to the next are left out."""

    def __init__(self, rows: pa.Table):
        self.rows = rows.sort_by("doc_id")
        self.data, self.offsets = strings(self.rows["text"])
        self.starts, self.ends, self.first = words.spans(self.data, self.offsets)
        self.hash = words.hashes(self.data, self.starts, self.ends)
        count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(count)), count)
        self.place = np.arange(len(self.doc)) - np.repeat(self.first[:-1], count)
        self.left = np.repeat(count, count) - self.place
        known = np.array(self.rows["doc_id"].is_valid())
        self.counts = np.repeat(known, count)  # a row without doc_id takes no part

    def keys(self, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each start where a window fits, and whether one does."""
        h = words.windows(self.hash, n, seed)
        fits = (self.left >= n) & self.counts
        return h, fits[: len(h)]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct rolling keys, whether each is also a block; starts with a key, and the number of the key of each."""
        h, fits = self.keys(BLOCK, 0xC2B2AE3D27D4EB4F)
        at = np.flatnonzero(fits)
        keys, number = np.unique(h[at], return_inverse=True)
        block = np.zeros(len(keys), bool)
        block[number[self.place[at] % BLOCK == 0]] = True
        return keys, block, at, number

    def candidates(self, hit: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Starts of the windows that contain a hit."""
        mark = np.zeros(len(self.doc) + 1, np.int64)
        mark[at[hit[number]] + 1] = 1
        total = np.cumsum(mark)
        _, fits = self.keys(WINDOW, 0x27D4EB2F165667C5)
        s = np.flatnonzero(fits)
        return s[total[s + WINDOW - BLOCK + 1] > total[s]]


def _locally_shared(b: Batch, block: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Keys that two documents of the batch hold, one as a block."""
    low, high = np.full(len(block), len(b.first)), np.full(len(block), -1)
    np.minimum.at(low, number, b.doc[at])
    np.maximum.at(high, number, b.doc[at])
    return block & (low < high)


def _repeats(b: Batch, hit: np.ndarray, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of candidate windows, their distinct keys and the smallest doc_id of each, the number of each start's key, and whether a smaller doc_id of the batch holds it."""
    s = b.candidates(hit, at, number)
    h, _ = b.keys(WINDOW, 0x27D4EB2F165667C5)
    keys, which = np.unique(h[s], return_inverse=True)
    ids = b.rows["doc_id"].fill_null(0).to_numpy()
    known = np.unique(ids)  # as unsigned numbers of the same order below
    rank = np.searchsorted(known, ids)  # rows without doc_id have no windows
    low = np.full(len(keys), len(ids))
    np.minimum.at(low, which, rank[b.doc[s]])
    least = known[low].view(np.uint64) ^ np.uint64(1 << 63) if len(keys) else np.zeros(0, np.uint64)
    return s, keys, least, which, low[which] < rank[b.doc[s]]


def _any_two(keys: np.ndarray, owner: np.ndarray, marks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 where at least two batches hold the key and one of them marks it."""
    held = np.diff(np.append(first, len(keys)))
    return spread((held > 1) & (np.maximum.reduceat(marks, first) > 0), first, len(keys)).astype(np.uint8)


def _earlier(keys: np.ndarray, owner: np.ndarray, marks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 where another batch holds the key under a smaller doc_id than this one."""
    return (spread(np.minimum.reduceat(marks, first), first, len(keys)) < marks).astype(np.uint8)


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space) and kept_sha256 of every whole text.

    A word goes where a window of 13 words over it also starts in a document with a smaller doc_id. A null or blank text
    has no words; texts under 13 words keep all. Rows with one doc_id aren't smaller than each other. A row without
    doc_id keeps all words and takes none. An empty table gives no rows; other columns, whatever their names, don't matter.
    """
    return _run(docs, with_text=True)


def digests(docs: DataFrame) -> DataFrame:
    """``removals`` without the kept text."""
    return _run(docs, with_text=False)


def _run(docs: DataFrame, with_text: bool) -> DataFrame:
    docs = id_and_text(docs)
    rows, size = volume(docs)
    bits = range_bits(size // 5)
    docs = hash_batches(docs, n_batches(rows, size))

    def ask_anchors(rows: pa.Table) -> pa.Table:
        keys, block, _, _ = Batch(rows).anchors()
        return table(ask(rows["batch"][0].as_py(), _ANCHOR, keys, block, bits, wide=False), ASK_NAMES, ASK)

    def hits(b: Batch, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, block, at, number = b.anchors()
        return (collect_answers(answers, _ANCHOR) > 0) | _locally_shared(b, block, at, number), at, number

    def ask_repeats(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(rows):
            return table([], ASK_NAMES, ASK)
        b = Batch(rows)
        _, keys, least, _, _ = _repeats(b, *hits(b, answers))
        return table(ask(rows["batch"][0].as_py(), _REPEAT, keys, least, bits, wide=True), ASK_NAMES, ASK)

    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        b = Batch(rows)
        s, _, _, which, local = _repeats(b, *hits(b, answers))
        go = s[local | (collect_answers(answers, _REPEAT)[which] > 0)]
        edge = np.zeros(len(b.doc) + 1, np.int64)
        np.add.at(edge, go, 1)
        np.add.at(edge, np.minimum(go + WINDOW, len(b.doc)), -1)
        gone = np.cumsum(edge[:-1]) > 0
        raw, kept, out = b.data.tobytes(), ~gone, []
        starts, ends = b.starts, b.ends
        for i, (a, z) in enumerate(zip(b.first[:-1].tolist(), b.first[1:].tolist(), strict=True)):
            k = kept[a:z]
            if k.all():
                text = b" ".join(raw[b.offsets[i] : b.offsets[i + 1]].split())
            else:
                text = b" ".join([raw[x:y] for x, y in zip(starts[a:z][k].tolist(), ends[a:z][k].tolist(), strict=True)])
            out.append((z - a, int(z - a - k.sum()), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None))
        n, removed, sha, text = zip(*out, strict=True)
        columns = {"doc_id": b.rows["doc_id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(columns | ({"kept": pa.array(text, pa.string())} if with_text else {}))

    asked = docs.groupBy("batch").applyInArrow(ask_anchors, ASK)
    anchors = answered(asked, {_ANCHOR: (False, _any_two)})
    again = docs.groupBy("batch").cogroup(anchors.groupBy("batch")).applyInArrow(ask_repeats, ASK)
    repeats = answered(again, {_REPEAT: (True, _earlier)})
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return docs.groupBy("batch").cogroup(anchors.unionByName(repeats).groupBy("batch")).applyInArrow(remove, out)
