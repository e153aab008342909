"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A pre-token's bytes are the leaves. Leaf i holds (rank of the pair that begins at live position i, i), or nothing; each
inner node holds the smaller of its children, so the root is the leftmost pair of lowest rank. A merge changes three
leaves (the pair itself, the pair before it, and the position that dies) and the nodes above them. Short pre-tokens go
through the tree many at a time, one row each; long ones go one by one through the same tree as a plain list.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, runs_of_docs
from .pretokens import distinct

NONE = np.int64(1) << np.int64(62)
#: Widest row of the array form; longer pre-tokens use the list form.
WIDE = 128
#: Distinct pre-tokens whose encodings a worker keeps.
KEPT = 150_000
#: Characters that are split at a time.
CHUNK = 1_000_000


class Ranks:
    """Ranks of a vocabulary, with the rank of each pair of tokens whose bytes together are a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {r: t for t, r in self.rank.items()}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {(l, r): k for t, k in self.rank.items() for i in range(1, len(t)) if (l := self.rank.get(t[:i])) is not None and (r := self.rank.get(t[i:])) is not None}
        self.pairs = pairs
        self.shift = max(self.token).bit_length()
        keys = np.array([(a << self.shift) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], np.int64(2**62)), np.append(np.array(list(pairs.values()), np.int64)[order], 0)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where there is none."""
        want = (left << self.shift) | right
        i = np.searchsorted(self.keys, want)
        return np.where(self.keys[i] == want, self.values[i], NONE)


@cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encode_rows(words: list[bytes], r: Ranks) -> list[list[int]]:
    """Encode words of at most WIDE bytes; the words of one width go through their trees together."""
    out: list[list[int]] = [[]] * len(words)
    sizes = np.array([len(w) for w in words])
    width = 1
    while width < WIDE:
        low, width = width, 2 * width
        which = np.flatnonzero((sizes > (low if low > 1 else 0)) & (sizes <= width))
        for i in range(0, len(which), 20_000 * 8 // width + 1):
            part = which[i : i + 20_000 * 8 // width + 1]
            for k, ids in zip(part.tolist(), _encode_width([words[k] for k in part], sizes[part], width, r), strict=True):
                out[k] = ids
    return out


def _encode_width(words: list[bytes], size: np.ndarray, width: int, r: Ranks) -> list[list[int]]:
    n = len(words)
    raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
    col = np.arange(width)
    live = col < size[:, None]
    ids = r.byte[raw]
    after = np.broadcast_to(col + 1, (n, width)).copy()
    before = np.broadcast_to(col - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), NONE, np.int64)
    pair = live[:, 1:] & live[:, :-1]
    rank = np.full((n, width - 1), NONE, np.int64)
    rank[pair] = r.of(ids[:, :-1][pair], ids[:, 1:][pair])
    tree[:, width : 2 * width - 1] = np.where(rank < NONE, (rank << 8) | col[:-1], NONE)
    level = width
    while level > 1:
        level //= 2
        np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
    dead = np.zeros((n, width), bool)

    def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + width
        tree[rows, node] = value
        node = node >> 1
        while node[0] if len(node) else 0:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        top = tree[rows, 1]
        at, new = top & 255, top >> 8
        gone = after[rows, at]
        nxt = after[rows, gone]
        ids[rows, at] = new
        dead[rows, gone] = True
        after[rows, at] = nxt
        put(rows, gone, np.full(len(rows), NONE))
        has = nxt < size[rows]
        before[rows[has], nxt[has]] = at[has]
        value = np.full(len(rows), NONE)
        rk = r.of(new[has], ids[rows[has], nxt[has]])
        value[has] = np.where(rk < NONE, (rk << 8) | at[has], NONE)
        put(rows, at, value)
        prev = before[rows, at]
        has = prev >= 0
        rk = r.of(ids[rows[has], prev[has]], new[has])
        put(rows[has], prev[has], np.where(rk < NONE, (rk << 8) | prev[has], NONE))
        rows = rows[tree[rows, 1] < NONE]
    keep = live & ~dead
    flat, ends = ids[keep].tolist(), np.cumsum(keep.sum(1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def encode_long(word: bytes, r: Ranks) -> list[int]:
    """The same tree for one word of any length."""
    n = len(word)
    width = 1 << max(1, (n - 1).bit_length())
    none, pairs = (1 << 62, 0), r.pairs
    ids = [int(x) for x in r.byte[np.frombuffer(word, np.uint8)]]
    after, before, dead = [*range(1, n + 1)], [*range(-1, n - 1)], bytearray(n)
    tree = [none] * (2 * width)
    for i in range(n - 1):
        if (k := pairs.get((ids[i], ids[i + 1]))) is not None:
            tree[width + i] = (k, i)
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(leaf: int, value: tuple[int, int]) -> None:
        node = leaf + width
        tree[node] = value
        while node := node >> 1:
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

    while tree[1] is not none and tree[1][0] < none[0]:
        new, at = tree[1]
        gone = after[at]
        nxt = after[gone]
        ids[at], dead[gone], after[at] = new, 1, nxt
        put(gone, none)
        if nxt < n:
            before[nxt] = at
        put(at, (k, at) if nxt < n and (k := pairs.get((new, ids[nxt]))) is not None else none)
        if (prev := before[at]) >= 0:
            put(prev, (k, prev) if (k := pairs.get((ids[prev], new))) is not None else none)
    return [x for x, d in zip(ids, dead, strict=True) if not d]


def encode_words(words: list[bytes], r: Ranks) -> list[list[int]]:
    """Ids of each pre-token; one that is a token as a whole is that token."""
    out: list[list[int] | None] = [[k] if (k := r.rank.get(w)) is not None else None for w in words]
    short = [i for i, x in enumerate(out) if x is None and len(words[i]) <= WIDE]
    for i, ids in zip(short, encode_rows([words[i] for i in short], r), strict=True):
        out[i] = ids
    return [encode_long(words[i], r) if x is None else x for i, x in enumerate(out)]


def decode(ids: list[int], r: Ranks) -> bytes:
    return b"".join([r.token[i] for i in ids])


class Encoder:
    """Encodes texts; keeps the encodings of a bounded number of pre-tokens between calls."""

    def __init__(self, path: str):
        self.r = ranks(path)
        self.kept: dict[str, tuple[int, bytes, bytes]] = {}

    def parts(self, names: list[str]) -> list[tuple[int, bytes, bytes]]:
        """For each pre-token: its number of ids, the ids as decimals joined by a space, and the bytes they decode to."""
        new = [w for w in names if w not in self.kept]
        if len(self.kept) + len(new) > KEPT:
            self.kept, new = {}, names
        for w, ids in zip(new, encode_words([w.encode() for w in new], self.r), strict=True):
            self.kept[w] = (len(ids), b" ".join([b"%d" % i for i in ids]), decode(ids, self.r))
        return [self.kept[w] for w in names]

    def texts(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, the ids as decimals joined by a space, decoded bytes) of each text."""
        for a, b in runs_of_docs(np.array([len(t) for t in texts], np.int64), CHUNK):
            names, number, begin = distinct(texts[a:b])
            parts = self.parts(names)
            counts = np.array([p[0] for p in parts], np.int64)
            total = np.concatenate([[0], np.cumsum(counts[number])]) if len(number) else np.zeros(1, np.int64)
            ids, raw = [p[1] for p in parts], [p[2] for p in parts]
            number, begin = number.tolist(), begin.tolist()
            for i in range(b - a):
                mine = number[begin[i] : begin[i + 1]]
                yield int(total[begin[i + 1]] - total[begin[i]]), b" ".join([ids[k] for k in mine]), b"".join([raw[k] for k in mine])


_encoders: dict[str, Encoder] = {}


def encoded(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal ids joined by a space) and decoded (binary) of every whole text.

    A null or empty text has no tokens, empty ids and empty bytes. Rows are independent: repeated rows and repeated or
    null doc_ids give a row each. An empty table gives no rows; other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(ranks_path, Encoder(ranks_path))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in runs_of_docs(np.array([len(t) for t in texts], np.int64), 4 * CHUNK):
                n, ids, raw = zip(*encoder.texts(texts[a:b]), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(n, pa.int64()), pa.array([x.decode() for x in ids], pa.string()), pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded binary")


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; cases as in ``encoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(ranks_path, Encoder(ranks_path))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = [(n, sha(ids), sha(raw)) for n, ids, raw in encoder.texts(texts)]
            n, ids, raw = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_tokens(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``docs`` plus n_tokens and token_ids, text being what the ids decode to; a null text stays null, with no ids.

    Columns of the input that are called n_tokens or token_ids are replaced.
    """
    kept = docs.drop("n_tokens", "token_ids")
    names, k = kept.columns, kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(ranks_path, Encoder(ranks_path))
        for batch in batches:
            texts = batch.column(k).to_pylist()
            for a, b in runs_of_docs(np.array([len(t or "") for t in texts], np.int64), 4 * CHUNK):
                part = texts[a:b]
                n, ids, raw = zip(*encoder.texts([t or "" for t in part]), strict=True)
                back = pa.array([x.decode() if t is not None else None for t, x in zip(part, raw, strict=True)], batch.column(k).type)
                ids = pa.array([np.array(x.split(), np.int32) for x in ids], pa.list_(pa.int32()))
                columns = [back if i == k else c[a:b] for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), ids], [*names, "n_tokens", "token_ids"])

    schema = kept.withColumn("n_tokens", F.lit(0).cast("long")).withColumn("token_ids", F.expr("cast(array() as array<int>)")).schema
    return kept.mapInArrow(run, schema)
