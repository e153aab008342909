"""Asking the whole corpus about keys, a batch of documents at a time.

A batch sends its distinct 64-bit keys, sorted and packed into one row for each range of the key space. The task that
owns a range sees the keys of every batch in it and answers each row with one byte for each key. Joined back to its
batch, the answers line up with the batch's sorted keys. A key travels once from a batch, however often it occurs there,
so one very frequent key is no more than one entry from each batch; ranges hold about RANGE_KEYS entries at any size
of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries that one range of the key space holds on average.
RANGE_KEYS = 1_000_000
#: Rows that ask: narrow keys are the 32 bits below those that name the range, wide ones all 64.
ASK = "kind int, part long, batch long, n int, keys binary, marks binary"
ASK_NAMES = ["kind", "part", "batch", "n", "keys", "marks"]
ANSWER = "kind int, part long, batch long, answers binary"
ANSWER_NAMES = ["kind", "part", "batch", "answers"]


def range_bits(entries: int) -> int:
    """Leading bits that name a range, for so many entries in all."""
    return max(0, min(28, (max(1, entries) // RANGE_KEYS).bit_length()))


def ask(batch: int, kind: int, keys: np.ndarray, marks: np.ndarray, bits: int, wide: bool) -> list[tuple]:
    """Rows of ASK for sorted distinct keys with a mark each: a byte or, where ``marks`` are 64-bit numbers, eight."""
    if not len(keys):
        return []
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    body = keys if wide else (keys >> np.uint64(32 - bits)).astype(np.uint32)
    cut = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cut.tolist(), len(keys)]
    return [(kind, int(part[a]), batch, b - a, body[a:b].tobytes(), _marks(marks[a:b])) for a, b in zip(edges, edges[1:], strict=False)]


def _marks(marks: np.ndarray) -> bytes:
    """Bytes of marks; numbers lie byte by byte, first bytes first, so that those of small numbers compress to nothing."""
    if marks.dtype != np.uint64:
        return marks.astype(np.uint8).tobytes()
    return marks.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(marks: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(marks, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def table(rows: list[tuple], names: list[str], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


#: (keys in order, the batch of each, rising within a key, marks, first entry of each key) -> a byte for each entry
Reply = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def answered(asked: DataFrame, replies: dict[int, tuple[bool, Reply]]) -> DataFrame:
    """ANSWER rows. ``replies``: for each kind, whether its keys are wide and what answers them."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("batch")
        kind, part = rows["kind"][0].as_py(), rows["part"][0].as_py()
        wide, reply = replies[kind]
        sizes = rows["n"].to_numpy()
        keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), np.uint64 if wide else np.uint32)
        packed = rows["marks"].to_pylist()
        long = len(packed[0]) == 8 * sizes[0]
        marks = np.concatenate([_numbers(m) for m in packed]) if long else np.frombuffer(b"".join(packed), np.uint8)
        owner = np.repeat(rows["batch"].to_numpy(), sizes)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        said = np.empty(len(keys), np.uint8)
        said[order] = reply(ordered, owner[order], marks[order], first)
        ends = np.cumsum(sizes).tolist()
        out = [(kind, part, b, said[a:z].tobytes()) for b, a, z in zip(rows["batch"].to_pylist(), [0, *ends[:-1]], ends, strict=True)]
        return table(out, ANSWER_NAMES, ANSWER)

    return asked.groupBy("kind", "part").applyInArrow(run, ANSWER)


def spread(per_key: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """A value for each key, given to its entries."""
    return np.repeat(per_key, np.diff(np.append(first, n)))


def collect_answers(answers: pa.Table, kind: int) -> np.ndarray:
    """A batch's answers of one kind, in the order of its sorted keys."""
    rows = answers.filter(pa.compute.equal(answers["kind"], kind)).sort_by("part")
    return np.frombuffer(b"".join(rows["answers"].to_pylist()), np.uint8)
