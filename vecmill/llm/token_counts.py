"""Token counts from distinct pre-tokens.

Each batch of documents sends its distinct pre-tokens; the task that owns a range of their hashes counts the pieces of
each distinct one once; the counts come back to the batch, are joined to the frequencies of pre-tokens in each document,
and are summed. Ids are never materialised for a document.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import hash_batches, id_and_text, n_batches, runs_of_docs, volume
from .exchange import table
from .pretokens import distinct

CHUNK = 1_000_000
#: Distinct pre-tokens that one range of hashes holds, about, before equal ones of several batches meet.
RANGE_NAMES = 400_000
ASK = "part long, batch long, n int, names binary"
ANSWER = "part long, batch long, counts binary"


def _pieces(texts: list[str], special: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at special strings: the pieces, the text of each, and the number of special strings in each text."""
    if not any(s in t for s in special for t in texts):
        return texts, np.arange(len(texts)), np.zeros(len(texts), np.int64)
    pieces, owner, found = [], [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        parts = [t]
        for s in special:
            parts = [x for p in parts for x in p.split(s)]
        found[i] = len(parts) - 1
        pieces += parts
        owner += [i] * len(parts)
    return pieces, np.array(owner), found


class Batch:
    """Pre-tokens of a batch's texts: distinct ones in a fixed order, and each text's frequencies."""

    def __init__(self, texts: list[str], special: list[str], bits: int):
        pieces, owner, self.special = _pieces(texts, special)
        names: dict[str, int] = {}
        self.chunks = []
        for a, b in runs_of_docs(np.array([len(t) for t in pieces], np.int64), CHUNK):
            own, number, begin = distinct(pieces[a:b])
            ids = np.array([names.setdefault(w, len(names)) for w in own], np.int64)
            text = np.repeat(owner[a:b], np.diff(begin))
            pair, times = np.unique(text * (len(own) + 1) + number, return_counts=True)
            self.chunks.append((pair // (len(own) + 1), ids[pair % (len(own) + 1)], times))
        raw = [w.encode() for w in names]
        part = np.array([zlib.crc32(x) >> (32 - bits) for x in raw], np.int64)
        order = np.array(sorted(range(len(raw)), key=raw.__getitem__), np.int64)
        order = order[np.argsort(part[order], kind="stable")]  # by part, then by name: neighbours share prefixes
        self.raw, self.part, self.order = [raw[i] for i in order.tolist()], part[order], order

    def total(self, counts: np.ndarray) -> np.ndarray:
        """Tokens of each text, given the pieces of each distinct pre-token in order."""
        of = np.zeros(len(self.raw), np.int64)
        of[self.order] = counts
        out = self.special.copy()
        for text, name, times in self.chunks:
            np.add.at(out, text, of[name] * times)
        return out


_libraries: dict[str, object] = {}


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _libraries:
        from tokenizers import Tokenizer

        _libraries[path] = Tokenizer.from_file(path)
    return _libraries[path]


def special_strings(path: str) -> list[str]:
    """Added tokens that the library finds inside texts by default."""
    return [t.content for t in _library(path).get_added_tokens_decoder().values()]


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def release(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)


def pack(names: list[bytes]) -> bytes:
    return squeeze(np.array([len(x) for x in names], np.uint32).tobytes() + b"".join(names))


def unpack(n: int, packed: bytes) -> list[bytes]:
    raw = release(packed)
    ends = (np.cumsum(np.frombuffer(raw, np.uint32, n), dtype=np.int64) + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 * n, *ends[:-1]], ends, strict=True)]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every whole text.

    The tokenizer is a byte-level BPE file of the tokenizers library. A null text counts as empty: no bytes, no tokens.
    Repeated rows and repeated or null doc_ids give a row each; an empty table gives no rows; other columns don't matter.
    """
    docs = id_and_text(docs)
    rows, size = volume(docs)
    bits = max(0, (size // 30 // RANGE_NAMES).bit_length())
    docs = hash_batches(docs, n_batches(rows, size))
    special = special_strings(tokenizer_path)
    out = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

    def asked(rows: pa.Table) -> pa.Table:
        b, key = Batch([t or "" for t in rows["text"].to_pylist()], special, bits), rows["batch"][0].as_py()
        part = b.part
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
        return table([(int(part[i]), key, j - i, pack(b.raw[i:j])) for i, j in zip(edges, edges[1:], strict=False)], ["part", "batch", "n", "names"], ASK)

    def answered(rows: pa.Table) -> pa.Table:
        library = _library(tokenizer_path)
        known: dict[bytes, int] = {}
        lists = [unpack(n, x) for n, x in zip(rows["n"].to_pylist(), rows["names"].to_pylist(), strict=True)]
        for names in lists:
            new = [x for x in names if x not in known]
            for i in range(0, len(new), 5_000):
                known.update((x, len(e)) for x, e in zip(new[i : i + 5_000], library.encode_batch_fast([x.decode() for x in new[i : i + 5_000]], add_special_tokens=False), strict=True))
        counts = [squeeze(np.array([known[x] for x in names], np.uint32).tobytes()) for names in lists]
        return pa.table([rows["part"], rows["batch"], pa.array(counts, pa.binary())], ["part", "batch", "counts"])

    def summed(rows: pa.Table, answers: pa.Table) -> pa.Table:
        texts = [t or "" for t in rows["text"].to_pylist()]
        counts = np.frombuffer(b"".join([release(x) for x in answers.sort_by("part")["counts"].to_pylist()]), np.uint32)
        n = Batch(texts, special, bits).total(counts)
        return pa.table([rows["doc_id"], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    answers = docs.groupBy("batch").applyInArrow(asked, ASK).groupBy("part").applyInArrow(answered, ANSWER)
    return docs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(summed, out)
