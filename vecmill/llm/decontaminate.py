"""Benchmark decontamination with an Aho-Corasick automaton.

Every window of 13 consecutive normalised words of a benchmark item (an item of fewer words is one window) is a pattern
over the numbers of words. One automaton over the patterns reads each normalised text once; a match's place gives the
words it covers, and the words' own offsets lead back to the original text. A word's number is written with two symbols, so
that no state has more than about the root of the vocabulary's size of successors. The benchmark travels to the executors
as blocks of a checked size, each with its automaton (about 180 bytes of memory for each byte of benchmark), PASS_BLOCKS of
them at most at a time: a larger benchmark takes several passes over the texts, each of which writes what it found before
the next one's blocks are sent.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, remove_stored, stored, volume

#: Words of a window.
WINDOW = 13
#: UTF-8 bytes of benchmark text in one automaton.
BLOCK_BYTES = 1_000_000
#: Blocks that are sent, and whose automata a worker keeps, at a time.
PASS_BLOCKS = 4
#: What a pass finds: words, words hit, first and last + 1 of each run of these in turn, and items.
MARKS = {"n_words": "long", "n_hit": "long", "runs": "array<int>", "items": "array<string>"}
#: Characters that belong to no word become spaces; A-Z become a-z; all bytes above 127 belong to words.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def normalised(text: str | None) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split() if text else []


def windows(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(WINDOW, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Machine(NamedTuple):
    """Numbers of words from 1, the base of their two symbols, the automaton, and the (words of a window, items) that its values point to."""

    numbers: dict[bytes, int]
    base: int
    automaton: ahocorasick.Automaton
    found: list[tuple[int, tuple[str, ...]]]

    def symbols(self, words: Sequence[bytes]) -> tuple[int, ...]:
        """Two for each word; those of words that no item has occur in no pattern."""
        n = np.fromiter((self.numbers.get(w, 0) for w in words), np.int64, len(words))
        return tuple(np.stack([n // self.base, self.base + n % self.base], 1).ravel().tolist())


@lru_cache(PASS_BLOCKS)
def automaton(items: tuple[tuple[str, str], ...]) -> Machine | None:
    """From a window to its number of words and the items that hold it."""
    held: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        for w in windows(normalised(text)):
            held.setdefault(w, set()).add(item)
    if not held:
        return None
    numbers = {w: i for i, w in enumerate(sorted({w for window in held for w in window}), 1)}
    made = Machine(numbers, math.isqrt(len(numbers)) + 1, ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), [])
    place: dict[tuple[int, tuple[str, ...]], int] = {}
    for window, names in held.items():
        key = (len(window), tuple(names))
        made.automaton.add_word(made.symbols(window), place.setdefault(key, len(place)))
    made.found.extend(place)
    made.automaton.make_automaton()
    return made


def hits(words: list[bytes], machine: Machine | None) -> tuple[np.ndarray, set[str]]:
    """Which words lie inside an occurrence of a window, and the items whose windows occur."""
    items: set[str] = set()
    edge = np.zeros(len(words) + 1, np.int64)
    if words and machine is not None:
        for end, value in machine.automaton.iter(machine.symbols(words)):
            n, names = machine.found[value]
            w = end // 2
            edge[w + 1 - n] += 1
            edge[w + 1] -= 1
            items.update(names)
    return np.cumsum(edge[:-1]) > 0, items


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the normalised words stand in the original text, in code points."""
    inside = np.array([ord(c) > 127 or c.isalnum() for c in text], bool)
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[tuple[str, str], ...]]]:
    """The benchmark's (item_id, text) pairs: lists of PASS_BLOCKS blocks of about BLOCK_BYTES, a list from each scan."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    _, size = volume(items)
    n = max(1, -(-size // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(0, n, PASS_BLOCKS):
        found: dict[int, list[tuple[str, str]]] = {k: [] for k in range(i, min(n, i + PASS_BLOCKS))}
        for r in items.withColumn("_part", part).where((part >= i) & (part < i + PASS_BLOCKS)).collect():
            found[r["_part"]].append((r["item_id"] or "", r["text"]))
        yield [tuple(sorted(x)) for x in found.values()]


def runs_of(hit: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).astype(np.int32)


def marked(docs: DataFrame, benchmark: DataFrame, keep: list[str], prefix: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and, with ``prefix``, those of MARKS."""
    spark, columns = docs.sparkSession, docs.columns
    k, names = columns.index("text"), [prefix + m for m in MARKS]
    now, done, sent = docs, None, []
    groups = blocks(benchmark)
    group, coming = next(groups), next(groups, None)
    while True:
        sent = [spark.sparkContext.broadcast(b) for b in group]  # PASS_BLOCKS * BLOCK_BYTES at most, about
        out = columns if coming else keep
        schema = docs.select(*(f"`{c}`" for c in out)).withColumns({n: F.lit(None).cast(t) for n, t in zip(names, MARKS.values(), strict=True)}).schema
        found = now.mapInArrow(_pass(sent, k, len(columns), [columns.index(c) for c in out]), schema)
        if not coming:
            return found
        last, done = done, stored(found)
        for s in sent:
            s.unpersist()
        if last is not None:
            remove_stored(last)
        now, group, coming = done, coming, next(groups, None)


def _pass(sent: list, k: int, own: int, keep: list[int]):
    """Reads the texts in column k with the automata of the blocks; columns from ``own`` on are an earlier pass's marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [automaton(s.value) for s in sent]
        for batch in batches:
            texts = batch.column(k).to_pylist()
            before = [c.to_pylist() for c in batch.columns[own + 2 : own + 4]] or [[()] * len(texts)] * 2
            n_words, n_hit, runs, items = [], [], [], []
            for text, old, known in zip(texts, *before, strict=True):
                words = normalised(text)
                hit, found = np.zeros(len(words), bool), set(known)
                for a, z in zip(old[::2], old[1::2], strict=True):
                    hit[a:z] = True
                for m in machines:
                    more, named = hits(words, m)
                    hit |= more
                    found |= named
                n_words.append(len(words))
                n_hit.append(int(hit.sum()))
                runs.append(runs_of(hit))
                items.append(sorted(found))
            marks = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            fields = [*(batch.schema.field(i) for i in keep), *(pa.field(f"m{i}", m.type) for i, m in enumerate(marks))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *marks], schema=pa.schema(fields))

    return run


def is_contaminated(prefix: str = ""):
    """Some word is hit, and at least one in twenty."""
    n_hit = F.col(prefix + "n_hit")
    return (n_hit > 0) & (20 * n_hit >= F.col(prefix + "n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted item_ids) and contaminated of every whole text.

    contaminated: some word is hit, and at least one in twenty. A null text has no words, as has one without letters
    and digits. Items without words match nothing, items with equal windows are all found, and an empty benchmark finds
    nothing. Repeated rows and repeated or null doc_ids give a row each; an empty documents table gives no rows; other
    columns of either table don't matter.
    """
    found = marked(id_and_text(docs), benchmark, ["doc_id"], "")
    return found.drop("runs").withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", is_contaminated())


def hit_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and spans (start, end) of maximal runs of hit words, in code points of the original text.

    A null text and one without hits have none. Repeated rows and repeated or null doc_ids give a row each; an empty table
    gives no rows; other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                at = word_spans(text) if runs else []
                spans.append([{"start": at[a][0], "end": at[z - 1][1]} for a, z in zip(runs[::2], runs[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "spans"])

    found = marked(id_and_text(docs), benchmark, ["doc_id", "text"], "").select("doc_id", "text", "runs")
    return found.mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int>>")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't contaminated; texts are judged as in ``contamination``."""
    prefix = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in docs.columns))  # more than any column has
    return marked(docs, benchmark, docs.columns, prefix).where(~is_contaminated(prefix)).select(*(f"`{c}`" for c in docs.columns))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
