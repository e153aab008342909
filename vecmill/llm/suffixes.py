"""Exact repeats of LENGTH bytes with a hash-compared suffix sort.

Every LENGTH-byte string has one anchor: the leftmost GRAM-byte string of least hash inside it. Equal strings have equal
anchors at equal distances, so only texts around an anchor that occurs twice need comparing. A stretch is the run of
starts with one anchor occurrence; its text is at most 2 * LENGTH - GRAM + LENGTH bytes.

The stretches of a shared anchor meet in one task. What follows the anchor is sorted as suffixes, and what stands before
it, read backwards, as well: a merge sort whose comparisons find the common extension of two strings by binary search
over prefix polynomial hashes. Neighbours' extensions are verified byte by byte. Two stretches hold the same string at
distance t before the anchor if their order-neighbours share at least LENGTH - t bytes after it and t bytes before it.

Equal stretches of a batch are one, once their bytes agree, so a frequent passage is one stretch from each batch. An anchor
that stands in over HOT different stretches would still fill one task. Such an anchor gets longer: its starts are cut into
cells of WIDTHS[1] places, and the bytes that all strings of a cell share (LENGTH less the cell's width, plus one) name the
piece; pieces of a name that is still too frequent are cut again, down to single strings, whose name is all their bytes.
Equal strings stay in equal pieces, and pieces are sorted and verified just as stretches are. Of a single string there is
one piece from each batch, however frequent it is; RUN batches meet in one group, and the first holder of each run in another.

The texts are dealt out to their batches once and stored so; each scan reads them there, and only questions, answers and
pieces are shuffled, however many times frequent anchors are cut.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_batches, id_and_text, n_batches, stored, stored_by, strings, volume
from .exchange import ASK, ASK_NAMES, answered, ask, collect_answers, range_bits, spread, table
from .words import byte_values, mix, powers

LENGTH = 200
GRAM = 32
#: Starts that can share one anchor occurrence.
SPAN = LENGTH - GRAM + 1
#: Pieces of a name, all batches together, beyond which they are cut (about 0.5 kB each in one task).
HOT = 16_384
#: Places in a cell, level by level: whole stretches first, single strings last.
WIDTHS = (SPAN, 43, 11, 1)
#: Batches whose copies of a single string meet in one group.
RUN = 4096
#: Steps of a byte's logarithmic count of stretches in an eighth of a doubling; the top bit says that the anchor occurs twice.
_STEPS, _TWICE = 8, 128
#: Bytes whose anchors are found at a time; places inside a piece take PLACE bits.
PIECE, PLACE = 1 << 19, 20
#: Kind of the questions of level 0; further levels count on.
_ANCHOR = 1
#: Answers: a name without a second occurrence; pieces that meet; to be cut; strings that meet in their run, or there and with the first of other runs.
_ALONE, _MEET, _CUT, _IN_RUN, _FIRST = range(5)
STRETCH = "part long, batch long, anchors binary, names binary, many binary, before binary, sizes binary, texts binary"
BITS = (SPAN + 7) // 8


def _rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of the GRAM-byte and of the LENGTH-byte string from each place (fewer of the latter)."""
    factor = 0x9FB21C651E98DF25
    by: dict[int, np.ndarray] = {1: byte_values()[data]}
    size = 1
    while 2 * size <= LENGTH:
        h = by[size]
        by[2 * size] = h[:-size] * np.uint64(pow(factor, size, 1 << 64)) + h[size:] if len(h) > size else np.zeros(0, np.uint64)
        size *= 2
    m = max(0, len(data) - LENGTH + 1)
    whole, at = np.zeros(m, np.uint64), 0
    for size in sorted(by, reverse=True):
        if LENGTH - at >= size:
            whole *= np.uint64(pow(factor, size, 1 << 64))
            whole += by[size][at : at + m]
            at += size
    return mix(by[GRAM]), mix(whole)


def _least(key: np.ndarray) -> np.ndarray:
    """Minimum of each SPAN consecutive values."""
    size, low = 1, key
    while 2 * size <= SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(key) - SPAN + 1], low[SPAN - size :])


class Pieces:
    """Runs of starts that share an anchor occurrence: stretches, or cells of them."""

    def __init__(self, data: np.ndarray, strings: list[np.ndarray], anchor: np.ndarray, place: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.data, self.strings, self.anchor, self.place, self.begin, self.end = data, strings, anchor, place, begin, end

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors, a mark of each (its different pieces, and whether it occurs twice), and the number of each piece's anchor."""
        keys, number, times = np.unique(self.anchor, return_inverse=True, return_counts=True)
        several = np.flatnonzero((times > 1)[number])
        different = np.ones(len(keys), np.int64)
        if len(several):
            pairs = np.unique(np.stack([number[several].astype(np.uint64), self.names(several)]), axis=1)[0].astype(np.int64)
            at, n = np.unique(pairs, return_counts=True)
            different[at] = n
        marks = np.minimum(np.ceil(_STEPS * np.log2(different)), _TWICE - 1) + _TWICE * (times > 1)
        return keys, marks.astype(np.uint8), number

    def take(self, which: np.ndarray) -> Pieces:
        return Pieces(self.data, self.strings, self.anchor[which], self.place[which], self.begin[which], self.end[which])

    def cut(self, width: int) -> Pieces:
        """The pieces inside cells of ``width`` distances before the anchor, named by what all strings of a cell share."""
        low, high = self.place - self.end + 1, self.place - self.begin
        cells = high // width - low // width + 1
        of = np.repeat(np.arange(len(cells)), cells)
        cell = (low // width)[of] + np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
        place = self.place[of]
        size = LENGTH - width + 1
        name = np.zeros(len(of), np.uint64)
        for i in range(0, len(of), 4096):
            at = (place - cell * width)[i : i + 4096, None] + np.arange(size)
            name[i : i + 4096] = (byte_values()[self.data[at]] * powers(size)).sum(1, dtype=np.uint64)
        anchor = mix(name ^ mix(self.anchor[of] + cell.astype(np.uint64) + np.uint64(1)))
        return Pieces(self.data, self.strings, anchor, place, place - np.minimum(high[of], cell * width + width - 1), place - np.maximum(low[of], cell * width) + 1)

    def starts(self, which: np.ndarray) -> np.ndarray:
        """All starts of some pieces."""
        size = (self.end - self.begin)[which]
        return np.repeat(self.begin[which], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)

    def string_hashes(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the strings from some starts."""
        out = np.zeros(len(at), np.uint64)
        for i, whole in enumerate(self.strings):
            mine = at // PIECE == i
            out[mine] = whole[at[mine] - i * PIECE]
        return out

    def names(self, which: np.ndarray) -> np.ndarray:
        """A hash of each piece's text, anchor place and extent."""
        first, last = self.begin[which], self.end[which] - 1
        shape = ((self.place[which] - first) * 1024 + (last - first)).astype(np.uint64)
        # strings that overlap from end to end fix the text between; one in SPAN starts is enough
        out = self.string_hashes(first) * np.uint64(0x9E3779B97F4A7C15) + self.string_hashes(last)
        return mix(out ^ mix(shape))

    def verified_names(self, which: np.ndarray) -> np.ndarray:
        """``names``, but different where the bytes are: each piece is compared with the first one of its name."""
        name = self.names(which)
        _, where, number = np.unique(name, return_index=True, return_inverse=True)
        again = np.flatnonzero(where[number] != np.arange(len(name)))
        col = np.arange(SPAN - 1 + LENGTH)
        for i in range(0, len(again), 4096):
            mine = which[again[i : i + 4096]]
            theirs = which[where[number[again[i : i + 4096]]]]
            size = (self.end - self.begin)[mine] + LENGTH - 1
            inside = col < size[:, None]
            x, y = (self.data[np.where(inside, self.begin[k][:, None] + col, 0)] for k in (mine, theirs))
            wrong = ((x != y) & inside).any(1) | ((self.end - self.begin)[theirs] + LENGTH - 1 != size)
            bad = again[i : i + 4096][wrong]
            name[bad] = mix(name[bad] + bad.astype(np.uint64) + np.uint64(1))
        return name


class Batch(Pieces):
    """The texts of a batch, one after the other, and their stretches."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        self.data, self.offsets = strings(rows["text"])
        anchors, begins, ends, places, self.strings = [], [], [], [], []
        limit = np.repeat(self.offsets[1:], np.diff(self.offsets))  # where each byte's document ends
        for p in range(0, max(0, len(self.data) - LENGTH + 1), PIECE):
            piece = self.data[p : p + PIECE + LENGTH - 1]
            gram, whole = _rolling(piece)
            key = (gram & ~np.uint64((1 << PLACE) - 1)) | np.arange(len(gram), dtype=np.uint64)
            least = _least(key)
            fits = np.arange(p, p + len(least)) + LENGTH <= limit[p : p + len(least)]
            change = np.append(True, (least[1:] != least[:-1]) | ~fits[:-1])
            begin = np.flatnonzero(fits & change)
            stop = np.flatnonzero(fits & np.append(change[1:] | ~fits[1:], True))
            anchors.append(least[begin] >> np.uint64(PLACE))
            places.append((least[begin] & np.uint64((1 << PLACE) - 1)).astype(np.int64) + p)
            begins.append(begin + p)
            ends.append(stop + p + 1)
            self.strings.append(whole)
        join = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        self.anchor, self.place = mix(join(anchors, np.uint64)), join(places, np.int64)
        self.begin, self.end = join(begins, np.int64), join(ends, np.int64)


def _anchor_counts(keys: np.ndarray, owner: np.ndarray, marks: np.ndarray, first: np.ndarray, most: int = HOT) -> np.ndarray:
    """_ALONE: one occurrence in all; _MEET: several; _CUT: in over ``most`` pieces."""
    batches = np.diff(np.append(first, len(keys)))
    repeated = (batches > 1) | (np.maximum.reduceat(marks, first) >= _TWICE)
    pieces = np.add.reduceat(2.0 ** ((marks % _TWICE) / _STEPS), first)
    return spread(repeated * np.where(pieces > most, _CUT, _MEET), first, len(keys)).astype(np.uint8)


def _string_counts(keys: np.ndarray, owner: np.ndarray, marks: np.ndarray, first: np.ndarray, run: int = RUN) -> np.ndarray:
    """_ALONE: one occurrence in all; else _FIRST for the first batch of each run, _IN_RUN for others (a key's batches come in order)."""
    repeated = (np.diff(np.append(first, len(keys))) > 1) | (np.maximum.reduceat(marks, first) >= _TWICE)
    leads = np.append(True, owner[1:] // run != owner[:-1] // run)
    leads[first] = True
    return np.where(spread(repeated, first, len(keys)), np.where(leads, _FIRST, _IN_RUN), _ALONE).astype(np.uint8)


class Suffixes:
    """Strings of up to ``width`` bytes, a row each, with prefix hashes; sorted inside groups."""

    def __init__(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, backwards: bool):
        col = np.arange(width)
        inside = col < size[:, None]
        at = begin[:, None] + (-1 - col if backwards else col)
        self.bytes = np.where(inside, text[np.where(inside, at, 0)], 0)
        self.size = size
        self.prefix = np.zeros((len(size), width + 1), np.uint64)
        np.cumsum(np.where(inside, byte_values()[self.bytes] * powers(width), np.uint64(0)), axis=1, out=self.prefix[:, 1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of rows a and b, by binary search over the prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        for _ in range(int(self.bytes.shape[1]).bit_length()):
            mid = (low + high + 1) // 2
            same = self.prefix[a, mid] == self.prefix[b, mid]
            low = np.where(same, mid, low)
            high = np.where(same, high, np.maximum(low, mid - 1))
        return low

    def below(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether row a sorts before row b; equal strings as ``ties`` says."""
        n = self.common(a, b)
        last = self.bytes.shape[1] - 1
        x = np.where(n < self.size[a], self.bytes[a, np.minimum(n, last)].astype(np.int64), -1)
        y = np.where(n < self.size[b], self.bytes[b, np.minimum(n, last)].astype(np.int64), -1)
        return (x < y) | ((x == y) & ties)

    def order(self, first: np.ndarray) -> np.ndarray:
        """Rows sorted inside each group (groups lie together; ``first``: the first row of each), by bottom-up merge sort."""
        n = len(self.size)
        order = np.arange(n)
        counts = np.diff(np.append(first, n))
        base, local = np.repeat(first, counts), np.arange(n) - np.repeat(first, counts)
        total = np.repeat(counts, counts)
        width = 1
        while width < (counts.max() if n else 0):
            active = np.flatnonzero(total > width)
            run = local[active] // width
            other = (run ^ 1) * width
            low = np.minimum(other, total[active])
            start, high = low.copy(), np.minimum(other + width, total[active])
            right = run % 2 == 1
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                theirs, mine = order[base[active[open_]] + mid], order[active[open_]]
                less = self.below(theirs, mine, right[open_])
                low[open_] = np.where(less, mid + 1, low[open_])
                high[open_] = np.where(less, high[open_], mid)
            place = base[active] + (run // 2) * 2 * width + local[active] % width + (low - start)
            merged = order.copy()
            merged[place] = order[active]
            order = merged
            width *= 2
        return order

    def neighbours(self, order: np.ndarray) -> np.ndarray:
        """Common prefix of each sorted row with the one before it; every hash-found length is verified on the bytes."""
        a, b = order[:-1], order[1:]
        n = self.common(a, b)
        last = self.bytes.shape[1]
        differ = np.where(np.arange(last) < np.minimum(self.size[a], self.size[b])[:, None], self.bytes[a] != self.bytes[b], True)
        true = np.where(differ.any(1), differ.argmax(1), last)
        n = np.where(true < n, true, n)  # a collision of hashes claims too much
        return np.append(0, n)


def _compare(anchor: np.ndarray, many: np.ndarray, before: np.ndarray, starts: np.ndarray, sizes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each piece a row of SPAN marks: whether the string that starts t bytes before the anchor occurs twice.

    many: whether the piece stands for several of its batch; before: bytes before the anchor; starts: number of starts.
    """
    n = len(anchor)
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(anchor, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(anchor[order]) != 0)) if n else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    middle = (begin + before)[order]
    right = Suffixes(text, middle, (sizes - before)[order], LENGTH, False)
    left = Suffixes(text, middle, before[order], SPAN, True)
    classes = []
    for side in (right, left):
        rows = side.order(first)
        shared = side.neighbours(rows)
        shared[np.append(True, group[rows[1:]] != group[rows[:-1]])] = -1
        classes.append((rows, shared))
    high = before[order]
    low = high - starts[order] + 1
    several = many[order] > 0
    out = np.zeros((n, SPAN), bool)
    number = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    for t in range(SPAN):
        use = np.flatnonzero((low <= t) & (t <= high))
        if not len(use):
            continue
        for k, least in ((0, LENGTH - t), (1, t)):
            rows, shared = classes[k]
            number[k][rows] = np.cumsum(shared < least)
        key = number[0][use] * (n + 1) + number[1][use]
        s = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.append(True, key[s][1:] != key[s][:-1]))
        times = np.diff(np.append(cut, len(use)))
        out[use[s], t] = np.repeat(times > 1, times)
        out[use, t] |= several[use]
    result = np.empty_like(out)
    result[order] = out
    return result


def _at(asking, level: int):
    """``asking`` at one level, with the two parameters that a cogrouped function has."""

    def ask_again(rows: pa.Table, answers: pa.Table) -> pa.Table:
        return asking(level, rows, answers)

    return ask_again


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary: what remains may split characters) of every whole text.

    A byte goes where a string of 200 bytes over it also starts anywhere else in the table, the same document included;
    every occurrence goes. A null text is empty; texts under 200 bytes stay whole. Repeated rows are repeats of each
    other, whatever their doc_ids, which may be null. An empty table gives no rows; other columns don't matter.
    """
    return _run(docs, with_text=True)


def digests(docs: DataFrame) -> DataFrame:
    """``removals`` without what is kept."""
    return _run(docs, with_text=False)


def _run(docs: DataFrame, with_text: bool) -> DataFrame:
    docs = id_and_text(docs)
    rows, size = volume(docs)
    bits = range_bits(size // 40)
    string_bits = range_bits(size // 4)
    stretch_bits = min(28, (size // 4_000_000).bit_length())
    n = n_batches(rows, size)
    docs = stored_by(hash_batches(docs, n), "batch", n)

    run, most = RUN, HOT  # as they are in the driver

    def walk(b: Batch, answers: pa.Table | None, level: int) -> tuple[list[Pieces], list[np.ndarray], Pieces]:
        """Pieces of the levels before ``level`` that are to be compared, the answer of each, and the pieces left for ``level``."""
        left, done, codes = b, [], []
        for i in range(level):
            _, _, number = left.anchors()
            code = collect_answers(answers, _ANCHOR + i)[number]
            fit = np.flatnonzero((code != _ALONE) & (code != _CUT))
            done.append(left.take(fit))
            codes.append(code[fit])
            left = left.take(np.flatnonzero(code == _CUT))
            if not len(left.begin):
                break
            left = left.cut(WIDTHS[i + 1])
        return done, codes, left

    def ask_level(level: int, rows: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        if not len(rows):
            return table([], ASK_NAMES, ASK)
        _, _, left = walk(Batch(rows), answers, level)
        if not len(left.begin):
            return table([], ASK_NAMES, ASK)
        keys, marks, _ = left.anchors()
        return table(ask(rows["batch"][0].as_py(), _ANCHOR + level, keys, marks, string_bits if level else bits, wide=level > 0), ASK_NAMES, ASK)

    def shared(b: Batch, answers: pa.Table) -> tuple[Pieces, np.ndarray, np.ndarray]:
        """Pieces to compare, the answer and the name of each."""
        done, codes, _ = walk(b, answers, len(WIDTHS))
        join = lambda f: np.concatenate([getattr(p, f) for p in done])
        p = Pieces(b.data, b.strings, *map(join, ("anchor", "place", "begin", "end")))
        return p, np.concatenate(codes), p.verified_names(np.arange(len(p.begin)))

    def stretches(rows: pa.Table, answers: pa.Table) -> pa.Table:
        names = STRETCH.replace(",", "").split()[::2]
        if not len(rows):
            return table([], names, STRETCH)
        b, batch = Batch(rows), rows["batch"][0].as_py()
        p, code, name = shared(b, answers)
        key, where, times = np.unique(name, return_index=True, return_counts=True)
        p, code = p.take(where), code[where]
        far, near = np.flatnonzero((code == _MEET) | (code == _FIRST)), np.flatnonzero((code == _IN_RUN) | (code == _FIRST))
        group = np.concatenate([p.anchor[far], mix(p.anchor[near] + np.uint64(batch // run + 1))])
        which = np.concatenate([far, near])
        part = (group >> np.uint64(64 - stretch_bits)).astype(np.int64) if stretch_bits else np.zeros(len(which), np.int64)
        order = np.argsort(part, kind="stable")  # by part, then by name
        which, part, group = which[order], part[order], group[order]
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
        out, raw = [], b.data.tobytes()
        for i, j in zip(edges, edges[1:], strict=False):
            w = which[i:j]
            before, size = p.place[w] - p.begin[w], p.end[w] - p.begin[w] + LENGTH - 1
            texts = b"".join([raw[x : x + n] for x, n in zip(p.begin[w].tolist(), size.tolist(), strict=True)])
            out.append((int(part[i]), batch, group[i:j].tobytes(), key[w].tobytes(), (times[w] > 1).astype(np.uint8).tobytes(), before.astype(np.uint8).tobytes(), size.astype(np.uint16).tobytes(), texts))
        return table(out, names, STRETCH)

    def compared(rows: pa.Table) -> pa.Table:
        get = lambda c, t: np.frombuffer(b"".join(rows[c].to_pylist()), t)
        sizes = get("sizes", np.uint16).astype(np.int64)
        marks = _compare(get("anchors", np.uint64), get("many", np.uint8), get("before", np.uint8).astype(np.int64), sizes - LENGTH + 1, sizes, get("texts", np.uint8))
        packed = np.packbits(marks, axis=1)
        counts = [len(x) // 8 for x in rows["anchors"].to_pylist()]
        ends = np.cumsum(counts).tolist()
        return pa.table([rows["batch"], rows["names"], pa.array([packed[a:z].tobytes() for a, z in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())], ["batch", "names", "marks"])

    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        b = Batch(rows)
        p, _, name = shared(b, answers)
        known = answers.filter(pa.compute.is_valid(answers["marks"]))
        names = np.frombuffer(b"".join(known["names"].to_pylist()), np.uint64)
        marks = np.frombuffer(b"".join(known["marks"].to_pylist()), np.uint8).reshape(-1, BITS)
        go = np.zeros(0, np.int64)
        if len(name):
            order = np.argsort(names)
            first = np.flatnonzero(np.append(True, np.diff(names[order]) != 0))
            marks = np.bitwise_or.reduceat(marks[order], first, axis=0)  # a string that met others in two groups
            marks = np.unpackbits(marks[np.searchsorted(names[order][first], name)], axis=1)[:, :SPAN]
            at = p.starts(np.arange(len(name)))
            row = np.repeat(np.arange(len(name)), p.end - p.begin)
            go = at[marks[row, p.place[row] - at] > 0]
        edge = np.zeros(len(b.data) + 1, np.int32)
        np.add.at(edge, go, 1)
        np.add.at(edge, go + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out, raw = [], b.data.tobytes()
        for a, z in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist(), strict=True):
            g = gone[a:z]
            removed = int(g.sum())
            kept = b.data[a:z][~g].tobytes() if removed else raw[a:z]
            spans = int((g[1:] & ~g[:-1]).sum()) + int(g[0]) if removed else 0
            out.append((z - a, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        n, removed, spans, sha, kept = zip(*out, strict=True)
        columns = {"doc_id": b.rows["doc_id"], "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(columns | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    texts = lambda: docs.groupBy("batch")
    anchors = stored(answered(texts().applyInArrow(lambda rows: ask_level(0, rows), ASK), {_ANCHOR: (False, partial(_anchor_counts, most=most))}))
    for level in range(1, len(WIDTHS)):
        again = (F.col("kind") == _ANCHOR + level - 1) & (F.instr(F.col("answers").cast("string"), chr(_CUT)) > 0)
        if anchors.where(again).isEmpty():
            break
        reply = partial(_anchor_counts, most=most) if WIDTHS[level] > 1 else partial(_string_counts, run=run)
        asked = texts().cogroup(anchors.groupBy("batch")).applyInArrow(_at(ask_level, level), ASK)
        anchors = anchors.unionByName(stored(answered(asked, {_ANCHOR + level: (True, reply)})))
    marks = texts().cogroup(anchors.groupBy("batch")).applyInArrow(stretches, STRETCH).groupBy("part").applyInArrow(compared, "batch long, names binary, marks binary")
    answers = anchors.unionByName(marks, allowMissingColumns=True)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return texts().cogroup(answers.groupBy("batch")).applyInArrow(remove, out)
