"""The operators on single texts against plain versions of their contracts."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecmill.llm import bpe, decontaminate, substrings, suffixes, token_counts

from .conftest import same

RANKS, LIBRARY = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("tiktoken", "json"))
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- repeated words and bytes
def plain_words(rows, window=13):
    where = defaultdict(set)
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, ws in split:
        for k in range(len(ws) - window + 1):
            if i is not None:
                where[tuple(ws[k : k + window])].add(i)
    out = []
    for i, ws in split:
        gone = set()
        for k in range(len(ws) - window + 1):
            if i is not None and min(where[tuple(ws[k : k + window])]) < i:
                gone.update(range(k, k + window))
        out.append((i, len(ws), len(gone), sha(" ".join(w for k, w in enumerate(ws) if k not in gone))))
    return out


def test_substring_dedup(docs, rows):
    same(substrings.digests(docs).collect(), plain_words(rows))
    kept = substrings.removals(docs).collect()
    same([(r["doc_id"], r["n_words"], r["n_removed"], sha(r["kept"])) for r in kept], plain_words(rows))


def test_substring_dedup_of_planted_passages(spark):
    rng = np.random.default_rng(1)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared, rows = word(60), []
    for i in range(40):
        a, n = int(rng.integers(0, 40)), int(rng.integers(9, 20))
        rows.append((i, " ".join(word(int(rng.integers(0, 30))) + shared[a : a + n] + word(int(rng.integers(0, 9))))))
    same(substrings.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect(), plain_words(rows))
    # the same over many batches
    import vecmill.llm.substrings as s

    old, s.n_batches = s.n_batches, lambda *_: 7
    try:
        same(substrings.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect(), plain_words(rows))
    finally:
        s.n_batches = old


def plain_bytes(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    times = defaultdict(int)
    for _, b in raw:
        for k in range(len(b) - length + 1):
            times[hash(b[k : k + length])] += 1
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if times[hash(b[k : k + length])] > 1:
                gone[k] += 1
                gone[min(len(b), k + length)] -= 1
        g = np.cumsum(gone[: len(b)]) > 0
        spans = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        out.append((i, len(b), int(g.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~g]))))
    return out


@pytest.mark.parametrize("hot", [16_384, 3])
def test_suffix_dedup(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "n_batches", lambda *_: 5)
    same(suffixes.digests(docs).collect(), plain_bytes(rows))


def test_a_frequent_passage_is_sorted_too(spark, monkeypatch):
    """5,000 copies of a passage, whole or cut, between words of their own: all through the suffix sort."""
    monkeypatch.setattr(suffixes, "n_batches", lambda *_: 12)
    rng = np.random.default_rng(9)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    passage = word(90)
    rows = [(i, f"{word(int(rng.integers(0, 12)))} {passage[int(rng.integers(0, 3)) * 100 :]} {word(int(rng.integers(0, 12)))}") for i in range(5000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    same(suffixes.digests(table).collect(), plain_bytes(rows))
    b = suffixes.Batch(pa.table({"text": [t for _, t in rows[:400]]}))
    keys, marks, number = b.anchors()
    assert (marks >= suffixes._TWICE).any() and (suffixes._anchor_counts(keys, marks, marks, np.arange(len(keys))) < 2).all()
    assert len(np.unique(b.verified_names(np.arange(len(b.begin))))) == len(np.unique(b.names(np.arange(len(b.begin)))))


def test_single_strings_meet_in_runs_of_batches(spark, monkeypatch):
    """A passage in every batch, cut down to single strings, with a copy that only one far batch holds and one that two hold."""
    monkeypatch.setattr(suffixes, "n_batches", lambda *_: 12)
    monkeypatch.setattr(suffixes, "HOT", 3)
    rng = np.random.default_rng(21)
    letters = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    passage, rare = letters(430), letters(260)
    rows = [(i, letters(int(rng.integers(0, 90))) + passage[int(rng.integers(0, 150)) : int(rng.integers(300, 430))] + letters(70)) for i in range(150)]
    rows += [(200 + i, letters(40) + rare[i * 20 :] + letters(30)) for i in range(4)] + [(300, rare[:150] + letters(80) + passage[:250])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for run in (1, 2, 5, 4096):
        monkeypatch.setattr(suffixes, "RUN", run)
        same(suffixes.digests(table).collect(), plain_bytes(rows))


def test_texts_are_dealt_out_once(docs, monkeypatch):
    """However often anchors are cut, no scan but the first shuffles texts."""
    monkeypatch.setattr(suffixes, "n_batches", lambda *_: 5)
    monkeypatch.setattr(suffixes, "HOT", 3)
    plans, keep = [], suffixes.answered
    monkeypatch.setattr(suffixes, "answered", lambda asked, replies: plans.append(asked) or keep(asked, replies))
    plans.append(suffixes.digests(docs))
    assert len(plans) > 3
    for plan in plans:
        lines = plan._jdf.queryExecution().executedPlan().toString().splitlines()
        scans = [i for i, x in enumerate(lines) if "FileScan" in x and "text#" in x]
        assert scans
        for i in scans:  # the first that isn't a row-wise step, going up from a scan of texts, is what takes them
            above = next(x for x in reversed(lines[:i]) if not any(k in x for k in ("Project", "Sort", "ColumnarToRow", "Filter")))
            assert "InArrow" in above and "Bucketed: true" in lines[i]


def test_an_anchor_in_50_000_different_stretches(spark):
    """A phrase that anchors every text, between letters of their own: cut into longer names, none of which is frequent."""
    rng = np.random.default_rng(22)
    letters = lambda n: bytes(rng.integers(97, 123, n, np.uint8))
    many = letters(2_000_000)
    at = int(suffixes._rolling(np.frombuffer(many, np.uint8)[: 1 << 20])[0].argmin())
    phrase = many[at : at + suffixes.GRAM]
    texts = [letters(150) + phrase + letters(150) for _ in range(50_000)]
    b = suffixes.Batch(pa.table({"text": [t.decode() for t in texts[:1000]]}))
    assert np.unique(b.anchor, return_counts=True)[1].max() > 950
    for k in range(0, 400, 2):
        texts[-k - 1] = letters(89) + b"-" + texts[k][90:]  # a byte that the other text never has there
    found = suffixes.digests(spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()
    copied = {*range(0, 400, 2), *(len(texts) - k - 1 for k in range(0, 400, 2))}
    same(found, [(i, 332, 242 if i in copied else 0, int(i in copied)) for i in range(len(texts))])


def test_names_that_collide_are_told_apart(monkeypatch):
    texts = ["a" * 150 + "b" * 150, "a" * 150 + "c" * 150] * 2
    b = suffixes.Batch(pa.table({"text": texts}))
    monkeypatch.setattr(suffixes.Batch, "names", lambda self, which: np.zeros(len(which), np.uint64))
    which = np.flatnonzero(b.end - b.begin == (b.end - b.begin)[0])
    name = b.verified_names(which)
    text = [bytes(b.data[b.begin[w] : b.end[w] + suffixes.LENGTH - 1]) for w in which]
    zero = [t for t, n in zip(text, name, strict=True) if not n]
    assert len(set(zero)) == 1 and len(set(name[name > 0])) == (name > 0).sum()


def test_cells_hold_each_start_once_under_the_name_of_its_string():
    rng = np.random.default_rng(23)
    copy = bytes(rng.integers(97, 100, 500, np.uint8)).decode()
    b = suffixes.Batch(pa.table({"text": [copy, "x" * 60 + copy[100:450], copy[:330] + "yz" * 90]}))
    every = np.sort(b.starts(np.arange(len(b.begin))))
    left = b
    for width in suffixes.WIDTHS[1:]:
        left = left.cut(width)
        assert (left.end - left.begin).max() <= width and (np.sort(left.starts(np.arange(len(left.begin)))) == every).all()
    string = [bytes(b.data[x : x + suffixes.LENGTH]) for x in left.begin]
    assert len(set(zip(string, left.anchor.tolist(), strict=True))) == len(set(string)) == len(set(left.anchor.tolist()))


def test_suffix_order_is_the_sorted_order():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 900).astype(np.uint8)
    begin = rng.integers(0, 800, 200)
    size = rng.integers(1, 90, 200)
    s = suffixes.Suffixes(text, begin, size, 90, False)
    got = [bytes(text[begin[i] : begin[i] + size[i]]) for i in s.order(np.array([0]))]
    assert got == sorted(got)
    for a, b, n in zip(got, got[1:], s.neighbours(s.order(np.array([0])))[1:], strict=False):
        k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert k == n


# ---------------------------------------------------------------- tokens
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows):
    library = tiktoken_encoding()
    wanted = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        wanted.append((i, len(ids), sha(" ".join(map(str, ids))), sha((t or "").encode())))
    same(bpe.digests(docs, RANKS).collect(), wanted)
    whole = bpe.encoded(docs, RANKS).collect()
    same([(r["doc_id"], r["n_tokens"], sha(r["ids"]), sha(bytes(r["decoded"]))) for r in whole], wanted)
    full = bpe.with_tokens(docs, RANKS)
    same([(r["doc_id"], r["text"]) for r in full.collect()], rows)
    same([(r["doc_id"], r["n_tokens"], sha(" ".join(map(str, r["token_ids"])))) for r in full.collect()], [w[:3] for w in wanted])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab  '\n\tstreldv.1²é　\x85"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_bpe_of_any_text(text):
    _, ids, raw = next(bpe.Encoder(RANKS).texts([text]))
    assert [int(x) for x in ids.split()] == tiktoken_encoding_cached().encode_ordinary(text) and raw.decode() == text


def tiktoken_encoding_cached(kept=[]):  # noqa: B006
    kept or kept.append(tiktoken_encoding())
    return kept[0]


def test_long_pre_tokens():
    r = bpe.ranks(RANKS)
    rng = np.random.default_rng(2)
    for n in (1, 2, 127, 128, 129, 1000, 4097):
        word = bytes(rng.choice(list(b"aeio"), n).astype(np.uint8))
        want = tiktoken_encoding_cached()._encode_single_piece(word)
        assert bpe.encode_words([word], r) == [want] and bpe.encode_long(word, r) == want


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(LIBRARY)
    wanted = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        wanted.append((i, len((t or "").encode()), n, n > 1024))
    same(token_counts.token_counts(docs, LIBRARY).collect(), wanted)


# ---------------------------------------------------------------- benchmark
def plain_contamination(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = defaultdict(set)
    for item, text in items:
        ws = words(text)
        n = min(13, len(ws))
        for k in range(len(ws) - n + 1) if n else ():
            held[tuple(ws[k : k + n])].add(item)
    sizes = {len(w) for w in held}
    out = []
    for i, t in rows:
        ws, hit, its = words(t), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if found := held.get(tuple(ws[k : k + n])):
                    hit.update(range(k, k + n))
                    its |= found
        out.append((i, len(ws), len(hit), len(its), sorted(its), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


@pytest.mark.parametrize(("block", "blocks"), [(2_000_000, 8), (3_000, 8), (2_500, 2)])
def test_decontamination(spark, docs, rows, block, blocks, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", blocks)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    some = [r["text"] for r in bench.limit(3).collect()]
    more = spark.createDataFrame([("short", "TWO, Words!"), ("nothing", "..."), ("null", None), ("again", some[0])], "item_id string, text string")
    bench = bench.select(F.col("item_id").cast("string").alias("item_id"), "text").union(more).withColumn("part", F.lit(1))
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    found = decontaminate.contamination(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect()
    same(found, plain_contamination(rows, items))
    kept = decontaminate.clean(docs, bench)
    same([(r["doc_id"], r["text"]) for r in kept.collect()], [r for r, w in zip(rows, plain_contamination(rows, items), strict=True) if not w[5]])


def test_hit_spans_lead_to_the_original_text(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(1, "Before: ONE, two - three\tfour FIVE six seven; eight nine ten eleven twelve thirteen! after")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    ((_, spans),) = decontaminate.hit_spans(docs, bench).collect()
    text = docs.first()["text"]
    assert [text[s["start"] : s["end"]] for s in spans] == ["ONE, two - three\tfour FIVE six seven; eight nine ten eleven twelve thirteen"]
    empty = bench.limit(0)
    assert [tuple(r) for r in decontaminate.contamination(docs, empty).select("n_hit", "n_items", "contaminated").collect()] == [(0, 0, False)]


def test_a_full_block_of_benchmark(spark, none):
    """The automaton of one block takes a bounded part of a worker's memory, and finds what is planted."""
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(97, 123, int(rng.integers(3, 9))))) for _ in range(40_000)]
    items, size = [], 0
    while size < decontaminate.BLOCK_BYTES:
        text = " ".join(rng.choice(words, 400))
        items.append((f"item{len(items)}", text))
        size += len(text)
    used = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6
    before = used()
    machine = decontaminate.automaton(tuple(items))
    assert used() - before < 350, used() - before
    noise = lambda n: [f"x{i}" for i in rng.integers(0, 10**6, n)]
    own = [t.encode() for t in items[7][1].split()[100:130]]
    text = [w.encode() for w in noise(50)] + own + [w.encode() for w in noise(9)] + own[:12]
    hit, names = decontaminate.hits(text, machine)
    assert np.flatnonzero(hit).tolist() == list(range(50, 80)) and names == {"item7"}
    decontaminate.automaton.cache_clear()
    bench = spark.createDataFrame(items[:2], "item_id string, text string")
    assert decontaminate.contamination(none, bench).collect() == decontaminate.hit_spans(none, bench).collect() == decontaminate.clean(none, bench).collect() == []


def test_empty_tables(none):
    assert substrings.digests(none).collect() == suffixes.digests(none).collect() == bpe.digests(none, RANKS).collect() == token_counts.token_counts(none, LIBRARY).collect() == []
