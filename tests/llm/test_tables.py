"""The operators on tables: languages, near copies, vectors, shards and the pipeline against plain versions."""

from __future__ import annotations

import binascii
import itertools
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

from vecmill.llm import common, embeddings, graph, langid, shards, simhash

from .conftest import same


def classes(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# ---------------------------------------------------------------- languages
def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: r for r in langid.languages(docs).collect()}
    known = {r["doc_id"]: r for r in docs.collect()}
    assert found.keys() == known.keys()
    right = []
    for i, r in found.items():
        assert r["held_out"] == (binascii.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        text = known[i]["text"]
        if not text or not any(map(str.isalpha, text)):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and known[i]["lang"] is not None and len(text) > 60:
            right.append(r["lang_pred"] == known[i]["lang"])
    assert len(right) > 100 and np.mean(right) > 0.95, np.mean(right)


def test_mixture_of_two_languages():
    rng = np.random.default_rng(4)
    vocabularies = {k: ["".join(rng.choice(list(a), int(rng.integers(3, 8)))) for _ in range(200)] for k, a in {"x": "abcdefg", "y": "hijklmn", "z": "opqrstu"}.items()}
    words = lambda k, n: " ".join(rng.choice(vocabularies[k], n))
    counts = np.full((langid.PLACES, 3), langid.SMOOTH)
    for j, k in enumerate("xyz"):
        code, _, _ = langid.trigrams([words(k, 3000)])
        counts[:, j] += np.bincount(code, minlength=langid.PLACES)
    model = langid.Model(tuple("xyz"), np.log(counts / counts.sum(0)).astype(np.float32))
    (one, s1, p1), (two, s2, p2), (none, s3, p3) = langid.predict([words("x", 80), words("y", 70) + " " + words("z", 30), "12 ?"], model)
    assert (one, set(p1)) == ("x", {"x"}) and s1 == 1.0
    assert two == "y" and set(p2) == {"y", "z"} and abs(p2["y"] - 0.7) < 0.1 and abs(s2 - 0.7) < 0.1
    assert (none, s3, p3) == ("und", 0.0, {})


def plain_prediction(text, model):
    """EM and selection in loops: (penalised value of each nested set, its proportions), the largest value first."""
    data = b" " + text.lower().encode() + b" "
    data = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in data)
    words, k = [], len(model.languages)
    for m in re.finditer(rb"[^ ]+", data):
        places = [(((data[i - 1] << 16) | (data[i] << 8) | data[i + 1]) * 2654435761 % 2**32) >> 16 for i in range(m.start(), m.end())]
        words.append([sum(float(model.table[p, j]) for p in places) for j in range(k)])
    like = [[math.exp(max(x - max(w), -30)) for x in w] for w in words]

    def mixture(allowed):
        share = [1 / len(allowed) if j in allowed else 0.0 for j in range(k)]
        for _ in range(langid.ROUNDS):
            part = [[w[j] * share[j] for j in range(k)] for w in like]
            part = [[x / sum(p) for x in p] for p in part]
            share = [sum(p[j] for p in part) / len(part) for j in range(k)]
        return share, sum(math.log(max(sum(w[j] * share[j] for j in range(k)), 1e-30)) for w in like)

    penalty = langid.PENALTY * 0.5 * math.log(len(words) + 1)
    order = sorted(range(k), key=lambda j: -mixture(range(k))[0][j])
    single = [sum(math.log(w[j]) for w in like) for j in range(k)]
    top = max(range(k), key=lambda j: single[j])
    nested = [(single[top], {top: 1.0})]
    for size in range(2, k + 1):
        share, total = mixture(order[:size])
        nested.append((total - (size - 1) * penalty, {j: share[j] for j in order[:size]}))
    every = [(mixture(s)[1] if len(s) > 1 else single[s[0]]) - (len(s) - 1) * penalty for n in range(1, k + 1) for s in itertools.combinations(range(k), n)]
    return max(nested, key=lambda v: v[0]), max(every)


def test_mixtures_against_plain_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train_on(docs)
    texts = [r["text"][:1500] for r in docs.where("text rlike '[A-Za-z]{3}'").orderBy("doc_id").limit(24).collect()]
    rng = np.random.default_rng(12)
    texts += [" ".join(t[: int(rng.integers(40, 400))] for t in rng.choice(texts, int(rng.integers(2, 4)), replace=False)) for _ in range(16)]
    best_of_all = 0
    for text, (lang, score, parts) in zip(texts, langid.predict(texts, model), strict=True):
        (value, wanted), overall = plain_prediction(text, model)
        assert set(parts) == {model.languages[j] for j in wanted}
        assert all(abs(parts[model.languages[j]] - x) < 1e-3 for j, x in wanted.items())
        assert lang == max(parts, key=parts.get) and abs(score - parts[lang]) < 1e-9
        best_of_all += value >= overall - 1e-6
    assert best_of_all >= 0.9 * len(texts)  # the nested sets hold the best of all sets


def test_every_label_is_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}zz " * 30, f"l{i:03}") for i in range(230)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == tuple(r[2] for r in rows)
    assert langid.predict([rows[7][1]], model)[0][0] == "l007"


def test_languages_of_odd_rows(docs, rows, none):
    found = langid.languages(docs).collect()
    same([(r["doc_id"],) for r in found], [(i,) for i, _ in rows])
    assert {r["lang_pred"] for r in found} == {"xx", "und"}
    assert langid.languages(none).collect() == [] and langid.accepted(docs).columns == docs.columns
    nothing = langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


# ---------------------------------------------------------------- SimHash
def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    n = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=2):
    values = np.array(fps, np.uint64)
    links = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius)]
    part = classes(len(fps), links)
    low = defaultdict(list)
    for i, p in zip(ids, part, strict=True):
        if i is not None:
            low[p].append(i)
    return [min(low[p]) if low[p] else None for p in part]


def test_simhash(docs, rows, none):
    fps = [plain_fingerprint(t) for _, t in rows]
    wanted = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, plain_components([i for i, _ in rows], fps), strict=True)]
    same(simhash.near_duplicates(docs).collect(), wanted)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    stays = {w[0] for w in wanted if w[0] is not None and w[0] == w[2]}
    got = [r["doc_id"] for r in kept.collect()]
    assert {i for i in got if i is not None} == stays
    assert simhash.near_duplicates(none).collect() == [] and simhash.one_of_each(none).collect() == []


@pytest.mark.parametrize("leaf", [8192, 64])
def test_links_of_close_fingerprints(spark, leaf, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "DIRECT", 50)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = {0, 1, 3, 2**64 - 1}
    for x in base.tolist():
        for _ in range(20):  # chains of small steps, and steps just too far
            fps.add(x)
            for b in rng.choice(64, int(rng.integers(1, 4)), replace=False).tolist():
                x ^= 1 << b
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    edges = [(r["a"], r["b"]) for r in simhash.linked(table).collect()]
    at = {x: i for i, x in enumerate(signed)}
    values = np.array(fps, np.uint64)
    links = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2)]
    assert classes(len(fps), links) == classes(len(fps), [(at[a], at[b]) for a, b in edges])


def test_components(spark):
    rng = np.random.default_rng(7)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2300)] + [(5, 5)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    part = classes(2400, links)
    assert got == {i: part[i] for a, b in links if a != b for i in (a, b)}


# ---------------------------------------------------------------- embeddings
def plain_vectors(rows, cosine=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = [np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok]
    exact = lambda v: [Fraction(c) for c in v]

    def linked(i, j, near):
        if abs(near - cosine) > 1e-9:
            return near > cosine
        a, b = exact(rows[i][1]), exact(rows[j][1])
        dot = sum(p * q for p, q in zip(a, b, strict=True))
        return dot > 0 and dot**2 >= Fraction(cosine) ** 2 * sum(p * p for p in a) * sum(q * q for q in b)

    links = [(a, b) for k, a in enumerate(ok) for m, b in enumerate(ok[:k]) if len(x[k]) == len(x[m]) and linked(a, b, float(x[k] @ x[m]))]
    n = Counter(i for p in links for i in p)
    part = classes(len(rows), links)
    low = defaultdict(list)
    for i, p in enumerate(part):
        if rows[i][0] is not None:
            low[p].append(rows[i][0])
    low = [min(low[p]) if low[p] else None for p in part]
    return [(v, n[i], low[i], v == low[i]) for i, (v, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [4096, 16])
def test_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(60):
        c = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((len(rows), (c + rng.normal(size=24) * rng.uniform(0, 0.28)).tolist()))
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1001, rows[0][1]), (1002, [2 * x for x in rows[1][1]]), (1003, None), (1004, []), (1005, [0.0] * 24), (1006, [None] + [1.0] * 23), (1007, [float("nan")] * 24), (1008, [float("inf")] * 24), (1009, [1.0, 2.0]), (1010, [1.0, 2.1]), (None, rows[2][1]), (1011, [1e300] * 24), (1012, [2e300] * 24), (1013, [1e-300] * 24)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("node", F.lit("x")).repartition(3)
    found = [tuple(r) for r in embeddings.near_duplicates(table).collect()]
    wanted = plain_vectors([(i, [x / max(abs(y) for y in v) for x in v] if v and all(x is not None and math.isfinite(x) for x in v) and any(v) else v) for i, v in rows])
    links = lambda rs: sum(r[1] for r in rs)
    assert len(found) == len(wanted) and links(found) <= links(wanted) and links(found) >= 0.9 * links(wanted), (links(found), links(wanted))
    if links(found) == links(wanted):
        same(found, wanted)
    assert embeddings.near_duplicates(table.limit(0)).collect() == []


def test_the_threshold_is_exact(spark, monkeypatch):
    """Cosines of exactly 19/20, and a hair less, in many scales and signs of the same integers; all pairs are compared."""
    monkeypatch.setattr(embeddings, "plan", lambda *_: ([(0, 0, 1)], 1))
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        y = [19.0, 6.0, 1.0, 1.0, 1.0] if k % 2 else [19.0, 6.0, 1.0, 1.0, 1.0 + 2e-14]  # of length 20, or a little over
        order = rng.permutation(4)
        for v in ([1.0, 0, 0, 0, 0], [y[0], *(y[1 + o] * rng.choice([-1, 1]) for o in order)]):
            e = np.zeros(64)
            e[5 * (k % 12) : 5 * (k % 12) + 5] = v
            rows.append((2 * k if len(rows) % 2 == 0 else 2 * k + 1, (e * 10.0 ** int(rng.integers(-3, 4))).tolist()))
    assert embeddings.reaches(np.array([1.0, 0, 0, 0, 0]), np.array([19.0, 6, 1, 1, 1]), 0.95)
    assert not embeddings.reaches(np.array([1.0, 0, 0, 0, 0]), np.array([19.0, 6, 1, 1, 1 + 1e-13]), 0.95)
    found = [tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    same(found, plain_vectors(rows))


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    left = spark.createDataFrame([(k % 3 if k < 200 else k, k) for k in range(260)] + [(None, 1)], "key long, x long")
    right = spark.range(300).selectExpr("id AS key", "id * 2 AS y")
    found = common.skew_join(left, right, "key")
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()
    same(found.collect(), left.join(right, "key").collect())


def test_pieces_and_leaves_grow_with_the_rows():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 64))
    coder = embeddings.Coder({64: v})
    for rows in (10_000, 10**8, 10**10):
        tables, radius = embeddings.plan(rows, coder, v, 0.95)
        assert min(size for _, _, size in tables) >= min(21, round(math.log2(rows / embeddings.FILL)))
        assert radius in (0, 1)
    deep = simhash.Tree(rng.integers(0, 2**63, 200_000, dtype=np.uint64), 10**9)
    assert deep.leaves > 4096


def test_embeddings_of_the_shipped_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = embeddings.near_duplicates(table).collect()
    rows = table.select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert sum(r["n_links"] for r in found) >= 0.9 * int(((x @ x.T) >= 0.95).sum() - len(x))
    assert len(found) == len(rows)


# ---------------------------------------------------------------- shards
def hilbert_cells(bits, dims, spark):
    side = 1 << bits
    cells = spark.range(side**dims).select(F.array(*[F.floor(F.col("id") / side**d).cast("long") % side for d in range(dims)]).alias("cell"))
    return sorted(map(tuple, cells.select(shards.hilbert(F.col("cell"), dims, bits).alias("at"), "cell").collect()))


@pytest.mark.parametrize(("bits", "dims"), [(3, 2), (2, 3), (4, 3)])
def test_hilbert_order_moves_one_step_at_a_time(spark, bits, dims):
    order = hilbert_cells(bits, dims, spark)
    assert [p for p, _ in order] == list(range((1 << bits) ** dims))
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for (_, a), (_, b) in zip(order, order[1:], strict=False))


def test_shards(docs, rows, none, spark):
    found = shards.assigned(docs).collect()
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in found], [(i, len((t or "").encode()) + 16, binascii.crc32((t or "").encode())) for i, t in rows])
    n = Counter(r["shard"] for r in found)
    assert set(n) <= set(range(40)) and max(n.values()) - min(n.get(s, 0) for s in range(40)) <= 1
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = [r["curve"] for r in sorted(found, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)
    assert shards.assigned(none).collect() == []
    assert sorted(r["shard"] for r in shards.assigned(docs.where("doc_id is not null").limit(3)).collect()) != [0, 0, 0]


def test_shards_on_disk(docs, rows, spark, tmp_path):
    """Whatever repeats, each row is written once, columns and all."""
    shards.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    same(back.select("doc_id", "text").collect(), rows)
    assert {r["shard"] for r in back.select("shard").distinct().collect()} == set(range(5)) and set(docs.columns) < set(back.columns)


def test_dimensions_are_ordered_by_whole_values(spark, monkeypatch):
    """Sources and languages of long common prefixes stand in cells of their own, also where values are numbered in slices."""
    from vecmill.functions import ranks

    stem = "https://a-long-common-prefix.example.org/" * 20
    rows = [(i, "text " * (i % 7), f"{stem}{i % 16:02d}", f"{stem[:300]}\u00e9{i % 4}") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for size in (200_000, 3):
        monkeypatch.setattr(ranks, "SLICE_ROWS", size)
        found = shards.assigned(docs).join(docs.select("doc_id", "source", "lang"), "doc_id")
        cells = found.groupBy("source", "lang").agg(F.collect_set("curve").alias("at")).collect()
        assert len(cells) == 16 and len({c for r in cells for c in r["at"]}) == sum(len(r["at"]) for r in cells)
    uneven = shards._cuts(spark.createDataFrame([("b",)] * 500 + [("a",)] * 20 + [(f"c{i:03d}",) for i in range(500)], "s string"), F.col("s"))
    assert uneven[0] == "b" and "a" not in uneven and len(uneven) == 8


def test_files_are_skipped_on_each_dimension(spark, tmp_path):
    """Parquet's own statistics exclude most shards for a filter on language, source or size, unlike those of a plain order."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shards.write_shards(docs, str(tmp_path / "curve"), 40)
    docs.repartitionByRange(40, "doc_id").withColumn("shard", F.spark_partition_id()).write.partitionBy("shard").parquet(str(tmp_path / "plain"))

    def read(name, column, values):
        """The part of the shards that a filter column = value has to read, on average."""
        spans = defaultdict(list)
        for path in (tmp_path / name).glob("shard=*/*.parquet"):
            meta = pq.ParquetFile(path).metadata
            at = meta.schema.to_arrow_schema().names.index(column)
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(at).statistics
                spans[path.parent.name] += [stats.min, stats.max] if stats is not None and stats.has_min_max else []
        return np.mean([sum(min(s) <= v <= max(s) for s in spans.values() if s) / len(spans) for v in values])

    for column, least in (("lang", 0.5), ("source", 0.5), ("n_chars", 0.5)):
        values = [r[0] for r in docs.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(50).collect()]
        curve, plain = read("curve", column, values), read("plain", column, values)
        assert curve <= least and curve < 0.7 * plain, (column, curve, plain)
