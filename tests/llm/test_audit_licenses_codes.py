"""Filter audit, licence scan and vector codes against plain versions of their contracts, and against their SQL."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vecmill.llm import codes, filters, licenses, queries

from .conftest import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def against_sql(spark, name, folder=SMALL):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    wanted = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    found = queries.queries()[name](spark, folder)
    assert sorted(columns) == sorted(found.columns)
    same(found.select(columns).collect(), wanted.fetchall())


# ---------------------------------------------------------------- filters
AUDIT = "part string, doc_id long, text string"


def plain_audit(rows, labels):
    """rows: (doc_id, text, lang); labels: doc_id -> (good, toxic). Every order is run over the documents."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        ws = WORD.findall(t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and t in first and first[t] < i}
        parts[lang or ""].append((fails, *labels.get(i, (False, False))))
    out = []
    for part, docs in parts.items():
        shapley, own = defaultdict(int), []
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                lost = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                failing = [d for d in docs if d[0][f]]
                alone = sum(sum(d[0].values()) == 1 for d in failing)
                shapley[f] += len(lost)
                own.append((f, (part, order, step, len(left), len(lost), len(failing) - len(lost), alone, sum(d[1] for d in lost), sum(d[2] for d in lost))))
        out += [(*r, shapley[f]) for f, r in own]
    return out


def test_audit_of_odd_rows(spark, rows, docs):
    named = [(i, t, "xx") for i, t in rows]
    marks = {rows[0][0]: (True, False), rows[1][0]: (False, True), rows[2][0]: (True, True), rows[3][0]: (False, False), rows[7][0]: (True, False)}
    table = [(i, int(g), int(t), "clash") for i, (g, t) in marks.items()] + [(None, 1, 1, "x"), (rows[3][0], 0, 1, "x"), (rows[4][0], None, None, "x")]
    marks[rows[3][0]] = (False, True)
    labels = spark.createDataFrame(table, "doc_id long, quality int, toxic int, kind string")
    same(filters.audit(docs, labels).collect(), plain_audit(named, marks))


@pytest.mark.parametrize("held", [1000, 2])
def test_audit_by_part(spark, held, monkeypatch):
    """Many parts, each failure alone and with others, copies across parts; counts that are sent on early."""
    monkeypatch.setattr(filters, "HELD_PARTS", held)
    rng = np.random.default_rng(11)
    rows = []
    for i in range(160):
        n = int(rng.choice([0, 5, 199, 200, 230]))
        ws = [f"w{k % (n // 2 if rng.random() < 0.3 and n > 9 else 10**6)}" for k in range(n)]
        text = " ".join(ws) + rng.choice(["", " $", " WORDS" * 30])
        rows.append((i, text if rng.random() < 0.7 else "a copy " * 3, rng.choice(["de", "en", "fr", "", None, "x y"])))
    marks = {i: (bool(rng.random() < 0.5), bool(rng.random() < 0.2)) for i in range(0, 160, 2)}
    docs = spark.createDataFrame([(i, t, None if p is None else str(p)) for i, t, p in rows], "doc_id long, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(i, int(g), int(t)) for i, (g, t) in marks.items()], "doc_id long, quality int, toxic int")
    same(filters.audit(docs, labels).collect(), plain_audit(rows, marks))


def test_audit_of_nothing(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit(none, labels).collect() == []
    one = filters.audit(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), labels).collect()
    assert len(one) == 600 and sum(r["removed"] for r in one) == 120 and {r["part"] for r in one} == {""}


def test_audit_against_sql(spark):
    against_sql(spark, "op11_filter_interactions")


# ---------------------------------------------------------------- licences
def plain_places(text):
    t = (text or "").translate({c: c + 32 for c in range(65, 91)})
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


LICENSED = [
    "MIT License; mit-license MIT LICENSE",
    "GNU General Public License. The Apache  License\nand CC BY-NC 4.0, cc-by",
    "gnu general public licenses, apache licensed, summit license",
    "// SPDX-License-Identifier: Apache-2.0 OR MIT",
    "é spdx-license-identifier: (GPL-2.0-only WITH Classpath-exception-2.0)\nmit license",
    'license = "BSD-3-Clause"',
    "License: see the file; the license.",
    "Permission is hereby granted, free of charge, to any person",
]


def test_license_base_of_odd_rows(spark, rows, docs, none):
    wanted = [(i, *plain_places(t)) for i, t in rows]
    found = licenses.scanned(docs)
    same(found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect(), wanted)
    own = [(i, t) for i, t in enumerate(LICENSED * 3 + [" ".join(LICENSED) * 200])]
    more = licenses.scanned(spark.createDataFrame(own, "doc_id long, text string"))
    same(more.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect(), [(i, *plain_places(t)) for i, t in own])
    for r in [*found.collect(), *more.collect()]:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert licenses.scanned(none).collect() == []


def test_license_labels(spark):
    found = {r["doc_id"]: r for r in licenses.scanned(spark.createDataFrame(list(enumerate(LICENSED)), "doc_id long, text string")).collect()}
    assert [found[i]["labels"] for i in range(8)] == ["mit", "apache,cc-by,cc-by-nc,gpl", "", "apache,mit", "gpl,mit", "bsd", "", "mit"]
    assert found[3]["score"] == 0.2 and found[4]["score"] == 0.4 and found[1]["score"] == 0.8
    spans = {r["doc_id"]: [(f["kind"], f["first"], f["end"]) for f in r["found"]] for r in licenses.notices(spark.createDataFrame(list(enumerate(LICENSED)), "doc_id long, text string")).collect()}
    assert spans[4] == [("expression", 1, 4), ("base", 13, 15)] and spans[5] == [("expression", 0, 1)]


def plain_expression(tokens):
    """Recursive descent over a list of tokens that is a whole expression."""

    def atom():
        if tokens[0] == "(":
            tokens.pop(0)
            out = either()
            assert tokens.pop(0) == ")"
        else:
            out = licenses.licence(tokens.pop(0))
        while tokens and tokens[0].lower() == "with":
            del tokens[:2]
            out = licenses.Value(out.labels, out.burden * licenses.EXCEPTED)
        return out

    def several(part, op, pick):
        out = part()
        while tokens and tokens[0].lower() == op:
            tokens.pop(0)
            b = part()
            out = licenses.Value(out.labels | b.labels, pick(out.burden, b.burden))
        return out

    either = lambda: several(lambda: several(atom, "and", max), "or", min)
    return either()


def test_expressions_against_recursive_descent():
    rng = np.random.default_rng(8)

    def made(depth):
        if depth == 0 or rng.random() < 0.25:
            out = [str(rng.choice(["MIT", "GPL-3.0-or-later", "Apache-2.0", "LGPL-2.1", "cc-by-sa-4.0", "LicenseRef-own", "AGPL-3.0", "BSD-2-Clause"]))]
        else:
            a, b = made(depth - 1), made(depth - 1)
            out = a + [str(rng.choice(["or", "AND", "And", "OR"]))] + b
            if rng.random() < 0.5:
                out = ["(", *out, ")"]
        return out + ["WITH", "own-exception-1"] if rng.random() < 0.15 and out[-1] in (")", *out[:1]) else out

    for _ in range(300):
        tokens = made(4)
        text = " ".join(tokens)
        value, end = licenses.expression(text + rng.choice(["", " and so on", " ) MIT", " or", " the rest (MIT)"]))
        assert value == plain_expression(list(tokens)) and end == len(text), text


def test_where_expressions_end():
    said = lambda t: (lambda v, e: (None if v is None else (sorted(v.labels), v.burden), t[:e]))(*licenses.expression(t))
    assert said("MIT and then") == ((["mit"], 0.2), "MIT")
    assert said("MIT or (Apache-2.0 and") == ((["apache", "mit"], 0.2), "MIT or (Apache-2.0")
    assert said("MIT. GPL-3.0") == ((["mit"], 0.2), "MIT")
    assert said("GPL-2.0+ with luck") == ((["gpl"], 0.8), "GPL-2.0+")
    assert said("MIT or (and GPL") == ((["mit"], 0.2), "MIT")
    assert said("mitre") == (None, "") and said("") == (None, "") and said("(") == (None, "") and said(") MIT") == (None, "")
    assert licenses.licence("cc-by-nc-4.0").labels == {"cc-by-nc"} and licenses.licence("0BSD") is None


# ---------------------------------------------------------------- vector codes
def plain_codes(rows, n_parts=8, entries=16, rounds=6):
    kept = [(i, x, lab) for i, x, lab in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(4096 * v) for v in r[1]]))
    cut = lambda x: [[math.floor(4096 * v) for v in x[p * len(x) // n_parts : (p + 1) * len(x) // n_parts]] for p in range(n_parts)]
    own = [cut(x) for _, x, _ in kept]
    books = [[x[p] for x in own[:entries]] for p in range(n_parts)]
    best = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(n_parts):
            held = defaultdict(list)
            for x in own:
                held[best(x[p], books[p])[1]].append(x[p])
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [[best(x[p], books[p]) for p in range(n_parts)] for x in own]
    errors = [sum(d for d, _ in f) for f in found]
    total = defaultdict(int)
    for (_, _, lab), e in zip(kept, errors, strict=True):
        total[lab] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in f), err, total[lab], digest) for (i, _, lab), f, err in zip(kept, found, errors, strict=True)]


VECTORS = "vec_id long, embedding array<float>, label int, part string, code string"


@pytest.mark.parametrize(("n", "dim", "few"), [(120, 16, 50_000), (60, 8, 2), (5, 4096, 50_000)])
def test_codes_of_odd_rows(spark, n, dim, few, monkeypatch):
    monkeypatch.setattr(codes, "FEW_LABELS", few)
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(v)) for v in rng.normal(size=dim) * rng.choice([0.01, 1, 30, 800])], None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(n)]
    rows += [rows[0], rows[1], (rows[2][0], rows[3][1], 5), (None, rows[4][1], None), (n + 1, [0.0] * dim, 1), (n + 2, None, 1), (n + 3, [None] + [1.0] * (dim - 1), 1), (n + 4, [float("nan")] * dim, 2), (n + 5, [float("inf")] * dim, None), (n + 6, [-0.0001] * dim, 4)]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS).repartition(5)
    same(codes.compressed(table).collect(), plain_codes(rows))


def test_codes_of_nothing_and_of_refused_vectors(spark):
    table = spark.createDataFrame([(1, None, 1, "", ""), (2, [None], 1, "", "")], VECTORS)
    assert codes.compressed(table).collect() == [] and codes.compressed(table.limit(0)).collect() == []
    for wrong in ([1.0] * 7, [100_000.0] * 8, []):
        with pytest.raises(Exception, match="multiple of 8"):
            codes.compressed(spark.createDataFrame([(1, wrong, 1, "", "")], VECTORS)).collect()
    with pytest.raises(Exception, match="unlike lengths"):
        codes.compressed(spark.createDataFrame([(1, [1.0] * 8, 1, "", ""), (2, [1.0] * 16, 1, "", "")], VECTORS)).collect()


def test_rounds_lower_the_error_and_codes_decode(spark):
    x = codes.kept(spark.read.parquet(f"{SMALL}/embeddings.parquet"))
    total = []
    for rounds in (0, 2, 6):
        books = codes.learned(x, rounds)
        total.append(codes.encoded(x, books).agg(F.sum("error")).first()[0])
    assert total == sorted(total, reverse=True) and total[2] < 0.9 * total[0]
    back = codes.decoded(codes.encoded(x, books), books).join(x, "vec_id")
    apart = F.aggregate(F.zip_with("vec", "x", lambda a, b: (a * codes.UNIT - b) * (a * codes.UNIT - b)), F.lit(0.0), lambda a, d: a + d)
    assert back.agg(F.sum(apart)).first()[0] == total[2]


def test_codes_against_sql(spark):
    against_sql(spark, "op13_vector_codes")


# ---------------------------------------------------------------- very long texts
def test_texts_of_over_a_million_characters(spark):
    """One text of 1.3 million characters beside short ones, through the operators that read a text as a whole."""
    import public_tokenizers
    import tiktoken  # noqa: F401  (the library whose ids are matched elsewhere)

    from vecmill.llm import bpe, langid, token_counts

    base = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id")
    some = [r["text"] for r in base.where("text rlike '[a-z]{4}'").limit(60).collect()]
    piece = " ".join(some) + " MIT License $ é\n"
    long = piece * (1_300_000 // len(piece) + 1)
    rows = [(1, long, "en"), (2, "short", "en"), (3, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    same(filters.audit(docs, labels).collect(), plain_audit(rows, {1: (True, False)}))
    found = licenses.scanned(docs)
    same(found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect(), [(i, *plain_places(t)) for i, t, _ in rows])
    counts = {r["doc_id"]: r for r in token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert counts[1]["n_tokens"] == counts[3]["n_tokens"] > 200_000 and counts[1]["n_bytes"] == len(long.encode())
    ids = {r["doc_id"]: r for r in bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert bytes(ids[1]["decoded"]).decode() == long and ids[1]["n_tokens"] == counts[1]["n_tokens"]
    model = langid.train_on(base)
    told = {r["doc_id"]: r["lang_pred"] for r in langid.languages(docs, model).collect()}
    assert told[1] == told[3] in model.languages
