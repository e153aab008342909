"""Personal data: the patterns against a plain version, and the network as the query ships it."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from vecmill.llm import pii, queries

from .conftest import same

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def plain_base(text):
    def luhn(s):
        d = [int(c) for c in s if c in "0123456789"]
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0

    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", luhn),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= sum(c in "0123456789" for c in s) <= 15),
    }
    out = []
    for kind, (pattern, ok) in patterns.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return sorted(out, key=lambda s: (s[1], list(patterns).index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789+-.() @ab_é\n", max_size=80))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


@pytest.fixture(scope="module")
def model(spark):
    """The network that the query trains on the shipped small table."""
    return pii.train(spark.read.parquet(f"{SMALL}/documents.parquet"))


@pytest.fixture(scope="module")
def planted(spark):
    """The shipped small documents, each with data in some spelling written into it: (doc_id, text, span)."""
    make, out = pii.Inventor(np.random.default_rng(2024)), []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        text = r["text"] or ""
        spaces = [m.end() for m in re.finditer(" ", text)]
        if len(spaces) > 3:
            at = make.pick(spaces)
            kind, item = make.data()
            out.append((r["doc_id"], f"{text[:at]}{item} {text[at:]}", (kind, at, at + len(item))))
    return out


#: Spellings and sentences that the generator of the training windows doesn't make.
BY_HAND = [
    ("phone", "+49–30–1234567"), ("phone", "030 / 1234 5678"), ("phone", "(0207) 946-0958"), ("phone", "0049 171 5551234"),
    ("card", "4539·1488·0343·6467"), ("card", "4539_1488_0343_6467"), ("card", "4539  1488  0343  6467"), ("card", "4539.1488.0343.6467"),
    ("ip", "192[.]168[.]10[.]5"), ("ip", "10 . 20 . 30 . 40"), ("ip", "10[dot]20[dot]30[dot]40"), ("ip", "172(.)16(.)254(.)1"),
    ("email", "ann.lee AT example DOT org"), ("email", "ann.lee<at>example.org"), ("email", "ann.lee @example.org"), ("email", "j_smith (at) mail (dot) net"), ("email", "bob99[at]host.io"),
]
SENTENCES = ["Please write to {} before the end of the month.", "The number on file is {}, which nobody has checked.", "Kontakt: {} (nur werktags)", "see {}\nfor details", "My data: {}; thanks a lot"]


def test_spellings_by_hand(model):
    texts, wanted = [], []
    for (kind, item), s in itertools.product(BY_HAND, SENTENCES):
        texts.append(s.format(item))
        wanted.append((kind, s.index("{}"), s.index("{}") + len(item)))
    base, added = pii.found(texts, model)
    assert not any(w in b for w, b in zip(wanted, base, strict=True))
    assert sum(w in a for w, a in zip(wanted, added, strict=True)) >= 0.8 * len(wanted)
    assert sum(s != w for w, a in zip(wanted, added, strict=True) for s in a) <= 0.05 * len(wanted)


def test_texts_without_data_stay_clean(model):
    plain = ["Meet at 10:30 on 2024-03-05 in room 1204.", "Version 3.11.2 took 12345678 steps.", "He stood at the door.", "It was 3,141,592 of 20,000,000.", "see pages 12-19, 112-119 and 1402", "sum(1..10) = 55", "call me at home or at work"]
    assert pii.found(plain, model) == ([[]] * len(plain), [[]] * len(plain))


def test_the_query_adds_planted_data(spark, planted, model, tmp_path):
    """Through op1 itself: at least 0.8 of what the patterns miss is found, and hardly anything else."""
    shipped = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10_000_000 + i, t) for i, t, _ in planted], "doc_id long, text string").selectExpr("doc_id", "text", "'xx' AS lang")
    shipped.union(more).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in queries.op1_lstm_crf_pii(spark, str(tmp_path)).collect()}
    assert len(rows) == shipped.count() + len(planted)
    wanted = {10_000_000 + i: s for i, t, s in planted if s not in plain_base(t)}
    right = sum(f"{k}:{a}:{z}" in rows[i]["spans"].split(",") for i, (k, a, z) in wanted.items())
    assert right >= 0.8 * len(wanted) > 0
    added = sum(r["n_added"] for r in rows.values())
    assert right <= added <= right + 0.1 * len(wanted)


def test_windows_without_a_sign_of_data_hold_none(planted, model, monkeypatch):
    """Reading every window of the grid finds no span that reading only those with a digit or an at misses."""
    texts = [t[max(0, s[1] - 700) : s[1] + 700] for _, t, s in planted[:120]]
    base, few = pii.found(texts, model)
    monkeypatch.setattr(pii, "TRIGGER", re.compile(r"(?s)."))
    _, every = pii.found(texts, model)
    lost = sum(len(set(e) - set(f)) for e, f in zip(every, few, strict=True))
    assert lost <= 0.03 * sum(map(len, every))
    sign = re.compile(rf"[0-9]|{pii._AT}", re.I)
    assert all(sign.search(t[a:z]) for t, e in zip(texts, every, strict=True) for _, a, z in e)


def test_spans_across_the_edges_of_windows(model):
    """A span comes out the same wherever the grid of windows cuts it."""
    for kind, item in (("email", "ann.lee (at) example (dot) org"), ("card", "4539.1488.0343.6467"), ("phone", "(0207) 946-0958")):
        texts = ["the of and " * 12 + ("lake " * 13)[:k] + " " + item + " and of the " * 12 for k in range(pii.WINDOW)]
        _, added = pii.found(texts, model)
        assert sum((kind, 133 + k, 133 + k + len(item)) in a for k, a in enumerate(added)) >= 0.9 * pii.WINDOW, kind


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(4)
    p = {k: rng.normal(size=s) for k, s in (("t", (pii.LABELS, pii.LABELS)), ("s", pii.LABELS), ("e", pii.LABELS))}
    for n in (1, 2, 5):
        e = rng.normal(size=(n, pii.LABELS))
        score = lambda y: p["s"][y[0]] + p["e"][y[-1]] + sum(e[i, x] for i, x in enumerate(y)) + sum(p["t"][a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        every = list(itertools.product(range(pii.LABELS), repeat=n))
        assert tuple(pii.viterbi(p, e)) == max(every, key=score)
        weight = np.exp([score(y) for y in every])
        prob = pii.marginals(p, e[:, None, :])[0][:, 0]
        for i, c in itertools.product(range(n), range(pii.LABELS)):
            assert abs(prob[i, c] - weight[[y[i] == c for y in every]].sum() / weight.sum()) < 1e-6


def test_crf_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in pii.initial(rng).items()}
    codes, labels = rng.integers(0, pii.SYMBOLS, (3, 12)), rng.integers(0, pii.LABELS, (3, 12))
    loss, grad = pii.gradient(p, codes, labels)
    for name in ("t", "o", "hf", "hb", "s", "e"):
        at = tuple(0 for _ in p[name].shape)
        q = p | {name: p[name].copy()}
        q[name][at] += 1e-2
        up = pii.gradient(q, codes, labels)[0]
        q[name][at] -= 2e-2
        assert abs((up - pii.gradient(q, codes, labels)[0]) / 2e-2 - grad[name][at]) < 2e-3


def test_training_windows_teach_no_contradiction():
    assert pii.windows_of("nothing here") == []
    assert pii.windows_of("write to ann [at] host.org or so") == []  # the patterns don't know it, so it is no lesson
    ((text, spans),) = pii.windows_of("mail ann@host.org now")
    assert [(k, text[a:z]) for k, a, z in spans] == [("email", "ann@host.org")]
    many = pii.windows_of(" and ".join(f"user{i}@host.org" for i in range(200)))
    assert len(many) > 40  # of whole texts, not of their beginnings


def test_pii_query_rows(docs, rows, model):
    found = pii.find(docs, model).collect()
    wanted = []
    for i, t in rows:
        b = plain_base(t or "")
        wanted.append((i, *(sum(s[0] == k for s in b) for k in pii.KINDS), sha(pii.written(b))))
    same([r[:6] for r in found], wanted)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for r in found:
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert len(spans) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"]
        assert any(set(pii.written(plain_base(t)).split(",")) - {""} <= {":".join(s) for s in spans} for t in texts[r["doc_id"]])
    assert pii.find(docs.limit(0), model).collect() == []


def test_masked_texts(spark, docs, none, model):
    masked = pii.masked(docs, model)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    texts = [r["text"] for r in masked.select("text").collect()]
    assert not any(plain_base(t) for t in texts if t and "<" in t)
    assert pii.masked(none, model).collect() == []
    long = "word " * 300_000 + "ann@host.org " + "word " * 10
    made = spark.createDataFrame([(1, "a@b.org and 10.0.0.1"), (1, "a@b.org and 10.0.0.1"), (None, None), (2, ""), (3, long)], "doc_id long, text string")
    got = {(r["doc_id"], r["text"]) for r in pii.masked(made, model).collect()}
    assert got == {(1, "<email> and <ip>"), (None, None), (2, ""), (3, long.replace("ann@host.org", "<email>"))}
