"""Licence notices and identifier tags in texts.

One Aho-Corasick automaton over normalised words finds notice phrases and tags. What follows a tag on its line is read as a
licence expression: a shunting-yard parser evaluates its and, or and with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .decontaminate import normalised, word_spans

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc0 1 0 universal": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Words after which, behind a colon or an equals sign, a licence expression stands.
TAGS = ("spdx license identifier", "license expression", "license", "licence")
#: How far a licence binds those who use the text (0: not at all), by label; an identifier is a label, alone or before a hyphen.
BURDEN = {
    "unlicense": 0.1,
    "cc0": 0.1,
    "mit": 0.2,
    "bsd": 0.2,
    "isc": 0.2,
    "bsl": 0.2,
    "zlib": 0.2,
    "apache": 0.25,
    "cc-by": 0.3,
    "licenseref": 0.5,
    "mpl": 0.6,
    "epl": 0.6,
    "lgpl": 0.6,
    "cc-by-sa": 0.6,
    "cc-by-nc": 0.7,
    "gpl": 0.8,
    "agpl": 1.0,
}
#: How strongly the operators of an expression bind, and what an exception leaves of a burden.
BINDS, EXCEPTED = {"or": 1, "and": 2, "with": 3}, 0.5

_LEAD = re.compile(r"""["']?[ \t]*[:=][ \t]*["']?""")
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+-]*)")


class Value(NamedTuple):
    """What an expression comes to: labels that it names, and the burden of the choice that binds least."""

    labels: frozenset[str]
    burden: float


class Finding(NamedTuple):
    """base, notice or expression; first and one past the last word; code points; labels and burden."""

    kind: str
    first: int
    end: int
    value: Value


@cache
def automaton() -> ahocorasick.Automaton:
    """From a phrase, with a space on either side, to its number of words, its kind and its label."""
    held: dict[str, list[tuple[int, str, str]]] = {}
    for kind, names in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in names.items():
            held.setdefault(phrase, []).append((phrase.count(" ") + 1, kind, label))
    out = ahocorasick.Automaton()
    for phrase, what in held.items():
        out.add_word(f" {phrase} ", what)
    out.make_automaton()
    return out


def licence(identifier: str) -> Value | None:
    """The longest label that the identifier is, or that it begins with before a hyphen or a plus."""
    name = identifier.lower().rstrip(".-").rstrip("+")
    known = [x for x in BURDEN if name == x or name.startswith(f"{x}-")]
    label = max(known, key=len, default=None)
    return None if label is None else Value(frozenset([label]), BURDEN[label])


def _applied(op: str, a: Value, b: Value | None) -> Value:
    """or leaves the choice, and binds to both, with loosens what stands before it."""
    if op == "with":
        return Value(a.labels, a.burden * EXCEPTED)
    return Value(a.labels | b.labels, min(a.burden, b.burden) if op == "or" else max(a.burden, b.burden))


def expression(text: str, at: int = 0) -> tuple[Value | None, int]:
    """What the expression that stands at a place in the text comes to, and where it ends.

    It ends before the first token that can't go on with it: an operator whose right side is no licence (after with: no
    exception) isn't part of it, and parentheses left open are closed there. Without a licence it is None.
    """
    values: list[Value | None] = []
    ops: list[str] = []
    end, wanted = at, True

    def apply() -> None:
        b, a = values.pop(), values.pop()
        values.append(_applied(ops.pop(), a, b))

    while m := _TOKEN.match(text, at):
        token, at = m[1], m.end()
        name = token.lower()
        if wanted:
            if name == "(" and ops[-1:] != ["with"]:
                ops.append("(")
                continue
            value = licence(token)
            if ops[-1:] == ["with"]:
                if "exception" not in name:
                    break
                value = None
            elif value is None:
                break
            values.append(value)
            wanted, end = False, m.start(1) + len(token.rstrip(".-"))
            if len(token.rstrip(".-")) < len(token):  # a full stop or a dash ends it
                break
        elif name in BINDS:
            while ops and ops[-1] != "(" and BINDS[ops[-1]] >= BINDS[name]:
                apply()
            ops.append(name)
            wanted = True
        elif name == ")" and "(" in ops:
            while ops[-1] != "(":
                apply()
            ops.pop()
            end = at
        else:
            break
    while wanted and ops:  # what an operator or a parenthesis still waits for doesn't come
        wanted = ops.pop() == "("
    while ops:
        if ops[-1] == "(":
            ops.pop()
        else:
            apply()
    return (values[0] if values else None), end


def findings(text: str | None) -> tuple[int, list[Finding]]:
    """The number of words, and what the automaton finds, in order of where it ends; tags count where an expression follows."""
    words = normalised(text)
    if not words:
        return 0, []
    joined = f" {b' '.join(words).decode()} "
    out, at, before, spans = [], 0, 0, None
    for end, what in automaton().iter(joined):
        before += joined.count(" ", at, end)  # spaces before the one after the match: words up to its last
        at = end
        for n, kind, label in what:
            if kind == "tag":
                spans = spans or word_spans(text)
                lead = _LEAD.match(text, spans[before - 1][1])
                value = expression(text, lead.end())[0] if lead else None
                if value is not None:
                    out.append(Finding("expression", before - n, before, value))
            else:
                out.append(Finding(kind, before - n, before, Value(frozenset([label]), BURDEN[label])))
    return len(words), out


def notices(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and found: kind (base, notice, expression), first and end (words from 0, end exclusive), labels and burden.

    An expression's words are those of its tag. Null, empty and wordless texts have no words and nothing is found. Repeated
    rows and repeated or null doc_ids give a row each, an empty table gives none; other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("labels", pa.list_(pa.string())), ("burden", pa.float64())]))
        for batch in batches:
            read = [findings(t) for t in batch.column(1).to_pylist()]
            found = [[{"kind": f.kind, "first": f.first, "end": f.end, "labels": sorted(f.value.labels), "burden": f.value.burden} for f in fs] for _, fs in read]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in read], pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "found"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, found array<struct<kind:string,first:long,end:long,labels:array<string>,burden:double>>")


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (the greatest burden found, 0 where nothing is) of every whole text.

    Odd rows are as in ``notices``; without a base place first_word and last_word are null and base_labels is empty.
    """
    base = F.filter("found", lambda f: f["kind"] == "base")
    named = lambda fs: F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.transform(fs, lambda f: f["labels"])))))
    starts = F.transform(base, lambda f: f["first"])
    score = F.coalesce(F.array_max(F.transform("found", lambda f: f["burden"])), F.lit(0.0))
    return notices(docs).select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), named(base).alias("base_labels"), named(F.col("found")).alias("labels"), score.alias("score"))
