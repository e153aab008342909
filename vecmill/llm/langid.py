"""Language identification by a mixture of languages.

Each language gives probabilities of byte trigrams, learned from labelled documents. A document is a mixture: each of its
words comes from one language, with likelihood the product over the word's trigrams. Expectation-maximisation estimates
the proportions, and the set of languages is the one of highest penalised likelihood among the nested sets of most
likely languages. All documents of a chunk run through the same array operations together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, runs_of_docs

#: Labelled documents of one language, about, that training reads (a documented bound; whole texts).
SAMPLE = 5_000
#: Places of the hashed trigram table.
PLACES = 1 << 16
#: Added to each count.
SMOOTH = 0.5
ROUNDS = 8
#: Penalty for one more language, in units of half the logarithm of the number of words.
PENALTY = 3.0
UNKNOWN = "und"
#: Letters that are scored at a time, for eight languages; fewer where there are more.
CHUNK = 600_000
#: ASCII characters other than letters become spaces.
LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: log probability of each place, a column for each language
    table: np.ndarray


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of all texts the place of the trigram around it; each word's first letter; each text's first word (one more at the end)."""
    raw = [b" " + t.lower().encode() for t in texts]
    data = np.frombuffer((b"".join(raw) + b" ").translate(LETTERS), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
    inside = data != 32
    at = np.flatnonzero(inside)
    wide = data.astype(np.uint32)
    code = ((wide[at - 1] << 16) | (wide[at] << 8) | wide[at + 1]) * np.uint32(2654435761) >> np.uint32(16)
    first = np.flatnonzero(~inside[at - 1]) if len(at) else np.zeros(0, np.int64)
    return code, first, np.searchsorted(at[first], begin) if len(at) else np.zeros(len(begin), np.int64)


def train(labelled: DataFrame) -> Model:
    """From the rows (text, lang) with both given: up to about SAMPLE documents of each language, chosen by a hash of the text.

    Every label is learned; the table takes PLACES floats for each. Rows of the same text are chosen together; without rows
    the model knows no language; other columns don't matter.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    found = rows.groupBy("lang").count().collect()
    languages = tuple(sorted(r["lang"] for r in found))
    if not languages:
        return Model((), np.zeros((PLACES, 0), np.float32))
    share = {r["lang"]: min(1.0, SAMPLE / r["count"]) for r in found}
    scale = 1 << 40
    limit = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(int(v * scale)))])
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(scale)) < F.coalesce(limit[F.col("lang")], F.lit(0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in set(langs):
                code, _, _ = trigrams([t for t, l in zip(texts, langs, strict=True) if l == lang])
                total[lang] = total.get(lang, 0) + np.bincount(code, minlength=PLACES)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "place", "n"])

    # at most PLACES rows for each language
    counts = sample.mapInArrow(count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((PLACES, len(languages)), SMOOTH)
    table[counts["place"].to_numpy(), [languages.index(x) for x in counts["lang"]]] += counts["n"].to_numpy()
    return Model(languages, np.log(table / table.sum(0)).astype(np.float32))


def _mixture(like: np.ndarray, first: np.ndarray, words: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in each document, and the log likelihood relative to each word's best; like: words x languages."""
    doc = np.repeat(np.arange(len(words)), words)
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        part = like * share[doc]
        part /= part.sum(1, keepdims=True)
        share = np.add.reduceat(part, first, axis=0) / words[:, None]
    total = np.add.reduceat(np.log(np.maximum((like * share[doc]).sum(1), 1e-30)), first)
    return share, total


def predict(texts: list[str | None], model: Model) -> list[tuple[str, float, dict[str, float]]]:
    """(language, score, proportions of the selected languages) of each text; UNKNOWN with score 0 for null and texts without letters."""
    out: list[tuple[str, float, dict[str, float]]] = [(UNKNOWN, 0.0, {})] * len(texts)
    use = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.languages else []
    for a, b in runs_of_docs(np.array([len(texts[i]) for i in use], np.int64), 8 * CHUNK // max(8, len(model.languages))):
        which = use[a:b]
        code, first, begin = trigrams([texts[i] for i in which])
        begin = begin[:-1]
        words = np.diff(np.append(begin, len(first)))
        score = np.add.reduceat(model.table[code], first, axis=0)
        # a floor under each word's likelihood: one odd word doesn't rule a language out
        like = np.exp(np.maximum(score - score.max(1, keepdims=True), -30))
        k = len(model.languages)
        share, best = _mixture(like, begin, words, np.ones((len(which), k)))
        single = np.add.reduceat(np.log(like), begin, axis=0)
        order = np.argsort(-share, axis=1, kind="stable")
        top = single.argmax(1)
        penalty = PENALTY * 0.5 * np.log(words + 1)
        chosen = np.eye(k, dtype=bool)[top]
        value = single.max(1)
        for size in range(2, k + 1):
            # no larger set gains more than all languages do
            open_ = np.flatnonzero(best - (size - 1) * penalty > value)
            if not len(open_):
                break
            allowed = np.zeros((len(open_), k))
            np.put_along_axis(allowed, order[open_, :size], 1.0, axis=1)
            part = np.concatenate([np.arange(begin[i], begin[i] + words[i]) for i in open_])
            n = words[open_]
            s, total = _mixture(like[part], np.cumsum(n) - n, n, allowed)
            total = total - (size - 1) * penalty[open_]
            better = total > value[open_]
            at = open_[better]
            value[at], share[at], chosen[at] = total[better], s[better], allowed[better] > 0
        alone = chosen.sum(1) == 1
        share[alone] = chosen[alone]  # proportions are of the selected set: one language has all
        own = np.where(chosen, share, 0)
        lead = np.where(alone, top, own.argmax(1))
        for j, i in enumerate(which):
            parts = {model.languages[c]: float(share[j, c]) for c in np.flatnonzero(chosen[j])}
            out[i] = (model.languages[lead[j]], float(min(1.0, max(0.0, share[j, lead[j]]))), parts)
    return out


def is_held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on(docs: DataFrame) -> Model:
    """Learn from the documents that are not held out; a row without doc_id is none of these."""
    return train(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))


def languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and proportions (map of the selected languages) of every whole text.

    Only text is used to predict. Null texts and those without a letter are ``und`` with score 0, and so is everything
    where there is nothing to learn from. Repeated rows and repeated or null doc_ids give a row each (a null doc_id isn't
    held out); an empty table gives no rows.
    """
    model = model or train_on(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # PLACES x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, parts = zip(*predict(batch.column("text").to_pylist(), sent.value), strict=True) if len(batch) else ((), (), ())
            columns = [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([list(p.items()) for p in parts], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "proportions"])

    found = id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, proportions map<string,double>")
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "proportions")


def accepted(docs: DataFrame, least: float = 0.25) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known and makes up at least ``least`` of the text.

    The model is learned from the labelled rows of ``docs`` that aren't held out; without any, no row is accepted. Null
    texts and those without a letter go; repeated rows are judged alike and all stay or go; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train_on(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [lang != UNKNOWN and score >= least for lang, score, _ in predict(batch.column("text").to_pylist(), sent.value)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
