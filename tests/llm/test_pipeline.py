"""The pipeline, stage by stage, against plain versions; on the shipped documents with odd rows among them, and on none."""

from __future__ import annotations

import re
from collections import defaultdict

import corpus_pipeline as p
import public_tokenizers
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vecmill.llm import langid

from .conftest import ODD_TEXTS, same
from .test_pii import plain_base
from .test_tables import classes
from .test_texts import plain_contamination, tiktoken_encoding


def plain_near(texts, similarity=0.8):
    """For each text the number of its group: five-word Jaccard of at least the similarity, linked on."""
    shingles = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        shingles.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    held = defaultdict(list)
    for i, s in enumerate(shingles):
        for x in s:
            held[x].append(i)
    pairs = {(a, b) for own in held.values() for k, a in enumerate(own) for b in own[:k]}
    links = [(a, b) for a, b in pairs if len(shingles[a] & shingles[b]) >= similarity * len(shingles[a] | shingles[b]) - 1e-9]
    return classes(len(texts), links)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A data folder whose documents hold odd rows, a contaminated one and near copies; more columns, some clashing."""
    path = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    most = docs.agg(F.max("doc_id")).first()[0]
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    bench.write.parquet(str(path / "benchmark.parquet"))
    item = max((r["text"] for r in bench.collect()), key=len)
    base = next(r["text"] for r in docs.orderBy("doc_id").collect() if r["text"] and 200 < len(r["text"].split()) < 900)
    words = base.split(" ")
    near = " ".join([*words[:50], "another", *words[51:]])
    odd = [(most + 1 + i, t) for i, t in enumerate(ODD_TEXTS)]
    odd += [(most + 50, item), (most + 51, base), (most + 52, near), (most + 52, near), (None, "a row without an id and the words of it"), (None, None), (most + 53, base[:300] + " write to ann.lee@host.org or 10.1.2.3 " + base[300:])]
    rows = spark.createDataFrame([(i, t, None, "web") for i, t in odd], docs.schema)
    docs.union(rows).withColumn("n_tokens", F.lit("clash")).withColumn("node", F.lit(1)).repartition(4).write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The documents, and what each stage kept, as the pipeline chains them."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    base = tmp_path_factory.mktemp("stages")
    for name, stage in [("", lambda spark, docs, _: docs), *p.STAGES]:
        stage(spark, docs, folder).write.parquet(str(base / f"stage_{name}"))
        docs = spark.read.parquet(str(base / f"stage_{name}"))
        out.append(docs)
    return out


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in p.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "tokens"]
    assert all(set(s.columns) == set(stages[0].columns) for s in stages[1:-1])
    assert {*stages[0].columns, "token_ids"} == set(stages[-1].columns)


def test_language_keeps_what_has_a_leading_language(stages):
    before, after = rows_of(stages[0]), rows_of(stages[1])
    texts = sorted({t for _, t in before if t and any(map(str.isalpha, t))})
    score = dict(zip(texts, langid.predict(texts, langid.train_on(stages[0])), strict=True))
    same(after, [r for r in before if r[1] in score and score[r[1]][1] >= 0.25])
    assert len(after) >= 0.98 * sum(r[1] in score for r in before)


def test_one_of_each_group_stays(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    group = plain_near([t for _, t in before])
    least = defaultdict(list)
    for (i, _), g in zip(before, group, strict=True):
        least[g].append(i)
    wanted = {min(i for i in ids if i is not None) for ids in least.values() if any(i is not None for i in ids)}
    assert sorted(i for i, _ in after if i is not None) == sorted(wanted)
    assert [t for i, t in after if i is None] == [t for (i, t), g in zip(before, group, strict=True) if i is None and set(least[g]) == {None}]


def test_contaminated_documents_go(spark, folder, stages):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before = rows_of(stages[2])
    same(rows_of(stages[3]), [r for r, w in zip(before, plain_contamination(before, items), strict=True) if not w[5]])
    assert stages[3].count() < stages[2].count()


def test_personal_data_is_masked(stages):
    before, after = dict(rows_of(stages[3])), dict(rows_of(stages[4]))
    assert before.keys() == after.keys()
    for i, text in before.items():
        spans, masked = plain_base(text), after[i]
        assert not plain_base(masked)
        if not spans:
            # only a learned span changes such a text, and leaves the rest of it
            assert masked == text or re.fullmatch(re.sub(r"(\\?<(email|ip|card|phone)\\?>)", ".{4,60}", re.escape(masked)), text, re.S)
        for kind, a, z in spans:
            assert text[a:z] not in masked and f"<{kind}>" in masked
    assert sum(before[i] != after[i] for i in before) <= 1.1 * sum(bool(plain_base(t)) for t in before.values()) + 2


def test_tokens_are_those_of_the_library(stages):
    library = tiktoken_encoding()
    before = dict(rows_of(stages[4]))
    for r in stages[5].collect():
        assert r["text"] == before[r["doc_id"]] and list(r["token_ids"]) == library.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["token_ids"])
    assert public_tokenizers.PATTERN and stages[5].count() == len(before)


def test_the_whole_run_is_its_stages(spark, folder, stages):
    same(rows_of(p.run(spark, folder)), rows_of(stages[5]))


def test_no_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert p.run(spark, str(tmp_path)).collect() == []
