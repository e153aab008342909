"""Documents for the operators' tests: a shipped table's rows, and rows of every odd kind."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

#: Columns whose names the operators use inside.
CLASHING = ("batch", "part", "keys", "fp", "slice", "cell", "rank", "component", "spans", "kept", "n_tokens", "token_ids")
ODD_TEXTS = [None, "", "   \n\t ", "?!", "one", "two words", "Ünïcödé 🎉   text here", "a" * 300, "tab\there\r\nnew\x0bline\x0c.", "word " * 5000, "0123456789" * 40, "don't we'll I've it's 'quoted' <|endoftext|> end"]


@pytest.fixture(scope="session")
def rows(small):
    """(doc_id, text) of the whole small table, and odd rows: null ids, repeated ids, repeated rows, very long texts."""
    import pyarrow.parquet as pq

    table = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"])
    out = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
    most = max(i for i, _ in out)
    out += [(most + 1 + i, t) for i, t in enumerate(ODD_TEXTS)]
    out += [(None, "a row without an id " * 20), (None, None), (None, "a row without an id " * 20)]
    out += [out[3], out[3], (out[5][0], "another text under a known id, " * 12), (most + 100, out[7][1]), (most + 101, " ".join(t or "" for _, t in out[:40]))]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """``rows`` as a table with more columns, some of clashing names."""
    path = str(tmp_path_factory.mktemp("docs"))
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("xx")).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "web"))
    for name in CLASHING:
        made = made.withColumn(name, F.lit("clash"))
    made.repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def same(found, wanted):
    """Equal as multisets."""
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    found, wanted = sorted(map(tuple, found), key=key), sorted(map(tuple, wanted), key=key)
    assert len(found) == len(wanted), (len(found), len(wanted))
    wrong = [(a, b) for a, b in zip(found, wanted, strict=True) if a != b]
    assert not wrong, (len(wrong), [(str(a)[:300], str(b)[:300]) for a, b in wrong[:3]])
