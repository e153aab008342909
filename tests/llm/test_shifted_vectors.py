"""op6 on vectors that share a direction, by the plans of small and of large tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmill.llm import embeddings


def shifted(mean, n=1500, dim=64, seed=5):
    """Unit vectors of about that mean norm, each with a partner at cosine 0.951 to 0.953."""
    rng = np.random.default_rng(seed)
    part = rng.normal(size=(n, dim)) / np.sqrt(dim)
    x = part * np.sqrt(1 - mean * mean)
    x[:, 0] += mean
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    way = rng.normal(size=x.shape)
    way -= (way * x).sum(1, keepdims=True) * x
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    c = rng.uniform(0.951, 0.953, size=(n, 1))
    return x, c * x + np.sqrt(1 - c * c) * way


def bucket_recall(rows, x, y, mean):
    both = np.concatenate([x, y])
    coder = embeddings.Coder({64: both})
    tables, radius = embeddings.plan(rows, coder, both, 0.95)
    apart = np.bitwise_count(embeddings.pieces_of(x, coder, tables) ^ embeddings.pieces_of(y, coder, tables))
    return np.mean((apart <= radius).any(1))


@pytest.mark.parametrize("mean", [0.0, 0.7, 0.85, 0.9])
@pytest.mark.parametrize("rows", [3000, 2_000_000, 100_000_000])
def test_tables_reach_the_threshold(mean, rows):
    assert bucket_recall(rows, *shifted(mean), mean) >= 0.95


def test_links_of_shifted_vectors(spark):
    x, y = shifted(0.85)
    both = np.concatenate([x, y])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    found = embeddings.near_duplicates(table).agg(F.sum("n_links")).first()[0]
    wanted = int((both @ both.T >= 0.95).sum()) - len(both)
    assert 0.95 * wanted <= found <= wanted
