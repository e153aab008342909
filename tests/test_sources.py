"""The .npy source in ranges, its writer, dataset metadata, profiles and shards."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from vecmill import catalogue
from vecmill.functions import ranks
from vecmill.functions import vectors as V
from vecmill.sources import npy
from vecmill.sources import vectors as sources

VECTORS = "id long, vec array<double>"


def test_one_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    m = np.arange(3000, dtype=np.float32).reshape(500, 6)
    np.save(tmp_path / "m.npy", m)
    spark.dataSource.register(npy.NpySource)
    df = spark.read.format("npy").option("range_bytes", 1000).load(str(tmp_path / "m.npy"))
    assert df.rdd.getNumPartitions() == 13 and df.select(F.spark_partition_id()).distinct().count() == 13
    rows = df.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(500)) and (np.array([r["vec"] for r in rows]) == m).all()
    for kind in (np.int16, np.float64):
        np.save(tmp_path / "k.npy", m[:7].astype(kind))
        assert [r["vec"] for r in sources.read(spark, f"file://{tmp_path}/k.npy", "npy").orderBy("id").collect()] == m[:7].astype(kind).astype(float).tolist()
    np.save(tmp_path / "none.npy", m[:0])
    assert sources.read(spark, str(tmp_path / "none.npy"), "npy").count() == 0
    np.save(tmp_path / "turned.npy", np.asfortranarray(m))
    np.save(tmp_path / "flat.npy", m[0])
    (tmp_path / "no.npy").write_bytes(b"something else")
    for wrong in ("turned", "flat", "no"):
        with pytest.raises(Exception, match="no rows of numbers|no .npy file"):
            sources.read(spark, str(tmp_path / f"{wrong}.npy"), "npy").collect()


def test_rows_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: rows past 2**31 bytes are read by their offset."""
    rows, width = 540_000, 1024
    with open(tmp_path / "large.npy", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (rows, width)})
        f.seek((rows - 1) * width * 4, os.SEEK_CUR)
        f.write(np.arange(width, dtype=np.float32).tobytes())
    parts = npy.NpyReader(str(tmp_path / "large.npy"), npy.RANGE_BYTES).partitions()
    assert len(parts) == 33 and (tmp_path / "large.npy").stat().st_size > 2**31
    *_, last = npy.NpyReader(str(tmp_path / "large.npy"), npy.RANGE_BYTES).read(parts[-1])
    assert last.column(0)[-1].as_py() == rows - 1 and last.column(1)[-1].as_py() == list(range(width))


def test_a_folder_of_parts_comes_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranks, "SLICE_ROWS", 100)
    v = catalogue.vectors(spark, SMALL).where("id % 3 = 0")
    at = str(tmp_path / "set")
    npy.write(v.union(spark.createDataFrame([(-5, None)], VECTORS)).repartition(4), at, name="small", distance="l2")
    n = v.count()
    about = npy.metadata(at)
    assert (about["name"], about["distance"], about["n_vectors"], about["dimension"]) == ("small", "l2", n, 64)
    back = {r["id"]: r["vec"] for r in sources.read(spark, at, "npy").collect()}
    assert back == {i: r["vec"] for i, r in enumerate(v.orderBy("id").collect())}
    with pytest.raises(Exception, match="holds a dataset already"):
        npy.write(v, at)
    npy.write(v.limit(5), at, overwrite=True)
    assert sources.read(spark, at, "npy").count() == 5 and sum(f.endswith(".npy") for f in os.listdir(at)) == len(npy.metadata(at)["parts"])
    npy.write(v.limit(0), str(tmp_path / "empty"))
    assert sources.read(spark, str(tmp_path / "empty"), "npy").count() == 0


def test_metadata_of_a_dataset(spark, tmp_path):
    train, queries = sources.train_and_queries(catalogue.vectors(spark, SMALL), 60, 4)
    at = str(tmp_path / "set")
    sources.write_dataset(train, queries, sources.truth(train, queries, None, 3), at, name="toy", kind="shipped", distance="squared L2")
    about = json.loads((tmp_path / "set" / "metadata.json").read_text())
    assert {k: about[k] for k in ("name", "kind", "distance", "n_train", "n_queries", "dimension", "gt_k")} == {"name": "toy", "kind": "shipped", "distance": "squared L2", "n_train": 60, "n_queries": 4, "dimension": 64, "gt_k": 3}
    sources.write_dataset(train.limit(2), queries, sources.truth(train, queries, None, 3), at, name="other")
    assert json.loads((tmp_path / "set" / "metadata.json").read_text())["name"] == "toy"


def test_profiles_and_shards(spark, tmp_path):
    for name, p in sources.PROFILES.items():
        rows = sources.profiled(spark, name, 300, 8).collect()
        assert len(rows) == 300 and {r["cluster"] for r in rows} <= set(range(p["clusters"]))
        assert all(abs(np.linalg.norm(r["vec"]) - 1) < 1e-9 for r in rows[:20])
    with pytest.raises(ValueError):
        sources.profiled(spark, "none", 5)
    paths = [str(tmp_path / f"s{i}") for i in range(3)]
    for i, p in enumerate(paths):
        spark.createDataFrame([(100 - j, [float(i), float(j)]) for j in range(5)], "vec_id long, embedding array<float>").repartition(2).write.parquet(p)
    got = sources.sharded(spark, paths, 7).orderBy("id").collect()
    assert [r["vec"] for r in got] == [[0.0, float(j)] for j in (4, 3, 2, 1, 0)] + [[1.0, 4.0], [1.0, 3.0]] and [r["id"] for r in got] == list(range(7))
    with pytest.raises(ValueError, match="fewer than"):
        sources.sharded(spark, paths, 16)
    assert sources.sharded(spark, paths, 16, allow_less=True).count() == 15


def test_generated_vectors_are_made_once(spark):
    """The plan names each drawn vector once, not again in its norm; zero vectors stay, null ones are null."""
    for made in (sources.boundary_mixtures(spark, {0: [1.0, 0.0], 1: [0.0, 1.0]}, 5), sources.around_centroids(spark, {0: [1.0, 0.0]}, 5), sources.generated(spark, 5, 4)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.upper().count("COS(") == (3 if "cluster" in made.columns else 1)  # three draws for a generated coordinate
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [1e-3, -1e3, 7.0])], "id long, vec array<double>")
    got = {r["id"]: r["vec"] for r in rows.select("id", V.unit(F.col("vec")).alias("vec")).collect()}
    assert got[0] == [3.0 * (1 / 5.0), 4.0 * (1 / 5.0)] and got[1] == [0.0, 0.0] and got[2] is None
    assert got[3] == pytest.approx(np.array([1e-3, -1e3, 7.0]) / np.linalg.norm([1e-3, -1e3, 7.0]))
