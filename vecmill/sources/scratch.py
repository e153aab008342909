"""Tables that end a plan's lineage, in the shared folder of spark.checkpoint.dir; they are deleted when the driver ends."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


#: Files of one bucketed table; Spark takes 100,000 buckets at most.
MOST_BUCKETS = 50_000


@cache
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="vecmill-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder. Where the setting is absent, a local session gets a temporary one; a cluster has none to share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own()
    return base.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession) -> str:
    """A new folder for a table or several, which goes when the driver ends."""
    path = f"{scratch_dir(spark)}/vecmill/{uuid.uuid4().hex}"
    at, files = _hadoop(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _hadoop(spark, path)
    return bool(files.exists(at))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none where it isn't there."""
    at, files = _hadoop(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, files = _hadoop(spark, path)
    files.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, by the store's own writer."""
    at, files = _hadoop(spark, path)
    out = files.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared scratch folder and read again: lineage ends here."""
    path = f"{scratch_path(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` dealt out by ``key`` once and written in buckets to the shared scratch folder: grouping by ``key`` needs no further shuffle."""
    spark = df.sparkSession
    name = f"vecmill_{uuid.uuid4().hex}"
    buckets = min(buckets, MOST_BUCKETS)
    write = df.repartition(buckets, key).write.format("parquet").option("compression", "zstd").bucketBy(buckets, key)
    write.option("path", f"{scratch_path(spark)}/table").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalogue's entry; the files have a path of their own and stay
    return out


def remove_stored(df: DataFrame) -> None:
    """Delete the files behind a ``stored`` table that no later plan reads."""
    for f in df.inputFiles()[:1]:
        at, files = _hadoop(df.sparkSession, f)
        files.delete(at.getParent().getParent(), True)
