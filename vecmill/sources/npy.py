"""Matrices in .npy files as a Spark data source: many tasks read ranges of one file, each task writes a part.

    spark.dataSource.register(NpySource)
    spark.read.format("npy").load("train.npy")                       # id, vec
    df.write.format("npy").option("name", "train").save("folder")    # parts and metadata.json

A path is one that Python can open on all executors: a shared folder, or a store that pyarrow knows (hdfs, s3, gs).
"""

from __future__ import annotations

import ast
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.arrow import lists, matrix
from ..functions.ranks import numbered

#: Bytes of a task's range of rows, of a batch, and of the vectors that a written part holds, about.
RANGE_BYTES, BATCH_BYTES, PART_BYTES = 64 << 20, 4 << 20, 256 << 20
METADATA = "metadata.json"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Layout:
    """Where the rows of a .npy file begin, and their type, number and width."""

    start: int
    dtype: str
    rows: int
    width: int

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.dtype).itemsize * self.width


def layout(path: str) -> Layout:
    """From the header alone; a file that isn't a matrix of numbers in rows is refused."""
    files, at = opened(path)
    with files.open_input_file(at) as f:
        head = f.read(12)
        if head[:6] != b"\x93NUMPY" or head[6] not in (1, 2, 3):
            raise ValueError(f"{path} is no .npy file")
        size, start = (struct.unpack("<H", head[8:10])[0], 10) if head[6] == 1 else (struct.unpack("<I", head[8:12])[0], 12)
        f.seek(start)
        said = ast.literal_eval(f.read(size).decode("latin1"))
    shape, dtype = said["shape"], np.dtype(said["descr"])
    if len(shape) != 2 or said["fortran_order"] or dtype.kind not in "fiu":
        raise ValueError(f"{path} holds no rows of numbers: {said}")
    return Layout(start + size, dtype.str, *shape)


@dataclass
class Range(InputPartition):
    """Rows first to last - 1 of a file, whose first row has the id ``base``."""

    path: str
    layout: Layout
    first: int
    last: int
    base: int


class NpyReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Range]:
        files, at = opened(self.path)
        if files.get_file_info(at).type == pafs.FileType.Directory:
            with files.open_input_file(f"{at}/{METADATA}") as f:
                parts = json.loads(f.read())["parts"]
            of = [(f"{self.path.rstrip('/')}/{p['file']}", p["first"]) for p in parts]
        else:
            of = [(self.path, 0)]
        out = []
        for path, base in of:
            x = layout(path)
            step = max(1, self.range_bytes // max(1, x.row_bytes))
            out += [Range(path, x, a, min(a + step, x.rows), base) for a in range(0, x.rows, step)]
        return out

    def read(self, part: Range | InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, Range):  # where there is no row Spark makes a partition of its own
            return
        files, at = opened(part.path)
        step = max(1, BATCH_BYTES // max(1, part.layout.row_bytes))
        with files.open_input_file(at) as f:
            for a in range(part.first, part.last, step):
                z = min(a + step, part.last)
                f.seek(part.layout.start + a * part.layout.row_bytes)
                m = np.frombuffer(f.read((z - a) * part.layout.row_bytes), part.layout.dtype).reshape(z - a, part.layout.width)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.base + a, part.base + z)), lists(m)], ["id", "vec"])


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict]
    width: int | None


class NpyWriter(DataSourceArrowWriter):
    """Rows (id, vec) whose ids are their places from 0; a task writes the rows that it gets, in order, in a file for each run of ids."""

    def __init__(self, path: str, options: dict[str, str], overwrite: bool):
        self.path, self.options, self.overwrite = path, options, overwrite
        self.files, self.at = opened(path)
        known = self.files.get_file_info(f"{self.at}/{METADATA}").type == pafs.FileType.File
        if known and not overwrite:
            raise ValueError(f"{path} holds a dataset already")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        import uuid

        files, at = opened(self.path)
        files.create_dir(at, recursive=True)
        held, size, parts, width = [], 0, [], None

        def put() -> None:
            nonlocal held, size
            if not held:
                return
            ids, m = np.concatenate([i for i, _ in held]), np.vstack([x for _, x in held]).astype(np.float32)
            for own in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids) != 1) + 1):
                name = f"part-{uuid.uuid4().hex}.npy"
                with files.open_output_stream(f"{at}/{name}") as f:
                    np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": m[own].shape})
                    f.write(m[own].tobytes())
                parts.append({"file": name, "first": int(ids[own[0]]), "rows": len(own)})
            held, size = [], 0

        for batch in batches:
            if not len(batch):
                continue
            m = matrix(batch.column(batch.schema.get_field_index("vec")))
            if width not in (None, m.shape[1]):
                raise ValueError("vectors of unlike lengths")
            width = m.shape[1]
            held.append((batch.column(batch.schema.get_field_index("id")).to_numpy(), m))
            size += m.nbytes
            if size >= PART_BYTES:
                put()
        put()
        return Written(parts, width)

    def commit(self, messages: list[Written | None]) -> None:
        """Parts count from here on: their list is written last, in order of ids; what an earlier list named goes."""
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: p["first"])
        widths = {m.width for m in messages if m and m.width is not None}
        if len(widths) > 1:
            raise ValueError("vectors of unlike lengths")
        old = []
        if self.files.get_file_info(f"{self.at}/{METADATA}").type == pafs.FileType.File:
            with self.files.open_input_file(f"{self.at}/{METADATA}") as f:
                old = [p["file"] for p in json.loads(f.read())["parts"]]
        said = {k: v for k, v in self.options.items() if k not in ("path",)}
        about = {**said, "n_vectors": sum(p["rows"] for p in parts), "dimension": next(iter(widths), 0), "created_utc": datetime.now(UTC).isoformat(), "parts": parts}
        self.files.create_dir(self.at, recursive=True)
        with self.files.open_output_stream(f"{self.at}/{METADATA}") as f:
            f.write(json.dumps(about, indent=2).encode())
        for name in old:
            self.files.delete_file(f"{self.at}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        for p in (p for m in messages if m for p in m.parts):
            self.files.delete_file(f"{self.at}/{p['file']}")


class NpySource(DataSource):
    """Options: range_bytes for reading; for writing any others, which metadata.json repeats (name, kind, source, distance)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "id long, vec array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], dict(self.options), overwrite)


def write(vectors: DataFrame, path: str, overwrite: bool = False, **about: str) -> None:
    """Vectors (id, vec) as a folder of .npy parts, numbered from 0 in order of id, with metadata.json; null vectors are left out."""
    vectors.sparkSession.dataSource.register(NpySource)
    rows = numbered(vectors.where("vec is not null").select("id", "vec"), [], ["id"]).select(F.col("place").alias("id"), "vec")
    n = max(1, -(-rows.count() // 200_000))
    ordered = rows.repartitionByRange(n, "id").sortWithinPartitions("id")
    ordered.write.format("npy").options(**about).mode("overwrite" if overwrite else "append").save(path)


def metadata(path: str) -> dict:
    files, at = opened(path)
    with files.open_input_file(f"{at}/{METADATA}") as f:
        return json.loads(f.read())
