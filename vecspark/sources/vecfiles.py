"""Vector, tag and attribute files as a Spark data source: ``spark.read.format("vecfile").option("kind", ...)``.

Kinds and what their rows are:

* ``fvecs`` / ``ivecs`` / ``bvecs`` — records of int32 d and d float32 / int32 / uint8 values → (id, v)
* ``fbin`` / ``u8bin`` / ``i8bin`` / ``ibin`` — uint32 n, uint32 d, n·d values → (id, v)
* ``csrtags`` — int64 rows, columns, entries; int64 offsets; int32 columns (values, if any, are not read) → (id, tags), sorted
* ``rangeattrs`` — uint64 attributes (2), uint64 n; n float32 of each → (id, a0, a1)

Options: ``path`` (a file, or several separated by commas: ids go on across them), ``start`` and ``count`` (rows of the
whole), ``block_rows`` (rows of a partition).  A partition is a range of rows read at its offset in pieces of at most PIECE bytes.
Files are opened through ``pyarrow.fs`` (local, HDFS, S3, ... by the path's scheme).  A file whose size does not fit its header
is refused, as are records of another dimension and columns outside the header's range.

Writing (``df.write.format("vecfile").option("kind", "fbin")...``, xbin kinds) makes files of at most ``block_rows`` rows each, in
the order of the partition, with one manifest (file, n) written at the commit; files of a failed job are deleted.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: fixed formats: value type of the file, element type of the rows
VECS = {"fvecs": ("<f4", "float"), "ivecs": ("<i4", "int"), "bvecs": ("u1", "int")}
XBIN = {"fbin": ("<f4", "float"), "ibin": ("<i4", "int"), "u8bin": ("u1", "int"), "i8bin": ("i1", "int")}
PIECE = 16 << 20
BLOCK_ROWS = 65536


def file_at(path: str):
    """(file system, path in it)."""
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class RowRange(InputPartition):
    """Rows ``first .. first + rows`` of one file; ``base`` is the id of the file's first row."""
    path: str
    first: int
    rows: int
    base: int
    shape: tuple

    def __post_init__(self):
        super().__init__(self.path)


class VecFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecfile"

    def schema(self) -> str:
        kind = self.options.get("kind", "fbin")
        if kind == "csrtags":
            return "id long, tags array<int>"
        if kind == "rangeattrs":
            return "id long, a0 float, a1 float"
        return f"id long, v array<{(VECS | XBIN)[kind][1]}>"

    def reader(self, schema) -> DataSourceReader:
        return VecReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return XbinWriter(dict(self.options), overwrite)


class VecReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind = options.get("kind", "fbin")
        self.paths = [p.strip() for p in options["path"].split(",")]
        self.start = int(options.get("start", 0))
        self.count = int(options["count"]) if "count" in options else None
        self.block_rows = int(options.get("block_rows", BLOCK_ROWS))

    def header(self, path: str) -> tuple[int, tuple]:
        """(rows, shape) of a file, checked against its size."""
        fs, p = file_at(path)
        size = fs.get_file_info(p).size
        with fs.open_input_file(p) as f:
            if self.kind in VECS:
                item = np.dtype(VECS[self.kind][0]).itemsize
                d = struct.unpack("<i", f.read(4))[0] if size else 0
                record = 4 + d * item
                if d < 0 or size % record:
                    raise ValueError(f"{path}: size {size} is not a whole number of records of dimension {d}")
                return size // record, (d,)
            if self.kind in XBIN:
                n, d = struct.unpack("<II", f.read(8))
                expected, shape = 8 + n * d * np.dtype(XBIN[self.kind][0]).itemsize, (d,)
            elif self.kind == "rangeattrs":
                d, n = struct.unpack("<QQ", f.read(16))
                if d != 2:
                    raise ValueError(f"{path}: {d} attributes, not 2")
                expected, shape = 16 + 8 * n, (n,)
            else:
                n, cols, nnz = struct.unpack("<qqq", f.read(24))
                expected, shape = 24 + 8 * (n + 1) + 4 * nnz, (n, cols, nnz)
                if size == expected + 4 * nnz:             # with a block of values, which is not read
                    expected = size
        if size != expected:
            raise ValueError(f"{path}: size {size}, but its header says {expected}")
        return n, shape

    def partitions(self) -> list[RowRange]:
        out, base, end = [], 0, None if self.count is None else self.start + self.count
        for path in self.paths:
            n, shape = self.header(path)
            lo, hi = max(0, self.start - base), n if end is None else min(n, end - base)
            out += [RowRange(path, s, min(hi, s + self.block_rows) - s, base, shape) for s in range(lo, max(lo, hi), self.block_rows)]
            base += n
        return out

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        fs, p = file_at(partition.path)
        with fs.open_input_file(p) as f:
            width = 4 * partition.shape[0] if self.kind in VECS or self.kind in XBIN else 64
            step = max(1, PIECE // max(width, 1))
            for lo in range(partition.first, partition.first + partition.rows, step):
                n = min(step, partition.first + partition.rows - lo)
                ids = pa.array(np.arange(partition.base + lo, partition.base + lo + n, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([ids, *self.columns(f, partition.shape, lo, n)], names=self.names())

    def names(self) -> list[str]:
        return {"csrtags": ["id", "tags"], "rangeattrs": ["id", "a0", "a1"]}.get(self.kind, ["id", "v"])

    def columns(self, f, shape: tuple, lo: int, n: int) -> list[pa.Array]:
        def at(offset: int, dtype: str, count: int) -> np.ndarray:
            return np.frombuffer(f.read_at(count * np.dtype(dtype).itemsize, offset), dtype)

        if self.kind == "rangeattrs":
            return [pa.array(at(16 + 4 * (k * shape[0] + lo), "<f4", n)) for k in (0, 1)]
        if self.kind == "csrtags":
            rows, cols, nnz = shape
            ptr = at(24 + 8 * lo, "<i8", n + 1)
            if (np.diff(ptr) < 0).any() or ptr[0] < 0 or ptr[-1] > nnz:
                raise ValueError("offsets are not in order")
            tags = at(24 + 8 * (rows + 1) + 4 * int(ptr[0]), "<i4", int(ptr[-1] - ptr[0]))
            if len(tags) and (tags.min() < 0 or tags.max() >= cols):
                raise ValueError("column out of range")
            row = np.repeat(np.arange(n), np.diff(ptr))
            return [pa.ListArray.from_arrays(pa.array((ptr - ptr[0]).astype(np.int32)), pa.array(tags[np.lexsort((tags, row))]))]
        dtype, element = (VECS | XBIN)[self.kind]
        d, item = shape[0], np.dtype(dtype).itemsize
        if self.kind in VECS:
            record = 4 + d * item
            raw = at(lo * record, "u1", n * record).reshape(n, record)
            if (raw[:, :4].copy().view("<i4") != d).any():
                raise ValueError("records of several dimensions")
            flat = raw[:, 4:].copy().view(dtype).ravel()
        else:
            flat = at(8 + lo * d * item, dtype, n * d)
        flat = flat.astype(np.float32 if element == "float" else np.int32)
        return [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(flat))]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class XbinWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.kind = options["path"].rstrip("/"), options.get("kind", "fbin")
        self.block_rows = int(options.get("block_rows", BLOCK_ROWS))
        if self.kind not in XBIN:
            raise ValueError(f"{self.kind!r} is read only")

    def write(self, rows) -> Written:
        from pyspark import TaskContext
        fs, folder = file_at(self.folder)
        fs.create_dir(folder)
        name, files, held = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}", [], []

        def flush() -> None:
            dims = {len(v) for v in held}
            if len(dims) != 1:
                raise ValueError(f"vectors of several lengths: {sorted(dims)}")
            dtype = np.dtype(XBIN[self.kind][0])
            m = np.array(held)
            if dtype.kind in "iu" and (m.min() < np.iinfo(dtype).min or m.max() > np.iinfo(dtype).max):
                raise OverflowError(f"a value does not fit {dtype.name}")
            path = f"{name}-{len(files):05d}.{self.kind}"
            with fs.open_output_stream(f"{folder}/{path}") as f:
                f.write(struct.pack("<II", *m.shape))
                f.write(m.astype(dtype).tobytes())
            files.append((path, len(held)))
            held.clear()

        for row in rows:
            held.append(row["v"])
            if len(held) >= self.block_rows:
                flush()
        if held:
            flush()
        return Written(files)

    def commit(self, messages) -> None:
        fs, folder = file_at(self.folder)
        lines = [f"{path}\t{n}" for m in messages if m is not None for path, n in sorted(m.files)]
        fs.create_dir(folder)
        with fs.open_output_stream(f"{folder}/_manifest.tsv") as f:
            f.write("\n".join(lines).encode())

    def abort(self, messages) -> None:
        fs, folder = file_at(self.folder)
        for m in messages:
            for path, _ in m.files if m is not None else ():
                fs.delete_file(f"{folder}/{path}")


def register(spark: SparkSession) -> None:
    from vecspark.session import ship_package
    ship_package(spark)
    spark.dataSource.register(VecFiles)


def read(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    register(spark)
    reader = spark.read.format("vecfile").option("kind", kind)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def write(df: DataFrame, folder: str, kind: str = "fbin", **options) -> None:
    """Rows in order of ``id`` (column ``v``) as xbin files of a folder."""
    register(df.sparkSession)
    writer = df.repartitionByRange("id").sortWithinPartitions("id").select("v").write.format("vecfile").option("kind", kind)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.mode("append").save(folder)


def read_folder(spark: SparkSession, folder: str, kind: str = "fbin", **options) -> DataFrame:
    """The files of a folder in their written order, ids from 0."""
    fs, p = file_at(folder)
    with fs.open_input_file(f"{p}/_manifest.tsv") as f:
        names = [line.split("\t")[0] for line in f.read().decode().splitlines()]
    return read(spark, ",".join(f"{folder.rstrip('/')}/{n}" for n in names), kind, **options)
