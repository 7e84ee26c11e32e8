"""A Spark data source for ``.npy`` and IDX array files: one row per record of the first axis.

    spark.dataSource.register(ArrayFiles)
    spark.read.format("arrays").load("/data/pictures")          # file, record, re (and im)
    df.select("re").write.format("arrays").mode("append").save("/data/out")

A file's header is read once, where partitions are planned: they are ranges of records of about
``bytesPerPartition`` bytes, so a large file is read by many tasks, each of which seeks to its first
record. Columns: ``file``, ``record`` (from 0), ``re`` and, for complex files, ``im``: the record's values
as doubles, the first axis within a record fastest (column-major), as everywhere in this library.
With a schema of some of these columns only those are made; without ``re`` and ``im`` no record is read.
Written are ``.npy`` files of doubles (complex ones with ``im``), one a task, whose records all have one
length; null values are an error. Files must be reachable as local paths on all machines.
"""

from __future__ import annotations

import ast
import glob
import os
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Fixed values of the formats: the first bytes of a file, and IDX types by code.
NPY_MAGIC = b"\x93NUMPY"
IDX_TYPES = {0x08: ">u1", 0x09: ">i1", 0x0B: ">i2", 0x0C: ">i4", 0x0D: ">f4", 0x0E: ">f8"}
BATCH_BYTES = 4_000_000


@dataclass(frozen=True)
class ArrayFile:
    path: str
    kind: str
    shape: tuple[int, ...]
    start: int
    fortran: bool

    @property
    def record_bytes(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64)) * np.dtype(self.kind).itemsize


def header(path: str) -> ArrayFile:
    """What stands before the values of an array file."""
    with open(path, "rb") as f:
        first = f.read(8)
        if first[:6] == NPY_MAGIC:
            wide = first[6] > 1
            size = struct.unpack("<I" if wide else "<H", f.read(4 if wide else 2))[0]
            about = ast.literal_eval(f.read(size).decode("utf-8" if first[6] > 2 else "latin-1"))
            found = ArrayFile(path, about["descr"], tuple(about["shape"]), f.tell(), about["fortran_order"])
            if np.dtype(found.kind).kind not in "biufc":
                raise ValueError(f"{path} holds no numbers")
            if found.fortran and len(found.shape) > 1:
                raise ValueError(f"{path} is stored column by column, so its records aren't apart")
        elif first[:2] == b"\0\0" and len(first) >= 4 and first[2] in IDX_TYPES:
            f.seek(4)
            shape = struct.unpack(f">{first[3]}I", f.read(4 * first[3]))
            found = ArrayFile(path, IDX_TYPES[first[2]], shape, 4 + 4 * first[3], False)
        else:
            raise ValueError(f"{path} is no array file")
    if not found.shape:
        raise ValueError(f"{path} holds a single number, no records")
    if os.path.getsize(path) < found.start + found.shape[0] * found.record_bytes:
        raise ValueError(f"{path} ends early")
    return found


@dataclass
class Records(InputPartition):
    file: ArrayFile
    first: int
    stop: int


def local(path: str) -> str:
    return path.removeprefix("file://")


def files_of(path: str) -> list[str]:
    path = local(path)
    found = sorted(f for f in glob.glob(os.path.join(path, "*")) if not os.path.basename(f).startswith((".", "_"))) if os.path.isdir(path) else sorted(glob.glob(path))
    if not found:
        raise ValueError(f"no files in {path}")
    return found


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        kind = np.dtype(header(files_of(self.options["path"])[0]).kind).kind
        return "file string, record long, re array<double>" + (", im array<double>" if kind == "c" else "")

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.options, schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArrayWriter(local(self.options["path"]), schema.fieldNames(), overwrite)


class ArrayReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        unknown = set(columns) - {"file", "record", "re", "im"}
        if unknown:
            raise ValueError(f"array files have no column {', '.join(sorted(unknown))}")
        self.path, self.columns, self.size = options["path"], columns, int(options.get("bytesPerPartition", 64_000_000))

    def partitions(self) -> list[Records]:
        out = []
        for f in map(header, files_of(self.path)):
            step = max(1, self.size // max(1, f.record_bytes))
            out += [Records(f, a, min(f.shape[0], a + step)) for a in range(0, f.shape[0], step)]
        return out or [Records(header(files_of(self.path)[0]), 0, 0)]

    def read(self, part: Records):
        f, kind = part.file, np.dtype(part.file.kind)
        each = max(1, f.record_bytes // kind.itemsize)
        step = max(1, BATCH_BYTES // (8 * each))
        with open(f.path, "rb") as file:
            for a in range(part.first, part.stop, step):
                n = min(step, part.stop - a)
                made = {"file": pa.array([f.path] * n), "record": pa.array(np.arange(a, a + n))}
                if "re" in self.columns or "im" in self.columns:
                    file.seek(f.start + a * f.record_bytes)
                    x = np.frombuffer(file.read(n * f.record_bytes), kind).reshape(n, *f.shape[1:])
                    x = x.transpose(0, *range(x.ndim - 1, 0, -1)).reshape(n, each)
                    ends = pa.array(np.arange(n + 1) * each, pa.int32())
                    for name, values in (("re", x.real), ("im", x.imag)):
                        if name in self.columns:
                            made[name] = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(values, float).ravel()))
                yield pa.RecordBatch.from_arrays([made[c] for c in self.columns], self.columns)


@dataclass
class Written(WriterCommitMessage):
    path: str


class ArrayWriter(DataSourceArrowWriter):
    """Each task writes a file under a name of its own that readers skip; committing gives it its name."""

    def __init__(self, path: str, columns: list[str], overwrite: bool):
        if columns not in (["re"], ["re", "im"]):
            raise ValueError("array files are written from the columns re, or re and im")
        self.path, self.columns, self.overwrite = path, columns, overwrite
        self.old = [f for f in glob.glob(os.path.join(path, "*.npy"))] if overwrite else []

    def write(self, batches) -> Written:
        os.makedirs(self.path, exist_ok=True)
        path, rows, each = os.path.join(self.path, f"_{uuid.uuid4().hex}.npy"), 0, None
        with open(path, "wb") as f:
            f.write(bytes(128))
            for b in batches:
                parts = []
                for c in b.columns:
                    if c.null_count or c.flatten().null_count:
                        raise ValueError("a null can't be written to an array file")
                    sizes = np.diff(c.offsets.to_numpy())
                    each = int(sizes[0]) if each is None and len(sizes) else each
                    if (sizes != each).any():
                        raise ValueError("records of one file must have one length")
                    parts.append(c.flatten().to_numpy())
                rows += b.num_rows
                f.write((parts[0] + 1j * parts[1] if len(parts) > 1 else parts[0]).astype("<c16" if len(parts) > 1 else "<f8").tobytes())
            about = f"{{'descr': '{'<c16' if len(self.columns) > 1 else '<f8'}', 'fortran_order': False, 'shape': ({rows}, {each or 0}), }}"
            f.seek(0)
            f.write(NPY_MAGIC + b"\x01\x00" + struct.pack("<H", 118) + about.ljust(117).encode() + b"\n")
        return Written(path)

    def commit(self, messages) -> None:
        for m in messages:
            if m is not None:
                folder, name = os.path.split(m.path)
                os.replace(m.path, os.path.join(folder, name.removeprefix("_")))
        for f in self.old:
            os.remove(f)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None:
                os.remove(m.path)
