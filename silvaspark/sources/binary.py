"""A data source for binary PLY and PCD point files, whose layout is read from each file's header: ``spark.dataSource.register(CloudSource)``, then ``spark.read.format("cloud").load(path)``.

Gives file, x, y, z, intensity as double; intensity is null where the header names none. Only headers are read on the driver; files are split by ranges of records, which tasks read as Arrow batches.
Other properties are skipped, points whose x, y or z is not a number are left out, files without points give no row. Compressed and text files, lists among the points or before them, a missing
coordinate and files that end before their last record raise an error.
Options: path (a file, or a folder whose .ply and .pcd files are read), records (of one partition, 2,000,000).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

BATCH, HEAD = 100_000, 4096
COLUMNS = ("x", "y", "z", "intensity")
#: Fixed by the formats: names of types in PLY headers (either spelling), kinds in PCD headers, and how intensity is named in use.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
PCD_KINDS = {"F": "f", "I": "i", "U": "u"}
INTENSITY = ("intensity", "scalar_intensity", "reflectance")


@dataclass(frozen=True)
class Layout:
    """Where the points of a file begin, how many there are, bytes of a record, and type and offset of each column that is read."""

    begin: int
    count: int
    record: int
    types: dict[str, tuple[str, int]]


def _chosen(path: str, fields: list[tuple[str, str]], begin: int, count: int) -> Layout:
    """The layout of records of the given (name, type) fields, in their order."""
    types, at = {}, 0
    for name, kind in fields:
        low = name.lower()
        column = "intensity" if low in INTENSITY else low
        if column in COLUMNS and column not in types:
            types[column] = (kind, at)
        at += np.dtype(kind).itemsize
    if not {"x", "y", "z"} <= set(types):
        raise ValueError(f"no x, y and z in the header: {path}")
    return Layout(begin, count, at, types)


def ply_layout(path: str, lines: list[list[str]], begin: int) -> Layout:
    endian, element, skipped, fields, count = "", "", 0, [], None
    sizes = {}
    for words in lines:
        if words[0] == "format":
            if words[1] not in ("binary_little_endian", "binary_big_endian"):
                raise ValueError(f"not binary: {path}")
            endian = "<" if words[1] == "binary_little_endian" else ">"
        elif words[0] == "element":
            element = words[1]
            sizes[element] = [int(words[2]), 0]
            count = int(words[2]) if element == "vertex" else count
        elif words[0] == "property" and (element == "vertex" or count is None):
            if words[1] == "list":
                raise ValueError(f"lists among the points or before them: {path}")
            kind = endian + PLY_TYPES[words[1]]
            sizes[element][1] += np.dtype(kind).itemsize
            if element == "vertex":
                fields.append((words[2], kind))
    if count is None or not endian:
        raise ValueError(f"no points in the header: {path}")
    for name, (n, size) in sizes.items():
        if name == "vertex":
            break
        skipped += n * size
    return _chosen(path, fields, begin + skipped, count)


def pcd_layout(path: str, lines: list[list[str]], begin: int) -> Layout:
    said = {words[0].upper(): words[1:] for words in lines}
    if said["DATA"] != ["binary"]:
        raise ValueError(f"not binary, or compressed: {path}")
    fields = []
    for name, size, kind, n in zip(said["FIELDS"], said["SIZE"], said["TYPE"], said.get("COUNT", ["1"] * len(said["FIELDS"])), strict=True):
        fields += [(name, f"<{PCD_KINDS[kind]}{size}")] + [("_", f"<{PCD_KINDS[kind]}{size}")] * (int(n) - 1)
    count = int(said["POINTS"][0]) if "POINTS" in said else int(said["WIDTH"][0]) * int(said["HEIGHT"][0])
    return _chosen(path, fields, begin, count)


def layout(path: str) -> Layout:
    """From the header of one file, read in growing pieces until its last line."""
    system, inner = fs.FileSystem.from_uri(path)
    size = HEAD
    with system.open_input_file(inner) as f:
        while True:
            f.seek(0)
            head = f.read(size)
            ply = head[:3] == b"ply"
            lines, at, done = [], 0, False
            while not done and (end := head.find(b"\n", at)) >= 0:
                words = head[at:end].decode("ascii", "replace").split()
                at = end + 1
                if words and words[0] not in ("ply", "comment", "obj_info") and words[0][0] != "#":
                    lines.append(words)
                    done = words[0] == "end_header" if ply else words[0].upper() == "DATA"
            if done:
                return ply_layout(path, lines, at) if ply else pcd_layout(path, lines, at)
            if len(head) < size or size > 1 << 24:
                raise ValueError(f"neither a PLY nor a PCD header: {path}")
            size *= 2


@dataclass
class Range(InputPartition):
    """A range of the records of one file."""

    path: str
    begin: int
    count: int
    record: int
    types: dict[str, tuple[str, int]]


class CloudReader(DataSourceReader):
    def __init__(self, path: str, records: int) -> None:
        self.path, self.records = path, records

    def partitions(self) -> list[Range]:
        system, inner = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [self.path]
        if info.type == fs.FileType.Directory:
            base, inside = self.path.rstrip("/"), system.get_file_info(fs.FileSelector(inner, recursive=True))
            files = sorted(base + f.path[len(inner.rstrip("/")) :] for f in inside if f.is_file and f.path.lower().endswith((".ply", ".pcd")))
        found = []
        for path in files:
            how = layout(path)
            found += [Range(path, how.begin + at * how.record, min(self.records, how.count - at), how.record, how.types) for at in range(0, how.count, self.records)]
        return found or [Range("", 0, 0, 1, {})]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        names = list(partition.types)
        raw = np.dtype({"names": names, "formats": [partition.types[n][0] for n in names], "offsets": [partition.types[n][1] for n in names], "itemsize": partition.record})
        system, inner = fs.FileSystem.from_uri(partition.path)
        with system.open_input_file(inner) as f:
            f.seek(partition.begin)
            for at in range(0, partition.count, BATCH):
                n = min(BATCH, partition.count - at)
                data = f.read(n * partition.record)
                if len(data) < n * partition.record:
                    raise ValueError(f"file ends before its last record: {partition.path}")
                rows = np.frombuffer(data, raw)
                values = {c: rows[c].astype(np.float64) for c in names}
                good = ~np.isnan(values["x"] + values["y"] + values["z"])
                columns = [pa.array(values[c][good]) if c in values else pa.nulls(int(good.sum()), pa.float64()) for c in COLUMNS]
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * int(good.sum()), pa.string()), *columns], names=["file", *COLUMNS])


class CloudSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cloud"

    def schema(self) -> str:
        return "file string, x double, y double, z double, intensity double"

    def reader(self, schema: StructType) -> DataSourceReader:
        path = self.options["path"]
        return CloudReader(path if "://" in path else f"file://{path}", int(self.options.get("records", 2_000_000)))
