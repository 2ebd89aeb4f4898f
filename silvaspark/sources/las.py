"""A data source for LAS point files (versions 1.0 to 1.4, point formats 0 to 10): ``spark.dataSource.register(LasSource)``, then ``spark.read.format("las").load(path)``.

Only headers are read on the driver; each file is then split by ranges of records, which tasks read as Arrow batches. Paths are local or anything that pyarrow's file systems open.
Options: path (a file, or a folder whose .las files are read), records (of one partition, 2,000,000). Compressed files are refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, x double, y double, z double, intensity int, classification int"
BATCH = 100_000
#: Fixed by the file format: places of header fields.
VERSION_MINOR, POINTS_FROM, FORMAT, RECORD, COUNT_32, SCALES, COUNT_64, HEADER = 25, 96, 104, 105, 107, 131, 247, 375


@dataclass
class Records(InputPartition):
    """A range of the records of one file."""

    path: str
    begin: int
    count: int
    record: int
    classes_at: int
    scales: tuple[float, ...]


def header(path: str) -> tuple[int, int, int, int, tuple[float, ...]]:
    """(first byte of points, bytes of a record, number of records, place of the class in a record, scales and offsets)."""
    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as f:
        h = f.read(HEADER)
    if len(h) < 227 or h[:4] != b"LASF":
        raise ValueError(f"not a LAS file: {path}")
    kind = h[FORMAT]
    if kind & 0x80 or kind > 10:
        raise ValueError(f"compressed or unknown point format {kind}: {path}")
    (begin,), (record,), (count,) = struct.unpack_from("<I", h, POINTS_FROM), struct.unpack_from("<H", h, RECORD), struct.unpack_from("<I", h, COUNT_32)
    if h[VERSION_MINOR] >= 4 and len(h) >= COUNT_64 + 8:
        count = struct.unpack_from("<Q", h, COUNT_64)[0] or count
    return begin, record, count, 16 if kind >= 6 else 15, struct.unpack_from("<6d", h, SCALES)


class LasReader(DataSourceReader):
    def __init__(self, path: str, records: int) -> None:
        self.path, self.records = path, records

    def partitions(self) -> list[Records]:
        system, inner = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [self.path]
        if info.type == fs.FileType.Directory:
            inside = system.get_file_info(fs.FileSelector(inner, recursive=True))
            base = self.path.rstrip("/")
            files = sorted(base + f.path[len(inner.rstrip("/")) :] for f in inside if f.is_file and f.path.lower().endswith(".las"))
        found = []
        for path in files:
            begin, record, count, classes_at, scales = header(path)
            found += [Records(path, begin + at * record, min(self.records, count - at), record, classes_at, scales) for at in range(0, count, self.records)]
        return found or [Records("", 0, 0, 20, 15, (1.0,) * 3 + (0.0,) * 3)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        raw = np.dtype({"names": ["x", "y", "z", "intensity", "class"], "formats": ["<i4", "<i4", "<i4", "<u2", "u1"], "offsets": [0, 4, 8, 12, partition.classes_at], "itemsize": partition.record})
        system, inner = fs.FileSystem.from_uri(partition.path)
        with system.open_input_file(inner) as f:
            f.seek(partition.begin)
            for at in range(0, partition.count, BATCH):
                n = min(BATCH, partition.count - at)
                data = f.read(n * partition.record)
                if len(data) < n * partition.record:
                    raise ValueError(f"file ends before its last record: {partition.path}")
                rows = np.frombuffer(data, raw)
                place = [rows[c] * partition.scales[i] + partition.scales[3 + i] for i, c in enumerate("xyz")]
                kind = rows["class"] & 31 if partition.classes_at == 15 else rows["class"]
                columns = [pa.array([partition.path] * n), *map(pa.array, place), pa.array(rows["intensity"].astype(np.int32)), pa.array(kind.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "x", "y", "z", "intensity", "classification"])


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        path = self.options["path"]
        return LasReader(path if "://" in path else f"file://{path}", int(self.options.get("records", 2_000_000)))
