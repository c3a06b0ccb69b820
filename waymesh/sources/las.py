"""LAS point clouds as a Spark data source that splits files into ranges of records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Records that one task decodes at most.
RANGE = 1_000_000
HEADER_BYTES = 375


def parse_header(head: bytes) -> dict:
    """The public header of LAS 1.0 to 1.4."""
    if len(head) < 227 or head[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = head[24], head[25]
    size, offset = struct.unpack_from("<HI", head, 94)
    kind, length, count = head[104], *struct.unpack_from("<HI", head, 105)
    if (major, minor) >= (1, 4) and len(head) >= 255:
        count = struct.unpack_from("<Q", head, 247)[0] or count
    if kind & 0xC0:
        raise ValueError("compressed LAZ records cannot be read; decompress the file first")
    scale, shift = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
    x1, x0, y1, y0, z1, z0 = struct.unpack_from("<6d", head, 179)
    if kind > 10:
        raise ValueError(f"unknown point format {kind}")
    return {"version": f"{major}.{minor}", "header_size": size, "offset": offset, "format": kind, "length": length, "count": count, "scale": scale, "shift": shift, "box": (x0, y0, z0, x1, y1, z1)}


def decode(records: bytes, header: dict) -> dict[str, np.ndarray]:
    """x, y, z and intensity of whole records."""
    raw = np.frombuffer(records, np.uint8).reshape(-1, header["length"])
    xyz = np.ascontiguousarray(raw[:, :12]).view("<i4").astype(np.float64) * header["scale"] + header["shift"]
    return {"x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "intensity": np.ascontiguousarray(raw[:, 12:14]).view("<u2").ravel().astype(np.float64)}


class Range(InputPartition):
    def __init__(self, path: str, first: int, count: int, header: dict):
        self.path, self.first, self.count, self.header = path, first, count, header


class LasReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def _open(self):
        import pyarrow.fs as fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return system.open_input_file(path)

    def partitions(self) -> list[InputPartition]:
        with self._open() as file:
            header = parse_header(file.read_at(HEADER_BYTES, 0))
            if file.size() < header["offset"] + header["count"] * header["length"]:
                raise ValueError("truncated LAS file")
        return [Range(self.path, a, min(RANGE, header["count"] - a), header) for a in range(0, header["count"], RANGE)] or [Range(self.path, 0, 0, header)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with self._open() as file:
            step = part.header["length"]
            values = decode(file.read_at(part.count * step, part.header["offset"] + part.first * step), part.header)
        yield pa.RecordBatch.from_arrays([pa.array(values[n]) for n in self.names], names=self.names)


class LasDataSource(DataSource):
    """spark.read.format("las").load(path): x, y, z, intensity; a schema picks some of them."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return "x double, y double, z double, intensity double"

    def reader(self, schema) -> LasReader:
        return LasReader(self.options["path"], [f.name for f in schema.fields])
