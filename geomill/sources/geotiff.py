"""GeoTIFF rasters of one band, read block by block.

The driver reads the header alone. A task takes a range of rows of blocks (strips or tiles),
fetches their entries of the offset table and those blocks that the window meets. Blocks are
raw or deflated, with or without horizontal differences, in classic and BigTIFF files of either
byte order; other compressions and several bands are refused. Pixels without data fall out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from geomill.sources.shapefiles import _bytes

SCHEMA = "row int, col int, value double"
#: Pixels that a task reads, about; at least one row of blocks.
TASK_PIXELS = 4_000_000
# Fixed values of the format: sizes and struct codes of field types, and numbers of tags.
_TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, BANDS, STRIP_ROWS, STRIP_SIZES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, SCALE, TIEPOINT, NO_DATA = 322, 323, 324, 325, 339, 33550, 33922, 42113


class Header:
    """The first directory of a file; values are fetched when asked for, or a range of them."""

    def __init__(self, path: str):
        self.path = path
        head = _bytes(path, 0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        if not self.order or len(head) < 8:
            raise ValueError(f"{path} is no TIFF file")
        version = struct.unpack_from(self.order + "H", head, 2)[0]
        if version not in (42, 43):
            raise ValueError(f"{path} is no TIFF file")
        big = version == 43
        at = struct.unpack_from(self.order + ("Q" if big else "I"), head, 8 if big else 4)[0]
        n = struct.unpack(self.order + ("Q" if big else "H"), _bytes(path, at, 8 if big else 2))[0]
        start, size, room = (at + 8, 20, 8) if big else (at + 2, 12, 4)
        table, self.tags = _bytes(path, start, n * size), {}
        for i in range(n):
            tag, kind = struct.unpack_from(self.order + "HH", table, i * size)
            if kind not in _TYPES:
                continue
            count = struct.unpack_from(self.order + ("Q" if big else "I"), table, i * size + 4)[0]
            field = i * size + size - room
            inside = count * _TYPES[kind][0] <= room
            place = start + field if inside else struct.unpack_from(self.order + ("Q" if big else "I"), table, field)[0]
            self.tags[tag] = (kind, count, place)
        if self.one(BANDS, 1) != 1:
            raise ValueError(f"{path} has several bands")
        if self.one(COMPRESSION, 1) not in (1, 8, 32946) or self.one(PREDICTOR, 1) not in (1, 2):
            raise ValueError(f"the compression of {path} is not known")
        self.width, self.height = self.one(WIDTH), self.one(HEIGHT)
        self.tiled = TILES in self.tags
        self.block = (self.one(TILE_HEIGHT), self.one(TILE_WIDTH)) if self.tiled else (min(self.one(STRIP_ROWS, self.height), self.height), self.width)
        self.across = -(-self.width // self.block[1])
        self.dtype = np.dtype(self.order + {1: "u", 2: "i", 3: "f"}[self.one(FORMAT, 1)] + str(self.one(BITS, 8) // 8))

    def values(self, tag: int, first: int = 0, n: int | None = None) -> tuple:
        kind, count, place = self.tags[tag]
        size, code = _TYPES[kind]
        n = count - first if n is None else n
        return struct.unpack(f"{self.order}{n}{code}", _bytes(self.path, place + first * size, n * size))

    def one(self, tag: int, default: int | None = None) -> int:
        if tag not in self.tags:
            if default is None:
                raise ValueError(f"{self.path} lacks the tag {tag}")
            return default
        return self.values(tag, 0, 1)[0]

    def no_data(self) -> float | None:
        return float(b"".join(self.values(NO_DATA)).strip(b"\0 ")) if NO_DATA in self.tags else None

    def blocks(self, first: int, n: int) -> Iterator[tuple[int, int, bytes]]:
        """Number, and bytes, of blocks in a range; one without bytes holds nothing."""
        offsets = self.values(TILES if self.tiled else STRIPS, first, n)
        sizes = self.values(TILE_SIZES if self.tiled else STRIP_SIZES, first, n)
        for i, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
            if size:
                yield first + i, size, _bytes(self.path, at, size)

    def pixels(self, number: int, content: bytes) -> np.ndarray:
        top = number // self.across * self.block[0]
        rows = self.block[0] if self.tiled else min(self.block[0], self.height - top)
        raw = content if self.one(COMPRESSION, 1) == 1 else zlib.decompress(content)
        found = np.frombuffer(raw, self.dtype, rows * self.block[1]).reshape(rows, self.block[1])
        return np.cumsum(found, axis=1, dtype=found.dtype) if self.one(PREDICTOR, 1) == 2 else found


@dataclass
class Blocks(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, window: tuple[int, int, int, int], pixels: int):
        self.path, self.window, self.task_pixels = path, window, pixels

    def _bounds(self, h: Header) -> tuple[int, int, int, int]:
        top, bottom, left, right = self.window
        return max(top, 0), min(bottom, h.height), max(left, 0), min(right, h.width)

    def partitions(self) -> list[Blocks]:
        h = Header(self.path)
        top, bottom, left, right = self._bounds(h)
        if top >= bottom or left >= right:
            return [Blocks(0, 0)]
        step = max(1, self.task_pixels // (h.block[0] * h.width))
        first, last = top // h.block[0], (bottom - 1) // h.block[0] + 1
        return [Blocks(i, min(i + step, last)) for i in range(first, last, step)]

    def read(self, p: Blocks) -> Iterator[pa.RecordBatch]:
        if p.first == p.last:
            return
        h = Header(self.path)
        top, bottom, left, right = self._bounds(h)
        nothing = h.no_data()
        from_col, to_col = left // h.block[1], (right - 1) // h.block[1] + 1
        for band in range(p.first, p.last):
            for number, _, content in h.blocks(band * h.across + from_col, to_col - from_col):
                found = h.pixels(number, content).astype(np.float64)
                row, col = np.indices(found.shape, np.int32)
                row, col = row + band * h.block[0], col + number % h.across * h.block[1]
                kept = (row >= top) & (row < bottom) & (col >= left) & (col < right) & ~np.isnan(found)
                if nothing is not None:
                    kept &= found != nothing
                yield pa.RecordBatch.from_arrays([pa.array(row[kept], pa.int32()), pa.array(col[kept], pa.int32()), pa.array(found[kept])], ["row", "col", "value"])


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        end = (1 << 31) - 1
        window = tuple(int(self.options.get(n, d)) for n, d in (("top", 0), ("bottom", end), ("left", 0), ("right", end)))
        return _Reader(self.options["path"], window, int(self.options.get("pixels", TASK_PIXELS)))


def load(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, task_pixels: int = TASK_PIXELS) -> DataFrame:
    """row, col, value of the pixels with data, as ``tables.raster`` has them; of a window only (first row, row past the last, first column, column past the last)."""
    spark.dataSource.register(GeoTiff)
    reader = spark.read.format("geotiff").option("pixels", task_pixels)
    for name, value in zip(("top", "bottom", "left", "right"), window or (), strict=False):
        reader = reader.option(name, value)
    return reader.load(path)


def place(path: str) -> tuple[float, float, float, float]:
    """West, north, and the width and height of a pixel, of a raster that isn't turned."""
    h = Header(path)
    if SCALE not in h.tags or TIEPOINT not in h.tags:
        raise ValueError(f"{path} has no place")
    (wide, high, *_), (col, row, _, x, y, *_) = h.values(SCALE), h.values(TIEPOINT)
    return x - col * wide, y + row * high, wide, high
