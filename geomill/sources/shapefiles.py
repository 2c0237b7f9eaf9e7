"""Shapefiles: polygons with holes and their attributes, read in ranges of records and written in parts.

Reading goes by the index file (``.shx``), whose entries have a fixed size: each task takes a
range of records, and fetches just their bytes of ``.shp`` and ``.dbf``. A path is a ``.shp`` file, or
a folder that ``write`` made. Writing gives each task files of its own, of at most ``PART_BYTES`` of
shapes; the commit writes the list of parts that count, so what lost or repeated tasks leave is
never read. Paths are those that pyarrow's file systems know.

Null shapes have null rings, deleted or blank attributes are null (so empty text comes back as
null), other kinds of shape than polygons are refused. An outer ring turns to the right, and a hole
belongs to the smallest outer ring around it; a hole that no ring is around is taken for a
polygon of its own. Attributes are text of at most 254 bytes, names of at most 10; longer ones are
refused, not cut.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from geomill.operators.regions import inside_polygon

RECORDS, PART_BYTES = 5_000, 64 << 20
_POLYGONS, _HEAD = (5, 15, 25), 100
SCHEMA = "part string, record int, attributes map<string, string>, rings array<array<array<double>>>"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _bytes(path: str, start: int = 0, size: int | None = None) -> bytes:
    system, at = _opened(path)
    with system.open_input_file(at) as f:
        f.seek(start)
        return f.read() if size is None else f.read(size)


def _exists(path: str) -> bool:
    system, at = _opened(path)
    return system.get_file_info(at).type == fs.FileType.File


def parts_of(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """The rings of a shape as polygons: an outer ring first, then its holes."""

    def area(r: np.ndarray) -> float:
        x, y = (r - r[0]).T
        return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2

    areas = [area(r) for r in rings]
    outer = [i for i, a in enumerate(areas) if a <= 0]
    found = {i: [rings[i]] for i in outer}
    for i, a in enumerate(areas):
        if a > 0:
            around = [o for o in outer if -areas[o] >= a and inside_polygon([rings[o]], rings[i][:, 1], rings[i][:, 0]).mean() >= 0.5]
            home = min(around, key=lambda o: -areas[o], default=None)
            if home is None:
                found[i] = [rings[i]]
            else:
                found[home].append(rings[i])
    return [found[i] for i in sorted(found)]


def _rings(content: bytes) -> list[np.ndarray] | None:
    kind = struct.unpack_from("<i", content)[0]
    if kind == 0:
        return None
    if kind not in _POLYGONS:
        raise ValueError(f"shapes of kind {kind} are no polygons")
    parts, points = struct.unpack_from("<ii", content, 36)
    starts = [*np.frombuffer(content, "<i4", parts, 44).tolist(), points]
    xy = np.frombuffer(content, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    return [xy[a:b] for a, b in zip(starts, starts[1:], strict=False) if b > a]


def _attributes(stem: str, first: int, n: int) -> list[dict[str, str | None] | None]:
    if not _exists(stem + ".dbf"):
        return [None] * n
    head = _bytes(stem + ".dbf", 0, 32)
    size, width = struct.unpack_from("<HH", head, 8)
    fields, names = _bytes(stem + ".dbf", 32, size - 33), []
    for at in range(0, len(fields) - 31, 32):
        names.append((fields[at : at + 11].split(b"\0")[0].decode("latin-1"), fields[at + 16]))
    code = _bytes(stem + ".cpg").decode("ascii").strip() if _exists(stem + ".cpg") else "latin-1"
    body, out = _bytes(stem + ".dbf", size + first * width, n * width), []
    for i in range(n):
        row, at, values = body[i * width : (i + 1) * width], 1, {}
        for name, wide in names:
            values[name] = row[at : at + wide].decode(code).strip("\0 ") or None
            at += wide
        out.append(None if row[:1] == b"*" else values)
    return out


@dataclass
class Records(InputPartition):
    stem: str
    first: int
    size: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path.rstrip("/"), per_task

    def partitions(self) -> list[Records]:
        whole = self.path.lower().endswith(".shp")
        stems = [self.path[:-4]] if whole else [f"{self.path}/{name}" for name in _bytes(f"{self.path}/_parts").decode().split()]
        out = []
        for stem in stems:
            system, at = _opened(stem + ".shx")
            n = (system.get_file_info(at).size - _HEAD) // 8
            out += [Records(stem, i, min(self.per_task, n - i)) for i in range(0, n, self.per_task)]
        return out or [Records("", 0, 0)]

    def read(self, p: Records) -> Iterator[Row]:
        if not p.size:
            return
        entries = np.frombuffer(_bytes(p.stem + ".shx", _HEAD + 8 * p.first, 8 * p.size), ">i4").reshape(-1, 2).astype(np.int64) * 2
        values = _attributes(p.stem, p.first, p.size)
        system, at = _opened(p.stem + ".shp")
        with system.open_input_file(at) as f:
            for i, (start, size) in enumerate(entries.tolist()):
                f.seek(start + 8)
                rings = _rings(f.read(size))
                for part in [None] if rings is None else parts_of(rings):
                    yield Row(part=p.stem.rpartition("/")[2], record=p.first + i, attributes=values[i], rings=None if part is None else [r.tolist() for r in part])


@dataclass
class _Parts(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex[:8]
        self.names = [f.name for f in schema.fields if f.name != "rings"]
        if long := [n for n in self.names if len(n.encode()) > 10]:
            raise ValueError(f"attribute names have at most 10 bytes: {long}")
        if "rings" not in schema.names:
            raise ValueError("there is no column rings")
        system, at = _opened(self.path + "/_parts")
        if system.get_file_info(at).type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} is there already")

    def write(self, rows: Iterator[Row]) -> _Parts:
        names, shapes, values, size = [], [], [], 0
        for row in rows:
            shapes.append(_content(row["rings"]))
            values.append([b"" if row[n] is None else str(row[n]).encode() for n in self.names])
            if any(len(v) > 254 for v in values[-1]):
                raise ValueError("an attribute is longer than 254 bytes")
            size += len(shapes[-1])
            if size > PART_BYTES:
                names.append(self._part(shapes, values))
                shapes, values, size = [], [], 0
        if shapes:
            names.append(self._part(shapes, values))
        return _Parts(names)

    def _part(self, shapes: list[bytes], values: list[list[bytes]]) -> str:
        name = f"part-{self.job}-{uuid.uuid4().hex}"
        boxes = np.array([struct.unpack_from("<4d", s, 4) for s in shapes if len(s) > 4]).reshape(-1, 4)
        box = (*boxes[:, :2].min(axis=0), *boxes[:, 2:].max(axis=0)) if len(boxes) else (0.0,) * 4
        at, index, body = _HEAD // 2, [], []
        for i, s in enumerate(shapes, 1):
            index.append(struct.pack(">ii", at, len(s) // 2))
            body.append(struct.pack(">ii", i, len(s) // 2) + s)
            at += 4 + len(s) // 2
        head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 5, *box, 0, 0, 0, 0)
        wide = [max([1, *(len(v[c]) for v in values)]) for c in range(len(self.names))]
        fields = b"".join(struct.pack("<11sc4xBB14x", n.encode(), b"C", w, 0) for n, w in zip(self.names, wide, strict=True))
        table = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(values), 33 + len(fields), 1 + sum(wide)) + fields + b"\r"
        rows = b"".join(b" " + b"".join(v.ljust(w) for v, w in zip(row, wide, strict=True)) for row in values)
        files = {".shp": head(at) + b"".join(body), ".shx": head(_HEAD // 2 + 4 * len(shapes)) + b"".join(index), ".dbf": table + rows + b"\x1a", ".cpg": b"utf-8"}
        for end, content in files.items():
            _put(f"{self.path}/{name}{end}", content)
        return name

    def commit(self, messages: list[_Parts | None]) -> None:
        _put(self.path + "/_parts", "\n".join(n for m in messages if m for n in m.names).encode())

    def abort(self, messages: list[_Parts | None]) -> None:
        """Parts that no list names are never read."""


def _put(path: str, content: bytes) -> None:
    system, at = _opened(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(content)


def _content(rings: list | None) -> bytes:
    """A polygon's record: the outer ring turned to the right, holes to the left."""
    if not rings:
        return struct.pack("<i", 0)
    turned = []
    for i, ring in enumerate(rings):
        r = np.array(ring, float)[:, :2]
        x, y = (r - r[0]).T
        left = (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() > 0
        turned.append(r[::-1] if left == (i == 0) else r)
    points = np.concatenate(turned)
    starts = np.cumsum([0, *map(len, turned[:-1])])
    return struct.pack("<i4dii", 5, *points.min(axis=0), *points.max(axis=0), len(turned), len(points)) + starts.astype("<i4").tobytes() + points.astype("<f8").tobytes()


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("records", RECORDS)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("shapefiles are written to new folders only")
        return _Writer(self.options["path"], schema)


def load(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """part, record (from 0), attributes and rings (the outer one first) of each polygon; a shape of several polygons has several rows."""
    spark.dataSource.register(Shapefile)
    return spark.read.format("shapefile").option("records", records).load(path)


def polygons(spark: SparkSession, path: str, name: str = "NAME", continent: str = "CONTINENT") -> DataFrame:
    """name, continent, ring and rings, as ``tables.polygons`` has them. Attribute names are compared without case."""
    of = lambda n: F.element_at(F.map_filter(F.transform_keys("attributes", lambda k, _: F.upper(k)), lambda k, _: k == n.upper()), n.upper())
    return load(spark, path).where("rings is not null").select(of(name).alias("name"), of(continent).alias("continent"), F.col("rings")[0].alias("ring"), "rings")


def write(shapes: DataFrame, path: str) -> None:
    """The rows' rings as polygons, all other columns as their attributes, in a new folder."""
    shapes.sparkSession.dataSource.register(Shapefile)
    shapes.write.format("shapefile").mode("append").save(path)
