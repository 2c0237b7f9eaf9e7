import struct
import zlib

import numpy as np
import pytest

from geomill.operators import regions
from geomill.sources import geotiff, tables


def tiff(path, pixels, block, tiled=False, deflate=False, predictor=1, order="<", big=False, no_data=None, bands=1):
    """A file by the format's rules: blocks, then values that don't fit into the directory, then the directory."""
    pixels = pixels.astype(pixels.dtype.newbyteorder(order))
    rows, cols = block if tiled else (block[0], pixels.shape[1])
    out, offsets, sizes = bytearray(b"\0" * 16), [], []
    for top in range(0, pixels.shape[0], rows):
        for left in range(0, pixels.shape[1], cols):
            part = pixels[top : top + rows, left : left + cols]
            if tiled:
                part = np.pad(part, ((0, rows - part.shape[0]), (0, cols - part.shape[1])))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=part.dtype.type(0)).astype(part.dtype)
            content = zlib.compress(part.tobytes()) if deflate else part.tobytes()
            offsets.append(len(out))
            sizes.append(len(content))
            out += content
    kind = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    tags = {256: ("I", [pixels.shape[1]]), 257: ("I", [pixels.shape[0]]), 258: ("H", [pixels.dtype.itemsize * 8]), 259: ("H", [8 if deflate else 1]), 277: ("H", [bands]), 317: ("H", [predictor]), 339: ("H", [kind])}
    tags |= {322: ("I", [cols]), 323: ("I", [rows]), 324: ("I", offsets), 325: ("I", sizes)} if tiled else {273: ("I", offsets), 278: ("I", [rows]), 279: ("I", sizes)}
    tags |= {33550: ("d", [10.0, 10.0, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, -180.0, 90.0, 0.0])}
    if no_data is not None:
        tags[42113] = ("c", [bytes([c]) for c in f"{no_data}\0".encode()])
    entries, room, wide = b"", 8 if big else 4, "Q" if big else "I"
    for tag, (code, values) in sorted(tags.items()):
        content = struct.pack(f"{order}{len(values)}{code}", *values)
        field = content.ljust(room, b"\0")
        if len(content) > room:
            field = struct.pack(order + wide, len(out))
            out += content
        entries += struct.pack(order + "HH" + wide, tag, {"H": 3, "I": 4, "d": 12, "c": 2}[code], len(values)) + field
    at = len(out)
    out += struct.pack(order + ("Q" if big else "H"), len(tags)) + entries
    head = {"<": b"II", ">": b"MM"}[order] + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    out[: len(head)] = head
    path.write_bytes(out)
    return str(path)


@pytest.mark.parametrize("options", [{}, {"tiled": True, "deflate": True, "predictor": 2}, {"order": ">", "big": True, "deflate": True}, {"tiled": True, "order": ">", "predictor": 2}])
@pytest.mark.parametrize("kind", ["u1", "i2", "f4"])
def test_pixels(spark, tmp_path, options, kind):
    if kind == "f4" and options.get("predictor") == 2:
        pytest.skip("horizontal differences are of whole numbers")
    pixels = (np.arange(37 * 53).reshape(37, 53) * 7 % 101).astype(kind)
    path = tiff(tmp_path / "r.tif", pixels, (16, 16), no_data=100, **options)
    df = geotiff.load(spark, path, task_pixels=1)
    want = {(r, c): float(v) for (r, c), v in np.ndenumerate(pixels) if v != 100}
    assert {(r.row, r.col): r.value for r in df.collect()} == want and df.rdd.getNumPartitions() == 3
    window = geotiff.load(spark, path, (10, 20, 15, 40))
    assert {(r.row, r.col): r.value for r in window.collect()} == {k: v for k, v in want.items() if 10 <= k[0] < 20 and 15 <= k[1] < 40}
    assert geotiff.load(spark, path, (50, 60, 0, 9)).count() == 0


def test_window_reads_its_blocks(tmp_path):
    """Blocks outside the window aren't fetched."""
    path = tiff(tmp_path / "r.tif", np.ones((64, 64), "u1"), (16, 16), tiled=True)
    reader = geotiff._Reader(path, (16, 32, 16, 48), 1)
    assert [(p.first, p.last) for p in reader.partitions()] == [(1, 2)]
    assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 2


def test_lookup_through_it(spark, tmp_path):
    """The same labels as through the text grid."""
    pixels = np.arange(18 * 36).reshape(18, 36) % 31
    path = tiff(tmp_path / "k.tif", pixels.astype("u1"), (4, 36), no_data=0)
    (tmp_path / "k.asc").write_text("ncols 36\nnrows 18\n" + "\n".join(" ".join(map(str, r)) for r in pixels))
    assert geotiff.place(path) == (-180.0, 90.0, 10.0, 10.0)
    p = spark.createDataFrame([(i, -89.0 + i * 3.3, -179.0 + i * 6.1) for i in range(54)] + [(99, None, 1.0)], "id int, Latitude double, Longitude double")
    told = lambda raster: sorted((r.id, r.value) for r in regions.raster_lookup(p, raster, -180.0, 90.0, 10.0).collect() if r.value)
    assert told(geotiff.load(spark, path)) == told(tables.raster(spark, str(tmp_path / "k.asc"))) != []


def test_refused(tmp_path):
    (tmp_path / "x.tif").write_bytes(b"no raster at all")
    with pytest.raises(ValueError, match="no TIFF"):
        geotiff.Header(str(tmp_path / "x.tif"))
    with pytest.raises(ValueError, match="bands"):
        geotiff.Header(tiff(tmp_path / "b.tif", np.ones((4, 4), "u1"), (2, 4), bands=3))
