"""Hierarchical cells.

The default grid is equirectangular with aperture 9: 45-degree cells at resolution 0,
each split into 3 x 3 at the next, so resolution 11 has cells of some 28 m. A cell is
a 64-bit number: resolution, row, column. Its hierarchy and neighbourhoods are plain
integer arithmetic, exact in any engine. Cell shapes, sizes and counts are not those of
a hexagonal grid. For identifiers of the H3 grid the bit-level functions (resolution,
parent) are exact; encoding needs the ``h3`` package, where there is one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FINEST, BASE = 11, 45.0
_ROW, _RES = 1 << 22, 1 << 44


def cell_size(resolution: int) -> float:
    return BASE / 3**resolution


def rows(resolution: int) -> int:
    return 4 * 3**resolution


def cell(row: Column, col: Column, resolution: int | Column) -> Column:
    r = F.lit(resolution) if isinstance(resolution, int) else resolution
    return r.cast("long") * _RES + row.cast("long") * _ROW + col.cast("long")


def encode(lat: Column, lon: Column, resolution: int = FINEST) -> Column:
    """The cell of a coordinate at a resolution; null if a coordinate is missing or latitude is out of range."""
    size = F.lit(cell_size(FINEST))
    fine_row = F.least(F.floor((lat + 90) / size), F.lit(rows(FINEST) - 1))
    fine_col = F.pmod(F.floor((lon + 180) / size), F.lit(2 * rows(FINEST)).cast("long"))
    step = 3 ** (FINEST - resolution)
    inside = lat.between(-90, 90) & lon.isNotNull() & ~F.isnan(lon)
    return F.when(inside, cell(F.floor(fine_row / step), F.floor(fine_col / step), resolution))


def resolution(c: Column) -> Column:
    return F.floor(c / _RES).cast("int")


def row(c: Column) -> Column:
    return F.floor(F.pmod(c, F.lit(_RES)) / _ROW)


def col(c: Column) -> Column:
    return F.pmod(c, F.lit(_ROW))


def parent(c: Column, to: int | Column) -> Column:
    """The ancestor at a coarser resolution; null if the cell is coarser itself."""
    target = F.lit(to) if isinstance(to, int) else to
    step = F.pow(F.lit(3), resolution(c) - target).cast("long")
    return F.when(resolution(c) >= target, cell(F.floor(row(c) / step), F.floor(col(c) / step), target))


def disk(c: Column) -> Column:
    """The cell and its neighbours, as an array: columns wrap round, rows end at the poles."""
    n = (F.pow(F.lit(3), resolution(c)) * 4).cast("long")
    at = lambda i, j: F.when((row(c) + i >= 0) & (row(c) + i < n), cell(row(c) + i, F.pmod(col(c) + j, 2 * n), resolution(c)))
    return F.array_distinct(F.array_compact(F.array(*[at(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])))


def centre(c: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the cell's centre."""
    size = F.lit(BASE) / F.pow(F.lit(3), resolution(c))
    return (row(c) + 0.5) * size - 90, (col(c) + 0.5) * size - 180


def boundary(c: Column) -> Column:
    """The four corners, as an array of (lat, lon)."""
    size = F.lit(BASE) / F.pow(F.lit(3), resolution(c))
    corner = lambda i, j: F.struct(((row(c) + i) * size - 90).alias("lat"), ((col(c) + j) * size - 180).alias("lon"))
    return F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0))


def unwrapped(ring: Column) -> Column:
    """A boundary that crosses the antimeridian with its western longitudes plus 360, unless it goes round a pole."""
    lons = F.transform(ring, lambda p: p["lon"])
    crosses = (F.array_max(lons) - F.array_min(lons) > 180) & (F.array_max(F.transform(ring, lambda p: F.abs(p["lat"]))) < 89.9)
    return F.transform(ring, lambda p: F.struct(p["lat"].alias("lat"), F.when(crosses & (p["lon"] < 0), p["lon"] + 360).otherwise(p["lon"]).alias("lon")))


def h3_number(hexadecimal: Column) -> Column:
    """An H3 identifier as a number (identifiers have at most 60 bits)."""
    return F.conv(hexadecimal, 16, 10).cast("long")


def h3_resolution(hexadecimal: Column) -> Column:
    return F.shiftright(h3_number(hexadecimal), 52).bitwiseAND(15).cast("int")


def h3_parent(hexadecimal: Column, to: int) -> Column:
    """The ancestor of an H3 identifier; null if it is coarser itself."""
    v = h3_number(hexadecimal)
    bits = v.bitwiseAND(~(15 << 52)).bitwiseOR(to << 52).bitwiseOR((1 << (3 * (15 - to))) - 1)
    return F.when(h3_resolution(hexadecimal) >= to, F.lower(F.hex(bits)))
