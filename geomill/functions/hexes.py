"""Cells of the hexagonal H3 grid: identifiers of coordinates, centres, corners, neighbours.

The grid lies on an icosahedron. Each face carries the Eisenstein integers p + q w (w a third
of a turn) of a plane that touches it; a vertex of the face stands two units from its middle.
A resolution divides the lattice by a number of norm 7, by turns 2 - w and 3 + w, so a digit is
the residue class of a point modulo 7, and the point above is an exact division. What
isn't stated below as fixed is derived from the places of the faces: which faces meet at an
edge or vertex, and how often a cell's digits turn between the plane they were found in and
that of the cell's own face. Around the twelve pentagons a sixth of the plane is missing, so
digits skip one of six directions.

All functions work on Arrow batches with array arithmetic. (As column expressions the walk over
the digits takes nested lambdas, which Spark interprets: some 100 microseconds a row.) A cell is its identifier in hexadecimal, as ``grid.h3_parent`` takes it. Missing
or non-finite coordinates and latitudes past the poles have no cell; text that is no
identifier has no centre, corners or neighbours.
"""

from __future__ import annotations

import cmath
import math
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

FINEST = 15
_PLACE = StructType([StructField("lat", DoubleType()), StructField("lon", DoubleType())])

# Fixed values of the grid: latitude and longitude of the middle of each face and the azimuth of its first axis, in radians.
FACES = (
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882),
    (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055),
    (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400),
    (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874),
    (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154),
    (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562),
    (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361),
    (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535),
    (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316),
    (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436),
    (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
)
# Fixed values of the grid: own face and place (i, j, k) on it of each cell of resolution 0, by number.
ZERO_CELLS = """
1 100  2 110  1 000  2 100  0 200  1 110  1 001  2 000  0 100  2 010  1 010  1 011
3 100  3 110  11 200  4 100  0 000  6 010  0 001  2 011  7 001  2 001  0 110  6 001
10 200  6 000  3 000  11 100  4 110  3 010  0 011  4 000  5 010  0 010  7 010  11 110
7 000  10 100  12 200  6 101  7 101  4 001  3 001  3 011  4 010  6 100  11 000  8 001
5 001  14 200  5 000  12 100  10 110  4 011  12 110  7 100  11 010  10 000  13 200  10 001
11 001  9 010  8 010  6 200  8 000  9 001  14 100  5 101  16 011  8 101  5 100  12 000
7 200  12 010  10 010  9 000  13 100  16 001  15 011  15 010  16 010  14 110  13 110  5 200
8 100  14 000  9 101  14 001  17 001  12 001  16 000  17 011  15 001  16 101  9 100  15 000
13 000  8 200  13 010  17 101  19 010  14 010  19 011  17 010  13 001  17 000  16 100  9 200
15 101  15 100  18 011  18 001  19 001  17 100  19 000  18 010  18 101  19 200  19 100  18 000
19 101  18 100
"""
# Fixed values of the grid: the length of a unit at resolution 0 in the plane, and what odd resolutions are turned by.
UNIT = 0.38196601125010500003
TURN = 0.333473172251832115

W = cmath.exp(2j * math.pi / 3)
#: The directions of digits 1 to 6, and of digit 0, as (p, q).
DIGITS = ((0, 0), (-1, -1), (0, 1), (-1, 0), (1, 0), (0, -1), (1, 1))
#: Digits 5 4 6 2 3 1 in the order of a turn by sixths to the left.
CIRCLE = (5, 4, 6, 2, 3, 1)
_AXES = (2, 2 * W, 2 * W * W)
_NORMALS = tuple(cmath.exp(1j * math.pi * (1 + 2 * e) / 3) for e in range(3))  # of the edges ij, jk, ki


def _xyz(lat: float, lon: float) -> np.ndarray:
    return np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)])


@lru_cache(1)
def _frames() -> np.ndarray:
    """Of each face: the middle, and the directions of the plane's real and imaginary axes."""
    out = []
    for lat, lon, azimuth in FACES:
        north = np.array([-math.sin(lat) * math.cos(lon), -math.sin(lat) * math.sin(lon), math.cos(lat)])
        east = np.array([-math.sin(lon), math.cos(lon), 0.0])
        out.append((_xyz(lat, lon), math.cos(azimuth) * north + math.sin(azimuth) * east, math.sin(azimuth) * north - math.cos(azimuth) * east))
    return np.array(out)


def _points(face: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Points of the sphere below places in the planes of faces."""
    f = _frames()[face]
    v = f[..., 0, :] + UNIT * (z.real[..., None] * f[..., 1, :] + z.imag[..., None] * f[..., 2, :])
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


@lru_cache(1)
def _edges() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The face past each edge of a face, and the factor and shift from one plane to the other."""
    corner = np.array([[_points(np.array(f), np.array(a)) for a in _AXES] for f in range(20)])
    to, factor, shift = np.zeros((20, 3), int), np.zeros((20, 3), complex), np.zeros((20, 3), complex)
    for f, e in product(range(20), range(3)):
        ends = (e, (e + 1) % 3)
        for g in set(range(20)) - {f}:
            same = [np.flatnonzero(np.linalg.norm(corner[g] - corner[f, a], axis=1) < 1e-6) for a in ends]
            if all(len(s) for s in same):
                a, b = (_AXES[s[0]] for s in same)
                to[f, e], factor[f, e] = g, (a - b) / (_AXES[ends[0]] - _AXES[ends[1]])
                shift[f, e] = a - factor[f, e] * _AXES[ends[0]]
    return to, factor, shift


@lru_cache(1)
def _zero_cells() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own face, place on it and point of the sphere of each cell of resolution 0."""
    words = ZERO_CELLS.split()
    face = np.array([int(w) for w in words[::2]])
    z = np.array([sum(int(n) * W**a for a, n in enumerate(w)) for w in words[1::2]])
    return face, z, _points(face, z)


@lru_cache(1)
def _fans() -> dict[int, list[tuple[int, int]]]:
    """Of each pentagon the faces around it to the left from its own one, each with the axis on which it has the pentagon."""
    face, z, at = _zero_cells()
    mids, fans = _frames()[:, 0], {}
    for n in np.flatnonzero(np.abs(z) > 1.9):
        v = at[n]
        first = mids[face[n]] - v * (mids[face[n]] @ v)
        side = np.cross(v, first)
        near = np.argsort(-(mids @ v))[:5]
        around = sorted(near, key=lambda g: (round(math.atan2(mids[g] @ side, mids[g] @ first), 6) + 1e-3) % (2 * math.pi))
        fans[int(n)] = [(int(g), int(np.argmin([np.linalg.norm(_points(np.array(g), np.array(a)) - v) for a in _AXES]))) for g in around]
    return fans


def _sixths(factor: complex) -> int:
    return round(cmath.phase(factor) / (math.pi / 3)) % 6


#: The digit that points from the pentagon into the face, if it stands on the first, second or third axis, by its place in the circle of five.
_INWARD = (4, 0, 2)


@lru_cache(1)
def _placed() -> list[tuple[int, int, int]]:
    """For face, p, q (-2 to 2): the cell of resolution 0 there, its turns, and 1 if missing digits turn right; -1 outside."""
    home, _, at = _zero_cells()
    to, factor, shift = _edges()
    out = []
    for f, p, q in product(range(20), range(-2, 3), range(-2, 3)):
        if abs(p - q) > 2:
            out.append((-1, 0, 0))
            continue
        z, g, turns = p + q * W, f, 0
        over = [(z * n.conjugate()).real for n in _NORMALS]
        e = int(np.argmax(over))
        if over[e] > 1 + 1e-9:
            z, g, turns = factor[f, e] * z + shift[f, e], int(to[f, e]), _sixths(factor[f, e])
        cell = int(np.argmin(np.linalg.norm(at - _points(np.array(g), np.array(z)), axis=1)))
        if cell in _fans():
            fan = _fans()[cell]
            step, axis = next((s, a) for s, (h, a) in enumerate(fan) if h == g)
            own = (4, 0, 1, 2, 3)[step]
            out.append((cell, (own - _INWARD[axis]) % 5, int(axis == 1)))
            continue
        if home[cell] != g:
            turns += _sixths(factor[g, list(to[g]).index(home[cell])])
        out.append((cell, turns % 6, 0))
    return out


def _encoded(lat: np.ndarray, lon: np.ndarray, resolution: int) -> np.ndarray:
    """Identifiers as numbers, 0 where there is none."""
    frames, placed = _frames(), np.array(_placed())
    la, lo = np.radians(lat), np.radians(lon)
    v = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], 1)
    near = v @ frames[:, 0].T
    face = near.argmax(axis=1)
    on = lambda axis: np.einsum("ni,ni->n", v, frames[face, axis]) / near[np.arange(len(v)), face] / UNIT
    z = (on(1) + 1j * on(2)) * math.sqrt(7) ** resolution * (cmath.exp(-1j * TURN) if resolution % 2 else 1)
    # the nearest lattice point: of three coordinates with sum 0 the one that rounding moves most follows from the others
    real = np.stack([z.real + z.imag / W.imag / 2, z.imag / W.imag])
    real = np.concatenate([real, real[1:] - real[:1]])
    p, q, s = np.rint(real)
    moved = np.abs(real - np.stack([p, q, s])).argmax(axis=0)
    p, q = np.where(moved == 0, q - s, p).astype(np.int64), np.where(moved == 1, p + s, q).astype(np.int64)
    digits = np.zeros((resolution + 1, len(v)), np.int64)
    lead = np.zeros(len(v), np.int64)
    steps = np.array(DIGITS)
    for level in range(resolution, 0, -1):
        w, first, second = (2, (3, -1), (1, 2)) if level % 2 else (4, (2, 1), (-1, 3))
        of_rest = np.argsort((steps[:, 0] + w * steps[:, 1]) % 7)
        d = of_rest[(p + w * q) % 7]
        p, q = p - steps[d, 0], q - steps[d, 1]
        p, q = (first[0] * p + first[1] * q) // 7, (second[0] * p + second[1] * q) // 7
        digits[level], lead = d, np.where(d != 0, d, lead)
    cell, turns, right = placed[face * 25 + (p + 2) * 5 + q + 2].T
    # sixths to turn all digits by; around a pentagon the leading one steps over the missing digit 1
    place = np.array([0, *[CIRCLE.index(d) for d in range(1, 7)]])[lead]
    missing = lead == 1
    kept = np.where(missing, np.where(right == 1, 4, 0), place)
    around = np.where(missing, np.where(right == 1, 5, 1), 0) + turns + (kept + turns >= 5)
    turns = np.where(np.isin(cell, sorted(_fans())), np.where(lead == 0, 0, around), turns) % 6
    turned = np.array([[0 if not d else CIRCLE[(CIRCLE.index(d) + t) % 6] for d in range(7)] for t in range(6)])
    out = (1 << 59) | (resolution << 52) | ((1 << (45 - 3 * resolution)) - 1) | cell << 45
    for level in range(1, resolution + 1):
        out |= turned[turns, digits[level]] << (45 - 3 * level)
    return np.where(cell >= 0, out, 0)


def _named(lat: np.ndarray, lon: np.ndarray, resolution: int) -> np.ndarray:
    out = np.full(len(lat), None, object)
    ok = np.isfinite(lat) & np.isfinite(lon) & (np.abs(np.nan_to_num(lat)) <= 90)
    out[ok] = [f"{n:x}" if n else None for n in _encoded(lat[ok], lon[ok], resolution)]
    return out


def encode(lat: Column, lon: Column, resolution: int = 11) -> Column:
    """The identifier of the cell of a coordinate in degrees."""
    if not 0 <= resolution <= FINEST:
        raise ValueError(f"resolutions go from 0 to {FINEST}, not {resolution}")

    @F.pandas_udf(StringType())
    def cell(lat: pd.Series, lon: pd.Series) -> pd.Series:
        return pd.Series(_named(lat.to_numpy(float), lon.to_numpy(float), resolution), dtype=object)

    return cell(lat.cast("double"), lon.cast("double"))


def _unfolded(face: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Points of the sphere of places that may lie past the edges of their faces."""
    to, factor, shift = _edges()
    face, z = face.copy(), z.copy()
    for _ in range(3):
        over = np.stack([(z * n.conjugate()).real for n in _NORMALS])
        e = over.argmax(axis=0)
        past = over.max(axis=0) > 1 + 1e-12
        z = np.where(past, factor[face, e] * z + shift[face, e], z)
        face = np.where(past, to[face, e], face)
    return _points(face, z)


def _located(cells: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the valid identifiers: which they are, a face, the place of the middle in its plane, and the vector of a step along the first axis."""
    texts = cells.fillna("").astype(str).str.lower()
    ok = texts.str.fullmatch("8[0-9a-f]{14}").to_numpy(bool)
    numbers = np.array([int(t, 16) for t in texts[ok]], np.int64)
    res, base = numbers >> 52 & 15, numbers >> 45 & 127
    digits = np.stack([numbers >> (45 - 3 * r) & 7 for r in range(1, 16)], 1) if len(numbers) else np.zeros((0, 15), np.int64)
    used = np.arange(1, 16)[None, :] <= res[:, None]
    lead = np.array([next((d for d, u in zip(row, on, strict=True) if d and u), 0) for row, on in zip(digits, used, strict=True)], int)
    pentagon = np.isin(base, sorted(_fans()))
    good = (base < 122) & ((digits < 7) | ~used).all(axis=1) & ((digits == 7) | used).all(axis=1) & ~(pentagon & (lead == 1))
    ok[ok] = good
    res, base, digits, lead, pentagon = res[good], base[good], digits[good], lead[good], pentagon[good]
    home, at, _ = _zero_cells()
    unit = np.array([complex(p + q * W) for p, q in DIGITS] + [0])
    step = np.sqrt(7.0) ** -np.arange(16) * np.where(np.arange(16) % 2, cmath.exp(1j * TURN), 1)
    offset = sum((np.where(res >= r, unit[digits[:, r - 1]] * step[r], 0) for r in range(1, 16)), np.zeros(len(res), complex))
    face, z, along = home[base], at[base] + offset, step[res].astype(complex)
    for i in np.flatnonzero(pentagon):
        # the leading digit tells the face; there the digits are those of the plane, turned
        place = CIRCLE.index(lead[i]) if lead[i] else 4
        face[i], axis = _fans()[int(base[i])][(place + 1) % 5]
        turn = cmath.exp(1j * math.pi / 3 * (_INWARD[axis] - place))
        z[i], along[i] = _AXES[axis] + offset[i] * turn, along[i] * turn
    return ok, face, z, along


def _pairs(points: np.ndarray) -> np.ndarray:
    return np.degrees(np.stack([np.arcsin(np.clip(points[..., 2], -1, 1)), np.arctan2(points[..., 1], points[..., 0])], -1))


@F.pandas_udf(_PLACE)
def centre(cells: pd.Series) -> pd.DataFrame:
    """Latitude and longitude of a cell's middle."""
    ok, face, z, _ = _located(cells)
    out = np.full((len(cells), 2), np.nan)
    out[ok] = _pairs(_unfolded(face, z))
    frame = pd.DataFrame(out, columns=["lat", "lon"]).astype("Float64")
    return frame.mask(frame.isna())


def _fan_around(base: int, along: complex, radius: float, turn: float) -> np.ndarray:
    """Five points around a pentagon, one in the plane of each of its faces: the ray of the turned star in the face's sixth."""
    faces, places = [], []
    for g, axis in _fans()[base]:
        inward = -_AXES[axis] / 2
        angle = (cmath.phase(along * cmath.exp(1j * turn) / inward) + math.pi / 6) % (math.pi / 3) - math.pi / 6
        faces.append(g)
        places.append(_AXES[axis] + radius * abs(along) * inward * cmath.exp(1j * angle))
    return _unfolded(np.array(faces), np.array(places))


def _rings(cells: pd.Series, radius: float, turn: float) -> list[np.ndarray | None]:
    """Latitudes and longitudes of the six or five points around each cell's middle."""
    ok, face, z, along = _located(cells)
    star = np.exp(1j * (np.arange(6) * math.pi / 3 + turn))
    six = _pairs(_unfolded(np.repeat(face[:, None], 6, axis=1), z[:, None] + radius * along[:, None] * star))
    out: list[np.ndarray | None] = [None] * len(cells)
    for i, ring, c, a in zip(np.flatnonzero(ok), six, z, along, strict=True):
        base = int(cells.iloc[i], 16) >> 45 & 127
        on_vertex = base in _fans() and min(abs(c - v) for v in _AXES) < 1e-9
        out[i] = _pairs(_fan_around(base, a, radius, turn)) if on_vertex else ring
    return out


@F.pandas_udf(ArrayType(_PLACE))
def corners(cells: pd.Series) -> pd.Series:
    """The corners in a turn to the left, six or five; points where a side bends at an edge of the icosahedron are left out. ``grid.unwrapped`` takes them over the antimeridian."""
    rings = _rings(cells, 1 / math.sqrt(3), math.pi / 6)
    return pd.Series([None if r is None else [{"lat": lat, "lon": lon} for lat, lon in r] for r in rings], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def disk(cells: pd.Series) -> pd.Series:
    """The cell and its neighbours (six, or five of a pentagon), as an array."""
    rings = _rings(cells, 1.0, 0.0)
    out = pd.Series([None] * len(cells), dtype=object)
    level = np.array([-1 if r is None else int(c, 16) >> 52 & 15 for c, r in zip(cells, rings, strict=True)], int)
    for res in sorted(set(level) - {-1}):
        mine = np.flatnonzero(level == res)
        sizes = [len(rings[i]) for i in mine]
        places = np.concatenate([rings[i] for i in mine])
        for i, names in zip(mine, np.split(_named(places[:, 0], places[:, 1], int(res)), np.cumsum(sizes)[:-1]), strict=True):
            out.iloc[i] = list(dict.fromkeys([cells.iloc[i].lower(), *names]))
    return out
