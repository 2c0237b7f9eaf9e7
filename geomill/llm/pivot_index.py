"""Exact top-k by inner product: a pivot-distance index with triangle-inequality stops.

Vectors are quantised to integers and lifted by one coordinate, sqrt(M - |x|^2) with M
the largest squared norm, so that the largest inner product is the smallest Euclidean
distance: |q - x|^2 = |q|^2 + M - 2 q.x. Each vector is keyed by its nearest pivot and
the distance r to it. Quantiles of that key cut the index into shards of about ``SHARD``
rows; rows with the very key of a cut are spread over the shards that it bounds, so a
vector that very many rows share fills several. Each shard is made of annuli of
``ANNULUS`` rows. For a query at distance d from the pivot, no vector of an annulus
[lo, hi] is nearer than max(d - hi, lo - d, 0).

A query first searches the shard nearest by that bound (of several, one by its hash),
which bounds its k-th score. It then goes only to the shards whose bound can beat that,
and expands their annuli in order of bound until none can. Rows meet in one sorted
shuffle: a task holds one shard, and the shard's queries stream past it. Queries are
counted before they move: a shard that more than ``QUERY_BLOCK`` ask is split among
as many tasks as it takes, and no other is copied. Pivots are fitted on at most
``SAMPLE`` rows; every row is indexed and the result is exact whatever the pivots are.

Defined cases: a null or empty vector, or one with null or non-finite components, takes
no part, nor does one of another length than most (of equally many the longer); ties go
to the smaller id; fewer than k candidates give fewer rows; a null id takes no part; of
rows repeated with one id the smallest vector asks and all are candidates, but a query
never meets rows with its own id; an empty table gives an empty result; other columns are
ignored. Products are exact in floating point while squared norms stay below 2^53, else
they are made in 64-bit integers; squared norms of 2^62 and more, whose products a long
may not hold, raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geomill.llm import scratch

PIVOTS, SAMPLE, SHARD, ANNULUS, QUERY_BLOCK = 64, 16_384, 8_192, 256, 65_536
#: Queries whose bounds are computed at once.
SLICE = 512
#: Distances in floating point are compared with this much room.
ROOM = 1e-6
EXACT, MOST = 2.0**53, 2.0**62
#: Less than any score.
NONE = -(2**62) - 1


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v, the floor of scale times each component, of the rows that may take part."""
    v, i = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(i.isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite).select(i.cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.empty((0, width))


def _spread(ids: np.ndarray) -> np.ndarray:
    """A hash of each id."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


def _pivots(rows: DataFrame, wanted: int) -> np.ndarray:
    """Farthest-first pivots of the SAMPLE rows with the smallest hashes."""
    sample = rows.select("v", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE).select("v").toPandas()
    x = np.stack(sample["v"].to_numpy())
    chosen, gap = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(wanted, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _bounds(d: np.ndarray, pivot: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each query (rows) and annulus (columns) the least distance there can be."""
    own = d[:, pivot]
    return np.maximum(np.maximum(own - hi, lo - own), 0.0) * (1 - ROOM)


class Shard:
    """Rows of the index in annuli; most: the largest squared norm."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivot: np.ndarray, r: np.ndarray, most: float) -> None:
        order = np.lexsort((r, pivot))
        self.ids, self.x, pivot, r, self.most = ids[order], x[order], pivot[order], r[order], most
        starts = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]])
        cuts = sorted({c for s, e in zip(starts, [*starts[1:], len(pivot)], strict=True) for c in range(s, e, ANNULUS)} | {len(pivot)})
        self.first, self.last = np.array(cuts[:-1]), np.array(cuts[1:]) - 1
        self.pivot, self.lo, self.hi = pivot[self.first], r[self.first], r[self.last]

    def _scores(self, q: np.ndarray, rows: slice) -> np.ndarray:
        if self.most < EXACT:
            return np.rint(q @ self.x[rows].T)
        return q.astype(np.int64) @ self.x[rows].astype(np.int64).T

    def search(self, q_id: np.ndarray, q: np.ndarray, d: np.ndarray, floor: np.ndarray, floor_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, vec ids, scores) of the k best that beat the k-th (score, id) that each query has already."""
        limit = _limit(q, _bounds(d, self.pivot, self.lo, self.hi), self.most)
        whole = np.float64 if self.most < EXACT else np.int64
        best = np.full((len(q), k), NONE, whole)
        best_id = np.full((len(q), k), np.iinfo(np.int64).max)
        for rank in np.argsort(-limit, axis=1, kind="stable").T:  # each query's next annulus
            top = limit[np.arange(len(q)), rank]
            going = top >= np.maximum(floor, best[:, -1])
            if not going.any():
                break
            for a in np.unique(rank[going]):
                mine = np.flatnonzero(going & (rank == a))
                rows = slice(self.first[a], self.last[a] + 1)
                scores = self._scores(q[mine], rows)
                scores[q_id[mine][:, None] == self.ids[rows][None, :]] = NONE
                all_s = np.concatenate([best[mine], scores], axis=1)
                all_i = np.concatenate([best_id[mine], np.broadcast_to(self.ids[rows], scores.shape)], axis=1)
                if all_s.shape[1] > 4 * k:  # ties at the k-th score must stay
                    kth = np.partition(all_s, -k, axis=1)[:, -k]
                    wide = int((all_s >= kth[:, None]).sum(axis=1).max())
                    keep = np.argpartition(-all_s, min(wide, all_s.shape[1]) - 1, axis=1)[:, :wide]
                    all_s, all_i = np.take_along_axis(all_s, keep, 1), np.take_along_axis(all_i, keep, 1)
                o = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                best[mine], best_id[mine] = np.take_along_axis(all_s, o, 1), np.take_along_axis(all_i, o, 1)
        ok = (best > NONE) & ((best > floor[:, None]) | ((best == floor[:, None]) & (best_id < floor_id[:, None])))
        return np.broadcast_to(q_id[:, None], best.shape)[ok], best_id[ok], best[ok].astype(np.int64)


def _limit(q: np.ndarray, bound: np.ndarray, most: float) -> np.ndarray:
    """The largest score that a distance allows: (|q|^2 + M - distance^2) / 2."""
    return ((q * q).sum(axis=1)[:, None] + most - bound * bound) / 2 * (1 + 1e-9) + ROOM * (1 + most * 1e-9)


class Space:
    """Distances to the pivots, and the shards that a query asks."""

    def __init__(self, centres: np.ndarray, most: float) -> None:
        self.centres, self.most = centres, most
        self.squares = (centres * centres).sum(axis=1)
        self.lift = np.sqrt(np.maximum(most - self.squares, 0))
        self.parts = [np.empty(0, np.int64)] * 2 + [np.empty(0)] * 2

    def distances(self, x: np.ndarray, up: np.ndarray) -> np.ndarray:
        flat = (x * x).sum(axis=1)[:, None] - 2 * x @ self.centres.T + self.squares
        return np.sqrt(np.maximum(flat + (up[:, None] - self.lift) ** 2, 0))

    def of_query(self, q: np.ndarray) -> np.ndarray:
        return self.distances(q, np.zeros(len(q)))

    def home(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The nearest shard of each query; of several, one by its hash."""
        shard, pivot, lo, hi = self.parts
        out = np.empty(len(q), np.int64)
        for at in range(0, len(q), SLICE):
            own = slice(at, min(at + SLICE, len(q)))
            bound = _bounds(self.of_query(q[own]), pivot, lo, hi)
            near = bound <= bound.min(axis=1, keepdims=True)
            turn = (_spread(ids[own]) % near.sum(axis=1).astype(np.uint64)).astype(np.int64)
            out[own] = shard[(near & (np.cumsum(near, axis=1) == turn[:, None] + 1)).argmax(axis=1)]
        return out

    def others(self, q: np.ndarray, floor: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) pairs: the shards besides its home that can beat a query's floor."""
        shard, pivot, lo, hi = self.parts
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for at in range(0, len(q), SLICE):
            own = slice(at, min(at + SLICE, len(q)))
            limit = _limit(q[own], _bounds(self.of_query(q[own]), pivot, lo, hi), self.most)
            who, what = np.nonzero((limit >= floor[own][:, None]) & (shard[None, :] != home[own][:, None]))
            pairs = np.unique(np.stack([who + at, shard[what]], axis=1), axis=0)
            out.append((pairs[:, 0], pairs[:, 1]))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


#: A row of the index (kind 0), or of a query on its way to a shard (kind 1: floor, floor_id).
MEETING = "shard int, part int, kind int, vec_id long, v array<double>, pivot int, r double, floor long, floor_id long"
NAMES = ["shard", "part", "kind", "vec_id", "v", "pivot", "r", "floor", "floor_id"]


def _searched(space: Space, width: int, k: int):  # noqa: ANN202
    """A function over rows of MEETING, sorted: a shard is held, its queries stream past it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, shard = None, [], None
        for batch in batches:
            number, part, kind = (batch.column(c).to_numpy() for c in range(3))
            ids, v, floor, floor_id = batch.column(3).to_numpy(), _matrix(batch.column(4), width), batch.column(7).to_numpy(zero_copy_only=False), batch.column(8).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if s == e:
                    continue
                if (number[s], part[s]) != at:
                    at, rows, shard = (number[s], part[s]), [], None
                if kind[s] == 0:
                    pivot, r = batch.column(5).slice(s, e - s).to_numpy(), batch.column(6).slice(s, e - s).to_numpy()
                    rows.append((ids[s:e].copy(), v[s:e].copy(), pivot.copy(), r.copy()))
                    continue
                if shard is None:
                    if not rows:
                        continue
                    shard, rows = Shard(*(np.concatenate([x[i] for x in rows]) for i in range(4)), space.most), []
                for a in range(s, e, SLICE):
                    own = slice(a, min(a + SLICE, e))
                    found = shard.search(ids[own], v[own], space.of_query(v[own]), floor[own], floor_id[own], k)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    return search


def _shards(keyed: DataFrame, n: int) -> np.ndarray:
    """The keys that cut the index into shards of about SHARD rows."""
    wanted = max(1, math.ceil(n / SHARD))
    if wanted == 1:
        return np.empty(0)
    at = [k / wanted for k in range(1, wanted)]
    return np.array(keyed.agg(F.percentile_approx("key", at, max(10_000, 20 * wanted)).alias("cuts")).first()["cuts"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with all other rows.

    is_query: a condition on column vec_id.
    """
    spark = vectors.sparkSession
    rows = scratch.materialize(quantised(vectors, scale, id_col, vector_col), "vectors")
    # one row for each length
    usual = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "w")).alias("x")).first()["x"]
    width = usual["w"] if usual else 0
    rows = rows.where(F.size("v") == width)
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most"), F.sum(F.when(is_query, 1).otherwise(0)).alias("queries")).first()
    if not whole["n"] or not whole["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = float(whole["most"])
    if most >= MOST:
        raise ValueError(f"squared norms of up to {most:.3g}: products may not fit a long")
    space = Space(_pivots(rows, PIVOTS), most)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            d = space.distances(x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0)))
            near = d.argmin(axis=1) if len(x) else np.empty(0, np.int64)
            r = d[np.arange(len(x)), near]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(r), pa.array(near + r / (2 * math.sqrt(most) + 1))], names=["vec_id", "v", "pivot", "r", "key"])

    keyed = scratch.materialize(rows.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<double>, pivot int, r double, key double"), "keyed")
    cuts = _shards(keyed, whole["n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(4).to_numpy()
            low, high = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
            shard = low + (_spread(batch.column(0).to_numpy()) % (high - low + 1).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *batch.columns[:4]], names=["shard", "vec_id", "v", "pivot", "r"])

    index = keyed.mapInArrow(place, "shard int, vec_id long, v array<double>, pivot int, r double")
    # a row for each shard, and one more for each pivot, at most (but for keys on a cut)
    parts = index.groupBy("shard", "pivot").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).orderBy("shard", "pivot").toPandas()
    space.parts = [parts[c].to_numpy() for c in ("shard", "pivot", "lo", "hi")]
    shards = int(parts["shard"].max()) + 1

    def routes(first: bool, split: np.ndarray | None):  # noqa: ANN202
        """Queries on their way, or only how many ask each shard."""

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = np.zeros(shards, np.int64)
            for batch in batches:
                ids, home = batch.column(0).to_numpy(), batch.column(4).to_numpy()
                who, what = (np.arange(len(batch)), home) if first else space.others(_matrix(batch.column(1), width), batch.column(2).to_numpy(), home)
                if split is None:
                    asked += np.bincount(what, minlength=shards)
                    continue
                for at in range(0, len(who), 8192):
                    w, s = who[at : at + 8192], what[at : at + 8192]
                    take, n = pa.array(w), len(w)
                    part = (_spread(ids[w] ^ 0x5555) % np.maximum(split[s], 1).astype(np.uint64)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(part), pa.array(np.ones(n, np.int32)), batch.column(0).take(take), batch.column(1).take(take), pa.nulls(n, pa.int32()), pa.nulls(n, pa.float64()), batch.column(2).take(take), batch.column(3).take(take)], names=NAMES)
            if split is None:
                some = np.flatnonzero(asked)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(asked[some])], names=["shard", "n"])

        return go

    def run(queries: DataFrame, first: bool) -> DataFrame:
        counts = queries.mapInArrow(routes(first, None), "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).toPandas()
        split = np.zeros(shards, np.int64)
        split[counts["shard"].to_numpy(np.int64)] = -(-counts["n"].to_numpy(np.int64) // QUERY_BLOCK)

        def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                times = split[batch.column(0).to_numpy()]
                for p in range(int(times.max()) if len(times) else 0):
                    own = batch.filter(pa.array(times > p))
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.full(n, p, np.int32)), pa.array(np.zeros(n, np.int32)), *own.columns[1:], pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64())], names=NAMES)

        meeting = index.mapInArrow(copies, MEETING).unionByName(queries.mapInArrow(routes(first, split), MEETING))
        dealt = meeting.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind", "pivot", "r")
        return dealt.mapInArrow(_searched(space, width, k), "query_id long, vec_id long, score long")

    # of rows repeated with one id one asks
    queries = keyed.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = space.home(batch.column(0).to_numpy(), _matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32))], names=["vec_id", "v", "floor", "floor_id", "home"])

    none = F.lit(NONE).cast("long")
    asking = "vec_id long, v array<double>, floor long, floor_id long, home int"
    asked = scratch.materialize(queries.select("vec_id", "v", none.alias("floor"), none.alias("floor_id")).mapInArrow(homes, asking), "asked")
    near = scratch.materialize(run(asked, True), "near")
    # k rows of each query at most
    last = F.max(F.struct((-F.col("score")).alias("s"), "vec_id"))
    floors = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, last).alias("kth")).select("query_id", (-F.col("kth.s")).alias("kth"), F.col("kth.vec_id").alias("kth_id"))
    known = asked.drop("floor", "floor_id").join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.coalesce("kth", none).alias("floor"), F.coalesce("kth_id", none).alias("floor_id"), "home")
    far = run(scratch.materialize(known, "known"), False)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
