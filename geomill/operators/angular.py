"""Exact nearest neighbours by cosine, through bounds on angles.

Gallery vectors belong to the nearest of some pivots; a pivot's vectors, in the order of
their angle to it, are cut into shards. By the triangle inequality of angles a vector
whose angle to the pivot lies between low and high is at least ``max(low - a, a - high)`` away
from a query at angle ``a``. A query first goes to the shards nearest to it, which gives it k
candidates; then to those shards alone whose bound lets one of them beat the k-th. Pivots
are looked at before their shards. Shards stay where they are and queries move, so what
moves grows with what the bounds leave; a shard that more than ``VISITS`` queries ask is
copied once for each so many.

The driver holds pivots and the shards' angles: at most ``PIVOTS`` vectors of ``PIVOT_BYTES``
in all, and ``SHARDS`` angles, for shards grow where the gallery is too large for that.
Similarities are to 6 places, ties go to the smaller id. Vectors of length 0 are at
similarity 0 to all. Null vectors take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.operators import ranks
from geomill.operators.near_dup import unit
from geomill.sources import shared

PIVOTS, PIVOT_BYTES = 1_024, 16 << 20
SHARDS, SHARD_ROWS, VISITS = 100_000, 4_096, 65_536
#: Similarities are rounded: how far a bound may be off.
MARGIN = 2e-6


class Map:
    """The pivots (rows of unit length) and the angles of their shards."""

    def __init__(self, pivots: np.ndarray, shards: pd.DataFrame) -> None:
        """shards: pivot (-1 for vectors of length 0), shard, low, high, n; sorted by pivot and shard."""
        self.pivots = pivots
        self.zero = shards.loc[shards["pivot"] < 0, "shard"].to_numpy()
        s = shards[shards["pivot"] >= 0]
        self.shard, self.low, self.high, self.n, pivot = (s[c].to_numpy() for c in ("shard", "low", "high", "n", "pivot"))
        self.start = np.searchsorted(pivot, np.arange(len(pivots) + 1))
        self.used = np.flatnonzero(np.diff(self.start))
        self.least = self.low[self.start[self.used]] if len(self.used) else np.empty(0)
        self.most = np.maximum.reduceat(self.high, self.start[self.used]) if len(self.used) else np.empty(0)

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.pivots[self.used].T, -1.0, 1.0))

    def _gap(self, angle: float, u: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a used pivot's shards where they are, and how near they can be."""
        at = np.arange(self.start[self.used[u]], self.start[self.used[u] + 1])
        return at, np.maximum(np.maximum(self.low[at] - angle, angle - self.high[at]), 0.0)

    def first(self, angles: np.ndarray, k: int) -> np.ndarray:
        """The shards nearest to a query that hold more than k vectors."""
        out, held = [], 0
        for u in np.argsort(angles, kind="stable"):
            at, gap = self._gap(angles[u], u)
            at = at[np.argsort(gap, kind="stable")]
            enough = int(np.searchsorted(held + np.cumsum(self.n[at]), k + 1)) + 1
            out.append(at[:enough])
            held += int(self.n[at[:enough]].sum())
            if held > k:
                break
        return self.shard[np.concatenate(out)] if out else self.zero[:0]

    def near(self, angles: np.ndarray, least: float) -> np.ndarray:
        """The shards that may hold a vector of at least this similarity."""
        limit = np.arccos(np.clip(least - MARGIN, -1.0, 1.0))
        open_ = np.flatnonzero(np.maximum(np.maximum(self.least - angles, angles - self.most), 0.0) <= limit)
        out = [at[gap <= limit] for at, gap in (self._gap(angles[u], u) for u in open_)]
        return np.concatenate([self.shard[np.concatenate(out)] if out else self.zero[:0], self.zero if least <= MARGIN else self.zero[:0]])


def mapped(gallery: DataFrame) -> tuple[Map, DataFrame]:
    """The map of a gallery (gid, v), and the gallery by shard (shard, gid, v) as a table."""
    spark = gallery.sparkSession
    gallery = shared.written(gallery.where("v is not null").withColumn("r", F.monotonically_increasing_id()), "gallery")
    n, width = gallery.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    want = max(1, min(PIVOTS, PIVOT_BYTES // (8 * (width or 1)), n // 8))
    chosen = gallery.where(F.pmod(F.xxhash64("gid", F.lit(7)), F.lit(max(n, 1)).cast("long")) < want).select("v").toPandas()["v"]
    x = np.stack(chosen.to_numpy()).astype(np.float64) if len(chosen) else np.ones((1, width or 1))
    pivots = np.unique(unit(x[np.linalg.norm(x, axis=1) > 0]), axis=0)
    if not len(pivots):
        pivots = unit(np.ones((1, width or 1)))
    shared_pivots = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            u = unit(np.stack(b["v"].to_numpy()))
            s = u @ shared_pivots.value.T
            best = s.argmax(axis=1)
            nil = ~u.any(axis=1)
            angle = np.where(nil, 0.0, np.arccos(np.clip(s[np.arange(len(u)), best], -1.0, 1.0)))
            yield pd.DataFrame({"r": b["r"], "pivot": np.where(nil, -1, best).astype(np.int32), "angle": angle})

    angles = shared.written(gallery.select("r", "v").mapInPandas(place, "r long, pivot int, angle double"), "angles")
    rows = max(SHARD_ROWS, -(-n // SHARDS))
    placed = ranks.numbered(angles, "pivot", ["angle", "r"]).withColumn("part", F.expr(f"place div {rows}"))
    placed = shared.written(placed.select("r", "pivot", "part", "angle"), "shards")
    of = placed.groupBy("pivot", "part").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n"))
    table = of.toPandas().sort_values(["pivot", "part"], ignore_index=True)
    table["shard"] = np.arange(len(table))
    numbers = spark.createDataFrame(table[["pivot", "part", "shard"]], "pivot int, part long, shard long") if len(table) else None
    if numbers is None:
        return Map(pivots, table), gallery.select(F.lit(0).cast("long").alias("shard"), "gid", "v")
    by_shard = gallery.join(placed.join(F.broadcast(numbers), ["pivot", "part"]).select("r", "shard"), "r")
    return Map(pivots, table), shared.written(by_shard.select("shard", "gid", "v"), "by-shard")


def _routed(queries: DataFrame, where: Map, k: int, again: bool) -> DataFrame:
    """(shard, qid): where queries (qid, v) go first, or, knowing ``least``, again."""
    spread = queries.sparkSession.sparkContext.broadcast(where)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = spread.value
        for whole in batches:
            for at in range(0, len(whole), 1_024):
                b = whole.iloc[at : at + 1_024]
                angles = own.angles(unit(np.stack(b["v"].to_numpy())))
                to = [own.first(a, k) for a in angles]
                if again:
                    to = [np.setdiff1d(own.near(a, least), done) for a, least, done in zip(angles, b["least"], to, strict=True)]
                yield pd.DataFrame({"shard": np.concatenate(to).astype(np.int64), "qid": np.repeat(b["qid"].to_numpy(), [len(t) for t in to])})

    kind = dict(queries.dtypes)["qid"]
    return shared.written(queries.mapInPandas(route, f"shard long, qid {kind}"), "routes")


def _met(queries: DataFrame, routes: DataFrame, by_shard: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """query_id, id, similarity: of each query and shard on its routes the k best."""
    copies = shared.written(routes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("copies")), "visits")
    asked = routes.join(copies, "shard").select("shard", F.pmod(F.xxhash64("qid"), F.col("copies").cast("long")).cast("int").alias("copy"), "qid").join(queries.select("qid", "v"), "qid").select("shard", "copy", "qid", "v")
    there = by_shard.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "gid", "v")
    result = f"query_id {dict(queries.dtypes)['qid']}, id {dict(by_shard.dtypes)['gid']}, similarity double"

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(a) and len(b):
            b = b.sort_values("gid", ignore_index=True)
            y, names = unit(np.stack(b["v"].to_numpy())), b["gid"].to_numpy()
            for at in range(0, len(a), 1_024):
                part = a.iloc[at : at + 1_024]
                s = np.round(unit(np.stack(part["v"].to_numpy())) @ y.T, 6)
                if exclude_self:
                    s[part["qid"].to_numpy()[:, None] == names[None, :]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(s, top, 1).ravel()
                found = pd.DataFrame({"query_id": np.repeat(part["qid"].to_numpy(), top.shape[1]), "id": names[top.ravel()], "similarity": value})
                parts.append(found[np.isfinite(value)])
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": a["qid"][:0], "id": b["gid"][:0], "similarity": np.empty(0)})

    return shared.written(asked.groupBy("shard", "copy").cogroup(there.groupBy("shard", "copy")).applyInPandas(meet, result), "met")


def candidates(queries: DataFrame, gallery: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """query_id, id, similarity: rows among which are the k most similar of gallery (gid, v) to each of queries (qid, v)."""
    queries = shared.written(queries.where("v is not null"), "queries")
    where, by_shard = mapped(gallery)
    if not len(where.shard) and not len(where.zero):
        return queries.select(F.col("qid").alias("query_id")).crossJoin(by_shard.select(F.col("gid").alias("id"), F.lit(0.0).alias("similarity")).limit(0))
    length = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    real, nil = queries.where(length > 0), queries.where(length == 0)
    first = _met(real, _routed(real, where, k, False), by_shard, k, exclude_self)
    best = F.sort_array(F.collect_list("similarity"), asc=False)
    # at most k of each shard that was visited first, mostly one
    least = first.groupBy(F.col("query_id").alias("qid")).agg(F.when(F.count(F.lit(1)) >= k, F.get(best, F.lit(k - 1))).otherwise(-1.0).alias("least"))
    told = shared.written(real.join(least, "qid", "left").select("qid", "v", F.coalesce("least", F.lit(-1.0)).alias("least")), "told")
    out = first.unionByName(_met(real, _routed(told, where, k, True), by_shard, k, exclude_self))
    # all gallery rows are alike to a query of length 0: the smallest ids
    smallest = by_shard.select(F.col("gid").alias("id")).orderBy("id").limit(k + 1)
    of_nil = nil.select(F.col("qid").alias("query_id")).crossJoin(F.broadcast(smallest)).withColumn("similarity", F.lit(0.0))
    return out.unionByName(of_nil.where(F.col("query_id") != F.col("id")) if exclude_self else of_nil)
