"""Greedy removal of near-duplicates inside cells.

In a given order a row stays unless it is more similar than a threshold to one of its
cell that stays: the first independent set in that order. A cell of at most a block (``BLOCK_BYTES``
of vectors) is one task's work. Larger ones are settled in rounds, all at once. A round takes the
next block of open rows of each, settles these among themselves, which nothing earlier can
change any more, and lets all other open rows of the cell, a chunk in a task, meet those
that stay; rows too similar to one go. So a dense cell lies over many tasks, no task holds
more than a block and a chunk, and similar pairs are never listed. Rounds are as many as the
largest cell keeps blocks. Vectors move once where no cell is larger than a block, and once
a round where some are.

Products are of floats; what lies so near the threshold that their error matters is
computed again in doubles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geomill.operators import ranks
from geomill.sources import shared

THRESHOLD = 0.95
#: Vectors settled at once in one task, as doubles, and vectors that meet what stays of them in another.
BLOCK_BYTES, CHUNK_BYTES = 64 << 20, 64 << 20
#: Parts of a cell of which each finds its own first block of open rows.
SALTS = 64


def unit(rows: np.ndarray) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def _limit(threshold: float) -> float:
    """Similarities above this are, to 6 places, above the threshold."""
    return (np.floor(np.round(threshold * 1e6, 3)) + 0.5) / 1e6


def _margin(x: np.ndarray) -> float:
    """How far a product of unit rows as floats may be off."""
    return 1.2e-7 * (x.shape[1] + 2)


def above(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """The matrix that says which unit rows of x and y are more similar than the threshold (to 6 places)."""
    limit, margin = _limit(threshold), _margin(x)
    s = x.astype(np.float32) @ y.astype(np.float32).T
    out = s > np.float32(limit - margin)
    r, c = np.nonzero(out & (s < np.float32(limit + margin)))
    for at in range(0, len(r), 65_536):
        i, k = r[at : at + 65_536], c[at : at + 65_536]
        out[i, k] = (x[i] * y[k]).sum(axis=1) > limit
    return out


def alike(x: np.ndarray, kept: np.ndarray, threshold: float, step: int = 2_048) -> np.ndarray:
    """Which unit rows are more similar than the threshold (to 6 places) to one of kept."""
    out, limit = np.zeros(len(x), bool), _limit(threshold)
    kept = kept[np.isfinite(kept).all(axis=1)]
    if not len(x) or not len(kept):
        return out
    margin, y = _margin(x), kept.astype(np.float32)
    for at in range(0, len(x), step):
        own = x[at : at + step].astype(np.float32)
        for c in range(0, len(kept), step):
            most = (own @ y[c : c + step].T).max(axis=1)
            near = at + np.flatnonzero((most > limit - margin) & (most < limit + margin))
            out[at : at + step] |= most >= limit + margin
            near = near[~out[near]]
            if len(near):
                out[near] = above(x[near], kept[c : c + step], threshold).any(axis=1)
    return out


def greedy(rows: np.ndarray, seeds: np.ndarray | None = None, threshold: float = THRESHOLD, step: int = 2_048) -> np.ndarray:
    """Which rows are kept: in order, a row stays unless it is more similar than the threshold (to 6 places) to a seed or one kept before. Matrix products by blocks."""
    x, out = unit(rows), np.zeros(len(rows), bool)
    base = np.empty((0, x.shape[1] if x.ndim == 2 else 0)) if seeds is None or not len(seeds) else unit(seeds)
    for at in range(0, len(x), step):
        block = x[at : at + step]
        free = ~alike(block, base, threshold) & ~alike(block, x[:at][out[:at]], threshold)
        inner = above(block, block, threshold)
        for i in np.flatnonzero(free):
            if free[i]:
                out[at + i] = True
                free[i + 1 :] &= ~inner[i, i + 1 :]
    return out


def dedup_cells(photos: DataFrame, cell: str, order: list[str], vector: str = "embedding", threshold: float = THRESHOLD, existing: DataFrame | None = None, id_col: str = "photo_key", block: int | None = None, chunk: int | None = None) -> DataFrame:
    """photos without near-duplicates inside each cell, in the given order (ties by id); existing photos of a cell are kept and come first. Rows without cell or vector fall out.

    Only ids and vectors are shuffled. block and chunk are in rows, else as many as ``BLOCK_BYTES`` and ``CHUNK_BYTES`` hold.
    """
    use = lambda df, old: df.where(F.col(cell).isNotNull() & F.col(vector).isNotNull()).select(F.col(cell).alias("c"), F.lit(not old).alias("new"), F.struct(*[F.col(o) for o in order]).alias("o"), F.col(id_col).alias("i"), F.col(vector).alias("v"))
    rows = use(photos, False)
    if existing is not None:
        rows = rows.unionByName(use(existing, True))
    sizes = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"))
    many = F.lit(block).cast("long") if block else F.greatest(F.expr(f"{BLOCK_BYTES} div (8 * greatest(width, 1))"), F.lit(1))
    # few: the rows over those of a block
    dense = shared.written(sizes.select("c", "n", many.alias("block"), (F.lit(chunk).cast("long") if chunk else F.greatest(F.expr(f"{CHUNK_BYTES} div (8 * greatest(width, 1))"), F.lit(1))).alias("chunk")).where("n > block").select("c", "block", "chunk"), "dense")
    none = dense.isEmpty()
    small = rows if none else rows.join(F.broadcast(dense), "c", "left_anti")
    small = small.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy("new", "o", "i")).cast("long"))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", ignore_index=True)
        x, new = np.stack(pdf["v"].to_numpy()), pdf["new"].to_numpy(bool)
        stays = ~new
        stays[new] = greedy(x[new], x[~new], threshold)
        return pdf.loc[stays, ["c", "k", "new", "i", "v"]]

    columns = ["c", "k", "new", "i", "v"]
    shape = ", ".join(f"{c} {t}" for c, t in small.select(*columns).dtypes)
    settled = lambda df: df.select(*columns).groupBy("c").applyInPandas(settle, shape)
    kept = [settled(small).where("new").select("i")]
    large = None if none else _in_order(rows.join(F.broadcast(dense), "c", "left_semi")).select(*columns)
    while large is not None and not large.isEmpty():
        # where the first rows of each cell end: first those of each salted part, then of all parts
        parts = Window.partitionBy("c", F.pmod("k", F.lit(SALTS))).orderBy("k")
        first = large.select("c", "k").join(F.broadcast(dense), "c").withColumn("p", F.row_number().over(parts)).where("p <= block")
        first = first.withColumn("p", F.row_number().over(Window.partitionBy("c").orderBy("k"))).where("p <= block")
        ends = shared.written(first.groupBy("c").agg(F.max("k").alias("end")), "ends")
        split = large.join(F.broadcast(ends), "c")
        stay = shared.written(settled(split.where("k <= end").select(*columns)), "stay")
        kept.append(stay.where("new").select("i"))
        large = shared.written(_far(split.where("k > end").select(*columns), stay, threshold, dense), "open")
    ids = kept[0]
    for k in kept[1:]:
        ids = ids.unionByName(k)
    return photos.join(ids.withColumnRenamed("i", "__i"), F.col(id_col) == F.col("__i"), "left_semi")


def _in_order(rows: DataFrame) -> DataFrame:
    """rows with their place k in their cell; the vectors stay apart while the others are sorted."""
    rows = shared.written(rows.withColumn("r", F.monotonically_increasing_id()), "cells")
    placed = ranks.numbered(rows.select("c", "new", "o", "i", "r"), "c", ["new", "o", "i", "r"], "k").select("r", "k")
    return shared.written(rows.join(placed, "r"), "placed")


def _far(rest: DataFrame, stay: DataFrame, threshold: float, dense: DataFrame) -> DataFrame:
    """rest without new rows too similar to one of their cell that stays."""
    counts = rest.groupBy("c").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(dense), "c")
    chunks = F.broadcast(shared.written(counts.select("c", F.ceil(F.col("n") / F.col("chunk")).cast("int").alias("chunks")), "chunks"))
    here = rest.join(chunks, "c").withColumn("chunk", F.pmod(F.xxhash64("k"), F.col("chunks").cast("long")).cast("int")).drop("chunks")
    there = stay.select("c", "v").join(chunks, "c").select("c", "v", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

    def meet(pdf: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) and len(kept):
            near = alike(unit(np.stack(pdf["v"].to_numpy())), unit(np.stack(kept["v"].to_numpy())), threshold)
            pdf = pdf[~(near & pdf["new"].to_numpy(bool))]
        return pdf.drop(columns="chunk")

    shape = ", ".join(f"{c} {t}" for c, t in rest.dtypes)
    return here.select(*rest.columns, "chunk").groupBy("c", "chunk").cogroup(there.groupBy("c", "chunk")).applyInPandas(meet, shape)


def pairs_checked(rows: DataFrame, cell: str, id_col: str, vector: str, kept: str, threshold: float, chunk: int | None = None) -> DataFrame:
    """id, kept, like: whether a row is more similar (to 6 places) than the threshold to a kept one of its cell with a smaller id, by looking at all pairs.

    Cells are dealt into chunks, of which each two meet in a task.
    """
    rows = rows.where(F.col(cell).isNotNull() & F.col(vector).isNotNull()).select(F.col(cell).alias("c"), F.col(id_col).alias("i"), F.col(vector).alias("v"), F.col(kept).alias("kept"))
    sizes = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"))
    most = F.lit(chunk) if chunk else F.expr(f"{CHUNK_BYTES} div (8 * greatest(width, 1))")
    dealt = rows.join(shared.written(sizes.select("c", F.ceil(F.col("n") / F.greatest(most, F.lit(1))).cast("int").alias("parts")), "parts"), "c")
    own, every = F.pmod(F.xxhash64("i"), F.col("parts").cast("long")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = dealt.select("c", own.alias("a"), every.alias("b"), "i", "v", "kept")
    right = dealt.where("kept").select(F.col("c").alias("d"), every.alias("a2"), own.alias("b2"), F.col("i").alias("j"), F.col("v").alias("w"))

    def look(pdf: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        like, step = np.zeros(len(pdf), bool), 2_048
        if len(pdf) and len(held):
            pdf, held = pdf.sort_values("i", ignore_index=True), held.sort_values("j", ignore_index=True)
            x, y, mine, theirs = unit(np.stack(pdf["v"].to_numpy())), unit(np.stack(held["w"].to_numpy())), pdf["i"].to_numpy(), held["j"].to_numpy()
            for at in range(0, len(x), step):
                before = int(np.searchsorted(theirs, mine[min(at + step, len(x)) - 1]))
                for c in range(0, before, step):
                    near = above(x[at : at + step], y[c : c + step], threshold) & (theirs[c : c + step] < mine[at : at + step, None])
                    like[at : at + step] |= near.any(axis=1)
        return pd.DataFrame({"i": pdf["i"], "kept": pdf["kept"], "like": like})

    met = left.groupBy("c", "a", "b").cogroup(right.groupBy("d", "a2", "b2")).applyInPandas(look, f"i {dict(rows.dtypes)['i']}, kept boolean, like boolean")
    return met.groupBy(F.col("i").alias(id_col), "kept").agg(F.max("like").alias("like"))
