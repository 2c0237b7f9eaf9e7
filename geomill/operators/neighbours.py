"""Exact nearest neighbours by cosine, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geomill.functions import vectors
from geomill.operators import angular

#: Rows of a block: with 1,000 components 16 MB.
BLOCK = 4_096
#: Queries that are broadcast at most, as doubles, and rows of a gallery that meet them at once.
QUERY_BYTES, GALLERY_ROWS = 16 << 20, 8_192
#: Pairs whose similarities stand in memory at once: 16 MB.
PAIRS = 1 << 21


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def _finite(ids: pd.Series, column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors, without those that have no length."""
    if not len(column):
        return ids.to_numpy(), np.empty((0, 0))
    x = _unit(column)
    ok = np.isfinite(x).all(axis=1)
    return ids.to_numpy()[ok], x[ok]


def _blocks(queries: DataFrame, gallery: DataFrame, id_col: str, vector: str, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides with the numbers of the pairs of blocks (qb, gb) where each row is needed."""
    q, g = queries.select(F.col(id_col).alias("qid"), F.col(vector).alias("v")), gallery.select(F.col(id_col).alias("gid"), F.col(vector).alias("v"))
    nq, ng = max(1, -(-q.count() // size)), max(1, -(-g.count() // size))
    deal = lambda df, c, n: df.withColumn("b", F.pmod(F.xxhash64(c), F.lit(n).cast("long")))
    left = deal(q, "qid", nq).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(ng - 1)))).select(F.col("b").alias("qb"), F.col("o").cast("long").alias("gb"), "qid", "v")
    right = deal(g, "gid", ng).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).select(F.col("o").cast("long").alias("qb"), F.col("b").alias("gb"), "gid", "v")
    return left, right


def cosine_top_k(queries: DataFrame, gallery: DataFrame, k: int, id_col: str = "id", vector: str = "v", exclude_self: bool = False, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, id, similarity (to 6 places): the k most similar gallery rows of each query; ties to the smaller id.

    Queries of up to ``query_bytes`` are broadcast, and the gallery, which doesn't move, meets
    them ``GALLERY_ROWS`` at a time. Beyond, queries go to those shards of the gallery that may
    hold better rows (``angular``). Either way a meeting keeps k rows of a query.
    """
    qid_type, id_type = dict(queries.dtypes)[id_col], dict(gallery.dtypes)[id_col]
    result = f"query_id {qid_type}, id {id_type}, similarity double"
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")

    if (queries.agg(F.sum(F.size(vector).cast("long") * 8)).first()[0] or 0) <= query_bytes:
        asked = queries.select(F.col(id_col).alias("qid"), F.col(vector).alias("v")).toPandas()
        shared = queries.sparkSession.sparkContext.broadcast(_finite(asked["qid"], asked["v"]))

        def pass_by(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += len(batch)
                if n >= GALLERY_ROWS:
                    yield from against(pd.concat(held, ignore_index=True))
                    held, n = [], 0
            if n:
                yield from against(pd.concat(held, ignore_index=True))

        def against(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
            names, v = shared.value
            b = b.sort_values("gid", ignore_index=True)
            gid, w = _finite(b["gid"], b["v"])
            n = len(gid)
            if not n or not len(names):
                return
            step = max(1, PAIRS // n)
            for at in range(0, len(names), step):
                qid = names[at : at + step]
                s = np.rint(v[at : at + step] @ w.T * 1e6).astype(np.int64)
                # no two alike: of equal similarities the smaller id is ahead
                s *= n
                s += np.arange(n - 1, -1, -1)
                if exclude_self:
                    own = np.minimum(np.searchsorted(gid, qid), n - 1)
                    hit = np.flatnonzero(gid[own] == qid)
                    # an id may be there twice
                    for r in hit:
                        s[r, own[r] : np.searchsorted(gid, qid[r], "right")] = np.iinfo(np.int64).min
                top = np.argpartition(s, max(0, n - k), axis=1)[:, -k:] if n > k else np.tile(np.arange(n), (len(qid), 1))
                score = np.take_along_axis(s, top, 1).ravel()
                out = pd.DataFrame({"query_id": np.repeat(qid, top.shape[1]), "id": gid[top.ravel()], "similarity": score // n / 1e6})
                yield out[score != np.iinfo(np.int64).min]

        met = gallery.select(F.col(id_col).alias("gid"), F.col(vector).alias("v")).mapInPandas(pass_by, result)
    else:
        of = lambda df, name: df.select(F.col(id_col).alias(name), F.col(vector).alias("v"))
        met = angular.candidates(of(queries, "qid"), of(gallery, "gid"), k, exclude_self)
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def own_rank(queries: DataFrame, gallery: DataFrame, id_col: str = "id", vector: str = "v") -> DataFrame:
    """query_id, id, rank: the exact rank of the gallery row with the query's id (null without one), by cosine to 6 places; ties to the smaller id.

    Both sides are dealt into blocks, of which each two meet in a task; of a pair of
    blocks one number for each query is kept.
    """
    own = gallery.groupBy(id_col).agg(F.first(vector).alias("w"))
    left, right = _blocks(queries.join(own, id_col, "left").select(id_col, F.struct(F.col(vector).alias("v"), "w").alias(vector)), gallery, id_col, vector)
    left = left.select("qb", "gb", "qid", F.col("v.v").alias("v"), F.col("v.w").alias("w"))

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a[a["w"].notna()]
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": a["qid"], "before": np.zeros(len(a), np.int64)})
        v, w = _unit(a["v"]), _unit(b["v"]).T
        mine = np.round((v * _unit(a["w"])).sum(axis=1), 6)
        qid, gid, before = a["qid"].to_numpy(), b["gid"].to_numpy(), np.empty(len(a), np.int64)
        twice = not b["gid"].is_unique
        step = max(1, PAIRS // len(b))
        for at in range(0, len(a), step):
            own, s = mine[at : at + step], v[at : at + step] @ w
            ahead = s > own[:, None] + 1e-6
            if twice:
                ahead &= gid != qid[at : at + step, None]
            count = ahead.sum(axis=1)
            # only the few whose rounding matters are rounded
            r, c = np.nonzero((s >= own[:, None] - 1e-6) & (s <= own[:, None] + 1e-6))
            near, name = np.round(s[r, c], 6), qid[at : at + step][r]
            first = ((near > own[r]) & (gid[c] != name)) | ((near == own[r]) & (gid[c] < name))
            before[at : at + step] = count + np.bincount(r[first], minlength=len(own))
        return pd.DataFrame({"query_id": a["qid"], "before": before})

    met = left.groupBy("qb", "gb").cogroup(right.groupBy("qb", "gb")).applyInPandas(count, f"query_id {dict(left.dtypes)['qid']}, before long")
    ranks = met.groupBy("query_id").agg((F.sum("before") + 1).alias("rank"))
    return queries.select(F.col(id_col).alias("query_id")).join(ranks, "query_id", "left").select("query_id", F.col("query_id").alias("id"), "rank")


def nearest_of_few(rows: DataFrame, few: DataFrame, id_col: str, vector: str, few_id: str, few_vector: str, most_bytes: int = 128 << 20) -> DataFrame:
    """rows with ``few_id`` and ``similarity`` of the most similar of a few vectors (centroids, prompts), which are broadcast if they take at most ``most_bytes`` as doubles."""
    size = few.agg(F.sum(F.size(few_vector).cast("long") * 8)).first()[0] or 0
    if size > most_bytes:
        top = cosine_top_k(rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")), few.select(F.col(few_id).alias("id"), F.col(few_vector).alias("v")), 1)
        return rows.join(top.select(F.col("query_id").alias(id_col), F.col("id").alias(few_id), "similarity"), id_col, "left")
    table = few.select(few_id, few_vector).orderBy(few_id).toPandas()
    if not len(table):
        return rows.withColumns({few_id: F.lit(None).cast(dict(few.dtypes)[few_id]), "similarity": F.lit(None).cast("double")})
    shared = rows.sparkSession.sparkContext.broadcast((_unit(table[few_vector]).astype(np.float64), table[few_id].to_numpy()))

    @F.pandas_udf(f"id {dict(few.dtypes)[few_id]}, similarity double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        centres, names = shared.value
        for s in batches:
            best, value = [], []
            for at in range(0, len(s), 1024):
                sims = np.round(_unit(s.iloc[at : at + 1024]) @ centres.T, 6)
                best.append(sims.argmax(axis=1))
                value.append(sims.max(axis=1))
            i = np.concatenate(best) if best else np.empty(0, int)
            yield pd.DataFrame({"id": names[i], "similarity": np.concatenate(value) if value else np.empty(0)})

    return rows.withColumn("__n", nearest(F.col(vector))).withColumns({few_id: F.col("__n.id"), "similarity": F.col("__n.similarity")}).drop("__n")


def similarity_matrix(a: DataFrame, b: DataFrame, ids: tuple[str, str] = ("a", "b")) -> DataFrame:
    """The cosine of every row of one table (a, va: texts of an evaluation) with every row of another (b, vb: its images): a row a pair, block by block."""
    left, right = _blocks(a.select(F.col(ids[0]).alias("id"), F.col("va").alias("v")), b.select(F.col(ids[1]).alias("id"), F.col("vb").alias("v")), "id", "v", BLOCK // 4)

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({ids[0]: x["qid"][:0], ids[1]: y["gid"][:0], "similarity": np.empty(0)})
        s = np.round(_unit(x["v"]) @ _unit(y["v"]).T, 6)
        return pd.DataFrame({ids[0]: np.repeat(x["qid"].to_numpy(), len(y)), ids[1]: np.tile(y["gid"].to_numpy(), len(x)), "similarity": s.ravel()})

    return left.groupBy("qb", "gb").cogroup(right.groupBy("qb", "gb")).applyInPandas(meet, f"{ids[0]} {dict(left.dtypes)['qid']}, {ids[1]} {dict(right.dtypes)['gid']}, similarity double")


def zero_shot_labels(rows: DataFrame, prompts: DataFrame, id_col: str, vector: str, k: int = 3) -> DataFrame:
    """id and the k best labels as one string. prompts: label, prompt (vector); a taxonomy is small."""
    top = cosine_top_k(rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")), prompts.select(F.col("label").alias("id"), F.col("prompt").alias("v")), k)
    return top.groupBy(F.col("query_id").alias(id_col)).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), ", ").alias("labels"))
