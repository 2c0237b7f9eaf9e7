"""Quality classification by hierarchical empirical Bayes.

A logistic model on cheap text features, fitted on at most ``SAMPLE`` labelled rows,
gives each document's own evidence. Hosts and paths get posterior log-odds from the
evidence of all their documents: a path's mean is shrunk towards its host's, a host's
towards the global one, each by a weight that the spread between the groups fixes
(method of moments): sparse sites stay near the prior. A document's posterior adds its
own log-odds to what its path's posterior says beyond the global prior.

Features are made by NumPy on Arrow batches, all else by column expressions and grouped
aggregates; only the sample reaches the driver. Site statistics are broadcast where their
measured row count is small.

Defined cases: a null or blank text has the features of an empty one; null host or
path are groups of their own; without both classes among the labels the model is the
share of good ones (one half without labels) and every document is kept if that
reaches the threshold; a null id is classified like any other; repeated rows are
judged each; an empty table gives an empty result; other columns are carried by
``keep_good`` and ignored by ``classify``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.llm import scratch
from geomill.llm.memory import give_back
from geomill.llm.wordhash import word_hashes

#: Labelled rows that the model is fitted on at most.
SAMPLE = 20_000
THRESHOLD = 0.5
#: How much a path's posterior may move a document's log-odds.
SITE_WEIGHT = 0.5
BROADCAST_SITES = 200_000
#: A document's own log-odds, and a site's over the global ones, are kept within these: one
#: document never counts as more than certain, and no site, however bad, outweighs good text.
MOST_LOGIT, MOST_SITE = 12.0, 3.0


#: Byte classes whose shares are features: capitals, exclamation, symbols, digits, punctuation, line ends.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?", b"#%&$*@^~=+<>{}[]\\|_", b"0123456789", b".,;:", b"\n")
#: Numbers that ``text_features`` returns.
WIDTH = 3 * (len(CLASSES) + 3)
_MEMBERS = np.stack([np.isin(np.arange(256), np.frombuffer(c, np.uint8)) for c in CLASSES])


def text_features(texts: list[bytes]) -> np.ndarray:
    """For each text the shares of its byte classes, of distinct words, and sizes, all from 0 to 1, with their squares and roots; 0 for a text without words."""
    words = word_hashes(texts)
    out = np.zeros((len(texts), WIDTH // 3))
    for i, (text, w) in enumerate(zip(texts, words, strict=True)):
        if len(w):
            counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            n, m = len(text), len(w)
            out[i] = [*(_MEMBERS @ counts / n), len(np.unique(w)) / m, min(np.log1p(m) / 10, 1.0), min(n / m / 20, 1.0)]
    return np.concatenate([out, out * out, np.sqrt(out)], axis=1)


def with_features(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with ``__x``, the features of the text."""

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            rows = [text_features([t or b"" for t in s.iloc[at : at + 512]]) for at in range(0, len(s), 512)]
            yield pd.Series([x for block in rows for x in block], dtype=object)
        give_back()

    return docs.withColumn("__x", features(F.col(text_col).cast("binary")))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the last for a constant, by Newton's method. x and its squares are the inputs."""
    design = np.c_[x, np.ones(len(x))]
    w = np.zeros(design.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-9] * len(x)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(hessian, design.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> list[float]:
    """The model's weights: labels has the id and quality (1 good, 0 bad)."""
    known = labels.where("quality is not null").select(F.col(id_col).alias("__l"), F.col("quality").cast("int").alias("__q")).groupBy("__l").agg(F.min("__q").alias("__q"))
    chosen = scratch.materialize(known.orderBy(F.xxhash64("__l")).limit(sample), "labelled")
    # of rows with one id the smallest text: at most as many rows as there are labels
    few = docs.select(F.col(id_col).alias("__l"), F.col(text_col).alias("__t")).join(F.broadcast(chosen), "__l").groupBy("__l", "__q").agg(F.min("__t").alias("__t"))
    rows = with_features(few, "__t").select(F.col("__x").alias("x"), "__q").orderBy("__l").toPandas()
    y = rows["__q"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        return [0.0] * WIDTH + [float(np.log(share / (1 - share)))]
    return fit_logistic(np.stack(rows["x"].to_numpy()), y).tolist()


def _sites(evidence: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, posterior log-odds) and the global log-odds, from evidence(host, path, p)."""
    paths = scratch.materialize(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not whole["n"]:
        return paths.select("host", "path", F.lit(0.0).alias("host_p"), F.lit(0.0).alias("path_p")), 0.5
    mean = min(max(whole["s"] / whole["n"], 1e-4), 1 - 1e-4)

    def weight(groups: DataFrame, n: str, s: str) -> float:
        """Prior size a + b of the Beta whose spread the group means show: m (1 - m) / variance - 1."""
        r = groups.agg(F.count(F.lit(1)).alias("g"), F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - mean, 2)).alias("ss"), F.sum(n).alias("n")).first()
        spread = max(r["ss"] / r["n"] - mean * (1 - mean) * r["g"] / r["n"], 1e-6)
        return float(min(max(mean * (1 - mean) / spread - 1, 2.0), 1000.0))

    hw, pw = weight(hosts, "hn", "hs"), weight(paths, "n", "s")
    host_p = (F.col("hs") + hw * mean) / (F.col("hn") + hw)
    path_p = (F.col("s") + pw * F.col("host_p")) / (F.col("n") + pw)
    joined = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    return joined.withColumn("host_p", host_p).withColumn("path_p", path_p).select("host", "path", "host_p", "path_p"), mean


def with_logit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with ``__logit``, a document's own log-odds."""
    w = fit(docs, labels, id_col, text_col)
    dot = F.aggregate(F.zip_with("__x", F.array(*map(F.lit, w[:-1])), lambda a, b: a * b), F.lit(w[-1]), lambda a, b: a + b)
    return with_features(docs, text_col).withColumn("__logit", F.least(F.greatest(dot, F.lit(-MOST_LOGIT)), F.lit(MOST_LOGIT))).drop("__x")


def _share(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _judged(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """rows(host, path, logit, ...) with host_p, path_p and posterior; evidence: the materialised (host, path, logit) of all."""
    sites, mean = _sites(evidence.select("host", "path", _share(F.col("logit")).alias("p")))
    sites = scratch.materialize(sites.select(F.col("host").alias("__h"), F.col("path").alias("__p"), "host_p", "path_p"), "sites")
    few = sites.count() <= BROADCAST_SITES
    joined = rows.join(F.broadcast(sites) if few else sites, F.col("host").eqNullSafe(F.col("__h")) & F.col("path").eqNullSafe(F.col("__p")), "left")
    p = F.least(F.greatest(F.col("path_p"), F.lit(1e-4)), F.lit(1 - 1e-4))
    site = F.least(F.greatest(F.log(p / (1 - p)) - float(np.log(mean / (1 - mean))), F.lit(-MOST_SITE)), F.lit(MOST_SITE))
    return joined.withColumn("posterior", _share(F.col("logit") + SITE_WEIGHT * site))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, host, path, evidence, host_p, path_p, posterior, keep of each row."""
    own = with_logit(docs.select(id_col, text_col, host_col, path_col), labels, id_col, text_col)
    evidence = scratch.materialize(own.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col("__logit").alias("logit")), "evidence")
    return _judged(evidence, evidence).select("doc_id", "host", "path", _share(F.col("logit")).alias("evidence"), "host_p", "path_p", "posterior", (F.col("posterior") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose posterior reaches the threshold."""
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(host_col).alias("host"), F.col(path_col).alias("path"))
    judged = with_logit(base, labels.withColumn("__id", F.col(id_col)), "__id", "__text").withColumn("logit", F.col("__logit"))
    evidence = scratch.materialize(judged.select("host", "path", "logit"), "evidence")
    return _judged(judged.select("row", "host", "path", "logit"), evidence).where(F.col("posterior") >= threshold).select("row.*")
