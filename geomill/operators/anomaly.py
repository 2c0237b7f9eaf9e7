"""Misplaced photos: locked latitudes, coordinate glitches, climates that look wrong."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geomill.functions import geo, grid, vectors
from geomill.operators import cluster
from geomill.sources import shared

LOCKED_COUNT, LOCKED_SPAN = 10, 1.0
NEIGHBOURS, LEAST_NEIGHBOURS, INCOMPATIBLE = 25, 5, 0.84
#: How many times the wanted neighbours a photo's ranking is known for, first for all and then for those whose neighbours are not among these; what is left meets the whole bank.
HEADS = (4, 40)
#: Vectors of a part of either side, as doubles, that meet in a task, and pairs that are compared at once.
PART_BYTES, PAIRS = 32 << 20, 1 << 20
#: Photos of one vector that are answered in one task, on the average.
LOT = 10_000
# Climates that don't look like a polar, and like a desert, place.
NOT_POLAR = ("Cfa", "Cfb", "Csa", "Csb", "Cwa", "Cwb", "Dfa", "Dfb")
NOT_DESERT = ("Af", "Am", "Cfa", "Cfb", "Cfc", "Dfa", "Dfb", "Dfc", "Dfd", "EF", "ET")


def locked_latitudes(photos: DataFrame, scope: Column | None = None) -> DataFrame:
    """Lines of one platform (and continent) at one latitude, of more than 10 photos over more than a degree."""
    group = ["Platform", *(["continent"] if "continent" in photos.columns else [])]
    rows = photos if scope is None else photos.where(scope)
    rows = rows.where(F.col("Latitude").isNotNull() & F.col("Platform").isNotNull())
    if "continent" in group:
        rows = rows.where("continent is not null")
    lines = rows.groupBy(*group, F.bround("Latitude", 5).alias("lat_round")).agg(F.count("Longitude").alias("n"), F.min("Longitude").alias("min_lon"), F.max("Longitude").alias("max_lon"))
    return lines.where((F.col("n") > LOCKED_COUNT) & (F.col("max_lon") - F.col("min_lon") > LOCKED_SPAN))


def glitches(photos: DataFrame) -> DataFrame:
    lat, lon = F.col("Latitude"), F.col("Longitude")
    return photos.where(geo.null_island(lat, lon) | geo.diagonal(lat, lon))


def clean_coordinates(photos: DataFrame, scope: Column | None = None, sequences: DataFrame | None = None) -> DataFrame:
    """photos without locked lines and glitches; with sequences (photo_key, sequence_id), without the whole sequences of removed photos too."""
    group = ["Platform", *(["continent"] if "continent" in photos.columns else [])]
    lines = locked_latitudes(photos, scope).select(*group, "lat_round", F.lit(True).alias("__locked"))
    inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    lat, lon = F.col("Latitude"), F.col("Longitude")
    marked = photos.withColumn("lat_round", F.bround("Latitude", 5)).join(lines, [*group, "lat_round"], "left")
    bad = inside & (F.col("__locked").isNotNull() | F.coalesce(geo.null_island(lat, lon) | geo.diagonal(lat, lon), F.lit(False)))
    marked = marked.withColumn("__bad", bad)
    if sequences is not None:
        one = sequences.groupBy("photo_key").agg(F.min("sequence_id").alias("__seq"))
        marked = marked.join(one, "photo_key", "left")
        worst = marked.where(F.col("__bad") & F.col("__seq").isNotNull()).select("__seq").distinct().withColumn("__out", F.lit(True))
        marked = marked.join(worst, "__seq", "left").withColumn("__bad", F.col("__bad") | F.col("__out").isNotNull())
    return marked.where(~F.col("__bad")).select(photos.columns)


def climate_bank(pool: DataFrame, units: DataFrame) -> DataFrame:
    """major, w, n: how many rows of the pool (major, w, ...) have a vector w, for each climate group without the tenth of its rows that is least like its mean. units: w, v and its bytes, each vector once.

    A group's rows with one vector are equally like its mean, so they stay or go together.
    """
    counts = shared.written(pool.groupBy("major", "w").agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.ascii("major")), "counts")
    of = counts.join(units, "w")
    means = cluster.centroids(of, "group", "v", unit=False, weight="n").select("group", vectors.normalised(F.col("centroid")).alias("mean"))
    alike = of.join(F.broadcast(means), "group").withColumn("s", F.round(vectors.dot(F.col("v"), F.col("mean")), 6))  # five rows
    alike = shared.written(alike.select("major", "w", "n", "s"), "alike")
    # an aggregate of its own for each group: an exact percentile of at most two million values of 6 places
    least = alike.groupBy("major").agg(F.round(F.percentile("s", F.lit(0.1), F.col("n")), 9).alias("least"), F.sum("n").alias("of"))
    kept = alike.join(F.broadcast(least), "major").where((F.col("of") < 10) | (F.col("s") >= F.col("least")))
    return shared.written(kept.select("major", "w", "n"), "trimmed-bank")


LEVELS = ("ok", "other", "any")


def _parts(asked: int, bank: int, cores: int) -> tuple[int, int]:
    """Into how many parts both sides are dealt. Every asked row goes to all parts of the bank and is answered by each, so these are few."""
    many = lambda n, most: -(-n // most)
    return max(1, many(asked, PART_BYTES), min(cores, many(asked, PART_BYTES // 16))), max(1, many(bank, 2 * PART_BYTES))


def _dealt(asked: DataFrame, bank: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides (with vectors v, and their bytes) with the numbers a, b of the parts that meet."""
    size = lambda df: df.agg(F.sum("bytes")).first()[0] or 0
    parts = _parts(size(asked), size(bank), asked.sparkSession.sparkContext.defaultParallelism)
    deal = lambda n: F.pmod(F.xxhash64(key), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # columns by new names of their own, as both may come from one table
    all_of = lambda df: [F.col(c).alias(c) for c in df.columns if c != "bytes"]
    return asked.select(deal(parts[0]).alias("a"), every(parts[1]).alias("b"), *all_of(asked)), bank.select(every(parts[0]).alias("a"), deal(parts[1]).alias("b"), *all_of(bank))


def _misfits() -> list[Column]:
    """Whether a row of the bank doesn't look like a polar, and like a desert, place."""
    return [(F.col("major").isin("A", "B") | F.col("koppen").isin(*NOT_POLAR)).alias("polar"), F.col("koppen").isin(*NOT_DESERT).alias("desert")]


def rankings(wanted: DataFrame, bank: DataFrame, units: DataFrame, most: int) -> DataFrame:
    """w of wanted, and rows: the ``most`` rows of the bank with the most similar vectors, best first, wherever they are.

    Similarities count to 6 places, ties go to the smaller key. Only vectors meet, each once:
    the first ``most`` rows of a vector stand behind it. The first rows of all are behind
    the first vectors by similarity and smallest key, of which each has one row at least.
    """
    first = bank.select("w", F.row_number().over(Window.partitionBy("w").orderBy("photo_key")).alias("r"), F.struct("photo_key", "Latitude", "Longitude", "c3", *_misfits()).alias("row")).where(F.col("r") <= most)
    lists = shared.written(first.groupBy("w").agg(F.array_sort(F.collect_list("row")).alias("rows")), "lists")
    asked, known = wanted.join(units, "w"), lists.select("w", F.size("rows").alias("n"), F.col("rows")[0]["photo_key"].alias("head")).join(units, "w")
    left, right = _dealt(asked, known, "w")

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("asked", "w", "far", "n", "head")}
        if not len(x) or not len(y):
            return pd.DataFrame(out, dtype=object)
        y = y.sort_values("head", ignore_index=True)
        unit, behind, n = np.stack(y["v"].to_numpy()).T, y["n"].to_numpy(), len(y)
        rows = max(1, PAIRS // n)
        for at in range(0, len(x), rows):
            part = x.iloc[at : at + rows]
            score = np.rint(np.stack(part["v"].to_numpy()) @ unit * 1e6).astype(np.int64) * n + (n - 1 - np.arange(n))  # no two alike
            top = np.argpartition(score, max(0, n - most), axis=1)[:, -most:]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1), 1)
            s = np.take_along_axis(score, top, 1) // n
            # as soon as enough rows are behind the vectors, only equally similar ones can have better rows
            enough = behind[top].cumsum(axis=1) >= most
            last = np.where(enough.any(axis=1), enough.argmax(axis=1), top.shape[1] - 1)
            i, j = np.nonzero(s >= np.take_along_axis(s, last[:, None], 1))
            at_y = top[i, j]
            for c, v in (("asked", part["w"].to_numpy()[i]), ("w", y["w"].to_numpy()[at_y]), ("far", -s[i, j]), ("n", behind[at_y]), ("head", y["head"].to_numpy()[at_y])):
                out[c].append(v)
        return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})

    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(meet, "asked string, w string, far long, n long, head string")
    # the same over all parts of the bank
    one = Window.partitionBy("asked")
    met = met.withColumn("sum", F.sum("n").over(one.orderBy("far", "head").rowsBetween(Window.unboundedPreceding, 0)))
    met = met.withColumn("last", F.min(F.when(F.col("sum") >= most, F.col("far"))).over(one)).where(F.col("last").isNull() | (F.col("far") <= F.col("last")))
    rows = F.transform("rows", lambda r: F.struct(F.col("far"), *[r[c].alias(c) for c in ("photo_key", "Latitude", "Longitude", "c3", "polar", "desert")]))
    of = met.join(lists, "w").groupBy(F.col("asked").alias("w")).agg(F.flatten(F.collect_list(rows)).alias("rows"))
    return of.select("w", F.slice(F.array_sort("rows"), 1, most).alias("rows"))


def ranked_shares(asked: DataFrame, heads: DataFrame, near: int, held: int) -> DataFrame:
    """asked with the share of misfits among its neighbours as in ``neighbours_shares``; null where its head of the ranking, if it isn't the whole bank of held rows, has too few from elsewhere."""
    apart = lambda r, c: F.coalesce(F.nanvl(F.abs(r[c].cast("double") - F.col(c).cast("double")), F.lit(0.0)) > 3, F.lit(False))
    # of vectors with very many photos, which are at most one in LOT of the rows, photos go to several tasks
    many = asked.groupBy("w").agg(F.ceil(F.count(F.lit(1)) / LOT).alias("lots")).where("lots > 1")
    if many.isEmpty():
        x = asked.join(heads, "w")
    else:
        of = lambda df: df.join(F.broadcast(many), "w", "left").withColumn("lots", F.coalesce("lots", F.lit(1)))
        x = of(asked).withColumn("lot", F.pmod(F.xxhash64("photo_key"), "lots")).drop("lots")
        x = x.join(of(heads).select("w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), "rows"), ["w", "lot"])
    x = x.withColumn("other", F.filter("rows", lambda r: r["c3"] != F.col("c3")))
    x = x.withColumn("ok", F.filter("other", lambda r: apart(r, "Latitude") | apart(r, "Longitude")))
    whole = F.size("rows") == held
    chosen = F.when(F.size("ok") >= near, F.col("ok")).when(whole, F.when(F.size("other") >= near, F.col("other")).otherwise(F.col("rows")))
    x = x.withColumn("chosen", F.slice(chosen, 1, near))
    bad = F.filter("chosen", lambda r: F.when(F.col("polar"), r["polar"]).otherwise(r["desert"]))
    return x.select(*asked.columns, F.when(F.col("chosen").isNotNull(), F.size(bad) / near).alias("share"))


def neighbours_shares(asked: DataFrame, bank: DataFrame, near: int) -> DataFrame:
    """photo_key and the share of misfits among the ``near`` rows of the bank most similar to it.

    Neighbours are from another cell and over three degrees away; where the bank hasn't
    enough such rows, from another cell; else any. asked has a column polar, which chooses
    what is a misfit. The asked are dealt into parts of ``PART_BYTES`` at most as doubles, the bank into twice as large ones,
    each two of which meet in a task; a meeting gives, for each level that may still
    be needed, its ``near`` best. Similarities count to 6 places, ties go to the smaller key.
    """
    columns = ["photo_key", "Latitude", "Longitude", "c3", "v", "bytes"]
    left, right = _dealt(asked.select(*columns, "polar"), bank.select(*columns, *_misfits()), "photo_key")

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("photo_key", "n_ok", "n_other", *[f"{c}_{x}" for c in LEVELS for x in ("far", "key", "bad")])}
        if not len(x) or not len(y):
            return pd.DataFrame(out, dtype=object)
        y = y.sort_values("photo_key", ignore_index=True)
        unit, name, n = np.stack(y["v"].to_numpy()).T, y["photo_key"].to_numpy(), len(y)
        cell, lat, lon = y["c3"].to_numpy(), y["Latitude"].to_numpy(float), y["Longitude"].to_numpy(float)
        rows = max(1, PAIRS // n)
        for at in range(0, len(x), rows):
            part = x.iloc[at : at + rows]
            s = np.rint(np.stack(part["v"].to_numpy()) @ unit * 1e6).astype(np.int64)
            score = s * n + (n - 1 - np.arange(n))  # no two alike
            p_lat, p_lon = part["Latitude"].to_numpy(float)[:, None], part["Longitude"].to_numpy(float)[:, None]
            other = cell != part["c3"].to_numpy()[:, None]
            ok = other & ((np.abs(lat - p_lat) > 3) | (np.abs(lon - p_lon) > 3))
            enough = np.zeros(len(part), bool)
            misfit = np.where(part["polar"].to_numpy(bool)[:, None], y["polar"].to_numpy(bool), y["desert"].to_numpy(bool))
            out["photo_key"] += part["photo_key"].tolist()
            out["n_ok"] += ok.sum(axis=1).tolist()
            out["n_other"] += other.sum(axis=1).tolist()
            for level, mask in zip(LEVELS, (ok, other, np.ones_like(ok)), strict=True):
                ranked = np.where(mask, score, np.iinfo(np.int64).min)
                top = np.argpartition(ranked, max(0, n - near), axis=1)[:, -near:]
                for r in range(len(part)):
                    t = () if enough[r] else top[r][mask[r, top[r]]]
                    t = np.asarray(t, np.int64)
                    out[f"{level}_far"].append(-s[r, t])
                    out[f"{level}_key"].append(name[t])
                    out[f"{level}_bad"].append(misfit[r, t])
                enough |= mask.sum(axis=1) >= near
        # a part may have a single row, whose list would not stay one
        return pd.DataFrame({c: pd.Series(v, dtype=object) if c.endswith(("_far", "_key", "_bad")) else v for c, v in out.items()})

    lists = ", ".join(f"{c}_far array<long>, {c}_key array<string>, {c}_bad array<boolean>" for c in LEVELS)
    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(meet, f"photo_key string, n_ok long, n_other long, {lists}")
    # near from each part of the bank, which has bounded many
    lists = {c: F.flatten(F.collect_list(F.arrays_zip(*[F.col(f"{c}_{x}").alias(x) for x in ("far", "key", "bad")]))) for c in LEVELS}
    of = met.groupBy("photo_key").agg(F.sum("n_ok").alias("n_ok"), F.sum("n_other").alias("n_other"), *[v.alias(c) for c, v in lists.items()])
    chosen = F.when(F.col("n_ok") >= near, F.col("ok")).when(F.col("n_other") >= near, F.col("other")).otherwise(F.col("any"))
    top = F.slice(F.array_sort(chosen), 1, near)
    return of.select("photo_key", (F.size(F.filter(top, lambda t: t["bad"])) / near).alias("share"))


def climate_outliers(photos: DataFrame, target_platforms: tuple[str, ...], cell: str = "cell", k: int = NEIGHBOURS, threshold: float = INCOMPATIBLE, pictures: DataFrame | None = None, by: str = "vec_id") -> DataFrame:
    """Keys of polar and remote desert photos most of whose nearest pictures, from elsewhere, show another climate.

    photos: photo_key, Platform, Latitude, Longitude, Koppen_Code, embedding, a cell and perhaps a continent.
    Where photos share vectors, pictures has each embedding by the column ``by`` of both, and photos have none.
    The bank of reference pictures is all fitting rows of five climate groups but the tenth of each that is least
    like its mean. Equal vectors are one, and only vectors are compared, all with all: of each one's ranking the
    head (``HEADS``), in which nearly all photos find their neighbours; the others meet every row of the bank.
    """
    digest = F.concat_ws("-", F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(1), "v")))
    of = photos if pictures is None else pictures
    of = of.where("embedding is not null").withColumn("v", vectors.normalised(F.col("embedding"))).withColumn("w", digest)
    # with their sizes, for which no vector has to be read
    units = shared.written(of.groupBy("w").agg(F.first("v").alias("v")).withColumn("bytes", F.size("v").cast("long") * 8), "units")
    antarctic = F.lower("continent") == "antarctica" if "continent" in photos.columns else F.lit(False)
    p = of if pictures is None else photos.join(of.select(by, "w"), by)
    p = p.select(
        "photo_key",
        F.lower("Platform").alias("plat"),
        F.coalesce("Koppen_Code", F.lit("")).alias("koppen"),
        F.substring(F.coalesce("Koppen_Code", F.lit("")), 1, 1).alias("major"),
        F.coalesce(grid.parent(F.col(cell), 3), F.lit(-1)).alias("c3"),
        grid.parent(F.col(cell), 4).alias("c4"),
        "Latitude",
        "Longitude",
        (F.coalesce(antarctic, F.lit(False)) | F.coalesce(F.col("Koppen_Code").isin("EF", "ET"), F.lit(False))).alias("polar"),
        "w",
    )
    p = shared.written(p, "photos")
    trusted = ~F.col("plat").isin(*target_platforms) if target_platforms else F.lit(False)
    cells = p.where("c3 >= 0").groupBy("c3").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("plat").alias("kinds"), F.max(trusted).alias("own"))
    cells = cells.select(F.col("c3"), (F.col("own") | ((F.col("kinds") >= 2) & (F.col("n") >= 20))).alias("good"), (F.col("n") >= 5).alias("some"))
    pool = p.where(F.col("major").isin(*"ABCDE")).join(cells, "c3", "left").withColumn("fit", F.coalesce(F.when(F.col("major") == "E", F.col("good") | F.col("some")).otherwise(F.col("good")), F.lit(False)))
    # groups without a fitting cell fall back to all their rows
    groups = pool.groupBy("major").agg(F.max("fit").alias("any_fit"))
    pool = pool.join(F.broadcast(groups), "major").where(F.col("fit") | ~F.col("any_fit"))
    pool = shared.written(pool.select("photo_key", "major", "koppen", "c3", "Latitude", "Longitude", "w"), "pool")
    kept = climate_bank(pool, units)
    held, kinds = kept.agg(F.sum("n"), F.countDistinct("major")).first()
    near = min(k, held or 0)
    if kinds < 2 or near < LEAST_NEIGHBOURS:
        return photos.select("photo_key").limit(0)
    bank = pool.join(kept.select("major", "w"), ["major", "w"], "left_semi")
    target = F.col("plat").isin(*target_platforms) if target_platforms else F.lit(True)
    dense = p.where("c4 is not null").groupBy("c4").agg(F.count(F.lit(1)).alias("n4"), F.countDistinct("plat").alias("k4")).where("n4 >= 500 and k4 >= 3").select("c4", F.lit(True).alias("dense"))
    asked = p.where(target).join(dense, "c4", "left").where(F.col("polar") | (F.col("koppen").isin("BWh", "BWk") & F.col("dense").isNull()))
    asked = shared.written(asked.select("photo_key", "Latitude", "Longitude", "c3", "polar", "w", F.count(F.lit(1)).over(Window.partitionBy("photo_key")).alias("same")), "asked")
    # rows with one key are one question, which only the last step can ask
    left, answered = asked.where("same = 1"), []
    for times in HEADS:
        if left.isEmpty():
            break
        heads = rankings(left.select("w").distinct(), bank, units, times * near)
        met = shared.written(ranked_shares(left, heads, near, held), "met")
        answered.append(met.where("share is not null").select("photo_key", "share"))
        left = met.where("share is null").drop("share")
    left = left.unionByName(asked.where("same > 1"))
    if not left.isEmpty():
        answered.append(neighbours_shares(left.join(units, "w"), bank.join(units, "w"), near))
    none = asked.select("photo_key", F.lit(0.0).alias("share")).limit(0)
    return reduce(DataFrame.unionByName, answered, none).where(F.col("share") >= threshold).select("photo_key")
