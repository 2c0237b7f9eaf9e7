"""Operators on small tables with known results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomill.functions import grid
from geomill.operators import angular, anomaly, cluster, filters, index, ingest, maintain, metrics, near_dup, neighbours, regions, sampling, trajectory
from geomill.sources import config, occurrences, tables


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def photo_rows(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def test_replace_cells(spark):
    old = photo_rows(spark, [("123", "flickr", "841f8f3ffffffff"), ("456", "mapillary", "841f8f3ffffffff"), ("789", "flickr", "841f8f5ffffffff"), ("000", "flickr", None)], ["Photo_ID", "Platform", "H3_Cell"])
    new = photo_rows(spark, [("999", "Flickr", "841f8f3ffffffff", "CC0")], ["Photo_ID", "Platform", "H3_Cell", "License"])
    out = ingest.replace_cells(old, new)
    assert ids(out, "Photo_ID") == ["000", "789", "999"]
    assert ids(out, "photo_key") == ["flickr_000", "flickr_789", "flickr_999"]


def test_normalize_and_platform_of_file(spark):
    raw = photo_rows(spark, [("1.0", "4", "5", "u", "1717156800")], ["ID", "lat", "lon", "url", "captured_at"])
    r = ingest.normalize(raw, F.lit("/data/flickr_photos.csv")).first()
    assert (r.Photo_ID, r.Platform, r.Latitude, r.Captured_At, r.photo_key) == ("1", "flickr", 4.0, "2024-05-31T12:00:00Z", "flickr_1")


def test_locked_latitudes_are_removed(spark):
    rows = [(i, "flickr", 34.0, x) for i, x in enumerate(np.linspace(-100, -50, 15).tolist())] + [(100 + i, "flickr", 45.0, x) for i, x in enumerate((-70.0, -70.1, -70.2))]
    p = photo_rows(spark, rows, ["id", "Platform", "Latitude", "Longitude"])
    assert ids(anomaly.clean_coordinates(p)) == [100, 101, 102]


def test_sequences_of_locked_photos_go(spark):
    rows = [(i, "mapillary", 34.0, x) for i, x in enumerate(np.linspace(-100, -50, 15).tolist())] + [(20 + i, "mapillary", 10.05 + i / 100, 9.0) for i in range(3)] + [(30 + i, "mapillary", 50.0 + i, 9.0) for i in range(4)]
    p = photo_rows(spark, rows, ["id", "Platform", "Latitude", "Longitude"]).withColumn("photo_key", F.col("id").cast("string"))
    seq = p.select("photo_key", F.when(F.col("id") < 30, "bad").otherwise("good").alias("sequence_id"))
    assert ids(anomaly.clean_coordinates(p, sequences=seq)) == [30, 31, 32, 33]


@pytest.mark.parametrize("part_bytes", [32 << 20, 1_500])
def test_climate_outliers(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(anomaly, "PART_BYTES", part_bytes)
    rng = np.random.default_rng(123)
    rows = []
    base = {"A": np.eye(16)[0], "E": np.eye(16)[1]}
    for i in range(80):
        major, code = ("A", "Af") if i % 2 else ("E", "ET")
        v = base[major] + rng.normal(0, 0.02, 16)
        rows.append((f"anchor{i}", "inaturalist", 60.0 - i if major == "E" else i / 4.0, float(i * 4 - 150), code, v.astype("float32").tolist()))
    rows.append(("bad", "flickr", 80.0, 170.0, "EF", base["A"].astype("float32").tolist()))
    rows.append(("good", "flickr", 80.5, 170.0, "EF", base["E"].astype("float32").tolist()))
    p = photo_rows(spark, rows, ["photo_key", "Platform", "Latitude", "Longitude", "Koppen_Code", "embedding"])
    p = p.withColumn("cell", grid.encode(F.col("Latitude"), F.col("Longitude")))
    assert ids(anomaly.climate_outliers(p, ("flickr",)), "photo_key") == ["bad"]


def outliers_one_by_one(rows, unit, k=25):
    """Keys of asked ET photos by plain loops. rows: (key, platform, lat, lon, code, c3, vector's number), all fitting."""
    bank = []
    for major in "AE":
        of = [r for r in rows if r[4][0] == major]
        mean = np.mean([unit[r[6]] for r in of], axis=0)
        s = np.round([unit[r[6]] @ mean / np.linalg.norm(mean) for r in of], 6)
        bank += [r for r, x in zip(of, s, strict=True) if x >= round(np.percentile(s, 10), 9)]
    out = []
    for a in (r for r in rows if r[1] == "flickr" and r[4] == "ET"):
        other = [b for b in bank if b[5] != a[5]]
        ok = [b for b in other if abs(b[2] - a[2]) > 3 or abs(b[3] - a[3]) > 3]
        level = next((x for x in (ok, other) if len(x) >= k), bank)
        top = sorted(level, key=lambda b: (-np.rint(unit[a[6]] @ unit[b[6]] * 1e6), b[0]))[:k]
        out += [a[0]] if sum(b[4][0] == "A" for b in top) / k >= 0.5 else []
    return sorted(out)


@pytest.mark.parametrize("heads", [(1, 2), ()])
@pytest.mark.parametrize(("lat", "lon"), [(60, 300), (4, 4), (0.5, 0.5)])
def test_climate_outliers_of_shared_vectors(spark, monkeypatch, heads, lat, lon):
    """Photos spread out, near each other and nearly all in one cell; heads of the ranking that are too short are not the answer."""
    monkeypatch.setattr(anomaly, "HEADS", heads)
    monkeypatch.setattr(anomaly, "LOT", 2)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 6)).astype("float32")
    base[30:] = base[:10]  # equal vectors by other numbers
    pictures = photo_rows(spark, [(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<float>")
    rows = [(f"k{i * 7919 % 400:03d}", ("flickr", "inaturalist")[i % 2], float(rng.uniform(0, lat)), float(rng.uniform(0, lon)), ("Af", "ET")[i // 2 % 2], int(rng.integers(40))) for i in range(400)]
    p = photo_rows(spark, rows, "photo_key string, Platform string, Latitude double, Longitude double, Koppen_Code string, vec_id long")
    # every cell has one of another platform
    trusted = p.select(F.concat(F.lit("z"), "photo_key").alias("photo_key"), F.lit("kartaview").alias("Platform"), "Latitude", "Longitude", "Koppen_Code", "vec_id")
    p = p.union(trusted).withColumn("cell", grid.encode(F.col("Latitude"), F.col("Longitude"))).localCheckpoint()
    unit = base.astype(float) / np.linalg.norm(base.astype(float), axis=1, keepdims=True)
    plain = [tuple(r) for r in p.select("photo_key", "Platform", "Latitude", "Longitude", "Koppen_Code", grid.parent(F.col("cell"), 3), "vec_id").collect()]
    want = outliers_one_by_one(plain, unit)
    assert 0 < len(want) < 100
    assert ids(anomaly.climate_outliers(p, ("flickr",), threshold=0.5, pictures=pictures), "photo_key") == want
    whole = p.join(pictures, "vec_id").drop("vec_id")
    assert ids(anomaly.climate_outliers(whole, ("flickr",), threshold=0.5), "photo_key") == want


def test_asked_photos_go_to_few_parts_of_the_bank():
    # 75,000 reference pictures of 64 components are one part, however many ask
    assert [anomaly._parts(n << 20, 38 << 20, 12) for n in (0, 5, 3_000)] == [(1, 1), (3, 1), (94, 1)]
    assert anomaly._parts(64 << 20, 600 << 20, 1) == (2, 10)


def points(spark, lat, lon, step_ms=1000):
    rows = [("s", f"{i:04d}", i * step_ms, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))]
    return photo_rows(spark, rows, ["sequence_id", "photo_id", "captured_at", "lat", "lon"])


def test_straight_track(spark):
    r = trajectory.validate(points(spark, [0.0] * 30, [i * 10 / 111_320 for i in range(30)])).first()
    assert r.is_valid and abs(r.tortuosity - 1) < 0.01 and abs(r.max_speed_kmh - 36) < 2


def test_jittering_camera(spark):
    g = random.Random(42)
    at = [(g.uniform(-1e-4, 1e-4), g.uniform(-1e-4, 1e-4)) for _ in range(30)]
    r = trajectory.validate(points(spark, *zip(*at, strict=True))).first()
    assert not r.is_valid and r.reason.startswith("Stationary camera GPS jitter") and r.tortuosity > 15 and r.bounding_radius_m < 35


def test_short_track(spark):
    assert trajectory.validate(points(spark, [0.0], [0.0])).first().reason == "Insufficient sequence frames"


def test_verdict_rules(spark):
    c = ["frame_count", "total_distance_m", "net_displacement_m", "tortuosity", "max_speed_kmh", "bounding_radius_m"]
    rows = [(20, 350.0, 10.0, 35.0, 15.0, 45.0), (20, 3500.0, 3000.0, 1.2, 350.0, 4500.0), (20, 3500.0, 3000.0, 1.2, 50.0, 4500.0)]
    got = [r.reason.split(":")[0] for r in trajectory.verdicts(photo_rows(spark, rows, c)).collect()]
    assert got == ["Severe random-walk tortuosity", "Impossible speed teleportation", "Valid moving trajectory"]


def test_index_is_additive(spark):
    rows = [(i, 10.0 + i % 3, 20.0 + i % 2, i % 4, f"c{i % 4}", "Spring") for i in range(10)]
    p = photo_rows(spark, rows, ["id", "Latitude", "Longitude", "cluster_id", "cluster_label", "Season"])
    p = p.withColumn("cell", grid.encode(F.col("Latitude"), F.col("Longitude"))).withColumn("cluster_description", F.lit(None).cast("string"))
    out = index.build(p)
    sums = {r.resolution: r.n for r in out.groupBy("resolution").agg(F.sum("image_count").alias("n")).collect()}
    assert sums == dict.fromkeys(range(1, 12), 10)
    assert index.point(out, 10.0, 20.0, 1).agg(F.sum("n")).first()[0] == 10
    assert index.point(out, -60.0, 100.0, 5).count() == 0


def test_greedy_is_not_transitive():
    a, b, c = [1.0, 0.0], [math.cos(0.25), math.sin(0.25)], [math.cos(0.5), math.sin(0.5)]
    assert near_dup.greedy(np.array([a, b, c]), threshold=0.95).tolist() == [True, False, True]
    assert near_dup.greedy(np.array([a, b, c]), seeds=np.array([b]), threshold=0.95).tolist() == [False, False, False]


def test_greedy_blocks_agree_with_the_plain_rule(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    kept = []
    for v in x / np.linalg.norm(x, axis=1, keepdims=True):
        kept.append(all(float(np.dot(v, w)) <= 0.9 for w, k in zip(x / np.linalg.norm(x, axis=1, keepdims=True), kept, strict=False) if k))
    assert near_dup.greedy(x, threshold=0.9, step=37).tolist() == kept


def test_similarities_at_the_threshold_count_in_doubles():
    # 0.6 and up to two millionths more; a float tells none of them apart
    at = np.arccos(0.6 + np.arange(0, 21) * 1e-7)
    x = np.stack([np.cos(at), np.sin(at), *np.zeros((300, 21))], axis=1)
    want = [round(float(c), 6) > 0.6 for c in 0.6 + np.arange(0, 21) * 1e-7]
    first = np.eye(1, 302)
    assert near_dup.above(x, first, 0.6)[:, 0].tolist() == near_dup.alike(x, first, 0.6).tolist() == want and 0 < sum(want) < 21
    assert near_dup.alike(x, np.vstack([first * np.nan, first]), 0.6).tolist() == want


@pytest.mark.parametrize("chunk", [7, None])
def test_all_pairs_of_a_cell_are_checked(spark, chunk):
    r = np.random.default_rng(5)
    x = r.normal(size=(80, 3)).astype(np.float32)
    kept = r.random(80) < 0.3
    kept[2::3] = False  # one cell keeps none
    df = spark.createDataFrame([(i, i % 3, v.tolist(), bool(k)) for i, (v, k) in enumerate(zip(x, kept, strict=True))], "id long, c long, v array<float>, kept boolean")
    u = near_dup.unit(x)
    want = {i: (bool(kept[i]), any(kept[j] and j % 3 == i % 3 and round(float(u[i] @ u[j]), 6) > 0.8 for j in range(i))) for i in range(80)}
    assert {t.id: (t.kept, t.like) for t in near_dup.pairs_checked(df, "c", "id", "v", "kept", 0.8, chunk).collect()} == want


def test_vectors_move_once_where_cells_are_small(spark, monkeypatch):
    """A cell of more than 4,096 rows, all of which stay, is no matter for rounds."""
    df = spark.range(6_000).selectExpr("id i", "1L c", "array(cast(cos(id / 900) as float), cast(sin(id / 900) as float)) v")
    written = []
    monkeypatch.setattr(near_dup.shared, "written", lambda t, name, own=near_dup.shared.written: written.append(name) or own(t, name))
    assert near_dup.dedup_cells(df, "c", ["i"], "v", 0.9999999, id_col="i").count() > 1 and written == ["dense"]


@pytest.mark.parametrize(("block", "chunk", "seeds"), [(4_096, 9_999, 60), (16, 40, 0), (16, 7, 60), (5, 1_000, 9)])
def test_dedup_in_rounds_equals_the_walk(spark, block, chunk, seeds):
    """A dense cell with many near and exact copies, zero vectors and seeds, settled in rounds; small and empty cells beside it."""
    r = np.random.default_rng(8)
    base = r.normal(size=(90, 6))
    x = base[r.integers(0, 90, 500)] + r.normal(scale=0.25, size=(500, 6)) * (r.random(500) < 0.7)[:, None]
    x[::50] = 0
    cells = np.where(np.arange(500) % 5 < 3, 7, np.arange(500) % 23 + 100)
    rows = [(i, int(c) if i % 41 else None, int(i * 7919 % 1000), v.astype(np.float32).tolist() if i % 43 else None) for i, (c, v) in enumerate(zip(cells, x, strict=True))]
    schema = "i long, c long, o long, v array<float>"
    old = [(10_000 + i, 7, i, v.astype(np.float32).tolist()) for i, v in enumerate(base[:seeds] + 0.2)]
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = near_dup.dedup_cells(df, "c", ["o"], "v", 0.9, spark.createDataFrame(old, schema) if seeds else None, "i", block, chunk)
    unit = lambda v: np.asarray(v, float) / (np.linalg.norm(v) or 1.0)
    kept = {7: [unit(v) for _, _, _, v in old]}
    want = set()
    for i, c, _, v in sorted((t for t in rows if t[1] is not None and t[3] is not None), key=lambda t: (t[2], t[0])):
        u = unit(v)
        if all(round(float(u @ k), 6) <= 0.9 for k in kept.setdefault(c, [])):
            kept[c].append(u)
            want.add(i)
    assert {t.i for t in got.collect()} == want and 0 < len(want) < 450


def test_dedup_keeps_existing(spark):
    p = photo_rows(spark, [("n1", 1, [1.0, 0.0]), ("n2", 1, [0.0, 1.0]), ("n3", 2, [1.0, 0.0])], ["photo_key", "c", "embedding"])
    old = photo_rows(spark, [("o1", 1, [1.0, 0.001])], ["photo_key", "c", "embedding"])
    assert ids(near_dup.dedup_cells(p, "c", ["photo_key"], existing=old), "photo_key") == ["n2", "n3"]


def test_votes(spark):
    s = photo_rows(spark, [(0, 10, 0), (0, 10, 1), (1, 20, 2), (1, 20, 3)], ["cluster_id", "parent", "idx"])
    assert {r.cluster_id: r.parent_cluster_id for r in cluster.vote(s, 3, 2).collect()} == {0: 10, 1: 20, 2: 1}


def test_closest_and_medoids(spark):
    p = photo_rows(spark, [(0, 0, [1.0, 0.0], 40.0, -74.0, "u0"), (1, 0, [0.99, 0.01], 40.0, -74.0, "u0"), (2, 0, [0.0, 1.0], 50.0, 2.0, "u1"), (3, 0, [0.1, 0.9], 50.0, 2.0, "u2")], ["photo_key", "cluster_id", "embedding", "Latitude", "Longitude", "Image_URL"])
    centre = photo_rows(spark, [(0, [1.0, 0.0])], ["cluster_id", "centroid"])
    got = cluster.diverse_medoids(p, centre, 2).orderBy("pick").collect()
    assert [r.id for r in got] == [0, 3]
    assert [r.photo_key for r in cluster.closest(p, centre, 1).collect()] == [0]


def test_drift(spark):
    e = lambda i: [1.0 if j == i else 0.0 for j in range(12)]
    old = photo_rows(spark, [(1, 0, e(0)), (2, 1, e(1)), (3, 2, e(2))], ["photo_key", "cluster_id", "embedding"])
    new = lambda rows: photo_rows(spark, rows, ["photo_key", "embedding"])
    base = [(1, e(0)), (2, e(1)), (3, e(2))]
    assert cluster.drift(new([*base, (4, e(0))]), old).first().decision == "assign"
    assert cluster.drift(new([*base, (4, e(10))]), old).first().decision == "fit"
    assert cluster.drift(new(base), old).first().decision == "assign"
    assert cluster.drift(new([(9, e(0))]), old).first().decision == "fit"


def test_hierarchy_covers_all_rows(spark):
    p = photo_rows(spark, [(i, [float(i % 2), 1.0 - i % 2, i / 100, 0.0]) for i in range(10)], ["photo_key", "embedding"])
    out = cluster.fit_hierarchy(p, 4, 2).toPandas()
    assert len(out) == 10 and (out.cluster_id >= 0).all() and (out.parent_cluster_id >= 0).all()


def test_elbow(spark):
    curve = photo_rows(spark, [(1, 100.0), (2, 30.0), (3, 20.0), (4, 15.0), (5, 12.0)], ["k", "cost"])
    assert cluster.elbow(curve).first().k == 2
    assert cluster.elbow(curve.where("k > 3")).first().k == 5


def test_metrics(spark):
    rows = [(q, i + 1, x == "A") for q, word in ((1, "ABABB"), (2, "BBA"), (3, "B")) for i, x in enumerate(word)]
    got = {r.query_id: (r.precision, r.ap, r.rr) for r in metrics.per_query(photo_rows(spark, rows, ["query_id", "rank", "match"]), 5).collect()}
    assert got == {1: (0.4, 0.833333, 1.0), 2: (0.2, 0.333333, 0.333333), 3: (0.0, 0.0, 0.0)}


@pytest.mark.parametrize("few", [16 << 20, -1])
def test_neighbours_in_blocks(spark, monkeypatch, few):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERY_BYTES", few)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    p = photo_rows(spark, [(i, v.tolist()) for i, v in enumerate(x)], ["id", "v"])
    got = {(r.query_id, r["rank"]): r.id for r in neighbours.cosine_top_k(p.where("id < 20"), p, 3, exclude_self=True).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T - 2 * np.eye(60)
    assert got == {(q, r + 1): int(np.argsort(-s[q])[r]) for q in range(20) for r in range(3)}


def test_meetings_hold_few_similarities_at_once(spark, monkeypatch):
    # as many rows and queries as they come, yet no product of more than PAIRS
    n = 12_000
    monkeypatch.setattr(neighbours, "PAIRS", 1 << 16)
    held = spark.range(n).selectExpr("id", "array(cos(id / 2000), sin(id / 2000)) v").coalesce(1)

    def most(df):
        def watched(batches):
            import tracemalloc

            import pandas as pd

            tracemalloc.start()
            list(f(batches))
            yield pd.DataFrame({"mb": [tracemalloc.get_traced_memory()[1] / 1e6]})

        f = df
        return watched

    seen = []
    real = type(held).mapInPandas

    def spied(self, f, schema):
        if schema.startswith("query_id"):
            seen.append(real(self, most(f), "mb double").first().mb)
        return real(self, f, schema)

    monkeypatch.setattr(type(held), "mapInPandas", spied)
    got = {r.query_id: r.id for r in neighbours.cosine_top_k(held.where("id % 4 = 1"), held, 1, exclude_self=True).collect()}
    assert len(got) == n // 4
    assert len(seen) == 1 and seen[0] < 20


def test_search_passes_over_vectors_that_are_not_finite(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PAIRS", 3)
    p = photo_rows(spark, [(0, [1.0, 0.0]), (1, [math.nan, 1.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.1])], ["id", "v"])
    got = sorted((r.query_id, r["rank"], r.id) for r in neighbours.cosine_top_k(p, p, 2, exclude_self=True).collect())
    assert got == [(0, 1, 2), (0, 2, 4), (2, 1, 4), (2, 2, 0), (3, 1, 2), (3, 2, 4), (4, 1, 2), (4, 2, 0)]


def test_sync_is_idempotent(spark):
    online = photo_rows(spark, [(f"mapillary_{i}",) for i in (1, 2, 3)], ["photo_key"])
    offline = photo_rows(spark, [(f"mapillary_{i}", i) for i in range(1, 6)], ["photo_key", "n"])
    kept, side = maintain.sync(online, offline, {"e": offline})
    assert ids(kept, "n") == [1, 2, 3] and ids(side["e"], "n") == [1, 2, 3]
    assert ids(maintain.sync(online, kept, {})[0], "n") == [1, 2, 3]


def test_restored_addresses(spark):
    c = ["Platform", "photo_key", "Image_URL"]
    platforms = ("flickr", "mapillary", "kartaview", "inaturalist", "wikimedia")
    online = photo_rows(spark, [(p, f"{p}_1", "on") for p in platforms], c)
    offline = photo_rows(spark, [(p, f"{p}_1", "off") for p in platforms] + [("flickr", "flickr_6", "off")], c)
    got = {r.photo_key: r.Image_URL for r in maintain.restore_addresses(offline, online).collect()}
    assert got == {f"{p}_1": "on" for p in platforms[:4]} | {"wikimedia_1": "off", "flickr_6": "off"}


def test_rule_purge(spark):
    p = photo_rows(spark, [(1, "flickr", "n"), (2, "mapillary", "n"), (3, "mapillary", "k"), (4, "flickr", "k"), (5, "flickr", "p")], ["id", "Platform", "cell"])
    rules = lambda *r: photo_rows(spark, list(r), ["cell", "platform", "expand_sequence"])
    assert ids(maintain.purge_by_rules(p, rules(("n", "all", False)), F.col("cell"))) == [3, 4, 5]
    assert ids(maintain.purge_by_rules(p, rules(("n", "mapillary", False), ("k", "mapillary", False)), F.col("cell"))) == [1, 4, 5]


def test_swap_a_table_read_by_itself(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).write.parquet(path)
    maintain.swap(spark.read.parquet(path).where("id > 6"), path)
    assert ids(spark.read.parquet(path)) == [7, 8, 9]


def test_filters():
    assert filters.parse_box("1,2,3,4") == (1.0, 2.0, 3.0, 4.0) and filters.parse_box("1,2") is None
    assert filters.parse_platforms("flickr, Mapillary") == ["flickr", "mapillary"] and filters.parse_platforms("flickr all") == []


def test_filter_of_missing_columns_is_left_out(spark):
    p = photo_rows(spark, [(1, 5.0, 5.0)], ["id", "Latitude", "Longitude"])
    assert filters.select(p, season="Winter", cluster_id=3, bbox="0,9,0,9").count() == 1


def test_regions(spark):
    ring = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]
    polygons = spark.createDataFrame([("Land", "X", ring)], "name string, continent string, ring array<array<double>>")
    p = photo_rows(spark, [(1, 5.0, 5.0), (2, 5.0, 10.5), (3, 5.0, 14.0)], ["id", "Latitude", "Longitude"])
    got = {r.id: r.country for r in regions.map_regions(p.withColumn("cell", grid.encode(F.col("Latitude"), F.col("Longitude"))), polygons).collect()}
    assert got == {1: "Land", 2: "Land", 3: "Ocean / Unknown"}


def test_sampling(spark):
    p = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("c"), (F.col("id") % 3).alias("g"))
    assert sampling.cell_cap(p, "c", 5, "id").count() == 35
    assert sampling.sample_size(p, "c", 70, "id").count() == 70
    assert [r["count"] for r in sampling.round_robin(p, "g", "c", 14, "id").groupBy("g", "c").count().collect()] == [2] * 21


def test_camera_samples(spark):
    rows = [("d", i, f"s{i // 2}", f"2024-01-{1 + i // 2:02d}", "winter", "day", i >= 6) for i in range(10)]
    got = sampling.camera_samples(photo_rows(spark, rows, ["deployment_id", "image_id", "sequence_id", "date", "season", "time_of_day", "is_animal"])).collect()
    # image 0 and 2 fill the bin; the animals 6 and 8 replace the blanks
    assert [(r.image_id, r.pick) for r in got] == [(6, 1), (8, 2)]


def plain_cameras(rows, per_bin=2, per_camera=4):
    """Image by image. rows: deployment, image, sequence, date, season, time of day, animal."""
    out = set()
    for d in {r[0] for r in rows}:
        bins = {}
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: r[1]):
            own = bins.setdefault((r[4], r[5]), [])
            if own and any(r[2] == x[2] for b in bins.values() for x in b):
                continue
            if len(own) < per_bin:
                if all(r[3] != x[3] for x in own):
                    own.append(r)
            elif r[6]:
                for k, x in enumerate(own):
                    if not x[6] and x[3] != r[3]:
                        own[k] = r
                        break
        ranked = [sorted(b, key=lambda x: not x[6]) for b in bins.values()]
        chosen = ([b[0] for b in ranked if b] + [b[1] for b in ranked if len(b) > 1])[:per_camera]
        out |= {(d, x[1], k) for k, x in enumerate(chosen, 1)}
    return out


@pytest.mark.parametrize("per_bin", [1, 2, 3])
def test_camera_samples_equal_the_walk(spark, per_bin):
    r = np.random.default_rng(per_bin)
    pick = lambda *of: of[r.integers(len(of))]
    rows = [(f"d{i % 9}", i, pick(*[f"s{k}" for k in range(60)], None), pick("1", "2", "3", "4", None), pick("w", "s", None), pick("day", "night"), bool(r.random() < 0.3)) for i in range(900)]
    df = spark.createDataFrame(rows, "deployment_id string, image_id long, sequence_id string, date string, season string, time_of_day string, is_animal boolean").repartition(4)
    assert {tuple(t) for t in sampling.camera_samples(df, per_bin, 5).collect()} == plain_cameras(rows, per_bin, 5)
    assert sampling.camera_samples(df.limit(0)).collect() == []


def plain_split(pairs, share):
    """Class by class."""
    of = {}
    for c, b, h in sorted(pairs, key=lambda t: (t[2], t[1])):
        of.setdefault(c, []).append((b, h))
    query, base = set(), set()
    for c in sorted(of, key=lambda c: (len(of[c]), c)):
        n = len(of[c])
        need_q = (max(1, int(n * share)) if n > 1 else 0) - sum(b in query for b, _ in of[c])
        need_b = (n > 1) - sum(b in base for b, _ in of[c])
        for b, h in of[c]:
            if b in query or b in base:
                continue
            if need_q > 0:
                query.add(b)
                need_q -= 1
            elif need_b > 0:
                base.add(b)
                need_b -= 1
            else:
                (query if h % 1_000 / 1_000 < share else base).add(b)
    return {**dict.fromkeys(query, True), **dict.fromkeys(base, False)}


@pytest.mark.parametrize("classes", [3, 40])
def test_block_split_equals_the_walk(spark, classes):
    r = np.random.default_rng(classes)
    rows = [(int(c), int(r.integers(0, 12 + 9 * c)) if i % 31 else None) for i, c in enumerate(r.integers(0, classes, 900))]
    df = spark.createDataFrame([(f"c{c}" if i % 37 else None, b) for i, (c, b) in enumerate(rows)], "label string, b long").repartition(3)
    pairs = {tuple(t) for t in df.where("b is not null and label is not null").select("label", "b", F.xxhash64(F.col("b").cast("string"), F.lit(42))).collect()}
    split = sampling.query_blocks(df, "b", "label", 0.3)
    assert {t.block: t.is_query for t in split.collect()} == plain_split(pairs, 0.3)
    assert sampling.query_blocks(df.limit(0), "b", "label").collect() == []


def test_blocks_cover_every_class(spark):
    p = spark.range(400).select((F.col("id") % 20).alias("b"), F.when(F.col("id") % 20 < 2, "rare").otherwise("common").alias("label"))
    split = {r.block: r.is_query for r in sampling.query_blocks(p, "b", "label").collect()}
    assert len(split) == 20 and {split[0], split[1]} == {True, False} and 3 <= sum(split.values()) <= 8


def test_sources(spark, tmp_path):
    d = photo_rows(spark, [("a", "1")], ["x", "y"])
    tables.save(d, str(tmp_path / "t.csv"))
    assert tables.load(spark, str(tmp_path / "t.csv"), ["y"]).collect()[0].y == "1"
    with pytest.raises(ValueError, match="pkl"):
        tables.load(spark, "t.pkl")
    (tmp_path / "boxes.txt").write_text("1,2,3,4\n\x005,6,7,8\n1,2\n")
    assert tables.logged_boxes(spark, str(tmp_path / "boxes.txt")).count() == 2


def test_save_splits_embeddings(spark, tmp_path):
    d = photo_rows(spark, [("flickr", "1", [1.0])], ["Platform", "Photo_ID", "embedding"])
    tables.save(d, str(tmp_path / "p.parquet"))
    assert spark.read.parquet(str(tmp_path / "p.parquet")).columns == ["Platform", "Photo_ID"]
    assert spark.read.parquet(str(tmp_path / "p.parquet.embeddings")).first().photo_key == "flickr_1"


def test_zipped_occurrences(spark, tmp_path):
    import zipfile

    header = ["gbifID", "decimalLatitude", "decimalLongitude", "eventDate", "associatedMedia"]
    with zipfile.ZipFile(tmp_path / "o.zip", "w") as z:
        z.writestr("occurrence.txt", "\n".join("\t".join(r) for r in (header, ["1", "4.5", "5", "2024", "https://a/b.jpg"], ["2", "x", "5", "2024", "https://a/b.jpg"], ["3", "bad line"])))
    rows = occurrences.tab_table(occurrences.zipped_lines(spark, str(tmp_path / "o.zip"), "occurrence.txt"), header)
    assert ids(occurrences.from_occurrences(rows), "Photo_ID") == ["1"]


def test_config(tmp_path):
    (tmp_path / "p.yaml").write_text("a:\n  b: 1\n  c: [1, 2]\n")
    (tmp_path / "p.local.yaml").write_text("a:\n  b: 2\n")
    p = config.load(str(tmp_path / "p.yaml"))
    assert config.get(p, "a.b") == 2 and config.get(p, "a.x", 7) == 7 and config.shell(config.get(p, "a.c")) == "1 2" and config.shell(True) == "true"


def test_stream(spark, tmp_path):
    from geomill.streaming import ingest as streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join('{"Photo_ID": "%d", "Platform": "flickr", "Latitude": 1.0, "Longitude": 2.0, "Captured_At": "2024-05-01T00:00:00Z"}' % (i % 3) for i in range(9)))
    seen = []
    s = streaming.photo_stream(spark, str(tmp_path / "in"), "Photo_ID string, Platform string, Latitude double, Longitude double, Captured_At string")
    streaming.write_batches(s, str(tmp_path / "check"), lambda b, i: seen.extend(r.photo_key for r in b.collect())).awaitTermination()
    assert sorted(seen) == ["flickr_0", "flickr_1", "flickr_2"]


def test_raster_and_polygons(spark, tmp_path):
    (tmp_path / "r.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 10\n1 2\n3 -9999\n")
    assert tables.raster_header(spark, str(tmp_path / "r.asc"))["cellsize"] == 10
    r = tables.raster(spark, str(tmp_path / "r.asc"))
    assert sorted((x.row, x.col, x.value) for x in r.collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, -9999.0)]
    p = photo_rows(spark, [(1, 15.0, 5.0), (2, 5.0, 5.0), (3, 50.0, 5.0)], ["id", "Latitude", "Longitude"])
    assert {x.id: x.value for x in regions.raster_lookup(p, r, 0.0, 20.0, 10.0).collect()} == {1: 1.0, 2: 3.0, 3: None}
    (tmp_path / "p.geojson").write_text('{"type": "FeatureCollection", "features": [{"properties": {"name": "A", "continent": "X"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 2]]]}}, {"properties": {"NAME": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[5, 5], [6, 5], [6, 6]]], [[[8, 8], [9, 8], [9, 9]]]]}}]}')
    shapes = tables.polygons(spark, str(tmp_path / "p.geojson"))
    assert sorted((x.name, x.south, x.east) for x in tables.polygon_boxes(shapes).collect()) == [("A", 0.0, 1.0), ("B", 5.0, 6.0), ("B", 8.0, 9.0)]


def test_batches(spark):
    assert [len(b) for b in tables.batches(spark.range(25), 10)] == [10, 10, 5]


@pytest.mark.parametrize("pairs", [5, 1 << 20])
def test_own_rank_equals_the_whole_matrix(spark, monkeypatch, pairs):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "PAIRS", pairs)
    rng = np.random.default_rng(3)
    # small whole numbers: many ties
    x, y = (rng.integers(1, 4, size=(40, 3)).astype(float) for _ in range(2))
    rows = lambda m: photo_rows(spark, [(i, v.tolist()) for i, v in enumerate(m)], ["id", "v"])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(unit(x) @ unit(y).T, 6)
    want = {i: 1 + sum((s[i, j], -j) > (s[i, i], -i) for j in range(40)) for i in range(40)}
    assert {r.query_id: r["rank"] for r in neighbours.own_rank(rows(x), rows(y)).collect()} == want


def test_own_rank_beyond_ten(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    gallery = [(i, [math.cos(i / 50), math.sin(i / 50)]) for i in range(30)]
    queries = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (99, [1.0, 0.0])]
    r = neighbours.own_rank(photo_rows(spark, queries, ["id", "v"]), photo_rows(spark, gallery, ["id", "v"]))
    assert {x.query_id: x.rank for x in r.collect()} == {0: 1, 20: 21, 99: None}
    assert metrics.self_match(r).first().mrr == pytest.approx((1 + 1 / 21) / 3, abs=1e-6)


def test_medoids_behind_repeated_addresses(spark):
    """Rows of one square that repeat an address already chosen don't hide the next one."""
    far = [(i, 0, [1.0, 0.01 * i], 10.0 + i, 5.0, f"u{i}") for i in range(2)]
    repeats = [(10 + i, 0, [1.0, 0.1 + 0.01 * i], 40.0, 7.0, f"u{i % 2}") for i in range(6)]
    last = [(30, 0, [1.0, 0.5], 40.0, 7.0, "new"), (31, 0, [1.0, 0.6], None, None, "u0"), (32, 0, [1.0, 0.7], None, None, "other")]
    p = photo_rows(spark, [*far, *repeats, *last], "photo_key long, cluster_id long, embedding array<double>, Latitude double, Longitude double, Image_URL string")
    centre = photo_rows(spark, [(0, [1.0, 0.0])], "cluster_id long, centroid array<double>")
    picks = lambda n: [r.id for r in cluster.diverse_medoids(p, centre, n).orderBy("pick").collect()]
    assert picks(3) == [0, 1, 30]
    assert picks(6) == [0, 1, 30, 32, 10, 11]


def test_landmarks_in_order(spark):
    """The rounds give what one walk over all photos gives."""
    import random

    r = random.Random(6)
    rows = [(i, f"c{r.randrange(12)}", f"l{int(r.paretovariate(1)) % 9}") for i in range(300)]
    counts = [(f"c{k}", 50 if k == 3 else 1) for k in range(12)]
    cells, landmarks, want = {}, {}, []
    for i, c, m in rows:
        if c != "c3" and cells.get(c, 0) < 4 and landmarks.get(m, 0) < 3:
            cells[c], landmarks[m] = cells.get(c, 0) + 1, landmarks.get(m, 0) + 1
            want.append(i)
    got = sampling.sparse_landmarks(photo_rows(spark, rows, ["id", "c", "m"]).repartition(3), photo_rows(spark, counts, ["c", "n"]), "c", "m", "id", 10, 4, 3)
    assert ids(got, "id") == want


@pytest.mark.parametrize(("shard_rows", "visits", "k"), [(4_096, 65_536, 5), (40, 30, 3), (7, 11, 12)])
def test_search_by_angle_bounds_is_exact(spark, monkeypatch, shard_rows, visits, k):
    """Clustered vectors, copies, ties, vectors of length 0 and null ones, on either side."""
    monkeypatch.setattr(angular, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(angular, "VISITS", visits)
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 8))
    x = centres[r.integers(0, 12, 700)] + r.normal(scale=0.1, size=(700, 8))
    x[::9] = x[0]
    x[5::100] = 0
    rows = [(i, None if i % 71 == 0 else v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(4)
    got = {}
    for t in neighbours.cosine_top_k(df.where("id % 5 = 0"), df, k, exclude_self=True, query_bytes=0).collect():
        got.setdefault(t.query_id, []).append((t["rank"], t.id, t.similarity))
    u = {i: np.asarray(v, float) / (np.linalg.norm(v) or 1.0) for i, v in rows if v}
    for q in (i for i in u if i % 5 == 0):
        want = sorted((-round(float(u[q] @ v), 6), i) for i, v in u.items() if i != q)[:k]
        assert [(s, i) for _, i, s in sorted(got[q])] == [(-s, i) for s, i in want]
    assert set(got) == {i for i in u if i % 5 == 0}


def test_bounds_leave_shards_out(spark, monkeypatch):
    """On clustered vectors queries visit a small part of all shards, and the gallery isn't copied."""
    monkeypatch.setattr(angular, "SHARD_ROWS", 20)
    r = np.random.default_rng(5)
    x = r.normal(size=(30, 16))[r.integers(0, 30, 1500)] + r.normal(scale=0.03, size=(1500, 16))
    gallery = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "gid long, v array<double>")
    where, by_shard = angular.mapped(gallery)
    shards = len(where.shard)
    visits = [len(where.near(a, float(np.sort(x[i] @ x.T / np.linalg.norm(x[i]) / np.linalg.norm(x, axis=1))[-6]))) for i, a in zip(range(0, 1500, 10), where.angles(x[::10] / np.linalg.norm(x[::10], axis=1, keepdims=True)), strict=True)]
    assert by_shard.count() == 1500 and shards >= 75
    assert np.mean(visits) < shards / 8


def test_search_in_empty_tables(spark):
    some, none = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>"), spark.createDataFrame([], "id long, v array<double>")
    for q, g in ((some, none), (none, some), (none, none)):
        assert neighbours.cosine_top_k(q, g, 2, query_bytes=0).collect() == []
