"""Tables that change where they are: coarse cells replaced, several tables in lockstep."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from geomill.operators import ingest, maintain, ranks
from geomill.sources import shared, versions


def files(path):
    return {os.path.join(d, f)[len(path) :]: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def photo(i, cell, platform="Flickr"):
    return (str(i), platform, cell, f"{platform.lower()}_{i}")


SCHEMA = "Photo_ID string, Platform string, H3_Cell long, photo_key string"


def coarse(c):
    return F.floor(c / 100).cast("long")


def rows_of(df):
    return sorted(map(tuple, df.select("Photo_ID", "Platform", "H3_Cell", "photo_key", *(["License"] if "License" in df.columns else [])).collect()), key=repr)


def test_upsert_touches_only_partitions_of_active_cells(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([photo(i, 100 * (i % 5) + i) for i in range(50)] + [photo(99, None)], SCHEMA)
    ingest.save_by_cells(old, path, coarse(F.col("H3_Cell")))
    before = files(path)
    new = spark.createDataFrame([photo(1000, 101, "MAPILLARY"), photo(1001, 107)], SCHEMA).withColumn("License", F.lit("CC0"))
    assert ingest.upsert_by_cells(spark, path, new, coarse) == ["c1"]
    after = files(path)
    changed = {f for f in {*before, *after} if before.get(f) != after.get(f)}
    assert changed and all(f.startswith("/part=c1/") for f in changed)
    assert rows_of(ingest.load_by_cells(spark, path)) == rows_of(ingest.replace_cells(old.withColumn("Platform", F.when(coarse(F.col("H3_Cell")) == 1, F.lower("Platform")).otherwise(F.col("Platform"))), new).withColumn("Platform", F.when(coarse(F.col("H3_Cell")) == 1, F.lower("Platform")).otherwise(F.initcap("Platform"))))


def test_upsert_of_emptied_and_missing_cells(spark, tmp_path):
    path = str(tmp_path / "t")
    ingest.save_by_cells(spark.createDataFrame([photo(1, 101), photo(2, 102), photo(3, 201), photo(4, None)], SCHEMA), path, coarse(F.col("H3_Cell")))
    cells = spark.createDataFrame([(101,), (102,), (901,), (None,)], "H3_Cell long")
    touched = ingest.upsert_by_cells(spark, path, spark.createDataFrame([photo(5, None)], SCHEMA), coarse, cells)
    assert touched == ["c1", "c9", "__HIVE_DEFAULT_PARTITION__"]
    assert {r[0] for r in rows_of(ingest.load_by_cells(spark, path))} == {"3", "4", "5"}
    assert not os.path.exists(f"{path}/part=c1")
    assert ingest.upsert_by_cells(spark, path, spark.createDataFrame([], SCHEMA), coarse) == []


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "a long")
    assert versions.latest(spark, root) == 0
    assert versions.commit(spark, root, {"x": df(1), "y": df(2)}) == 1
    pinned = versions.read(spark, root, "x", 1)
    assert versions.commit(spark, root, {"x": df(3).withColumn("b", F.lit("n"))}, append=True) == 2
    values = lambda t, v=None: sorted(map(tuple, versions.read(spark, root, t, v).collect()))
    assert values("x") == [(1, None), (3, "n")] and values("y") == [(2,)] and values("x", 1) == [(1,)]
    assert versions.commit(spark, root, {"x": df(9)}) == 3
    assert values("x") == [(9,)] and values("x", 2) == [(1, None), (3, "n")] and [r.a for r in pinned.collect()] == [1]
    with pytest.raises(LookupError):
        versions.read(spark, root, "z")
    with pytest.raises(TypeError):
        versions.commit(spark, root, {"x": spark.createDataFrame([("t",)], "a string")}, append=True)
    assert len(versions.tidy(spark, root, keep=1)) == 2 and values("x") == [(9,)] and values("y") == [(2,)]


def test_two_jobs_from_one_version(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    df = spark.range(3)
    assert versions.commit(spark, root, {"x": df}) == 1
    assert versions.commit(spark, root, {"x": df}, append=True, base=1) == 2
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, {"x": df}, append=True, base=1)
    assert versions.read(spark, root, "x").count() == 6 and versions.latest(spark, root) == 2


def test_killed_between_tables(spark, tmp_path):
    """Metadata are written, then the embeddings' job dies: readers see the version before, and the next call makes up for it."""
    root = f"file://{tmp_path}/s"
    todo = spark.range(40).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("photo_key"), "id")
    vectors = lambda rows: rows.withColumn("embedding", F.array(F.rand(), F.rand()))  # noqa: E731  not the same twice
    assert ingest.resume_in_lockstep(todo.where("id < 10"), root, vectors) == 1
    rest = vectors(todo.where("id >= 10"))
    broken = rest.select("photo_key", F.when(F.col("id") < 20, F.col("embedding")).otherwise(F.array(F.raise_error(F.lit("killed")).cast("double"))).alias("embedding"))
    with pytest.raises(Exception, match="killed"):
        versions.commit(spark, root, {"metadata": rest.drop("embedding"), "embeddings": broken, "keys": rest.select("photo_key")}, append=True)
    counts = lambda: [versions.read(spark, root, t).count() for t in ("metadata", "embeddings", "keys")]
    assert versions.latest(spark, root) == 1 and counts() == [10, 10, 10]
    assert ingest.resume_in_lockstep(todo, root, vectors) == 2 and counts() == [40, 40, 40]
    assert ingest.resume_in_lockstep(todo, root, vectors) == 2
    keys = [{r[0] for r in versions.read(spark, root, t).select("photo_key").collect()} for t in ("metadata", "embeddings", "keys")]
    assert keys[0] == keys[1] == keys[2] and len(keys[0]) == 40
    assert versions.tidy(spark, root) != []


@pytest.mark.parametrize("few", [0, 1000])
def test_numbered(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 70)
    monkeypatch.setattr(ranks, "BROADCAST_COUNTS", few)
    rows = [("hot" if i % 3 else f"g{i % 7}", i * 7919 % 1000) for i in range(1000)]
    got = {(r.g, r.v): (r.place, r.n) for r in ranks.numbered(shared.written(spark.createDataFrame(rows, "g string, v long"), "r"), "g", ["v"]).collect()}
    of = {}
    for g, v in sorted(rows):
        of.setdefault(g, []).append(v)
    assert got == {(g, v): (k, len(vs)) for g, vs in of.items() for k, v in enumerate(vs)}
    assert ranks.numbered(spark.createDataFrame([], "g string, v long"), "g", ["v"]).collect() == []


def test_no_shared_folder_on_a_cluster():
    session = lambda master: SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError):
        shared.folder(session("spark://host:7077"))
    assert shared.folder(session("local[4]")).startswith("file:///")


def test_restored_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = [(str(i), p, "local", f"{p}_{i}") for i, p in enumerate(["flickr", "mapillary", "wikimedia", "flickr"])]
    names = ["Photo_ID", "Platform", "Image_URL", "photo_key"]
    spark.createDataFrame(rows, names).write.parquet(path)
    online = spark.createDataFrame([("0", "flickr", "http://0", "flickr_0"), ("2", "wikimedia", "http://2", "wikimedia_2")], names)
    done = {r.platform: (r.updated, r.kept) for r in maintain.restored_table(spark.read.parquet(path), online, path).collect()}
    assert done == {"flickr": (1, 1), "mapillary": (0, 1), "wikimedia": (0, 1)}
    assert {r.Image_URL for r in spark.read.parquet(path).collect()} == {"http://0", "local"}
    before = files(path)
    monkeypatch.setattr(maintain, "restore_addresses", lambda offline, online: offline.where("Photo_ID <> '1'"))
    with pytest.raises(ValueError, match="4 rows went in and 3 came out"):
        maintain.restored_table(spark.read.parquet(path), online, path)
    assert files(path) == before and sorted(os.listdir(tmp_path)) == ["t"]


def test_companion_out_of_step(spark):
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "embedding_idx long, embedding array<double>")
    index = spark.createDataFrame([(i, f"k{i}") for i in range(6)], "embedding_idx long, photo_key string")
    active = index.where("embedding_idx < 2")
    v, i, removed = maintain.prune_companion(vectors, index, active)
    assert (v.count(), i.count(), removed) == (2, 2, 4)
    v, i, removed = maintain.prune_companion(vectors, index.where("embedding_idx > 0"), active)
    assert (v.count(), i.count(), removed) == (6, 5, 0)
