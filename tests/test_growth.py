"""What must not grow with the rows: tasks of a fit, vectors moved with photos, groups of one task."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from geomill.functions import grid
from geomill.operators import cluster, index


def tables(spark, path, vectors=60, photos=3_000):
    """Vectors in two well separated heaps, by their number; photos share them in turns."""
    spark.range(vectors).selectExpr("id vec_id", "cast(id % 2 as int) label", "array(cast(10 * (id % 2) + id / 100 as float), cast(1 - id % 2 as float)) embedding").write.parquet(f"{path}/embeddings.parquet")
    spark.range(photos).selectExpr("id event_id", "id % 9 user_id", "timestamp'2024-05-01 00:00:00' ts").write.parquet(f"{path}/events.parquet")
    return spark.read.parquet(f"{path}/embeddings.parquet")


def shared_rows(spark, photos=600):
    """Rows of place, block and a vector's number, and the vectors."""
    rows = spark.range(photos).selectExpr("id photo_key", "id % 20 vec_id", "id % 37 block", "cast(id % 50 as double) Latitude", "cast(id % 70 as double) Longitude", "concat('u', id) Image_URL")
    bank = spark.range(20).selectExpr("id vec_id", "id % 2 cluster_id", "array(id % 2 * 10 + id / 10, 1.0 - id % 2) embedding")
    return rows, bank


def tasks_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, [i.numTasks for i in map(tracker.getStageInfo, stages) if i and i.numCompletedTasks]


def test_fits_take_no_task_for_each_partition(spark):
    rows, bank = shared_rows(spark)
    wide = rows.join(bank, "vec_id").repartition(64)
    _, tasks = tasks_of(spark, "block_costs", lambda: cluster.block_validation(wide, F.col("block"), [2]).collect())
    assert sum(n > spark.sparkContext.defaultParallelism for n in tasks) <= 3, "only what makes the rows may have 64 tasks"


def test_costs_of_shared_vectors(spark):
    """Vectors with weights cost what their rows cost each by itself."""
    rows, bank = shared_rows(spark)
    each = cluster.block_validation(rows.join(bank, "vec_id"), F.col("block"), [2]).first()
    held = rows.join(bank, "vec_id").where(F.pmod(F.xxhash64("block", F.lit(42)), F.lit(1000)) < 100)
    assert 0 < held.count() < 600
    once = cluster.block_validation(rows, F.col("block"), [2], bank=bank).first()
    assert [round(x, 6) for x in once] == [round(x, 6) for x in each]


def test_medoids_of_shared_vectors(spark, monkeypatch):
    rows, bank = shared_rows(spark)
    whole = rows.join(bank, "vec_id")
    weighted = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).join(bank, "vec_id")
    plain, once = cluster.centroids(whole), cluster.centroids(weighted, weight="n")
    near = lambda c: {r.cluster_id: ([round(x, 9) for x in r.centroid], r.n) for r in c.collect()}
    assert near(once) == near(plain)
    for shortlist in (64, 2):
        monkeypatch.setattr(cluster, "SHORTLIST", shortlist)
        picks = lambda m: sorted(map(tuple, m.collect()))
        assert picks(cluster.diverse_medoids(rows, once, 4, bank=bank)) == picks(cluster.diverse_medoids(whole, plain, 4))


def test_queries_score_each_vector_once(spark, tmp_path, monkeypatch):
    vectors = tables(spark, tmp_path)
    seen = []
    plain = cluster.centroids
    monkeypatch.setattr(cluster, "centroids", lambda rows, *a, **b: seen.append(rows.count()) or plain(rows, *a, **b))
    for name in ("medoid_summary", "medoid_firsts"):
        assert entry.queries()[name](spark, str(tmp_path)).count() == 2
    assert seen == [vectors.count()] * 2


def test_a_task_groups_one_resolution(spark):
    p = spark.range(500).selectExpr("id % 7 cluster_id", "'Spring' Season", "cast(id % 80 as double) lat", "cast(id % 90 as double) lon").withColumn("cell", grid.encode(F.col("lat"), F.col("lon")))
    built = index.build(p)
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan, "all resolutions would meet in one task's groups"
    one = built.where("resolution = 3")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in one and one.count("Aggregate") == 2
    want = p.groupBy(grid.parent(F.col("cell"), 3).alias("c"), "cluster_id").count()
    assert sorted(map(tuple, built.where("resolution = 3").select("query_cell", "cluster_id", "image_count").collect())) == sorted(map(tuple, want.collect()))
