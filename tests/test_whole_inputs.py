"""Queries that have to see every row and the whole of each text."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from geomill.functions import grid
from geomill.functions.text import LAYOUT_PHRASES
from geomill.operators import anomaly
from geomill.plans import q_vectors


def cleaned(text):
    for pattern, by in LAYOUT_PHRASES:
        text = re.sub("(?i)" + pattern, by, text)
    text = re.sub(r"^[.,;:\s]+", "", re.sub(r"\s+([.,;:!?])", r"\1", re.sub(r"\s{2,}", " ", text).strip()))
    return text[:1].upper() + text[1:]


def test_descriptions_are_cleaned_to_their_end(spark, tmp_path):
    filler = "word of prose " * 30
    bodies = [filler + "seen in each frame of the vertical stack .", filler + "\n\nbetween the frames , " + filler + "the stacked photographs", "short", ""]
    spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    leads = ["The input image is a vertical stack of four real-world photographs. ", "the composite image shows, in each frame , ", "Seen across all frames, "]
    got = {r.doc_id: r.cleaned for r in entry.queries()["row_descriptions"](spark, str(tmp_path)).collect()}
    assert got == {i: cleaned(leads[i % 3] + b) for i, b in enumerate(bodies)}
    assert got[0].endswith("in each view of the scene.") and len(got[1]) > 800


def test_recall_medoids_costs_and_keys_see_rows_behind_500(spark, tmp_path):
    n = 1_000
    spark.range(n).selectExpr("id vec_id", "cast(id div 500 as int) label", "array(cast(1 as float), cast(id % 7 as float)) embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(3 * n).selectExpr("id event_id", "id % 9 user_id", "timestamp'2024-05-01 00:00:00' ts").write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: entry.queries()[name](spark, str(tmp_path))
    # every 50th vector asks; those with numbers of a multiple of 17 have no place
    assert run("geographic_recall").first().queries == sum(i % 17 != 0 for i in range(0, n, 50))
    assert run("migrated_keys").where("photo_key like 'unknown%'").count() == n // 4
    assert run("text_image_matrix").count() == n * n // 100
    assert {r.cluster_id for r in run("medoid_summary").collect()} == {0, 1}
    assert q_vectors._with_vectors(spark, str(tmp_path)).selectExpr("count(*)", "count(distinct vec_id)").first() == (3 * n, n)


def test_climate_banks_have_all_rows_of_a_group(spark):
    """Forty rows of a group that come behind 15,500 trusted ones are the nearest."""
    vector = "case when id < 13500 then array(1.0, 0.0, 0.0) when id < 15500 then array(-1.0, 0.0, 0.0) when id < 15540 then array(0.5, 1.0, 0.0) else array(0.0, 1.0, 0.3) end"
    bank = spark.range(15_580).selectExpr(
        "concat('p', id) photo_key",
        "if(id between 15500 and 15539, 'flickr', 'inaturalist') Platform",
        "cast(id % 100 - 50 as double) Latitude",
        "cast(id * 37 % 340 - 170 as double) Longitude",
        "if(id < 15540, 'Dfb', 'ET') Koppen_Code",
        f"cast({vector} as array<float>) embedding",
    )
    asked = spark.createDataFrame([("lost", "flickr", -80.0, 20.0, "EF", [0.5, 1.0, 0.0])], bank.schema)
    p = bank.union(asked).withColumn("cell", grid.encode(F.col("Latitude"), F.col("Longitude")))
    assert [r.photo_key for r in anomaly.climate_outliers(p, ("flickr",)).collect()] == ["lost"]
