"""Camera-trap tables: deployments, projects, media, observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.operators.filters import camera_deployments


def deployments(raw: DataFrame, projects: DataFrame | None = None, exclude_fuzzed: bool = True, only_functioning: bool = True) -> DataFrame:
    """Usable deployments with their project's columns."""
    kept = camera_deployments(raw, exclude_fuzzed, only_functioning)
    if projects is None or "project_id" not in kept.columns:
        return kept
    one = projects.groupBy("project_id").agg(*[F.min(c).alias(c) for c in projects.columns if c != "project_id" and c not in kept.columns])
    return kept.join(one, "project_id", "left")


def usable_images(images: DataFrame, only_animals: bool = False) -> DataFrame:
    """Images with a place in the archive and no person or calibration in them."""
    name = F.lower(F.coalesce("common_name", F.lit("")))
    ok = F.col("location").isNotNull() & ~name.contains("human") & ~name.contains("calibration")
    return images.where(ok & (name != "blank") & (name != "") if only_animals else ok)


def observed_media(media: DataFrame, observations: DataFrame, places: DataFrame, only_animals: bool = False) -> DataFrame:
    """Media with their observation and deployment; those without observation stay unless only animals are asked for."""
    one = observations.groupBy("media_id").agg(F.min_by(F.struct(*[c for c in observations.columns if c != "media_id"]), "observation_id").alias("o")).select("media_id", "o.*")
    return media.join(one, "media_id", "inner" if only_animals else "left").join(places, "deployment_id")
