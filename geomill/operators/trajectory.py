"""Kinematics of photo sequences, and verdicts on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geomill.functions import geo

MIN_FRAMES, STATIONARY_FRAMES, STATIONARY_RADIUS, MAX_TORTUOSITY, MAX_SPEED = 15, 15, 35.0, 20.0, 160.0


def steps(points: DataFrame, sequence: str = "sequence_id") -> DataFrame:
    """Each point with the distance from the one before and, where at least half a second passed, the speed. captured_at: epoch ms."""
    w = Window.partitionBy(sequence).orderBy("captured_at", "photo_id")
    lag = lambda c: F.lag(c).over(w)
    dt = F.col("captured_at") - lag("captured_at")
    moved = points.withColumns({"step_m": geo.haversine_m(lag("lat"), lag("lon"), F.col("lat"), F.col("lon")), "dt_ms": dt})
    return moved.withColumn("kmh", F.when(F.col("dt_ms") >= 500, F.col("step_m") / (F.col("dt_ms") / 1000.0) * 3.6))


def metrics(points: DataFrame, sequence: str = "sequence_id") -> DataFrame:
    """Per sequence of two points or more: distances, tortuosity, speeds, radius, duration."""
    at = F.struct("captured_at", "photo_id")
    place = F.struct("lat", "lon")
    w = Window.partitionBy(sequence)
    rows = steps(points, sequence).withColumns({"mlat": F.avg("lat").over(w), "mlon": F.avg("lon").over(w)})
    agg = rows.groupBy(sequence).agg(
        F.count(F.lit(1)).alias("frame_count"),
        F.sum("step_m").alias("total"),
        F.min_by(place, at).alias("a"),
        F.max_by(place, at).alias("b"),
        F.max(geo.haversine_m(F.col("mlat"), F.col("mlon"), F.col("lat"), F.col("lon"))).alias("radius"),
        F.max("kmh").alias("top"),
        F.count("kmh").alias("speeds"),
        F.sort_array(F.collect_list("kmh")).alias("sorted"),
        ((F.max("captured_at") - F.min("captured_at")) / 1000.0).alias("duration"),
    )
    net = geo.haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    p95 = F.get("sorted", F.least(F.floor(F.col("speeds") * 0.95), F.col("speeds") - 1).cast("int"))
    return agg.where("frame_count >= 2").select(
        sequence,
        "frame_count",
        F.round("total", 2).alias("total_distance_m"),
        F.round(net, 2).alias("net_displacement_m"),
        F.round(F.col("total") / F.greatest(net, F.lit(1.0)), 2).alias("tortuosity"),
        F.round(F.coalesce("top", F.lit(0.0)), 1).alias("max_speed_kmh"),
        F.round(F.coalesce(p95, F.lit(0.0)), 1).alias("p95_speed_kmh"),
        F.round("radius", 2).alias("bounding_radius_m"),
        F.round("duration", 1).alias("duration_seconds"),
    )


def verdicts(measured: DataFrame) -> DataFrame:
    """measured with is_valid and reason: the first rule that applies."""
    tail = lambda c: F.format_string("%.1f", F.col(c))
    jitter = (F.col("frame_count") >= STATIONARY_FRAMES) & (F.col("bounding_radius_m") <= STATIONARY_RADIUS) & (F.col("total_distance_m") >= 100) & (F.col("tortuosity") >= 15)
    walk = (F.col("total_distance_m") >= 250) & (F.col("net_displacement_m") <= 25) & (F.col("tortuosity") >= MAX_TORTUOSITY)
    leap = F.col("max_speed_kmh") >= MAX_SPEED
    reason = (
        F.when(jitter, F.concat(F.lit("Stationary camera GPS jitter: "), F.col("frame_count").cast("string"), F.lit(" frames within "), tail("bounding_radius_m"), F.lit(" m")))
        .when(walk, F.concat(F.lit("Severe random-walk tortuosity: "), tail("tortuosity")))
        .when(leap, F.concat(F.lit("Impossible speed teleportation: "), tail("max_speed_kmh"), F.lit(" km/h")))
        .otherwise("Valid moving trajectory")
    )
    return measured.withColumns({"is_valid": ~(jitter | walk | leap), "reason": reason})


def validate(points: DataFrame, sequence: str = "sequence_id", min_frames: int = MIN_FRAMES) -> DataFrame:
    """A verdict for each sequence; those with too few frames are invalid whatever their metrics."""
    sizes = points.groupBy(sequence).agg(F.count(F.lit(1)).alias("frames"))
    judged = sizes.join(verdicts(metrics(points, sequence)).drop("frame_count"), sequence, "left")
    few = F.col("frames") < max(min_frames, 2)
    return judged.withColumns({"is_valid": ~few & F.coalesce("is_valid", F.lit(False)), "reason": F.when(few, "Insufficient sequence frames").otherwise(F.col("reason"))})


def track(points: DataFrame, sequence: str = "sequence_id") -> DataFrame:
    """A GeoJSON line of each sequence."""
    ordered = F.sort_array(F.collect_list(F.struct("captured_at", "photo_id", "lon", "lat")))
    line = F.struct(F.lit("LineString").alias("type"), F.transform(ordered, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    return points.groupBy(sequence).agg(F.to_json(line).alias("geojson"))


def even_subsample(points: DataFrame, most: int, sequence: str = "sequence_id") -> DataFrame:
    """At most so many points of each sequence, evenly spaced in order; the last is always one of them."""
    w = Window.partitionBy(sequence)
    n = F.count(F.lit(1)).over(w)
    i = F.row_number().over(w.orderBy("captured_at", "photo_id")) - 1
    step = F.col("__n") / F.lit(float(most))
    # i is int(j * step) for some j below most
    j = F.ceil(F.col("__i") / step)
    taken = (j < most) & (F.floor(j * step) == F.col("__i"))
    last_slot = F.floor((most - 1) * step)
    keep = (F.col("__n") <= most) | (taken & (F.col("__i") != last_slot)) | (F.col("__i") == F.col("__n") - 1)
    return points.withColumns({"__n": n, "__i": i}).where(keep).drop("__n", "__i")


def audit_purge(photos: DataFrame, membership: DataFrame, judged: DataFrame) -> DataFrame:
    """photos without those of invalid sequences. membership: photo_key, sequence_id."""
    bad = membership.join(judged.where("not is_valid").select("sequence_id"), "sequence_id", "left_semi").select("photo_key").distinct()
    return photos.join(bad, "photo_key", "left_anti")
