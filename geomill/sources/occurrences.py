"""Biodiversity archives: occurrence and multimedia tables, also inside ZIP files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.functions.text import media_address

BATCH = 20_000


def zipped_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """value: the lines of a member of ZIP files. An archive is read in its task and streamed; large ones are better unpacked first."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        if name.endswith(member):
                            with z.open(name) as f:
                                held = []
                                for line in io.TextIOWrapper(f, "utf-8", "replace"):
                                    held.append(line.rstrip("\r\n"))
                                    if len(held) >= BATCH:
                                        yield pa.RecordBatch.from_arrays([pa.array(held)], names=["value"])
                                        held = []
                                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "value string")


def tab_table(lines: DataFrame, header: list[str], line: str = "value") -> DataFrame:
    """Columns of tab-separated lines; the header line and lines of another number of fields fall out."""
    parts = F.split(line, "\t")
    rows = lines.where((F.size(parts) == len(header)) & (F.get(parts, F.lit(0)) != header[0]))
    return rows.select(*[F.nullif(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(header)])


def from_occurrences(occurrences: DataFrame) -> DataFrame:
    """Photo rows of occurrences with coordinates and a usable picture address."""
    url = media_address(F.col("associatedMedia"))
    lat, lon = (F.col(c).try_cast("double") for c in ("decimalLatitude", "decimalLongitude"))
    rows = occurrences.select(F.col("gbifID").alias("Photo_ID"), F.lit("inaturalist").alias("Platform"), lat.alias("Latitude"), lon.alias("Longitude"), url.alias("Image_URL"), F.col("eventDate").alias("Captured_At"))
    return rows.where("Latitude is not null and Longitude is not null and Image_URL is not null")


def from_archive(occurrences: DataFrame, multimedia: DataFrame, position: str | None = None) -> DataFrame:
    """Photo rows of occurrences joined with the first still image of each that has a usable address: by the column ``position``, or else as the scan numbers the rows."""
    url = media_address(F.col("identifier"))
    numbered = multimedia.withColumn("__at", F.monotonically_increasing_id() if position is None else F.col(position))
    stills = numbered.where(F.col("type") == "StillImage").select("gbifID", url.alias("associatedMedia"), "__at").where("associatedMedia is not null")
    first = stills.groupBy("gbifID").agg(F.min_by("associatedMedia", F.struct("__at", "associatedMedia")).alias("associatedMedia"))
    return from_occurrences(occurrences.drop("associatedMedia").join(first, "gbifID"))
