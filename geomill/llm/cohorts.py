"""Cohort retention matrix in two states of knowledge, in DataFrame functions only.

Some clicks arrive late, so what is known at a date (state 0) differs from what is
known in the end (state 1). One conditional-min aggregation over the clicks gives each
client its start in either state; a shuffled join takes the starts back to the clicks,
which are counted by (state, client, period) first and then rolled up to cells.

Equal rows (in all columns) count once. They meet by a digest of the columns that
nothing here uses beside those that are used, so long payloads don't shuffle. The
distinct clicks and the starts are written once. Both sides of the join are then plain
tables under one exchange each, so a client with a third of all rows is split by AQE's
skew join; partial sums are made before the next exchange, which is by the client's
name as text: the join's own partitioning wouldn't do for it, so the split costs none.
Clients and cells are merged, never broadcast.

Times are compared as they are written (TIMESTAMP in the session's zone, TIMESTAMP_NTZ
as it stands), in whole microseconds.

Defined cases: clicks without ts or client_id are dropped; one without arrived_at is
unknown in state 0; one without click_id isn't late; a null value, or one that isn't
finite or has more than 17 digits of cents, counts 0; a client that ``clients`` lacks, or
without a city, is of segment ''; of a client's several rows the greatest city counts;
extra columns only make rows differ. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.llm.scratch import materialize

DAY = 86_400_000_000
USED = ("click_id", "ts", "arrived_at", "client_id", "kind", "value")


def micros(time: Column) -> Column:
    """Microseconds since 1970 on the clock that the time shows."""
    since = time.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda name: F.extract(F.lit(name), since)
    return part("DAY").cast("long") * DAY + part("HOUR").cast("long") * (DAY // 24) + part("MINUTE").cast("long") * (DAY // 1440) + (part("SECOND") * 1_000_000).cast("long")


def decimal_crc32(number: Column) -> Column:
    return F.crc32(number.cast("string").cast("binary"))


def distinct_clicks(clicks: DataFrame) -> DataFrame:
    """Clicks of a client at a time, equal rows once: client_id, at and due (microseconds), purchase, cents."""
    rest = [F.col(f"`{c}`") for c in clicks.columns if c not in USED]
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    other = F.unhex(F.sha2(F.to_json(F.struct(*rest), exact), 256)) if rest else F.lit(None).cast("binary")
    rows = clicks.where("ts is not null and client_id is not null").select(*USED, other.alias("other")).distinct()
    h = decimal_crc32(F.col("click_id"))
    late = F.when(h % 3 == 0, h % 100).otherwise(0)
    cents = F.floor(F.when(F.abs("value") < 1e15, 100 * F.col("value") + 0.5))
    return rows.select("client_id", micros(F.col("ts")).alias("at"), (micros(F.col("arrived_at")) + late * DAY).alias("due"), F.coalesce(F.col("kind") == "purchase", F.lit(False)).alias("purchase"), F.coalesce(cents, F.lit(0)).cast("long").alias("cents"))


def client_starts(clicks: DataFrame, clients: DataFrame, known: int) -> DataFrame:
    """Each client with a purchase: its start in either state (start0 may be null) and its segment."""
    first = lambda when: F.min(F.when(when, F.col("at")))
    starts = clicks.groupBy("client_id").agg(first(F.col("purchase") & (F.col("due") < known)).alias("start0"), first(F.col("purchase")).alias("start1")).where("start1 is not null")
    cities = clients.groupBy("client_id").agg(F.max("city").alias("city"))
    return starts.join(cities.hint("merge"), "client_id", "left").select("client_id", "start0", "start1", F.coalesce("city", F.lit("")).alias("segment"))


def retention(clicks: DataFrame, clients: DataFrame, known_until: str = "2024-03-01 00:00:00", cohort_days: int = 3, period_days: int = 3) -> DataFrame:
    """state, segment, cohort, period, users, users_crc32, moved, cents: a row for each nonempty cell."""
    spark = clicks.sparkSession
    known = spark.range(1).select(micros(F.lit(known_until))).first()[0]
    rows = materialize(distinct_clicks(clicks), "clicks")
    starts = materialize(client_starts(rows, clients, known), "starts")
    cohort, period = cohort_days * DAY, period_days * DAY
    whole = lambda us, unit: ((us - F.pmod(us, F.lit(unit))) / unit).cast("long")
    start = F.when(F.col("state") == 0, F.col("start0")).otherwise(F.col("start1"))
    joined = rows.join(starts.hint("merge"), "client_id").where(F.col("at") >= F.least("start0", "start1"))
    states = joined.withColumn("state", F.explode(F.when(F.col("due") < known, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    of_state = states.withColumn("start", start).where(F.col("at") >= F.col("start")).select(
        "state",
        F.col("client_id").cast("string").alias("who"),
        F.expr(f"(at - start) div {period}").alias("period"),
        "segment",
        whole(F.col("start"), cohort).alias("cohort"),
        F.coalesce(whole(F.col("start0"), cohort) != whole(F.col("start1"), cohort), F.lit(False)).alias("moved"),
        "cents",
    )
    own = [F.first(c).alias(c) for c in ("segment", "cohort", "moved")]
    users = of_state.groupBy("state", "who", "period").agg(*own, F.sum("cents").alias("cents"))
    return users.groupBy("state", "segment", "cohort", "period").agg(
        F.count(F.lit(1)).alias("users"),
        F.sum(F.crc32(F.col("who").cast("binary"))).alias("users_crc32"),
        F.sum(F.col("moved").cast("long")).alias("moved"),
        F.sum("cents").alias("cents"),
    )
