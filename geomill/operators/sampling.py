"""Stratified samples. Random choice is by hash of key and seed, so it is the same in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geomill.operators import ranks
from geomill.sources import shared


def chance(key: str, seed: int = 42) -> Column:
    """A fixed pseudo-random number of a row."""
    return F.xxhash64(F.col(key).cast("string"), F.lit(seed))


def per_group(df: DataFrame, group: list[str], n: int | Column, order: list[Column]) -> DataFrame:
    """The first n rows of each group in an order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def cell_cap(df: DataFrame, cell: str, most: int, key: str, seed: int = 42) -> DataFrame:
    """At most so many random rows of each cell."""
    return per_group(df.where(F.col(cell).isNotNull()), [cell], most, [chance(key, seed), F.col(key)])


def cap_for_size(df: DataFrame, cell: str, size: int) -> int:
    """The cap per cell whose sample comes nearest to a size, from the histogram of cell counts (of which there are few different ones)."""
    counts = df.where(F.col(cell).isNotNull()).groupBy(cell).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("cells"))
    rows = [(r["n"], r["cells"]) for r in counts.collect()]
    low, high, best = 1, max((n for n, _ in rows), default=1), (float("inf"), 1)
    while low <= high:
        cap = (low + high) // 2
        got = sum(min(cap, n) * c for n, c in rows)
        best = min(best, (abs(got - size), cap), key=lambda b: b[0])
        if got == size:
            break
        low, high = (cap + 1, high) if got < size else (low, cap - 1)
    return best[1]


def sample_size(df: DataFrame, cell: str, size: int, key: str, seed: int = 42) -> DataFrame:
    """About so many rows evenly over the cells, never more."""
    return cell_cap(df, cell, cap_for_size(df, cell, size), key, seed).orderBy(chance(key, seed + 1), key).limit(size)


def round_robin(df: DataFrame, group: str, cell: str, most: int, key: str, seed: int = 42) -> DataFrame:
    """At most so many rows of each group, one from each of its cells in turn."""
    turn = Window.partitionBy(group, cell).orderBy(chance(key, seed), key)
    row = Window.partitionBy(group).orderBy("__turn", cell)
    # the first so many of a cell are all that can be taken
    first = df.withColumn("__turn", F.row_number().over(turn)).where(F.col("__turn") <= most)
    return first.withColumn("__r", F.row_number().over(row)).where(F.col("__r") <= most).drop("__turn", "__r")


def interleave(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Rows with ``turn`` in their group: by (turn, group) the groups take turns."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def cluster_stratified(df: DataFrame, cell: str, cluster: str, n: int, key: str) -> DataFrame:
    """n rows of each cell with pick: one of each cluster, larger clusters first, then others by key."""
    inner = Window.partitionBy(cell, cluster)
    ranked = df.where(F.col(cell).isNotNull()).withColumns({"__first": F.row_number().over(inner.orderBy(key)), "__size": F.count(F.lit(1)).over(inner)})
    outer = Window.partitionBy(cell).orderBy(F.when(F.col("__first") == 1, 0).otherwise(1), F.when(F.col("__first") == 1, -F.col("__size")), F.when(F.col("__first") == 1, F.col(cluster)), key)
    # only the first n of a cluster can be taken
    return ranked.where(F.col("__first") <= n).withColumn("pick", F.row_number().over(outer)).where(F.col("pick") <= n).drop("__first", "__size")


def prioritised(df: DataFrame, cell: str, platform: str, first: str, n: int, key: str) -> DataFrame:
    """n rows of each cell, one platform's before the others."""
    return per_group(df, [cell], n, [F.when(F.lower(platform) == first, 0).otherwise(1), F.col(key)])


def balanced(df: DataFrame, group: str, total: int, classes: list[str], key: str, seed: int = 42) -> DataFrame:
    """The same number of random rows of each listed class."""
    return per_group(df.where(F.lower(group).isin(classes)), [group], total // max(1, len(classes)), [chance(key, seed), F.col(key)])


def balanced_outcomes(df: DataFrame, label: str, success: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """Of each class half successes and half failures; what one lacks the other fills."""
    inner = Window.partitionBy(label, success).orderBy(chance(key, seed), key)
    w = Window.partitionBy(label).orderBy(F.when(F.col("__r") <= n // 2, 0).otherwise(1), "__r", success)
    return df.withColumn("__r", F.row_number().over(inner)).where(F.col("__r") <= n).withColumn("__s", F.row_number().over(w)).where(F.col("__s") <= n).drop("__r", "__s")


def camera_samples(images: DataFrame, per_bin: int = 2, per_camera: int = 4) -> DataFrame:
    """deployment_id, image_id, pick of at most per_camera images of each camera.

    images: deployment_id, image_id, sequence_id, date, season, time_of_day, is_animal. In
    order of image_id each (season, time of day) bin takes up to per_bin images of
    different dates; a sequence already taken by the camera doesn't add to a bin that has
    one; a full bin lets an animal replace a blank of another date. Then one image of each
    bin is picked, animals first, then a second.

    The rule is sequential within a camera: a fold over its sorted images, which keeps at
    most per_bin images a bin, in the order in which they came in. Nulls are equal to each
    other; a null is_animal is a blank.
    """
    bin_ = F.struct("season", "time_of_day")
    image = F.struct(F.col("image_id"), bin_.alias("bin"), F.col("sequence_id"), F.col("date"), F.coalesce("is_animal", F.lit(False)).alias("animal"))
    rows = images.groupBy("deployment_id").agg(F.array_sort(F.collect_list(image)).alias("images"))
    none = F.slice("images", 1, 0)

    def take(taken: Column, new: Column) -> Column:
        own = F.filter(taken, lambda x: x["bin"] == new["bin"])
        known = (F.size(own) > 0) & F.exists(taken, lambda x: x["sequence_id"].eqNullSafe(new["sequence_id"]))
        fresh = ~F.exists(own, lambda x: x["date"].eqNullSafe(new["date"]))
        places = F.transform(taken, lambda x, i: F.when((x["bin"] == new["bin"]) & ~x["animal"] & ~x["date"].eqNullSafe(new["date"]), i))
        place = F.array_min(places)
        replaced = F.transform(taken, lambda x, i: F.when(i == place, new).otherwise(x))
        full = F.when(new["animal"] & place.isNotNull(), replaced).otherwise(taken)
        return F.when(known, taken).when(F.size(own) < per_bin, F.when(fresh, F.concat(taken, F.array(new))).otherwise(taken)).otherwise(full)

    taken = rows.select("deployment_id", F.posexplode(F.aggregate("images", none, take)).alias("at", "x"))
    own = Window.partitionBy("deployment_id", "x.bin")
    ranked = taken.select("*", F.min("at").over(own).alias("bin_at"), F.row_number().over(own.orderBy(~F.col("x.animal"), "at")).alias("turn")).where("turn <= 2")
    pick = F.row_number().over(Window.partitionBy("deployment_id").orderBy("turn", "bin_at"))
    return ranked.select("deployment_id", F.col("x.image_id").alias("image_id"), pick.alias("pick")).where(F.col("pick") <= per_camera)


def sparse_landmarks(photos: DataFrame, counts: DataFrame, cell: str, landmark: str, key: str, threshold: int, per_cell: int = 10, per_landmark: int = 3) -> DataFrame:
    """Photos of cells with fewer than threshold so far: in order of key each is taken unless its cell or its landmark has enough of those taken before.

    The order-dependent rule in rounds: a photo is sure to be taken if it would be even if all
    open ones before it were, and sure not to be if enough taken ones stand before it. Each
    round settles the first open photo of every cell and landmark at least, mostly nearly all.
    """
    few = counts.where(F.col("n") >= threshold).select(cell)
    rows = photos.join(few, cell, "left_anti")
    state = _cut(rows.select(F.col(key).alias("__k"), F.col(cell).alias("__c"), F.col(landmark).alias("__l"), F.lit(None).cast("boolean").alias("__taken")))
    while not state.where("__taken is null").isEmpty():
        taken, open_ = F.coalesce(F.col("__taken"), F.lit(False)).cast("int"), F.col("__taken").isNull().cast("int")
        enough, might = F.lit(False), F.lit(False)
        for group, most in (("__c", per_cell), ("__l", per_landmark)):
            before = Window.partitionBy(group).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
            own = F.coalesce(F.sum(taken).over(before), F.lit(0))
            enough = enough | (own >= most)
            might = might | (own + F.coalesce(F.sum(open_).over(before), F.lit(0)) >= most)
        settled = F.when(F.col("__taken").isNotNull(), F.col("__taken")).when(enough, False).when(~might, True)
        state = _cut(state.withColumn("__next", settled).select("__k", "__c", "__l", F.col("__next").alias("__taken")))
    return rows.join(state.where("__taken").select(F.col("__k").alias(key)), key, "left_semi").select(photos.columns)


def _cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder."""
    return shared.written(df, "round")


def query_blocks(items: DataFrame, block: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """block, is_query: spatial blocks split so that rare classes have query and database blocks.

    Classes are visited by their number of blocks, rare first (ties by name); each takes
    query blocks, in hash order, up to a share of its own (one at least if it has two), then a
    database block; the others fall by chance. Blocks without a class take no part.

    A block is the concern of the first class visited that has it. So classes need not wait
    for each other but where they share blocks: in each round all classes are settled
    whose other blocks are (or whose needs are met by then), each by the places of its own
    blocks, which never change. Rounds are as many as the longest chain of classes that wait.
    """
    named = items.where(F.col(block).isNotNull() & F.col(label).isNotNull())
    pairs = named.select(F.col(label).cast("string").alias("label"), F.col(block).alias("block")).distinct()
    many = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("many"))
    pairs = shared.written(pairs.join(many, "label").withColumn("h", F.xxhash64(F.col("block").cast("string"), F.lit(seed))), "pairs")
    first = F.min(F.struct("many", "label"))
    owned = shared.written(pairs.groupBy("block", "h").agg(first.alias("o")).select("block", "h", F.col("o.label").alias("owner"), F.col("o.many").alias("many")), "owned")
    falls = F.pmod("h", F.lit(1_000).cast("long")) / 1_000 < share
    blocks = ranks.numbered(owned, "owner", ["h", "block"]).select("block", "owner", "place", falls.alias("falls"), F.lit(None).cast("boolean").alias("is_query"))
    blocks = _cut(blocks)
    others = F.col("owner") != F.col("label")
    count = lambda what: F.sum((others & F.coalesce(what, F.lit(False))).cast("int"))
    while not blocks.where("is_query is null").isEmpty():
        known = pairs.join(blocks.select("block", "owner", "is_query"), "block").groupBy("label", "many").agg(count(F.col("is_query")).alias("q"), count(~F.col("is_query")).alias("b"), count(F.col("is_query").isNull()).alias("open"))
        two = F.col("many") > 1
        wanted = F.when(two, F.greatest(F.lit(1), F.floor(F.col("many") * share))).otherwise(0)
        need_q, need_b = F.greatest(F.lit(0), wanted - F.col("q")), F.greatest(F.lit(0), two.cast("int") - F.col("b"))
        ready = known.select(F.col("label").alias("owner"), "open", need_q.alias("need_q"), need_b.alias("need_b")).where("open = 0 or (need_q = 0 and need_b = 0)")
        side = F.when(F.col("place") < F.col("need_q"), True).when(F.col("place") < F.col("need_q") + F.col("need_b"), False).when(F.col("need_q").isNotNull(), F.col("falls"))
        blocks = _cut(blocks.join(ready.drop("open"), "owner", "left").select("block", "owner", "place", "falls", F.coalesce("is_query", side).alias("is_query")))
    return blocks.select("block", "is_query")
