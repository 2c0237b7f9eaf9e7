"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 counts, over all rows, the bits that each text's hash sets in a blocked
Bloom filter and keeps those set at least twice. Pass 2 probes that filter: a row
with some bit set only once has no copy and passes straight through; only the
others (possibly repeated) shuffle to be grouped by their SHA-256.

The filter travels as ``(word, bits)`` rows, at most ``FILTER_WORDS`` of them whatever
the input, and is always broadcast: where rows outnumber its bits more digests pass
it, and nothing else changes. All this moves digest rows (an id and 32 bytes), never texts.

``drop_exact_duplicates`` decides on digests which ids go, and takes these from the
documents by an anti-join in one scan. Up to ``BROADCAST_IDS`` ids are broadcast; beyond,
a filter of ids of the same bounded size lets the rows that stay pass straight through,
and only those that it holds meet the ids in a shuffled join.

Defined cases: a null text counts as empty; a null id sorts after every other; rows
repeated with one id are copies of each other, of which one stays (the smallest by its
other columns' hash); an empty table gives an empty result; other columns are ignored by
``exact_duplicates`` and carried by ``drop_exact_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.llm import scratch

#: 16 filter bits for each row; a filter word has 64.
BITS_PER_ROW = 16
#: Filter words at most: about 50 MB of broadcast hash table.
FILTER_WORDS = 2_000_000
#: Ids that are broadcast at most: about 60 MB of hash table.
BROADCAST_IDS = 2_000_000
#: Groups of copies: about 30 MB of broadcast hash table.
BROADCAST_GROUPS = 200_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _mask(hash_: Column) -> Column:
    """Two bits of a 64-bit word, from hash bits that don't choose the word."""
    one = F.lit(1).cast("long")
    bit = lambda by: F.call_function("shiftleft", one, F.shiftrightunsigned(hash_, by).bitwiseAND(63).cast("int"))
    return bit(58).bitwiseOR(bit(52))


def _word(hash_: Column, words: int) -> Column:
    return F.pmod(hash_.bitwiseAND((1 << 52) - 1), F.lit(words).cast("long"))


def _words(rows: int) -> int:
    return max(1, min(rows * BITS_PER_ROW // 64, FILTER_WORDS))


def repeated_bits(digests: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The filter's bits that two rows or more set, as (word, bits), and the number of words."""
    words = _words(rows)
    h = F.xxhash64("sha")
    bits = F.explode(F.array_distinct(F.array(F.shiftrightunsigned(h, 58).bitwiseAND(63), F.shiftrightunsigned(h, 52).bitwiseAND(63))))
    cells = digests.select(_word(h, words).alias("word"), bits.alias("bit")).groupBy("word", "bit").agg(F.count(F.lit(1)).alias("n"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").cast("int"))
    return cells.where("n > 1").groupBy("word").agg(F.bit_or(mask).alias("bits")), words


def _probe(rows: DataFrame, h: Column, bloom: DataFrame, words: int) -> DataFrame:
    """rows with a column ``__hit``: whether the filter has all bits of the hash."""
    table = bloom.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
    joined = rows.join(F.broadcast(table), _word(h, words) == F.col("__word"), "left")
    return joined.withColumn("__hit", F.coalesce(F.col("__bits").bitwiseAND(_mask(h)) == _mask(h), F.lit(False))).drop("__word", "__bits")


def _groups(candidates: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
    return candidates.groupBy("sha").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).select("sha", F.col("first.id").alias("keep_id"), F.col("first.rid").alias("keep_rid"), "n")


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The digests (id, rid, sha), and the same with ``__hit``: whether the text may be repeated."""
    digests = scratch.materialize(docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("rid"), _digest(F.col(f"`{text_col}`")).alias("sha")), "digests")
    bloom, words = repeated_bits(digests, digests.count())
    return digests, _probe(digests, F.xxhash64("sha"), scratch.materialize(bloom, "repeated-bits"), words)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests, probed = _prepared(docs, id_col, text_col)
    columns = [F.col("id").alias("doc_id"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (F.col("n").isNull() | (F.col("rid") == F.col("keep_rid"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]
    alone = probed.where("not __hit").select("id", "rid", "sha", F.lit(None).cast(digests.schema["id"].dataType).alias("keep_id"), F.lit(None).cast("long").alias("keep_rid"), F.lit(None).cast("long").alias("n"))
    candidates = probed.where("__hit").select("id", "rid", "sha")
    joined = _with_group(candidates, _copies(candidates))
    return alone.unionByName(joined.select(alone.columns)).select(*columns)


def _copies(candidates: DataFrame) -> DataFrame:
    """The groups of two rows or more, as a table: a join with it can split a hot group."""
    return scratch.materialize(_groups(candidates).where("n > 1"), "copies")


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    few = groups.count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(groups) if few else groups, "sha", "left")


def _gone(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The ids of which every row goes, and of which some do: (id) and (id, sha, stays)."""
    digests, probed = _prepared(docs, id_col, text_col)
    candidates = probed.where("__hit").select("id", "rid", "sha")
    copies = _with_group(candidates, _copies(candidates)).where(F.col("n").isNotNull() & (F.col("rid") != F.col("keep_rid")))
    lost = scratch.materialize(copies.groupBy("id").agg(F.count(F.lit(1)).alias("lost")), "lost").withColumnRenamed("id", "__id")
    few = lost.count() <= BROADCAST_IDS
    same_id = F.col("id").eqNullSafe(F.col("__id"))
    mixed = digests.join(F.broadcast(lost) if few else lost, same_id).groupBy("__id").agg(F.count(F.lit(1)).alias("all"), F.first("lost").alias("lost")).where("all > lost").select("__id")
    mixed = scratch.materialize(mixed, "mixed")
    if mixed.isEmpty():
        return lost.select("__id"), mixed
    return lost.join(mixed.withColumnRenamed("__id", "__m"), F.col("__id").eqNullSafe(F.col("__m")), "left_anti").select("__id"), mixed


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies: of equal texts the row with the smallest id stays."""
    gone, mixed = _gone(docs, id_col, text_col)
    own, the_id = docs.columns, F.col(f"`{id_col}`")
    if not mixed.isEmpty():
        # ids of several rows, of which some go: these rows alone meet all with their texts
        rows = docs.join(mixed, the_id.eqNullSafe(F.col("__id")), "left_semi")
        smaller = docs.join(mixed, the_id.eqNullSafe(F.col("__id")), "left_anti")
        return _without(smaller, gone, the_id).unionByName(_one_of_each(rows, docs, id_col, text_col))
    return _without(docs, gone, the_id).select(*[F.col(f"`{c}`") for c in own])


def _one_of_each(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of rows with one id and one text one, unless a smaller id has that text."""
    own = docs.columns
    sha = scratch.materialize(rows.select(_digest(F.col(f"`{text_col}`")).alias("sha")).distinct(), "mixed-texts")
    keys = docs.select(F.col(f"`{id_col}`").alias("__first"), _digest(F.col(f"`{text_col}`")).alias("sha")).join(sha, "sha", "left_semi")
    first = keys.groupBy("sha").agg(F.min(F.struct(F.col("__first").isNull().alias("none"), "__first")).alias("first")).select(F.col("sha").alias("__sha"), F.col("first.__first").alias("__first"))
    tagged = rows.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), F.col(f"`{id_col}`").alias("__own"), _digest(F.col(f"`{text_col}`")).alias("__sha"), F.xxhash64(*[F.col(f"`{c}`") for c in own]).alias("__hash"))
    kept = tagged.join(first, "__sha").where(F.col("__own").eqNullSafe(F.col("__first")))
    return kept.groupBy("__sha").agg(F.min_by("__row", "__hash").alias("__row")).select("__row.*")


def _without(docs: DataFrame, gone: DataFrame, the_id: Column) -> DataFrame:
    """docs but for the rows of these ids."""
    same = the_id.eqNullSafe(F.col("__id"))
    n = gone.count()
    if n <= BROADCAST_IDS:
        return docs.join(F.broadcast(gone), same, "left_anti")
    words, h = _words(n), F.xxhash64(the_id)
    of_id = F.xxhash64("__id")
    bits = scratch.materialize(gone.select(_word(of_id, words).alias("word"), _mask(of_id).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")), "gone-bits")
    probed = _probe(docs, h, bits, words)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return probed.where("not __hit").select(*own).unionByName(probed.where("__hit").select(*own).join(gone, same, "left_anti"))
