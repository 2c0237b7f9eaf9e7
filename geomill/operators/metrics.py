"""Retrieval metrics over ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def per_query(ranked: DataFrame, k: int, query: str = "query_id", match: str = "match", by_relevant: bool = False) -> DataFrame:
    """precision, ap, rr at k of each query. ranked: query, rank (from 1), match.

    Precision divides by k even if fewer were retrieved; average precision by the hits
    retrieved (or, by_relevant, by min(relevant, k), where ranked has a column relevant).
    """
    hit = F.col(match).cast("int")
    seen = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranked.where(F.col("rank") <= k).withColumn("h", F.coalesce(hit, F.lit(0))).withColumn("at", F.col("h") * F.sum("h").over(seen) / F.col("rank"))
    hits = F.sum("h")
    bottom = F.least(F.max("relevant"), F.lit(k)) if by_relevant else hits
    return rows.groupBy(query).agg(
        F.round(hits / F.lit(float(k)), 6).alias("precision"),
        F.round(F.coalesce(F.try_divide(F.sum("at"), bottom), F.lit(0.0)), 6).alias("ap"),
        F.round(F.coalesce(1 / F.min(F.when(F.col("h") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("rr"),
    )


def means(scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Mean precision, mean average precision and mean reciprocal rank."""
    return scores.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("precision"), 6).alias("mean_precision"), F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("rr"), 6).alias("mrr"))


def geographic(ranked: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Shares of queries with a near result. ranked: query_id, rank, km, same_country, other_platform.

    ``cross`` is, of the queries with some result of another platform within 50 km, the
    share whose first result of another platform is.
    """
    g = [*(group or []), "query_id"]
    within = lambda k, km: F.max((F.col("rank") <= k) & (F.col("km") <= km)).cast("int")
    first_other = F.min_by("km", F.when(F.col("other_platform"), F.col("rank")))
    rows = ranked.groupBy(*g).agg(
        within(1, 5).alias("r1_5"), within(5, 5).alias("r5_5"), within(1, 50).alias("r1_50"), within(5, 50).alias("r5_50"), within(10, 50).alias("r10_50"),
        F.max((F.col("rank") == 1) & F.col("same_country")).cast("int").alias("country"),
        F.max(F.col("other_platform") & (F.col("km") <= 50)).cast("int").alias("can_cross"),
        (first_other <= 50).cast("int").alias("crosses"),
    )
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return rows.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("queries"), *map(mean, ("r1_5", "r5_5", "r1_50", "r5_50", "r10_50", "country")), F.round(F.avg(F.when(F.col("can_cross") == 1, F.coalesce("crosses", F.lit(0)))), 6).alias("cross"))


def geographic_scores(ranked: DataFrame, km: float = 50.0, k: int = 10) -> DataFrame:
    """precision, ap and rr at k of each query, a result within km being a hit; average precision by the hits retrieved."""
    return per_query(ranked.withColumn("match", F.col("km") <= km), k)


def self_match(ranked: DataFrame) -> DataFrame:
    """top1, top5 (percent) and mrr where the right answer of a query is the gallery item with its id. ranked: query_id, rank, id, complete."""
    rank = ranked.groupBy("query_id").agg(F.min(F.when(F.col("id") == F.col("query_id"), F.col("rank"))).alias("r"))
    return rank.agg(F.round(F.avg((F.coalesce("r", F.lit(1 << 30)) <= 1).cast("int")) * 100, 6).alias("top1"), F.round(F.avg((F.coalesce("r", F.lit(1 << 30)) <= 5).cast("int")) * 100, 6).alias("top5"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


def exact_match(answers: DataFrame, columns: list[str], truth: str = "_true", by: str | None = None) -> DataFrame:
    """Percent of exact answers, per column, compared without case and blanks; with ``by``, of each of its values, with the number of answers n."""
    same = lambda c: (F.lower(F.trim(c)) == F.lower(F.trim(c + truth))).cast("int")
    shares = [F.round(F.avg(F.coalesce(same(c), F.lit(0))) * 100, 6).alias(c) for c in columns]
    return answers.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *shares) if by else answers.agg(*shares)


def report_name(line: Column) -> Column:
    return F.trim(F.get(F.split(_inside_bars(line), r"\|"), F.lit(0)))


def report_values(line: Column) -> Column:
    """The figures of a table line behind its name, without percent signs and bold marks."""
    cells = F.split(_inside_bars(line), r"\|")
    return F.transform(F.slice(cells, 2, 100), lambda x: F.trim(F.regexp_replace(x, "[%*]", "")).try_cast("double"))


def parse_report(lines: DataFrame, line: str = "value") -> DataFrame:
    """name, values of the rows of a Markdown table."""
    rows = lines.where(F.col(line).startswith("|") & ~F.col(line).rlike(r"^\|[\s:|-]+\|?$"))
    return rows.select(report_name(F.col(line)).alias("name"), report_values(F.col(line)).alias("values"))


def _inside_bars(c: Column) -> Column:
    return F.btrim(F.trim(c), F.lit("|"))


def drop_repeated_rows(rows: DataFrame, model: str, name: str, values: str, reference: str = "Average Patch") -> DataFrame:
    """Rows of a model but for those whose figures are the reference row's."""
    ref = rows.where(F.col(name) == reference).select(F.col(model).alias("__m"), F.col(values).alias("__v")).distinct()
    return rows.join(ref, (F.col(name) != reference) & (F.col(model) == F.col("__m")) & (F.col(values) == F.col("__v")), "left_anti")
