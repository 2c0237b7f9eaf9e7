"""Connected components of a links table, by hooking and pointer jumping on tables.

Each round hooks every root to its smallest neighbouring root, jumps pointers until
the trees are flat, and relabels the links between what are now fewer roots. Links and
labels stay distributed; each round ends in tables in the shared folder. The joins
have at most one row for a node on one side, so a hot node's links can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.llm import scratch


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of links(a, b): root is the smallest node that links reach."""
    links = scratch.materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = scratch.materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "parents")
        while True:
            up = parents.select(F.col("node").alias("p"), F.col("root").alias("pp"))
            jumped = scratch.materialize(parents.join(up, parents["root"] == up["p"]).select("node", F.col("pp").alias("root"), (F.col("pp") != F.col("root")).alias("moved")), "parents")
            parents = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        to = parents.select(F.col("node").alias("old"), F.col("root").alias("new"))
        if labels is None:
            labels = parents
        else:
            labels = scratch.materialize(labels.join(to, labels["root"] == to["old"], "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
        half = links.join(to, links["a"] == to["old"]).select(F.col("new").alias("a"), "b")
        whole = half.join(to, half["b"] == to["old"]).select("a", F.col("new").alias("b")).where("a <> b")
        links = scratch.materialize(whole.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels
