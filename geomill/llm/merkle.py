"""Merkle manifest of a dataset: a digest of all rows, and for each row the proof that it is in it.

Rows are leaves; each source is a tree over its leaves in the order of ids, and the
sources' roots, in the order of sources, are the leaves of a tree on top. In a tree,
every ``ARITY`` consecutive nodes become one until one node is left.

A tree is cut into aligned blocks of ``ARITY ** block_levels`` nodes. A task walks a
block recursively and in postorder: it returns the subtree's digest and, unwinding,
appends each node's siblings to the leaves it contains. The blocks' roots are the nodes
of another traversal of the same kind, until each tree is one node. What the traversals
above found (of each block, few rows) comes back down to the blocks, where each leaf's
proof is hashed and its root folded, so siblings of leaves are never shuffled.

Leaves get their places by a range partitioning on (source, id): a place in a partition
plus the counts of the partitions before. No source, however large, goes through one
task. Hot sources fall into blocks like others.

Defined cases: a null is ``-`` in a leaf; the null source is a tree of its own and comes
first; null ids come first in a source; rows repeated with one id are leaves side by
side, in the order of their digests; a tree of one leaf is that leaf, and with no
siblings at all the proof is the digest of nothing; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geomill.llm.scratch import materialize

ARITY, BLOCK_LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of a range partition, of some 150 bytes each.
RANGE_ROWS = 500_000
#: Counts of (partition, source) that are broadcast at most: about 20 MB.
BROADCAST_COUNTS = 200_000


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def rounds(nodes: int) -> int:
    """Rounds until one node is left."""
    k = 0
    while nodes > 1:
        nodes, k = -(-nodes // ARITY), k + 1
    return k


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def walk(digests: list[str], height: int, paths: list[list[tuple[str, str]]] | None = None, first: int = 0) -> str:
    """The digest of the subtree of this height over the leaves from ``first`` on.

    On the way back each leaf in it gets what stands before and behind its ancestor
    among that one's siblings.
    """
    if height == 0:
        return digests[first]
    step = ARITY ** (height - 1)
    starts = range(first, min(first + ARITY * step, len(digests)), step)
    children = [walk(digests, height - 1, paths, s) for s in starts]
    if paths is not None:
        for i, s in enumerate(starts):
            siblings = "".join(children[:i]), "".join(children[i + 1 :])
            for path in paths[s : min(s + step, len(digests))]:
                path.append(siblings)
    return _digest("".join(children))


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        digest = _digest(before + digest + after)
    return digest


def placed(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """rows with ``place``, from 0 in each tree by ``order``, and ``n``, the tree's size. Tree and order together must be unique."""
    n = rows.count()
    spread = rows.repartitionByRange(max(1, -(-n // RANGE_ROWS)), F.col(tree), *[F.asc_nulls_first(c) for c in order])
    # the number of a row in its partition, written once
    numbered = materialize(spread.sortWithinPartitions(F.col(tree), *[F.asc_nulls_first(c) for c in order]).withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("__at", 33).alias("__part")
    counts = numbered.groupBy(tree, part).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__count"))
    whole = Window.partitionBy(tree)
    before = F.sum("__count").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(tree), "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__count").over(whole).alias("n"))
    counts = materialize(counts, f"{name}-counts")
    few = counts.count() <= BROADCAST_COUNTS
    joined = numbered.withColumn("__part", part).join(F.broadcast(counts) if few else counts, [tree, "__part"])
    return joined.withColumn("place", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def _height(n: int, levels: int) -> int:
    return min(levels, rounds(n))


def _block(levels: int) -> Column:
    return F.expr(f"place div {ARITY**levels}").alias("block")


def climb(nodes: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """The nodes (tree, place, n, digest) of each traversal, from the given ones to those that are alone in their tree."""

    def roots(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        n = int(pdf["n"].iloc[0])
        height = _height(n, levels)
        return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "n": [-(-n // ARITY**height)], "digest": [walk(pdf["digest"].tolist(), height)]})

    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 1) > 1:
        grouped = out[-1].select("tree", "place", "n", "digest", _block(levels)).groupBy("tree", "block")
        out.append(materialize(grouped.applyInPandas(roots, "tree string, place long, n long, digest string"), f"{name}-{len(out)}"))
    return out


PATH = "array<struct<before: string, after: string>>"


def _descend(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """above (tree, place, path, subroot) tells each block of nodes its path up; the nodes' own paths and subroots."""

    def down(key: tuple, pdf: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        pdf, paths = _paths(pdf, up, levels)
        path = [[{"before": b, "after": a} for b, a in p] for p in paths]
        return pd.DataFrame({"tree": pdf["tree"], "place": pdf["place"], "path": path, "subroot": [up["subroot"].iloc[0]] * len(pdf)})

    grouped = nodes.select("tree", "place", "n", "digest", _block(levels)).groupBy("tree", "block")
    return grouped.cogroup(above.groupBy("tree", "place")).applyInPandas(down, f"tree string, place long, path {PATH}, subroot string")


def _paths(pdf: pd.DataFrame, up: pd.DataFrame, levels: int) -> tuple[pd.DataFrame, list[list[tuple[str, str]]]]:
    """A block's rows in order, and of each all siblings up to the root."""
    pdf = pdf.sort_values("place", ignore_index=True)
    paths: list[list[tuple[str, str]]] = [[] for _ in range(len(pdf))]
    walk(pdf["digest"].tolist(), _height(int(pdf["n"].iloc[0]), levels), paths)
    rest = [(p["before"], p["after"]) for p in up["path"].iloc[0]]
    return pdf, [p + rest for p in paths]


def manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    Where 5 divides the crc32 of the id, the root is folded from a leaf whose text was
    lower-cased (A-Z), and so only verifies if that changes nothing.
    """
    fields = [F.col(c) for c in FIELDS]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # sorts the null source first
    leaves = docs.select("doc_id", tree.alias("tree"), leaf(fields).alias("digest"), F.when(tampered(F.col("doc_id")), leaf([*fields[:-1], lower])).alias("changed"), F.monotonically_increasing_id().alias("rid"))
    leaves = materialize(leaves, "leaves")
    nodes = materialize(placed(leaves, "tree", ["doc_id", "digest", "rid"], "sorted-leaves").drop("rid"), "placed-leaves")
    levels = climb(nodes, block_levels, "blocks")
    # the sources' roots are the leaves of the tree on top
    tops = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    tops = materialize(placed(tops, "tree", ["of"], "sources"), "placed-sources")
    summit = climb(tops, block_levels, "top")
    root = (summit[-1].select("digest").first() or [None])[0]
    above = summit[-1].select("tree", "place", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"))
    for below in reversed(summit):
        above = materialize(_descend(below, above, block_levels), "paths")
    of = tops.select("place", "of", "digest").join(above.select("place", "path"), "place")
    above = of.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"))
    for below in reversed(levels[1:]):
        above = materialize(_descend(below, above, block_levels), "paths")

    def prove(key: tuple, pdf: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        pdf, paths = _paths(pdf, up, block_levels)
        start = pdf["changed"].where(pdf["changed"].notna(), pdf["digest"])
        proofs = [_digest("".join(b + a for b, a in p)) for p in paths]
        folded = [fold(d, p) for d, p in zip(start, paths, strict=True)]
        return pd.DataFrame({"doc_id": pdf["doc_id"], "leaf": pdf["digest"], "subroot": [up["subroot"].iloc[0]] * len(pdf), "proof_sha256": proofs, "folded_root": folded})

    # ids as text: a null would turn pandas' integers into floats
    grouped = nodes.select("tree", _block(block_levels), "place", "n", "digest", "changed", F.col("doc_id").cast("string").alias("doc_id")).groupBy("tree", "block")
    proved = grouped.cogroup(above.groupBy("tree", "place")).applyInPandas(prove, "doc_id string, leaf string, subroot string, proof_sha256 string, folded_root string")
    return proved.select(F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", F.coalesce(F.col("folded_root") == F.lit(root), F.lit(False)).alias("verified"))
