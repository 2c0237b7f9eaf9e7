import hashlib
import zlib

import duckdb
import pytest

from geomill.llm import merkle, queries
from geomill.llm.merkle import manifest, rounds, walk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place string, n string, digest string, block string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, lower=False):
    i, text, lang, source, n = row[:5]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h("".join(map(field, (i, source, lang, n, text))))


def levels(nodes):
    """All nodes of a tree, by level."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][at : at + 16])) for at in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, at):
    """(before, after) of a leaf's ancestors."""
    out = []
    for level in tree[:-1]:
        run = at - at % 16
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 16])))
        at //= 16
    return out


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (own := sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))), levels([leaf(r) for r in own])) for s in order}
    top = levels([trees[s][1][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        own, tree = trees[s]
        for at, r in enumerate(own):
            path = siblings(tree, at) + siblings(top, k)
            d = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for b, a in path:
                d = h(b + d + a)
            root = top[-1][0]
            out.append((r[0], leaf(r), tree[-1][0], root, h("".join(b + a for b, a in path)), d, d == root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def row(i, source="a", text="Some Text", lang="en"):
    return (i, text, lang, source, len(text) if text is not None else None, "x", "x", "x", "x", "x")


@pytest.mark.parametrize(("block_levels", "range_rows"), [(1, 40), (2, 500), (3, 100_000)])
def test_many_levels(spark, monkeypatch, block_levels, range_rows):
    monkeypatch.setattr(merkle, "RANGE_ROWS", range_rows)
    rows = [row(7 * i % 1013, "hot", f"Text {i}") for i in range(600)] + [row(2000 + i, f"s{i % 20}") for i in range(90)] + [row(5000 + i, None, None) for i in range(17)] + [row(6000, "single")]
    assert rows_of(manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), block_levels)) == plain(rows)


@pytest.mark.parametrize("few", [0, 200_000])
def test_odd_rows(spark, monkeypatch, few):
    monkeypatch.setattr(merkle, "BROADCAST_COUNTS", few)
    big = 2**60 + 1
    rows = [row(1), row(1), row(1, text="Other"), row(None), row(None, text=None, lang=None), row(big), row(big + 1, "é"), row(3, ""), row(4, "=" , "ÄB c\x00"), row(5, None, "x" * 300_000), row(-5, "a", ""), *[row(9, "copies") for _ in range(40)]]
    assert rows_of(manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), 1)) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_small_trees(spark, n):
    rows = [row(i) for i in range(n)]
    got = rows_of(manifest(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows)
    if n == 1:
        assert got[0][4] == h("") and got[0][1] == got[0][2] == got[0][3]


def test_walk_returns_digest_and_siblings():
    leaves = [h(str(i)) for i in range(300)]
    paths = [[] for _ in leaves]
    tree = levels(leaves)
    assert walk(leaves, rounds(len(leaves)), paths) == tree[-1][0]
    assert paths == [siblings(tree, i) for i in range(len(leaves))]


def test_tampering_shows(spark):
    rows = [row(i, text="ABC" if i % 2 else "abc") for i in range(200)]
    for i, *_, verified in rows_of(manifest(spark.createDataFrame(rows, SCHEMA))):
        assert verified == (zlib.crc32(str(i).encode()) % 5 != 0 or i % 2 == 0)


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({queries.ORACLES['op13_merkle_manifest']})").fetchall()
    assert rows_of(queries.op13_merkle_manifest(spark, sf)) == sorted(want, key=repr)
