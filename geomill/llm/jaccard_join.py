"""N-gram Jaccard self-join by PartEnum signatures, as classes of linked documents.

Sets of shingle hashes fall into bands of sizes; a set signs for its own band and the
next, so any two sets whose sizes allow the similarity sign for one band together.
Two such sets differ in at most ``k`` elements. The hash domain is cut into first-level
partitions, each of these into ``SECOND`` second-level ones; of each first-level
partition every subset that leaves one second-level partition out is a signature. Where
two sets differ in at most one element of a first-level partition they share one of its
signatures, and where in none, all of them.

So a first-level partition hides a similar pair only at the price of two differences, or
of one if some of its signatures can't be used, or of none if all can't. Signatures of
nothing (only empty partitions) are never used, and frequent ones (those that only a
common line fills) need not be: a set can leave them out as long as the prices still sum up to
more than ``k``. There are ``SPARE`` partitions in a hundred beyond what ``k`` needs for
that. A set whose elements lie so close together that its empty partitions alone
take too much signs with all others of that kind in its band.

Two scans: the first finds which signatures may repeat (``repeated``), the second
emits only those. In each signature's group every member is compared with its smallest
document, not with each other: sketches (a byte for each second-level partition) rule out
pairs with too few equal partitions, whole texts decide on the rest. Where what met one
document then still is of different classes, it is compared among itself, in blocks of
which each two meet in a task: sketches first, then the shingle hashes of those with a
partner left, unless they are connected by then. Only links that connect come out, and
whole texts decide on them too. Sets count as equal where their words are the same
(a 192-bit digest of them), or where whole texts of equal set hashes say so.

Defined cases: ids are integers, others an error; a null or blank text has an empty set and no links; fewer words than a
shingle count as one shingle; equal sets are linked; a null id is returned with no
component; rows repeated with one id are one node; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.llm import repeated, scratch
from geomill.llm.components import components
from geomill.llm.memory import give_back
from geomill.llm.wordhash import mix, shingle_set, word_hashes

#: Second-level partitions of a first-level one, and first-level ones in a hundred that may be lost.
SECOND, SPARE = 3, 20
#: A signature of more sets than this counts as frequent.
FREQUENT = 64
#: No task compares more than twice as many sets with each other.
BLOCK = 1_024
#: Ids whose texts are fetched by a broadcast of at most 16 MB; beyond, by a shuffled join.
BROADCAST_IDS = 1_000_000
#: Signatures that a task holds before it passes them on.
HELD_SIGNATURES = 200_000
#: Documents whose sets are made at once.
BATCH_DOCS = 512


class Bands:
    """Size bands and partition counts for a similarity of ``percent`` / 100."""

    def __init__(self, percent: int) -> None:
        self.percent, self.last = percent, [0]
        self.known: dict[int, tuple[int, int]] = {}
        self.named: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def of(self, size: int) -> int:
        while self.last[-1] < size:
            low = self.last[-1] + 1
            self.last.append(max(low, low * 100 // self.percent))
        return int(np.searchsorted(self.last, size))

    def parameters(self, band: int) -> tuple[int, int]:
        """(k, first-level partitions) of the sets that sign for band."""
        if band not in self.known:
            while len(self.last) <= band:
                self.of(self.last[-1] + 1)
            k = 2 * self.last[band] * (100 - self.percent) // (100 + self.percent)
            self.known[band] = (k, (k + 1 + max(3, (k + 1) * SPARE // 100) + 1) // 2)
        return self.known[band]

    def fixed(self, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the second-level partitions begin (but for the first), and numbers that name them and what is left when each is out."""
        if band not in self.named:
            n = self.parameters(band)[1] * SECOND
            begin = (np.arange(1, n, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(n - 1)) // np.uint64(n) << np.uint64(32)
            names = mix(np.arange(n, dtype=np.uint64) + (np.uint64(band) << np.uint64(32)))
            self.named[band] = (begin, names, mix(names + np.uint64(1)).reshape(-1, SECOND))
        return self.named[band]

    def contents(self, elements: np.ndarray, band: int, sums: np.ndarray | None = None) -> np.ndarray:
        """Hashes of a sorted set's second-level partitions, 0 for empty ones. sums: of ``running``."""
        begin, names, _ = self.fixed(band)
        at = np.empty(len(begin) + 2, np.int64)
        at[0], at[1:-1], at[-1] = 0, np.searchsorted(elements, begin), len(elements)
        up_to = (running(elements) if sums is None else sums)[at]
        out = mix(up_to[1:] - up_to[:-1] + names) | np.uint64(1)
        out[at[1:] == at[:-1]] = 0
        return out

    def sketch(self, elements: np.ndarray, band: int) -> np.ndarray:
        """The partitions' contents, a byte each: similar sets agree in all but k."""
        found = self.contents(elements, band)
        return (found >> np.uint64(56)).astype(np.uint8) | (found > 0)

    def signatures(self, elements: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """For a sorted set's own band and the next (band, what may still be lost, signatures, their first-level partitions, how many each of these has)."""
        out = []
        own, sums = self.of(len(elements)), running(elements)
        for band in (own, own + 1):
            k, n = self.parameters(band)
            if not k:  # only equal sets are similar; they are linked without signatures
                continue
            found = self.contents(elements, band, sums).reshape(n, SECOND)
            signs = mix(found.sum(axis=1, keepdims=True) - found + self.fixed(band)[2]).ravel()
            full = found > 0
            kinds = full.sum(axis=1, keepdims=True)
            used = (kinds > full).ravel()  # something is left
            usable = used.reshape(n, SECOND).sum(axis=1)
            spare = int(_price(usable, 0).sum()) - (k + 1)
            which, many = np.repeat(np.arange(n), SECOND), np.repeat(usable, SECOND)
            if not used.all():
                signs, which, many = signs[used], which[used], many[used]
            if spare < 0:
                signs, which, many = np.r_[signs, mix(np.array([band], np.uint64) + np.uint64(77))], np.r_[which, -1], np.r_[many, SECOND]
            out.append((band, spare, signs, which, many))
        return out


def running(elements: np.ndarray) -> np.ndarray:
    """Sums of the elements' hashes, from none to all."""
    out = np.zeros(len(elements) + 1, np.uint64)
    np.cumsum(mix(elements ^ np.uint64(0x5851F42D4C957F2D)), out=out[1:])
    return out


def _price(usable: np.ndarray, frequent: np.ndarray | int) -> np.ndarray:
    """Differences that hide a pair from a first-level partition of so many signatures, of which so many are left out."""
    left = usable - frequent
    return np.where(left == SECOND, 2, np.where(left > 0, 1, 0))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int | None, np.ndarray, bytes]]:
    """id, shingle hashes and text of each row."""
    for at in range(0, len(batch), BATCH_DOCS):
        part = batch.slice(at, BATCH_DOCS)
        texts = [t or b"" for t in part.column(1).to_pylist()]
        for own, w, t in zip(part.column(0).to_pylist(), word_hashes(texts), texts, strict=True):
            yield own, shingle_set(w, shingle), t


def _identity(elements: np.ndarray) -> tuple[int, int]:
    """Equal for equal sets of hashes."""
    a, b = np.add.reduce(mix(elements)), np.add.reduce(mix(elements + np.uint64(0x1234567)))
    return int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))


def _words_digest(text: bytes) -> bytes:
    """Names the sequence of a text's words."""
    return blake2b(b" ".join(text.lower().split()), digest_size=24).digest()


def string_set(text: bytes, shingle: int) -> set[bytes]:
    w = text.lower().split()
    if len(w) < shingle:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)))


def _of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts' rows of the ids given."""
    ids = scratch.materialize(ids.distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _sketches(ids: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(id, n, own, next): a set's size and its partitions' contents in two bands, a byte each: 0 for an empty one."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            ids, n, own, after = [], [], [], []
            for i, s, _ in _sets(batch, shingle):
                band = bands.of(len(s))
                ids.append(i), n.append(len(s))
                for out, b in ((own, band), (after, band + 1)):
                    out.append(bands.sketch(s, b).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(own, pa.binary()), pa.array(after, pa.binary())], names=["id", "n", "own", "next"])
        give_back()

    made = _of(texts, ids).select("id", "text").mapInArrow(make, "id long, n long, own binary, next binary")
    return scratch.materialize(made.dropDuplicates(["id"]), "sketches")


def _may_be_similar(bands: Bands, a: tuple[int, bytes, bytes], b: tuple[int, bytes, bytes]) -> bool:
    """Whether two sketches (size, own band, next band) allow the similarity: similar sets agree in all but k partitions."""
    x, y = bands.of(a[0]), bands.of(b[0])
    if abs(x - y) > 1 or min(a[0], b[0]) * 100 < max(a[0], b[0]) * bands.percent:
        return False
    k, n = bands.parameters(max(x, y))
    v, w = (np.frombuffer(s[1] if band == max(x, y) else s[2], np.uint8) for s, band in ((a, x), (b, y)))
    return int((v == w).sum()) >= SECOND * n - k


def _maybe(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity."""
    side = lambda c: sketches.select(F.col("id").alias(c), F.struct("n", "own", "next").alias(f"s_{c}"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            keep = [_may_be_similar(bands, tuple(x.values()), tuple(y.values())) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(test, "a long, b long")


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, by their whole texts. b may be a hot key: its text meets the pairs in a join that can be split."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    own = scratch.materialize(_of(texts, ids).dropDuplicates(["id"]), "texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[bytes, set] = (b"", set())
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                y = y.as_py() or b""
                if y != seen[0]:
                    seen = (y, string_set(y, shingle))
                s = string_set(x.as_py() or b"", shingle)
                both = len(s & seen[1])
                keep.append(both * 100 >= (len(s) + len(seen[1]) - both) * percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    joined = pairs.join(own.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(own.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return scratch.materialize(joined.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long"), "similar")


def _equal(sets: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) from a set (id, h1, h2, words) to the smallest id with an equal one.

    The same words make equal sets; of different words whose sets' hashes are equal, whole
    texts decide.
    """
    groups = sets.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("words").alias("w0"), F.max("words").alias("w1"))
    members = sets.select("h1", "h2", "words", "id").join(scratch.materialize(groups.where("first <> last"), "same"), ["h1", "h2"])
    same = members.where("w0 = w1 and id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    mixed = scratch.materialize(members.where("w0 <> w1").select("h1", "h2", "words", "id", "first"), "same-hashes")
    if mixed.isEmpty():
        return same.distinct()
    of_words = scratch.materialize(mixed.groupBy("h1", "h2", "words", "first").agg(F.min("id").alias("b")), "same-words")
    copies = mixed.join(of_words.select("h1", "h2", "words", "b"), ["h1", "h2", "words"]).where("id <> b").select(F.col("id").alias("a"), "b")
    other = of_words.where("b <> first").select(F.col("b").alias("a"), F.col("first").alias("b")).distinct()
    return same.unionByName(copies).unionByName(_similar(other, texts, shingle, percent)).distinct()


def linked_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: the smallest id that links of at least percent / 100 reach."""
    scratch.integer_ids(docs, id_col)
    texts = _texts(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    share = 2 * SECOND * (1 + SPARE / 100) * (100 - percent) / (100 + percent)
    log2, ranges = repeated.table_size(int(size / 6 * share))

    def first_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, collector = Bands(percent), repeated.Collector(log2, ranges)

        def rows(ids: list, n: list, h1: list, h2: list, words: list, sent: list) -> pa.RecordBatch:
            k, nulls = len(sent), len(ids)
            columns = [*[pa.array(c + [None] * k, pa.int64()) for c in (ids, n, h1, h2)], pa.array(words + [None] * k, pa.binary()), pa.array([None] * nulls + [r for r, _ in sent], pa.int32()), pa.array([None] * nulls + [c for _, c in sent], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["id", "n", "h1", "h2", "words", "range", "cells"])

        for batch in batches:
            ids, n, h1, h2, words = [], [], [], [], []
            for i, s, text in _sets(batch, shingle):
                a, b = _identity(s) if len(s) else (0, 0)
                ids.append(i), n.append(len(s)), h1.append(a), h2.append(b), words.append(_words_digest(text))
                if len(s) and i is not None:
                    for _, _, found, *_ in own.signatures(s):
                        if collector.add(found):
                            yield rows([], [], [], [], [], list(collector.send()))
            yield rows(ids, n, h1, h2, words, [])
        yield rows([], [], [], [], [], list(collector.send()))
        give_back()

    scanned = scratch.materialize(texts.mapInArrow(first_scan, "id long, n long, h1 long, h2 long, words binary, range int, cells binary"), "sets")
    sets = scanned.where("range is null").select("id", "n", "h1", "h2", "words")
    open_table = repeated.repeated_table(scanned.where("range is not null").select("range", "cells"), log2, ranges)
    # one document stands for those with an equal set
    equal = scratch.materialize(_equal(sets.where("n > 0 and id is not null"), texts, shingle, percent), "equal")
    copies = equal.select(F.col("a").alias("id"))
    few = equal.count() <= BROADCAST_IDS

    def second_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bits = Bands(percent), open_table()
        names = ["sig", "id", "band", "spare", "part", "usable"]

        def rows(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64 if k < 2 else np.int32)) for k in range(6)], names=names)

        none = (np.empty(0, np.int64),) * 6
        for batch in batches:
            parts, ready = [none], 0
            for i, s, _ in _sets(batch, shingle):
                if not len(s) or i is None:
                    continue
                for band, spare, found, part, usable in own.signatures(s):
                    hit = np.flatnonzero(repeated.maybe_repeated(found, bits, log2))
                    if len(hit):
                        parts.append((found[hit].view(np.int64), *(np.full(len(hit), x, np.int64) for x in (i, band, spare)), part[hit], usable[hit]))
                        ready += len(hit)
                if ready >= HELD_SIGNATURES:
                    yield rows(parts)
                    parts, ready = [none], 0
            yield rows(parts)
        give_back()

    asked = texts.join(F.broadcast(copies), "id", "left_anti").select(texts.columns) if few else texts
    signed = scratch.materialize(asked.mapInArrow(second_scan, "sig long, id long, band int, spare int, part int, usable int"), "signatures")
    if not few:
        signed = signed.join(copies, "id", "left_anti")
    return _classes(sets, equal, signed, texts, shingle, percent)


def _classes(sets: DataFrame, equal: DataFrame, signed: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    # groups of at least two, and which of them are frequent
    groups = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last").drop("last")
    groups = scratch.materialize(groups, "groups")
    members = scratch.materialize(signed.join(groups, "sig"), "members")
    hot = members.where(F.col("n") > FREQUENT)
    gone = hot.groupBy("id", "band", "part", "usable", "spare").agg(F.count(F.lit(1)).alias("f"))
    price = lambda left: F.when(left == SECOND, 2).when(left > 0, 1).otherwise(0)
    lost = gone.groupBy("id", "band", "spare").agg(F.sum(price(F.col("usable")) - price(F.col("usable") - F.col("f"))).alias("lost"))
    needed = scratch.materialize(lost.where((F.col("lost") > F.col("spare"))).select("id", "band"), "needed")
    kept = hot.join(needed, ["id", "band"]).select(*members.columns)
    members = members.where(F.col("n") <= FREQUENT).unionByName(kept)

    # each other member meets its leader: sketches tell which may be similar, texts which are
    pairs = scratch.materialize(members.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    sketches = _sketches(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), texts, shingle, percent)
    near = _similar(scratch.materialize(_maybe(pairs, sketches, percent), "maybe"), texts, shingle, percent)
    links = scratch.materialize(equal.unionByName(near), "links")
    roots = components(links)

    # a set that met a leader stands in its group; groups that hold different classes are open
    state = scratch.materialize(_rooted(pairs.select(F.col("a").alias("id"), F.col("b").alias("leader")), roots, "id", "root"), "state")
    split = scratch.materialize(state.groupBy("leader").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("n")).where("r0 <> r1").select("leader", "n"), "split")
    if not split.isEmpty():
        cells = _cells(scratch.materialize(state.join(split, "leader"), "open"))
        hopeful = scratch.materialize(_hopeful(cells, sketches, percent), "hopeful")
        found = scratch.materialize(_settle(cells.join(hopeful, [*GROUP, "id"]), texts, shingle, percent).distinct(), "found")
        roots = components(links.unionByName(_similar(found, texts, shingle, percent)))
    return _rooted(sets.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles")), roots, "doc_id", "component_id")


def _rooted(df: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    """df with the root of a node, which is the node itself where it has no links."""
    r = roots.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    return df.join(r, F.col(node) == F.col("__n"), "left").withColumn(name, F.coalesce("__r", node)).drop("__n", "__r")


#: What names a task that compares the sets of a group, or of two blocks of it.
GROUP = ["leader", "i", "j"]


def _cells(rest: DataFrame) -> DataFrame:
    """rest(leader, id, root, n) dealt into tasks GROUP: larger groups are cut into blocks of which each two meet."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rest.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    return dealt.select("leader", "id", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "root", "block")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group, of batches sorted by their first columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        own = [batch.column(k).to_numpy() for k in range(keys)]
        cuts = (np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in own])) + 1).tolist()
        if held and any(held[-1].column(k)[-1].as_py() != x[0] for k, x in enumerate(own)):
            yield pa.Table.from_batches(held)
            held = []
        for s, e in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            held.append(batch.slice(s, e - s))
            if e < len(batch):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def hopeful(n: np.ndarray, roots: np.ndarray, block: np.ndarray, own: list[bytes], after: list[bytes], bands: Bands, two_blocks: bool) -> np.ndarray:
    """Which of these sets have a partner of another class (of another block, if two meet) whose sketch allows the similarity."""
    band, hit = np.array([bands.of(x) for x in n]), np.zeros(len(n), bool)
    for meet in np.unique(np.r_[band, band + 1]):
        k, first = bands.parameters(int(meet))
        here = np.flatnonzero((band == meet) | (band + 1 == meet))
        if not k or len(here) < 2:
            continue
        v = np.stack([np.frombuffer(own[x] if band[x] == meet else after[x], np.uint8) for x in here])
        for x in range(len(here) - 1):
            rest = here[x + 1 :]
            ok = (np.maximum(band[rest], band[here[x]]) == meet) & (roots[rest] != roots[here[x]])
            if two_blocks:
                ok &= block[rest] != block[here[x]]
            if not ok.any():
                continue
            ok[ok] = (v[x + 1 :][ok] == v[x]).sum(axis=1) >= SECOND * first - k
            if ok.any():
                hit[here[x]] = True
                hit[rest[ok]] = True
    return hit


def _hopeful(cells: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(GROUP, id) of the members with a partner in the task that is of another class and whose sketch allows the similarity."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for group in _groups(batches, len(GROUP)):
            n, roots, block = (group.column(c).to_numpy() for c in ("n", "root", "block"))
            hit = hopeful(n, roots, block, group.column("own").to_pylist(), group.column("next").to_pylist(), bands, group.column("i")[0] != group.column("j")[0])
            if hit.any():
                yield from group.select([*GROUP, "id"]).filter(pa.array(hit)).combine_chunks().to_batches()
        give_back()

    rows = cells.dropDuplicates([*GROUP, "id"]).join(sketches, "id").select(*GROUP, "id", "n", "root", "block", "own", "next")
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "id").mapInArrow(choose, "leader long, i int, j int, id long")


def _elements(ids: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(id, e): the sorted shingle hashes of the sets that are still open."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, elements = zip(*[(i, s.tobytes()) for i, s, _ in _sets(batch, shingle)], strict=True) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(elements, pa.binary())], names=["id", "e"])

    return scratch.materialize(_of(texts, ids).select("id", "text").mapInArrow(make, "id long, e binary").dropDuplicates(["id"]), "elements")


def settled(ids: list[int], roots: list[int], block: list[int], sets: list[np.ndarray], percent: int, two_blocks: bool) -> list[tuple[int, int]]:
    """Links that join different roots, at most one fewer than there are sets. Pairs inside a block are passed over if two blocks meet."""
    bands, tree = Bands(percent), {r: r for r in roots}

    def top(r: int) -> int:
        while tree[r] != r:
            tree[r] = tree[tree[r]]
            r = tree[r]
        return r

    own = np.array([bands.of(len(s)) for s in sets])
    at_block, out = np.array(block), []
    for band in np.unique(np.r_[own, own + 1]):
        k, n = bands.parameters(int(band))
        here = np.flatnonzero((own == band) | (own + 1 == band))
        if not k or len(here) < 2:
            continue
        v = np.stack([bands.sketch(sets[x], int(band)) for x in here])
        for x in range(len(here)):
            i = here[x]
            rest = here[x + 1 :]
            # the band in which two sets of neighbouring sizes meet is the larger one's own
            ok = ((v[x + 1 :] == v[x]).sum(axis=1) >= SECOND * n - k) & (np.maximum(own[rest], own[i]) == band)
            if two_blocks:
                ok &= at_block[rest] != at_block[i]
            for j in rest[ok]:
                a, b = len(sets[i]), len(sets[j])
                if min(a, b) * 100 < max(a, b) * percent or top(roots[i]) == top(roots[j]):
                    continue
                both = a + b - len(np.union1d(sets[i], sets[j]))
                if both * 100 >= (a + b - both) * percent:
                    out.append((ids[i], ids[j]))
                    tree[top(roots[i])] = top(roots[j])
    return out


def _settle(cells: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between members of one task that join different roots."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("id", ignore_index=True)
        sets = [np.frombuffer(e, np.uint64) for e in pdf["e"]]
        found = settled(pdf["id"].tolist(), pdf["root"].tolist(), pdf["block"].tolist(), sets, percent, bool(pdf["i"].iloc[0] != pdf["j"].iloc[0]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return cells.join(_elements(cells.select("id"), texts, shingle), "id").groupBy(*GROUP).applyInPandas(settle, "a long, b long")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without those linked to others, but for the smallest id of each class. Of rows repeated with one id of a class one stays; a null id stays."""
    classes = linked_classes(docs, id_col, text_col, shingle, percent)
    gone = scratch.materialize(classes.where("component_id is not null and component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    few = gone.count() <= BROADCAST_IDS
    other = gone.select(F.col("doc_id").alias("__gone"))
    return docs.join(F.broadcast(other) if few else other, docs[id_col] == F.col("__gone"), "left_anti")
