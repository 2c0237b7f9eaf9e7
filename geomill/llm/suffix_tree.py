"""Language-model scores by a probabilistic suffix tree over the bytes of a token stream.

A text is its words (A-Z lower-cased), a space between two and an end mark behind the
last. Training counts, over all training texts, every byte after the ``DEPTH`` bytes
before it, and every word. A context stays in the tree if it was seen at least
``LEAST_COUNT`` times and its next-byte distribution diverges from that of its longest
kept suffix: by ``DIVERGENCE`` nats, and by more than the description length of its own
counts. Distributions are smoothed towards that suffix's, down to the root's add-half
counts.

The least count is absolute, so the tree grows with the corpus. It is never in one
place: contexts that end in the same three bytes are learned in one task (the shorter
ones are at most 2^24 counts), and the kept ones, oldest byte last, are sorted arrays
in files of the shared folder that workers map. Scoring looks up each distinct position
of some texts: its longest kept context that has the byte, and the smoothing weights of
the kept ones that are longer. Word counts for the unigram base score: the ``COMMON``
most frequent short words are broadcast, and the others of each text meet the counts in
a join.

Defined cases: a null text is empty, its score that of the end mark; a null id counts
as an empty text in the split; a NUL byte is scored, but no context that holds one is
kept; without training rows every byte is equally likely; rows repeated with one id are
scored each; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.llm import scratch
from geomill.llm.memory import give_back

DEPTH, LEAST_COUNT, DIVERGENCE, SMOOTHING = 6, 2, 0.01, 10.0
FOLDS, HELD_OUT = 5, 1
COMMON, COMMON_BYTES = 200_000, 48
END = 10
#: Distinct words and positions that a task holds before it passes counts on.
HELD_WORDS, HELD_BYTES = 600_000, 4 << 20
#: Contexts of up to so many bytes are learned by the driver; counts that a task gathers before it adds them up; bytes of texts scored at once.
LOW, HELD_CODES, SCORED_BYTES = 2, 4 << 20, 1 << 20
#: Codes in a row, and packed codes of neighbouring keys that are learned together.
PACKED, LEARNED_BYTES = 256, 24 << 20
PARTS = ("contexts", "weights", "pairs", "logp")
#: A text steps through the automaton in rows of so many bytes, so many rows at once.
ROW, ROWS = 256, 8_192


def is_held_out(doc_id: object) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % FOLDS == HELD_OUT


def grams(streams: list[bytes], depth: int) -> np.ndarray:
    """The code of each position: the bytes before it (0 before the start mark), then its own, in a 64-bit number."""
    data = np.frombuffer(b"".join(b"\0" * (depth - 1) + b"\n" + s + b"\n" for s in streams), np.uint8)
    code = np.zeros(len(data) - depth, np.uint64)
    for k in range(depth + 1):
        code = (code << np.uint64(8)) | data[k : len(data) - depth + k]
    sizes = np.array([len(s) + 1 + depth for s in streams])
    inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= depth
    return code[inside[depth:]]


def turned(codes: np.ndarray, depth: int) -> np.ndarray:
    """Codes with the bytes of the context in reverse order: what ends alike lies together when sorted."""
    raw = np.ascontiguousarray(codes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, [0, *range(depth, 0, -1), *range(depth + 1, 8)]]).view("<u8").ravel()


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, back = np.unique(np.concatenate(codes), return_inverse=True)
    return u, np.bincount(back, np.concatenate(counts), len(u)).astype(np.int64)


#: A task's counts: of a word, of a byte behind LOW bytes (code), or packed ones of codes that end alike (key).
COUNTED = {"word": pa.binary(), "code": pa.int64(), "key": pa.int32(), "codes": pa.binary(), "counts": pa.binary(), "c": pa.int64()}
COUNTED_DDL = "word binary, code long, key int, codes binary, counts binary, c long"


def _row(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, kind)) for name, kind in COUNTED.items()], names=list(COUNTED))


def _packed(u: np.ndarray, c: np.ndarray, depth: int) -> Iterator[pa.RecordBatch]:
    """Sorted codes and their counts, a row for each key and at most ``PACKED`` codes."""
    keys = (u >> np.uint64(8 * (depth - LOW))).astype(np.int32)
    new = np.r_[True, keys[1:] != keys[:-1]] if len(u) else np.empty(0, bool)
    first = np.flatnonzero(new)
    inside = np.arange(len(u)) - np.repeat(first, np.diff(np.r_[first, len(u)]))
    cuts = np.r_[np.flatnonzero(inside % PACKED == 0), len(u)]
    for at in range(0, len(cuts) - 1, 10_000):
        part = cuts[at : at + 10_001]
        s, e, n = int(part[0]), int(part[-1]), len(part) - 1
        own = lambda x, width: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(((part - s) * width).astype(np.int32).tobytes()), pa.py_buffer(x[s:e].tobytes())])  # noqa: B023, E731
        yield _row(n, key=pa.array(keys[part[:-1]]), codes=own(u, 8), counts=own(c.astype(np.int64), 8))


def _counts(depth: int):  # noqa: ANN202
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        streams: list[bytes] = []
        held, texts = 0, 0
        codes: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> None:
            nonlocal held
            if streams:
                codes.append(np.unique(turned(grams(streams, depth), depth), return_counts=True))
                streams.clear()
                held = 0

        def send() -> Iterator[pa.RecordBatch]:
            fold()
            kind = list(words)
            for at in range(0, len(kind), 100_000):
                part = kind[at : at + 100_000]
                yield _row(len(part), word=pa.array(part, pa.binary()), c=pa.array([words[w] for w in part], pa.int64()))
            words.clear()
            if codes:
                u, c = _summed(*map(list, zip(*codes, strict=True)))
                codes.clear()
                low, back = np.unique(u >> np.uint64(8 * (depth - LOW + 1)) << np.uint64(8) | u & np.uint64(255), return_inverse=True)
                yield _row(len(low), code=pa.array(low.view(np.int64)), c=pa.array(np.bincount(back, c, len(low)).astype(np.int64)))
                yield from _packed(u, c, depth)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if is_held_out(doc_id):
                    continue
                own = (text or b"").lower().split()
                words.update(own)
                texts += 1
                streams.append(b" ".join(own))
                held += len(streams[-1])
                if held >= HELD_BYTES:
                    fold()
                if len(words) >= HELD_WORDS or len(codes) >= 16:
                    yield from send()
        yield from send()
        # the end mark: a word of its own, with neither word nor code nor key here
        yield _row(1, c=pa.array([texts], pa.int64()))
        give_back()

    return count


def _find(among: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands among sorted ones, and whether it does."""
    if not len(among):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return at, among[at] == keys


def grow(codes: np.ndarray, c: np.ndarray, depth: int, base: int, p: np.ndarray | None = None, below: np.ndarray | None = None) -> tuple[dict[int, list[np.ndarray]], np.ndarray, np.ndarray]:
    """For each depth over ``base``: the kept contexts, log10 of their smoothing weights, their (context, byte) pairs, log10 of those probabilities.

    codes: sorted, distinct, turned, of contexts of ``depth`` bytes. p: the probability of
    each pair ``below``, which are those of ``base`` bytes (without: the root's). Last come
    the pairs of ``depth`` bytes and their probabilities, whether kept or not.
    """
    pairs, counts, up = {depth: codes}, {depth: c.astype(np.float64)}, {}
    for k in range(depth - 1, base - 1, -1):
        pairs[k], up[k + 1] = np.unique(pairs[k + 1] >> np.uint64(16) << np.uint64(8) | pairs[k + 1] & np.uint64(255), return_inverse=True)
        counts[k] = np.bincount(up[k + 1], counts[k + 1], len(pairs[k]))
    if p is None:
        now = (counts[0] + 0.5) / (counts[0].sum() + 0.5 * 256)
    else:
        now = p[_find(below, pairs[base])[0]]
    out = {}
    for k in range(base + 1, depth + 1):
        before, n_of = now[up[k]], counts[k]
        contexts = pairs[k] >> np.uint64(8)
        first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(contexts) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[first, len(contexts)])
        contexts = contexts[first]
        n = np.add.reduceat(n_of, first) if len(first) else np.empty(0)
        own = (n_of + SMOOTHING * before) / (np.repeat(n, sizes) + SMOOTHING)
        gain = np.add.reduceat(n_of * np.log(own / before), first) if len(first) else np.empty(0)
        kept = (n >= LEAST_COUNT) & (gain >= DIVERGENCE * n) & (gain > 0.5 * sizes * np.log(n + 1))
        for j in range(k):  # those from before the start mark say what the mark says
            kept &= (contexts >> np.uint64(8 * j)) & np.uint64(255) != 0
        each = np.repeat(kept, sizes)
        now = np.where(each, own, before)
        out[k] = [contexts[kept], np.log10(SMOOTHING / (n[kept] + SMOOTHING)).astype(np.float32), pairs[k][each], np.log10(now[each]).astype(np.float32)]
    return out, pairs[depth], now


class SortedTree:
    """The kept contexts as sorted arrays: levels[k] as from ``grow``, root: log10 of the probability of each byte."""

    def __init__(self, root: np.ndarray, levels: dict[int, list[np.ndarray]], depth: int) -> None:
        self.root, self.levels, self.depth = root, levels, depth

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the byte at each turned code."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(self.depth, 0, -1):
            contexts, weights, pairs, logp = self.levels[k]
            open_ = codes[left]
            context = open_ >> np.uint64(8 * (self.depth - k + 1))
            at, kept = _find(contexts, context)
            inside = np.flatnonzero(kept)
            pair, seen = _find(pairs, context[inside] << np.uint64(8) | open_[inside] & np.uint64(255))
            out[left[inside[seen]]] += logp[pair[seen]]
            out[left[inside[~seen]]] += weights[at[inside[~seen]]]
            rest = np.ones(len(left), bool)
            rest[inside[seen]] = False
            left = left[rest]
        out[left] += self.root[(codes[left] & np.uint64(255)).astype(np.int64)]
        return out

    def scores(self, streams: list[bytes]) -> np.ndarray:
        """log10 probability of each stream and its end mark."""
        total, at = np.zeros(len(streams)), 0
        while at < len(streams):
            end, held = at, 0
            while end < len(streams) and (end == at or held + len(streams[end]) <= SCORED_BYTES):
                held += len(streams[end])
                end += 1
            own, back = np.unique(turned(grams(streams[at:end], self.depth), self.depth), return_inverse=True)
            sizes = np.array([len(s) + 1 for s in streams[at:end]])
            total[at:end] = np.add.reduceat(self.positions(own)[back], np.cumsum(sizes) - sizes)
            at = end
        return total


class SuffixTree:
    """The same tree as an automaton, whole and in memory, for a few texts.

    next and logp: for each state and byte class; classes: of each byte. Class 0 leads to the root at no cost.
    """

    def __init__(self, counts: dict[bytes, np.ndarray], divergence: float = DIVERGENCE, smoothing: float = SMOOTHING) -> None:
        """counts: for each context, oldest byte first, how often each byte follows; the root is b''."""
        root = counts.get(b"", np.zeros(256))
        seen = np.flatnonzero(root)
        self.classes = np.ones(256, np.uint8)  # 1: never seen
        self.classes[seen] = np.arange(2, 2 + len(seen))
        self.width = 2 + len(seen)
        total = root.sum() + 0.5 * 256
        dist = {b"": np.r_[0.5 / total, (root[seen] + 0.5) / total]}
        for context in sorted(counts, key=len):
            if not context:
                continue
            c = np.r_[0.0, counts[context][seen]]
            n, up = c.sum(), dist[self._suffix(context, dist)]
            own = (c + smoothing * up) / (n + smoothing)
            there = c > 0
            gain = float((c[there] * np.log(own[there] / up[there])).sum())
            if gain >= divergence * n and gain > 0.5 * there.sum() * math.log(n + 1):
                dist[context] = own
        self.contexts = len(dist)
        nodes = sorted({c[:k] for c in dist for k in range(len(c) + 1)}, key=len)
        at = {c: i for i, c in enumerate(nodes)}
        self.next = np.zeros((len(nodes), self.width), np.int32)
        self.logp = np.zeros((len(nodes), self.width), np.float32)
        children: dict[bytes, list[bytes]] = {}
        for c in nodes[1:]:
            children.setdefault(c[:-1], []).append(c)
        for c in nodes:  # shorter first: the longest proper suffix that is a node has its row already
            fail = next((c[k:] for k in range(1, len(c) + 1) if c[k:] in at), b"")
            if c:
                self.next[at[c]] = self.next[at[fail]]
            for child in children.get(c, ()):
                self.next[at[c], self.classes[child[-1]]] = at[child]
            self.logp[at[c], 1:] = np.log10(dist[c if c in dist else self._suffix(c, dist)])

    @staticmethod
    def _suffix(context: bytes, among: dict) -> bytes:
        return next(context[k:] for k in range(1, len(context) + 1) if context[k:] in among)

    def scores(self, streams: list[bytes], depth: int = DEPTH) -> np.ndarray:
        """log10 probability of each stream and its end mark."""
        pad = np.zeros(depth - 1, np.uint8)
        start = self.classes[np.array([END])]
        parts, rows, owner, base = [], [], [], 0
        for i, s in enumerate(streams):
            body = self.classes[np.frombuffer(s + b"\n", np.uint8)]
            n = -(-len(body) // ROW)
            parts += [pad, start, body, np.zeros(n * ROW - len(body), np.uint8)]
            rows.append(base + ROW * np.arange(n))
            owner.append(np.full(n, i))
            base += depth + n * ROW
        flat, total = np.concatenate(parts), np.zeros(len(streams))
        all_rows, all_owner = np.concatenate(rows), np.concatenate(owner)
        step, nxt, logp = np.arange(depth + ROW), self.next.ravel() * np.int32(self.width), self.logp.ravel()
        for a in range(0, len(all_rows), ROWS):
            symbols = np.ascontiguousarray(flat[all_rows[a : a + ROWS, None] + step].T)
            state, sum_ = np.zeros(symbols.shape[1], np.int32), np.zeros(symbols.shape[1])
            for t in range(depth + ROW):
                k = state + symbols[t]
                if t >= depth:
                    sum_ += logp[k]
                state = nxt[k]
            total += np.bincount(all_owner[a : a + ROWS], sum_, len(streams))
        return total


def _learn(counted: DataFrame, depth: int):  # noqa: ANN202
    """A function that opens the tree in a worker."""
    spark = counted.sparkSession
    low = counted.where("code is not null").groupBy("code").agg(F.sum("c").alias("c")).toPandas().sort_values("code")
    pairs, c = low["code"].to_numpy().astype(np.uint64), low["c"].to_numpy()
    small, below, p = grow(pairs, c, LOW, 0)
    times = np.bincount((pairs & np.uint64(255)).astype(np.int64), c, 256)
    root = np.log10((times + 0.5) / (times.sum() + 0.5 * 256))
    shared = spark.sparkContext.broadcast((below, p))

    blobs = counted.where("key is not null")
    # neighbouring keys up to LEARNED_BYTES are one bucket; a row for each key, 2^24 at most
    sizes = blobs.groupBy("key").agg(F.sum(F.octet_length("codes").cast("long")).alias("b")).toPandas().sort_values("key")
    up_to = sizes["b"].to_numpy(np.int64).cumsum()
    buckets = spark.createDataFrame(sizes[["key"]].assign(bucket=(up_to - sizes["b"].to_numpy(np.int64)) // LEARNED_BYTES), "key int, bucket int")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: tuple[list, list] = ([], [])
        held = distinct = 0
        at = None
        below, p = shared.value

        def add_up() -> None:
            nonlocal held, distinct
            u, c = _summed(*gathered)
            gathered[0][:], gathered[1][:] = [u], [c]
            held, distinct = 0, len(u)

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal held, distinct
            add_up()
            for k, arrays in grow(gathered[0][0], gathered[1][0], depth, LOW, p, below)[0].items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([len(arrays[0])], pa.int64()), pa.array([len(arrays[2])], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], names=["k", "at", "n", "m", *PARTS])
            gathered[0].clear(), gathered[1].clear()
            held = distinct = 0

        for batch in batches:
            bucket = batch.column(0).to_numpy()
            cuts = (np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist()
            for s, e in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if s == e:
                    continue
                if at is not None and bucket[s] != at:
                    yield from finish()
                at = int(bucket[s])
                own, times = (np.frombuffer(b"".join(batch.column(k).slice(s, e - s).to_pylist()), np.uint64 if k == 1 else np.int64) for k in (1, 2))
                gathered[0].append(own)
                gathered[1].append(times)
                held += len(own)
                if held >= max(HELD_CODES, distinct):
                    add_up()
        if at is not None:
            yield from finish()
        give_back()

    dealt = blobs.join(F.broadcast(buckets), "key").select("bucket", "codes", "counts").repartition("bucket").sortWithinPartitions("bucket")
    grown = scratch.materialize(dealt.mapInArrow(learn, "k int, at int, n long, m long, " + ", ".join(f"{x} binary" for x in PARTS)), "tree")
    sizes = {r["k"]: (r["n"], r["m"]) for r in grown.groupBy("k").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect()}
    files = [scratch.local_file(spark, scratch.write_file(spark, x, (bytes(r[x]) for r in grown.select("k", "at", x).orderBy("k", "at").toLocalIterator()))) for x in PARTS]

    def tree() -> SortedTree:
        levels, at = dict(small), [0, 0]
        whole = [np.memmap(f(), kind, "r") if sizes and any(m for _, m in sizes.values()) else np.empty(0, kind) for f, kind in zip(files, (np.uint64, np.float32, np.uint64, np.float32), strict=True)]
        for k in range(LOW + 1, depth + 1):
            n, m = sizes.get(k, (0, 0))
            levels[k] = [np.asarray(x[a : a + size]) for x, a, size in zip(whole, (at[0], at[0], at[1], at[1]), (n, n, m, m), strict=True)]
            at = [at[0] + n, at[1] + m]
        return SortedTree(root, levels, depth)

    return tree


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark, id_type = docs.sparkSession, dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    counted = scratch.materialize(rows.select("doc_id", "text").mapInArrow(_counts(depth), COUNTED_DDL), "counted")
    words = scratch.materialize(counted.where("word is not null").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    ends = counted.where("word is null and code is null and key is null").agg(F.sum("c").alias("c")).first()["c"] or 0
    # eight bins an octave of counts
    short = F.octet_length("word") <= COMMON_BYTES
    bins = words.groupBy(F.floor(F.log2("c") * 8).alias("bin")).agg(F.count(F.when(short, 1)).alias("n"), F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds")).collect()
    total, kinds = ends + sum(b["total"] for b in bins), (1 if ends else 0) + sum(b["kinds"] for b in bins)
    least, taken = None, 0
    for b in sorted(bins, key=lambda b: -b["bin"]):
        if taken + b["n"] > COMMON:
            break
        least, taken = b["bin"], taken + b["n"]
    is_common = short & (F.floor(F.log2("c") * 8) >= F.lit(least if least is not None else 1 << 30))
    weight = total + 0.5 * (kinds + 1)
    common = {bytes(r["word"]): math.log10((r["c"] + 0.5) / weight) for r in words.where(is_common).toLocalIterator()}
    end_score = math.log10((ends + 0.5) / weight)
    open_tree = _learn(counted, depth)
    shared = spark.sparkContext.broadcast(common)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, get = open_tree(), shared.value.get
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                ids = part.column(0).to_pylist()
                streams, n, known, base, rare, times = [], [], [], [], [], []
                for text in part.column(1).to_pylist():
                    own = (text or b"").lower().split()
                    found = list(map(get, own))
                    other: Counter[bytes] = Counter()
                    if None in found:
                        other = Counter(w for w, x in zip(own, found, strict=True) if x is None)
                        found = [x for x in found if x is not None]
                    streams.append(b" ".join(own))
                    n.append(len(own) + 1)
                    known.append(len(found) + (1 if ends else 0))
                    base.append(math.fsum(found) + end_score)
                    rare.append(list(other))
                    times.append(list(other.values()))
                held = [is_held_out(i) for i in ids]
                columns = [part.column(0), part.column(2), pa.array(held, pa.bool_()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(tree.scores(streams)), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "held_out", "n_tokens", "known", "base", "score", "rare", "times"])

    ddl = f"doc_id {id_type}, row long, held_out boolean, n_tokens long, known long, base double, score double, rare array<binary>, times array<long>"
    scored = scratch.materialize(rows.mapInArrow(score, ddl), "scored")
    pair = F.explode(F.arrays_zip("rare", "times")).alias("p")
    asked = scored.select("row", pair).select("row", F.col("p.rare").alias("word"), F.col("p.times").alias("t"))
    met = asked.join(words.where(~is_common), "word", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(weight))
    rest = met.groupBy("row").agg(F.sum(F.col("t") * log).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("t")).otherwise(0)).alias("more_known"))
    out = scored.drop("rare", "times").join(rest, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
