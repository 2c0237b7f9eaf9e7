"""Substring deduplication by content-defined chunks under a gear rolling hash.

The gear hash of the last 16 bytes decides, behind each white-space byte, whether a
chunk ends there, so an insertion moves the chunks around it and no others. Chunks have
``LEAST`` to ``MOST`` bytes; without a cut they end at ``MOST``, between characters.
A chunk whose 128-bit digest occurs earlier (by document, then by place) is a
repeat; neighbouring repeats join to one span, and spans of at least ``MIN_WORDS``
words and two chunks are the result. The first occurrence stays.

Two scans: the first finds which digests may repeat (``repeated``), the second emits
only those chunks. Counting is pre-aggregated and the join back has one row a digest
on one side, so a very common passage can be split.

Defined cases: ids are integers, others an error; null and empty texts have no chunks; offsets and lengths are in UTF-8
bytes; a null id sorts first; rows with one id and one text are one document, of
which every row is treated alike; an empty table gives an empty result; other columns
are carried by ``drop_repeats`` and ignored by ``repeated_spans``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geomill.llm import repeated, scratch
from geomill.llm.memory import give_back

LEAST, MOST, ONE_IN = 16, 256, 4
#: Passages of more than 50 words are sought; their outer chunks may be cut elsewhere.
MIN_WORDS = 16
#: Spans cut by a broadcast of at most some 30 MB; beyond, by a shuffled join.
BROADCAST_SPANS = 300_000

_GEAR = np.random.default_rng(5).integers(0, 1 << 16, 256).astype(np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes whose rolling hashes are made at once, and texts whose chunks are.
BLOCK, SLICE = 4 << 20, 512


def candidates(data: np.ndarray) -> np.ndarray:
    """The places behind a white-space byte where the gear hash of the last 16 bytes asks for a cut."""
    found = []
    for at in range(0, len(data), BLOCK):
        part = data[max(0, at - 16) : at + BLOCK]
        h = _GEAR[part]
        for step in (1, 2, 4, 8):  # h[i] sums gear[i - j] << j over 2 * step bytes
            longer = h.copy()
            longer[step:] += h[:-step] << np.uint16(step)
            h = longer
        here = np.flatnonzero(_SPACE[part] & (h >> np.uint16(16 - ONE_IN.bit_length() + 1) == 0)) + max(0, at - 16) + 1
        found.append(here[here > at])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def chunk_ends(data: np.ndarray, cuts: list[int]) -> list[int]:
    """The ends of the chunks of one text; cuts: its candidates."""
    ends, last, n = [], 0, len(data)
    for c in [*cuts, n]:
        while c - last > MOST:
            e = last + MOST
            while e > last + 1 and e < n and data[e] & 0xC0 == 0x80:
                e -= 1
            ends.append(e)
            last = e
        if c - last >= LEAST or (c == n and c > last):
            ends.append(c)
            last = c
    return ends


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[int], list[bytes], np.ndarray]]:
    """(place in the batch, text, chunk ends, chunks, digests as pairs of 64-bit numbers) of each text that has any."""
    texts = [t or b"" for t in batch.column(0).to_pylist()]
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) < BLOCK // 2:
            size += len(texts[to])
            to += 1
        # 16 bytes between texts keep their rolling hashes apart
        data = np.frombuffer((b"\0" * 16).join(texts[at:to]), np.uint8)
        found, base = candidates(data), 0
        for i in range(at, to):
            text = texts[i]
            own = found[np.searchsorted(found, base, "right") : np.searchsorted(found, base + len(text), "right")] - base
            ends = chunk_ends(data[base : base + len(text)], own.tolist())
            base += len(text) + 16
            if ends:
                chunks = [text[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
                yield i, text, ends, chunks, np.frombuffer(b"".join(xxhash.xxh3_128_digest(c) for c in chunks), np.uint64).reshape(-1, 2)
        at = to


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, start, length, n_words, n_chunks, first_doc_id, first_start of each repeated span."""
    scratch.integer_ids(docs, id_col)
    source = docs.select(F.col(text_col).cast("binary").alias("text"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"))
    size = source.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    log2, ranges = repeated.table_size(size // 30)

    def first_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collector = repeated.Collector(log2, ranges)

        def send() -> pa.RecordBatch:
            sent = list(collector.send())
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in sent], pa.int32()), pa.array([c for _, c in sent], pa.binary())], names=["range", "cells"])

        for batch in batches:
            for at in range(0, len(batch), SLICE):
                for *_, digests in _chunks(batch.slice(at, SLICE)):
                    if collector.add(digests[:, 0]):
                        yield send()
        yield send()
        give_back()

    open_table = repeated.repeated_table(source.select("text").mapInArrow(first_scan, "range int, cells binary"), log2, ranges)

    def second_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = open_table()
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, len(whole), SLICE)):
            owner, rows, words = [], [], []
            for i, _, ends, chunks, digests in _chunks(batch):
                hit = np.flatnonzero(repeated.maybe_repeated(digests[:, 0], bits, log2))
                if len(hit):
                    e = np.array(ends, np.int64)
                    s = np.r_[np.int64(0), e[:-1]]
                    d = digests[hit].view(np.int64)
                    rows.append(np.stack([d[:, 0], d[:, 1], hit.astype(np.int64), s[hit], (e - s)[hit]]))
                    words += [len(chunks[k].split()) for k in hit.tolist()]
                    owner += [i] * len(hit)
            flat = np.concatenate(rows, axis=1) if rows else np.empty((5, 0), np.int64)
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(2).take(take), *map(pa.array, flat), pa.array(words, pa.int64())], names=["id", "th", "d1", "d2", "k", "start", "length", "words"])
        give_back()

    hits = scratch.materialize(source.mapInArrow(second_scan, "id long, th long, d1 long, d2 long, k long, start long, length long, words long"), "chunks")
    place = F.struct("id", "th", "start")
    first = hits.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("d1", "d2", "first")
    # a table of one row a digest: in a join with it a very common chunk can be split
    first = scratch.materialize(first, "repeated")
    again = hits.join(first, ["d1", "d2"]).where(~place.eqNullSafe(F.col("first"))).dropDuplicates(["id", "th", "k"])
    # a text's chunks stand together: neighbours share k minus their rank
    order = Window.partitionBy("id", "th").orderBy("k")
    runs = again.withColumn("run", F.col("k") - F.row_number().over(order)).groupBy("id", "th", "run")
    head = F.min_by("first", "k").alias("head")
    spans = runs.agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.sum("words").alias("n_words"), F.count(F.lit(1)).alias("n_chunks"), head)
    spans = spans.where((F.col("n_words") >= min_words) & (F.col("n_chunks") >= 2))
    return spans.select(F.col("id").alias("doc_id"), F.col("th").alias("text_hash"), "start", "length", "n_words", "n_chunks", F.col("head.id").alias("first_doc_id"), F.col("head.start").alias("first_start"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the repeated spans cut out of their texts, and the character count set anew where there was one."""
    spans = scratch.materialize(repeated_spans(docs, id_col, text_col, min_words), "spans")
    few = spans.count() <= BROADCAST_SPANS
    own = spans.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("__spans"))
    joined = docs.join(F.broadcast(own) if few else own, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th")), "left")
    raw = F.col(text_col).cast("binary")
    piece = lambda at, to: F.substring(raw, (at + 1).cast("int"), (to - at).cast("int"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("kept"))
    kept = F.aggregate("__spans", zero, lambda a, x: F.struct((x["start"] + x["length"]).alias("at"), F.concat(a["kept"], piece(a["at"], x["start"])).alias("kept")), lambda a: F.concat(a["kept"], piece(a["at"], F.octet_length(raw).cast("long"))))
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(kept.cast("string"))
    out = joined.withColumn("__text", text)
    columns = [F.col("__text").alias(c) if c == text_col else F.when(F.col("__spans").isNull(), F.col(c)).otherwise(F.char_length("__text")).cast(dict(docs.dtypes)[c]).alias(c) if c == chars_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns)
