"""Best-fit packing of token sequences under several capacities at once.

A document's ids are the tokenizer's, then ``END``; only documents longer than a
sequence are cut, into full pieces and a last shorter one. Full pieces fill a sequence
each. The others are packed by vector best-fit, longest first: of the open sequences
whose residual tokens, documents and attention cost all admit the piece, the one with
the best score gets it. The score is the residual norm that would be left (smaller is
better) or the dot product of demand and residual (larger is better), each dimension
weighted and scaled by its capacity.

Pieces are dealt by a hash of the document into groups of about ``GROUP`` pieces,
packed apart: a group's few open sequences at its end are all that this costs.

Defined cases: a null or empty text is ``END`` alone; a piece that no empty sequence
admits (capacity below one document's own cost) gets a sequence alone; of equal scores
the first in the list of open sequences wins; rows repeated with one id are documents of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.llm import scratch
from geomill.llm.memory import give_back
from geomill.llm.tokens import WordEncoder

SEQUENCE, END, GROUP = 4096, 1, 8_192


def best_fit(lengths: np.ndarray, capacity: int = SEQUENCE, documents: int = SEQUENCE, attention: int = SEQUENCE * SEQUENCE, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; a piece of n tokens costs n tokens, one document and n * n of attention."""
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    wt, wd, wa = weights[0] / capacity**2, weights[1] / documents**2, weights[2] / float(attention) ** 2
    # residual tokens, documents and attention of the open sequences, and their numbers
    left = np.empty((3, max(n, 1)))
    ids = np.empty(max(n, 1), np.int64)
    open_, made = 0, 0
    order = np.argsort(-lengths, kind="stable")
    least = float(lengths[order[-1]]) if n else 0.0
    for i in order:
        size = float(lengths[i])
        cost = size * size
        t, d, a = left[0, :open_], left[1, :open_], left[2, :open_]
        fits = np.flatnonzero((t >= size) & (d >= 1) & (a >= cost))
        if len(fits):
            t, d, a = t[fits], d[fits], a[fits]
            if score == "norm":
                at = fits[np.argmin(wt * (t - size) ** 2 + wd * (d - 1) ** 2 + wa * (a - cost) ** 2)]
            else:
                at = fits[np.argmax(wt * t * size + wd * d + wa * a * cost)]
        else:
            at = open_
            left[:, at], ids[at] = (capacity, documents, attention), made
            open_, made = open_ + 1, made + 1
        sequence[i], offset[i] = ids[at], capacity - left[0, at]
        left[:, at] -= (size, 1.0, cost)
        if left[0, at] < least or left[1, at] < 1 or left[2, at] < least * least:  # it admits nothing more: closed
            open_ -= 1
            left[:, at], ids[at] = left[:, open_], ids[open_]
    return sequence, offset


def tokenize_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 (and ids as packed bytes) of each piece."""
    fields = [("doc_id", "id"), ("row", "long"), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), *([("ids", "binary")] if keep_ids else [])]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder.of(tokenizer), np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                source, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, own in enumerate(encoder.encode([x or b"" for x in part.column(2).to_pylist()])):
                    own += end
                    for k, s in enumerate(range(0, len(own), 4 * capacity)):
                        cut = own[s : s + 4 * capacity]
                        for column, value in ((source, i), (piece, k), (start, s // 4), (length, len(cut) // 4), (crc, zlib.crc32(cut)), (ids, cut if keep_ids else None)):
                            column.append(value)
                take = pa.array(source, pa.int64())
                out = [part.column(0).take(take), part.column(1).take(take), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *([pa.array(ids, pa.binary())] if keep_ids else [])]
                yield pa.RecordBatch.from_arrays(out, names=[f for f, _ in fields])
        give_back("tokens")

    id_type = dict(docs.dtypes)[id_col]
    ddl = ", ".join(f"{f} {id_type if t == 'id' else t}" for f, t in fields)
    return docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("binary").alias("text")).mapInArrow(pieces, ddl)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE, documents: int = SEQUENCE, attention: int = SEQUENCE * SEQUENCE, score: str = "norm", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece (and ids)."""
    pieces = scratch.materialize(tokenize_pieces(docs, tokenizer, id_col, text_col, capacity, keep_ids), "pieces")
    full = (F.col("length") >= capacity) & F.lit(documents >= 1)
    names = [c for c in pieces.columns if c != "row"]
    counts = pieces.agg(F.sum(F.when(full, 0).otherwise(1)).alias("part")).first()
    groups = max(1, -(-(counts["part"] or 0) // GROUP))
    slot = F.pmod(F.xxhash64("row"), F.lit(groups).cast("long"))
    whole = pieces.where(full).withColumn("sequence_id", F.monotonically_increasing_id() + (1 << 61)).withColumn("offset", F.lit(0).cast("long"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable", ignore_index=True)
        sequence, offset = best_fit(pdf["length"].to_numpy(np.int64), capacity, documents, attention, score=score)
        return pd.DataFrame({"row": pdf["row"], "sequence_id": sequence + (pdf["slot"].to_numpy(np.int64) << 32), "offset": offset})

    short = pieces.where(~full)
    placed = short.select("row", "length", slot.alias("slot")).groupBy("slot").applyInPandas(pack, "row long, sequence_id long, offset long")
    return whole.select(*names, "sequence_id", "offset").unionByName(short.join(placed, "row").select(*names, "sequence_id", "offset"))
