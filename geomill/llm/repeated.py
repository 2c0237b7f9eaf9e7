"""Which 64-bit keys may occur twice: a mapped bit table, made in one light shuffle.

Each task hashes its keys to cells and sends, for each range of cells, one sorted
array of 32-bit cell numbers: four bytes a key, and at most two for a cell. A range's
arrays meet in one task, which marks the cells met twice. The table has 16 to 32 cells
for each key expected, ``2 ** MOST_LOG2`` at most; it is a file in the shared folder, written
range by range, that workers map read-only. A key in an unmarked cell occurs once, so a
second scan need shuffle only the others. On inputs that fill the table more keys
shuffle, and nothing else changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from geomill.llm import scratch

MOST_LOG2 = 32
#: Keys that a task holds before it sends them.
HELD = 2_000_000
#: Ranges that the driver passes on at once, of 256 KB to 1 MB each.
FETCHED = 4


def table_size(keys: int) -> tuple[int, int]:
    """(log2 of the cells, number of ranges) for about so many keys."""
    log2 = min(MOST_LOG2, max(12, (16 * max(keys, 1)).bit_length()))
    ranges = 1 << min(log2 - 8, max(4, (keys // 500_000).bit_length()))
    return log2, ranges


def cells(keys: np.ndarray, log2: int) -> np.ndarray:
    return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - log2)).astype(np.uint32)


class Collector:
    """A task's cells, ready to be sent."""

    def __init__(self, log2: int, ranges: int) -> None:
        self.log2, self.edges, self.parts, self.n = log2, (np.arange(1, ranges, dtype=np.uint64) << np.uint64(log2)) // np.uint64(ranges), [], 0

    def add(self, keys: np.ndarray) -> bool:
        """Whether it is time to send."""
        self.parts.append(cells(keys, self.log2))
        self.n += len(keys)
        return self.n >= HELD

    def send(self) -> Iterator[tuple[int, bytes]]:
        """(range, array) pairs."""
        if self.n:
            value, count = np.unique(np.concatenate(self.parts), return_counts=True)
            value = np.repeat(value, np.minimum(count, 2))
            for k, own in enumerate(np.split(value, np.searchsorted(value, self.edges.astype(np.uint32)))):
                if len(own):
                    yield k, own.tobytes()
        self.parts, self.n = [], 0


def repeated_table(sent: DataFrame, log2: int, ranges: int) -> Callable[[], np.ndarray]:
    """A function that maps the packed bit table of the sent (range, cells) rows: 2 ** log2 bits."""
    width = (1 << log2) // ranges

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["range"].iloc[0])
        c = np.sort(np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["cells"]]))
        bits = np.zeros(width, bool)
        bits[c[1:][c[1:] == c[:-1]].astype(np.int64) - k * width] = True
        return pd.DataFrame({"range": [k], "bits": [np.packbits(bits).tobytes()]})

    marked = scratch.materialize(sent.groupBy("range").applyInPandas(mark, "range int, bits binary"), "marked")

    def parts() -> Iterator[bytes]:
        at = 0
        # a few ranges of the table are here at once
        ordered = marked.repartitionByRange(max(1, ranges // FETCHED), "range").sortWithinPartitions("range")
        for row in ordered.toLocalIterator():
            for _ in range(at, row["range"]):
                yield bytes(width // 8)
            yield bytes(row["bits"])
            at = row["range"] + 1
        for _ in range(at, ranges):
            yield bytes(width // 8)

    path = scratch.local_file(sent.sparkSession, scratch.write_file(sent.sparkSession, "repeated", parts()))
    return lambda: np.memmap(path(), np.uint8, "r")


def maybe_repeated(keys: np.ndarray, table: np.ndarray, log2: int) -> np.ndarray:
    c = cells(keys, log2)
    return (table[c >> np.uint32(3)] >> (7 - (c & np.uint32(7))).astype(np.uint8)) & 1 == 1
