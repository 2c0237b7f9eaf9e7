"""URL filters: a memory-mapped sorted array of 64-bit xxhash keys.

A rule is a host and a path prefix, written ``host/path``; rules are few and given, or rows
of a table, which Spark sorts and the driver passes on one by one. The index file holds
the sorted keys, the offsets and the rules' strings; executors map it read-only, so its
pages are shared by all workers of a machine. A URL probes, in one vectorised binary
search per batch, the keys of each parent domain of its host that has no more labels
than some rule's host with each prefix of its path that is as long as some rule's path;
every hit is confirmed on the full string,
so hash collisions change nothing. The longest fitting rule wins, then the longer host.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits
no rule; an empty path doesn't start with ``/``; without a fitting rule the verdict is
the default; repeated rules count once: of equal ones the last given verdict holds, in a
table a blocking one; null rules are none.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.llm import scratch

SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str) -> tuple:
    """Columns of the host (A-Z lower-cased) and the path of a URL column."""
    u = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(u, r"://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(u, r"://[^/?#]*([^?#]*)", 1)


def key(text: str) -> int:
    """The number that the SQL function of this name gives, unsigned."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), SEED)


class DigestIndex:
    """The sorted digest array, as a file: counts, keys, offsets, path lengths, then strings with a verdict byte each."""

    HEAD = struct.Struct("<qqq")

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        n, lengths, self.most_labels = self.HEAD.unpack(bytes(raw[: self.HEAD.size]))
        at = np.cumsum([self.HEAD.size, 8 * n, 8 * (n + 1), 8 * lengths]).tolist()
        self.keys = raw[at[0] : at[1]].view(np.uint64)
        self.offsets = raw[at[1] : at[2]].view(np.int64)
        self.lengths = raw[at[2] : at[3]].view(np.int64).tolist()
        self.strings = raw[at[3] :]

    @staticmethod
    def parts(rules: Iterable[tuple[str, bool]]) -> Iterator[bytes]:
        """The file's bytes, of (host/path, allow) rules."""
        last = dict(rules)
        ordered = sorted((key(r), r) for r in last)
        strings = [r.encode("utf-8", "surrogatepass") + (b"\x01" if last[r] else b"\x00") for _, r in ordered]
        hosts = [r.partition("/")[0] for r in last]
        lengths = sorted({len(r) - len(h) for r, h in zip(last, hosts, strict=True)})
        yield DigestIndex.HEAD.pack(len(ordered), len(lengths), max((h.count(".") + 1 for h in hosts), default=0))
        yield np.array([k for k, _ in ordered], np.uint64).tobytes()
        yield np.cumsum([0, *map(len, strings)], dtype=np.int64).tobytes()
        yield np.array(lengths, np.int64).tobytes()
        yield b"".join(strings) or b"\x00"

    @staticmethod
    def table_parts(rules: DataFrame) -> Iterator[bytes]:
        """The file's bytes, of a table of rules (rule, allow); a few thousand rows are here at once."""
        known = scratch.materialize(rules.where("rule is not null").groupBy("rule").agg(F.min("allow").alias("allow")), "rules")
        host = F.substring_index("rule", "/", 1)
        length = F.char_length("rule") - F.char_length(host)
        size = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split(host, r"\."))).alias("labels")).first()
        lengths = [r["n"] for r in known.select(length.cast("long").alias("n")).distinct().orderBy("n").collect()]
        unsigned = F.xxhash64("rule").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
        ordered = known.select("rule", "allow", F.xxhash64("rule").alias("key")).orderBy(unsigned, "rule")
        yield DigestIndex.HEAD.pack(size["n"], len(lengths), size["labels"] or 0)
        rows = lambda *c: batched(ordered.select(*c).toLocalIterator(prefetchPartitions=True), 8192)
        for part in rows("key"):
            yield np.array([r["key"] for r in part], np.int64).tobytes()
        at = 0
        yield struct.pack("<q", at)
        for part in rows(F.octet_length("rule").alias("b")):
            ends = at + np.cumsum([r["b"] + 1 for r in part])
            at = int(ends[-1])
            yield ends.astype(np.int64).tobytes()
        yield np.array(lengths, np.int64).tobytes()
        for part in rows("rule", "allow"):
            yield b"".join(r["rule"].encode("utf-8", "surrogatepass") + (b"\x01" if r["allow"] else b"\x00") for r in part)
        if not size["n"]:
            yield b"\x00"

    def find(self, probes: list[str]) -> list[bool | None]:
        """For each probe the verdict of the rule that is this very string, else None."""
        out: list[bool | None] = [None] * len(probes)
        if not probes or not len(self.keys):
            return out
        keys = np.fromiter(map(key, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            j, own = int(at[i]), probes[i].encode("utf-8", "surrogatepass")
            while j < len(self.keys) and self.keys[j] == keys[i]:
                rule = self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes()
                if rule[:-1] == own:
                    out[i] = rule[-1] == 1
                j += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str, bool] | None]:
        """The longest fitting rule of each URL and whether it allows."""
        probes: list[str] = []
        owner: list[int] = []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            at, domains = len(host), []
            while at > 0 and len(domains) < self.most_labels:
                at = host.rfind(".", 0, at)
                domains.append(host[at + 1 :])
            for domain in reversed(domains):
                for n in self.lengths:
                    if n > len(path):
                        break
                    probes.append(domain + path[:n])
                    owner.append(i)
        best: list[tuple[str, bool] | None] = [None] * len(hosts)
        for i, probe, verdict in zip(owner, probes, self.find(probes), strict=True):
            if verdict is not None and (best[i] is None or len(probe) > len(best[i][0])):
                best[i] = (probe, verdict)
        return best


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, bool]] | DataFrame, default_allow: bool = True, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) of every row.

    The index file is written to the shared folder, from which Spark gives each executor a
    copy to map.
    """
    parts = DigestIndex.table_parts(rules) if isinstance(rules, DataFrame) else DigestIndex.parts(rules)
    path = scratch.write_file(pages.sparkSession, "digests", parts)
    name = path.rpartition("/")[2]
    pages.sparkSession.sparkContext.addFile(path)
    id_type = dict(pages.dtypes)[id_col]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex(SparkFiles.get(name))
        for batch in batches:
            found = index.judge(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            rule = pa.array([x and x[0] for x in found], pa.string())
            verdict = pa.array([("allow" if (default_allow if x is None else x[1]) else "block") for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = url_parts(url_col)
    return pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).mapInArrow(judge, f"page_id {id_type}, host string, path string, rule string, verdict string")
