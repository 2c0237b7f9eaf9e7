"""WARC archives: write captures, read records, assemble transactions.

Each capture is three records: ``request``, ``response`` (or ``revisit``) and
``metadata``; request and metadata name the main record in WARC-Concurrent-To.
Every record is a gzip member of its own. Spark's text writer commits the files (so
a failed task leaves nothing behind), with an empty gzip member as line separator, and
the driver then gives them their name: plain ``.warc.gz`` for any reader. A file holds at
most ``FILE_PARTS`` parts of ``BATCH_BYTES`` and a last record beyond that.

Assembly joins the records of a capture on the identifiers that they share, however long
their chain (metadata of a request of a response), and emits one nested row each:
``capture_id, request, main, metadata[]``. Where every record names at most one other, which
names none itself, one join tells so and that one is the capture; else the connected
records are found on tables of identifiers.

Defined cases: null html is an empty payload; null url an empty target; payloads
under ``MIN_REVISIT`` bytes are always responses; rows repeated with one id are
captures of their own (of those with the largest id one is the response); an empty
table gives empty archives; other columns are ignored. A capture without request or
metadata record has null or an empty list there; of several requests or main records
that with the smallest identifier is taken, and metadata stand in the order of theirs;
records that name one another are one capture, and so are those that name a record
which isn't there.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.llm import scratch
from geomill.llm.components import components

MIN_REVISIT = 1000
DATE = "1970-01-01T00:00:00Z"
#: Original payloads known to have copies: about 100 bytes each where broadcast.
BROADCAST_ROWS = 200_000
#: Bytes passed on at once, and so many of these in a file, which one task reads whole.
BATCH_BYTES, FILE_PARTS = 4 << 20, 16

RECORD = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary())])
RECORD_DDL = "record_id string, type string, concurrent_to array<string>, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, block binary"


def plan_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, rid, url, html, payload_digest, payload_bytes, refers_to (capture key, null: a response)."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.monotonically_increasing_id().alias("rid"), F.regexp_replace(F.coalesce(url_col, F.lit("")), r"[\x00-\x20]", "").alias("url"), payload.alias("html")).withColumns({"payload_digest": F.sha1("html"), "payload_bytes": F.octet_length("html").cast("long")})
    last = F.max(F.struct(F.col("page_id").isNotNull().alias("some"), "page_id", "rid"))
    first = rows.where(F.col("payload_bytes") >= min_revisit).select("page_id", "rid", "payload_digest").groupBy("payload_digest").agg(last.alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    originals = scratch.materialize(first.select("payload_digest", F.col("last.page_id").alias("o_page"), F.col("last.rid").alias("o_rid")), "originals")
    few = originals.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(originals) if few else originals, "payload_digest", "left")
    key = F.concat_ws(":", F.coalesce(F.col("o_page").cast("string"), F.lit("")), F.col("o_rid").cast("string"))
    revisit = F.col("o_rid").isNotNull() & (F.col("payload_bytes") >= min_revisit) & (F.col("o_rid") != F.col("rid"))
    return joined.select("page_id", "rid", "url", F.when(~revisit, F.col("html")).alias("html"), "payload_digest", "payload_bytes", F.when(revisit, key).alias("refers_to"))


def _record(kind: str, record_id: str, uri: str, block: bytes, more: list[str], mime: str) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {uri}"] if uri else []), *more, f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, held = [], 0
        for row in batch.to_pylist():
            key, uri = f"{'' if row['page_id'] is None else row['page_id']}:{row['rid']}", row["url"]
            main, digest = f"urn:capture:{key}:main", f"WARC-Payload-Digest: sha1:{row['payload_digest']}"
            path = "/" + uri.partition("://")[2].partition("/")[2]
            host = uri.partition("://")[2].partition("/")[0]
            status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
            own = [
                _record("request", f"urn:capture:{key}:request", uri, f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), [f"WARC-Concurrent-To: <{main}>"], "application/http; msgtype=request"),
                _record("response", main, uri, status + row["html"], [digest], "application/http; msgtype=response")
                if row["refers_to"] is None
                else _record("revisit", main, uri, status, [digest, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:capture:{row['refers_to']}:main>"], "application/http; msgtype=response"),
                _record("metadata", f"urn:capture:{key}:metadata", uri, f"payloadBytes: {row['payload_bytes']}\r\n".encode(), [f"WARC-Concurrent-To: <{main}>"], "application/warc-fields"),
            ]
            out += own
            held += sum(map(len, own))
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["value"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["value"])


def write_warc(captures: DataFrame, path: str) -> None:
    """Write the rows of ``plan_captures`` as .warc.gz files under path."""
    members = captures.mapInArrow(_members, "value binary").select(F.col("value").cast("string"))
    empty = gzip.compress(b"", 6, mtime=0).decode("iso-8859-1")
    members.write.mode("overwrite").option("lineSep", empty).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_PARTS).option("compression", "none").text(path)
    spark = captures.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for file in fs.listStatus(place):
        name = file.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(file.getPath(), spark._jvm.org.apache.hadoop.fs.Path(place, name.removesuffix(".txt") + ".warc.gz"))


def parse_members(data: bytes) -> Iterator[dict]:
    """The records of a .warc.gz file, one gzip member at a time."""
    view, at, held = memoryview(data), 0, b""
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof and at < len(view):
            parts.append(z.decompress(view[at : at + 65536]))
            at += min(65536, len(view) - at) - len(z.unused_data)
        held += b"".join(parts)
        while True:
            head, end, rest = held.partition(b"\r\n\r\n")
            if not end:
                break
            lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
            fields: dict = {"warc-concurrent-to": []}
            for key, _, value in (x.partition(":") for x in lines[1:]):
                if key.strip().lower() == "warc-concurrent-to":  # the one field that may be repeated
                    fields["warc-concurrent-to"].append(value.strip())
                else:
                    fields[key.strip().lower()] = value.strip()
            size = int(fields.get("content-length", 0))
            if len(rest) < size + 4:
                break
            yield fields | {"": rest[:size]}
            held = rest[size + 4 :]


def _row(x: dict, keep_block: bool) -> dict:
    bare = lambda k: x[k].strip("<>") if k in x else None
    kind, block = x.get("warc-type"), x[""]
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in x.get("content-type", "") else block
    digest = hashlib.sha1(payload).hexdigest() if kind == "response" else x.get("warc-payload-digest", "").rpartition(":")[2] or None
    return {"record_id": bare("warc-record-id"), "type": kind, "concurrent_to": [i.strip("<>") for i in x["warc-concurrent-to"]], "target_uri": x.get("warc-target-uri"), "date": x.get("warc-date"), "refers_to": bare("warc-refers-to"), "payload_digest": digest, "payload_bytes": len(payload), "block": block if keep_block or kind == "metadata" else None}


def read_warc(spark: SparkSession, path: str, keep_block: bool = True) -> DataFrame:
    """One row per record of the archives under path; digests and sizes are of the bytes read."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                out, held = [], 0
                for record in parse_members(data.as_py()):
                    out.append(_row(record, keep_block))
                    held += 300 + len(out[-1]["block"] or b"")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(out, RECORD)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select("content").mapInArrow(parse, RECORD_DDL)


def _captures(records: DataFrame) -> DataFrame:
    """(record_id, root) of the records whose capture isn't named after themselves."""
    ids = scratch.materialize(records.select("record_id", F.coalesce("concurrent_to", F.array()).alias("to")).where(F.size("to") > 0), "concurrent")
    chained = ids.select(F.explode("to").alias("t")).join(ids.select("record_id").distinct(), F.col("t") == F.col("record_id"), "left_semi")
    if ids.where(F.size("to") > 1).isEmpty() and chained.isEmpty():
        return ids.select("record_id", F.col("to")[0].alias("root")).distinct()
    return components(ids.select(F.col("record_id").alias("a"), F.explode("to").alias("b"))).select(F.col("node").alias("record_id"), "root")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id (its main record's identifier; without one the identifier that the others name, or their smallest), request, main, metadata[].

    records are read more than once: a written table serves best.
    """
    one = F.struct(*[F.col(c) for c in records.columns])
    roots = _captures(records).select(F.col("record_id").alias("__id"), F.col("root").alias("__root"))
    joined = records.join(roots, F.col("record_id") == F.col("__id"), "left").withColumn("__root", F.coalesce("__root", "record_id"))
    of = lambda *kinds: F.min_by(one, F.when(F.col("type").isin(*kinds), F.col("record_id")))
    nested = joined.groupBy("__root").agg(of("request").alias("request"), of("response", "revisit", "resource", "conversion").alias("main"), F.sort_array(F.collect_list(F.when(F.col("type") == "metadata", one))).alias("metadata"))
    return nested.select(F.coalesce("main.record_id", "__root").alias("capture_id"), "request", "main", "metadata")
