import gzip
import hashlib
import math
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomill.llm import pivot_index, quality, url_filter, warc
from geomill.llm.pivot_index import top_k
from geomill.llm.quality import classify, keep_good
from geomill.llm.queries import URL_RULES, op4_warc
from geomill.llm.url_filter import DigestIndex, filter_urls
from geomill.llm.warc import assemble, parse_members, plan_captures, read_warc, write_warc

# --- WARC


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, rid string, refers_to string").repartition(2)


ROWS = [(1, "http://a.b/x y", "é" * 600), (2, None, "é" * 600), (3, "https://c.d/p?q#f", None), (4, "u", ""), (5, "http://e/", "short"), (6, "http://e/", "short"), (7, "http://f/", "line\r\n\r\nWARC/1.1\r\n" * 200), (None, "http://n/", "x" * 1000), (8, "http://r/", "r" * 5000), (8, "http://r/", "r" * 5000)]


def test_round_trip(spark, tmp_path):
    write_warc(plan_captures(pages(spark, ROWS)), str(tmp_path / "w"))
    records = read_warc(spark, str(tmp_path / "w"))
    assert records.groupBy("type").count().collect() and records.count() == 3 * len(ROWS)
    captures = assemble(records).collect()
    assert len(captures) == len(ROWS)
    payloads = sorted(hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in ROWS)
    assert sorted(c.main.payload_digest for c in captures) == payloads
    for c in captures:
        assert c.request.type == "request" and len(c.metadata) == 1 and c.request.concurrent_to == [c.main.record_id] == [c.capture_id]
        body = c.main.block.partition(b"\r\n\r\n")[2]
        assert hashlib.sha1(body).hexdigest() == c.main.payload_digest if c.main.type == "response" else not body
    revisits = [c.main for c in captures if c.main.type == "revisit"]
    assert len(revisits) == 2 and all(m.refers_to in {c.main.record_id for c in captures if c.main.type == "response"} for m in revisits)


def test_files_are_gzip_members(spark, tmp_path):
    write_warc(plan_captures(pages(spark, ROWS)), str(tmp_path / "w"))
    assert {f.name.partition(".")[2] for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")} == {"warc.gz"}
    for f in (tmp_path / "w").glob("*.warc.gz"):
        data = f.read_bytes()
        whole = gzip.decompress(data)
        assert len(list(parse_members(data))) == whole.count(b"WARC-Record-ID:")
        z = zlib.decompressobj(31)
        assert z.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: request") and z.eof


def test_parser_takes_other_layouts():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    one_member = gzip.compress(record * 3)
    assert [r[""] for r in parse_members(one_member)] == [b"abc"] * 3
    assert [r[""] for r in parse_members(b"".join(gzip.compress(record) for _ in range(3)))] == [b"abc"] * 3


def test_missing_records_are_null(spark):
    r = spark.createDataFrame([("m", "response", None), ("q", "request", ["x"])], "record_id string, type string, concurrent_to array<string>")
    got = {c.capture_id: c for c in assemble(r).collect()}
    assert got["m"].request is None and got["m"].metadata == [] and got["x"].main is None


@pytest.mark.parametrize("back", [[], ["q2"]])
def test_chains_of_identifiers(spark, back):
    """Metadata of a request of a response, records that name several, and such as name each other."""
    rows = [("m1", "response", []), ("q1", "request", ["m1"]), ("d1", "metadata", ["q1"]), ("d0", "metadata", ["d1", "m1"]), ("m2", "revisit", back), ("q2", "request", ["m2"]), ("d2", "metadata", ["q2", "m2"]), ("m3", "response", None), ("d9", "metadata", ["gone"])]
    r = spark.createDataFrame(rows, "record_id string, type string, concurrent_to array<string>").repartition(3)
    got = {c.capture_id: (c.request and c.request.record_id, c.main and c.main.record_id, [d.record_id for d in c.metadata]) for c in assemble(r).collect()}
    assert got.pop("m1") == ("q1", "m1", ["d0", "d1"]) and got.pop("m2") == ("q2", "m2", ["d2"]) and got.pop("m3") == (None, "m3", [])
    assert list(got.values()) == [(None, None, ["d9"])]


def test_repeated_fields_and_sizes_of_files(spark, tmp_path, monkeypatch):
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <d>\r\nWARC-Concurrent-To: <a>\r\nwarc-concurrent-to: <b>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert [r["warc-concurrent-to"] for r in parse_members(gzip.compress(record))] == [["<a>", "<b>"]]
    monkeypatch.setattr(warc, "FILE_PARTS", 1)
    r = random.Random(1)
    rows = [(i, "http://a/", r.randbytes(30_000).hex()) for i in range(400)]
    write_warc(plan_captures(pages(spark, rows)), str(tmp_path / "w"))
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("*.warc.gz")]
    assert max(sizes) < warc.BATCH_BYTES + 100_000 and len(sizes) >= 4
    assert read_warc(spark, str(tmp_path / "w"), keep_block=False).count() == 1200


def test_empty_pages(spark, tmp_path):
    write_warc(plan_captures(pages(spark, [])), str(tmp_path / "w"))
    assert read_warc(spark, str(tmp_path / "w")).count() == 0


def test_large_groups_join_by_shuffle(spark, sf, monkeypatch):
    want = sorted(map(tuple, op4_warc(spark, sf).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, op4_warc(spark, sf).collect()), key=repr) == sorted(want, key=repr)


# --- URL filters


def plain_verdict(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = max((r for r, _ in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])), key=len, default=None)
    return host, path, best, "allow" if best is None or dict(URL_RULES)[best] else "block"


def test_urls_equal_plain_rules(spark):
    r = random.Random(1)
    urls = [None, "", "no scheme", "http://", "http://com", "HTTP://WWW.Example.COM/en/x", "http://xcom/en/", "http://.com/", "x://a.net/es/?u=http://b.com/", "http://a.net/es", "http://example.com/en/\n", "http://ÉX.com/é", "http://a.com#/en/"]
    urls += ["http://" + r.choice(["", "www.", "a.b.", "x"]) + r.choice(["example.com", "net", "foo.net", "com", "example.org"]) + r.choice(["", "/", "/en/1", "/es/", "/fr/x?y", "/en", "#/en/"]) for _ in range(300)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(3)
    got = {x.page_id: tuple(x)[1:] for x in filter_urls(df, URL_RULES).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(urls)}
    assert filter_urls(df.limit(0), URL_RULES).count() == 0
    assert {x.verdict for x in filter_urls(df, [], default_allow=False).collect()} == {"block"}


def test_rules_of_a_table(spark):
    r = random.Random(7)
    rules = {f"{h}{p}": r.random() < 0.5 for h in ("com", "a.com", "b.a.com", "net", "x.y.z.net", "é.org") for p in ("/", "/en/", "/en/x", "/fr")}
    urls = [f"http://{r.choice(['', 'b.', 'q.b.', 'x.y.z.', 'y.z.'])}{r.choice(['a.com', 'net', 'com', 'é.org'])}{r.choice(['/', '/en/', '/en/xy', '/fr?', ''])}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([*rules.items(), (None, True), *[(k, True) for k in list(rules)[:5]]], "rule string, allow boolean").repartition(4)
    want = sorted(map(tuple, filter_urls(df, rules.items()).collect()), key=repr)
    assert sorted(map(tuple, filter_urls(df, table).collect()), key=repr) == want
    assert {x.verdict for x in filter_urls(df, table.limit(0)).collect()} == {"allow"}


def test_hosts_of_very_many_labels(tmp_path):
    (tmp_path / "i").write_bytes(b"".join(DigestIndex.parts([("a.b/", False), ("c/x", True)])))
    index, began = DigestIndex(str(tmp_path / "i")), time.process_time()
    assert index.judge(["x." * 200_000 + "a.b", "." * 100_000, ".a.b", "a.b.", ""], ["/"] * 5) == [("a.b/", False), None, ("a.b/", False), None, None]
    assert time.process_time() - began < 1


def test_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "key", lambda text: len(text) % 2)
    (tmp_path / "i").write_bytes(b"".join(DigestIndex.parts([("a.b/", False), ("c.d/x", True), ("a.b/", True)])))
    index = DigestIndex(str(tmp_path / "i"))
    assert index.find(["a.b/", "c.d/x", "e.f/", "zz"]) == [True, True, None, None]
    assert index.judge(["www.c.d", "c.d"], ["/xy", "/y"]) == [("c.d/x", True), None]


# --- top-k


def brute_top(rows, k, scale=64):
    ok = [(i, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in ok:
        if q % 5 == 0:
            out[q] = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q))[:k]
    return {(q, r + 1): (i, -s) for q, found in out.items() for r, (s, i) in enumerate(found)}


@pytest.mark.parametrize(("shard", "annulus", "block"), [(4096, 256, 4096), (32, 4, 8)])
def test_top_k_equals_brute_force(spark, monkeypatch, shard, annulus, block):
    for name, value in (("SHARD", shard), ("ANNULUS", annulus), ("QUERY_BLOCK", block), ("PIVOTS", 9)):
        monkeypatch.setattr(pivot_index, name, value)
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + r.normal(size=8) * 0.2).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # equal vectors: ties
    rows += [(2000, None), (2005, [float("nan")] * 8), (2010, [1.0, None] * 4), (2015, [float("inf")] * 8), (None, rows[0][1]), (2020, [0.0] * 8)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in top_k(df, F.col("vec_id") % 5 == 0, k=7).collect()}
    assert got == brute_top(rows, 7)


def test_top_k_of_odd_vectors(spark):
    """Vectors of no or another length than most take no part; large components are multiplied exactly."""
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (5, []), (6, [3.0]), (7, [9.0, 9.0, 9.0]), (8, [0.0, 1.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in top_k(df, F.col("vec_id") % 5 == 0, k=7).collect()}
    assert got == {(0, 1): (1, 64 * 64 * 4), (0, 2): (8, 64 * 64 * 2)}
    assert top_k(df.where("vec_id in (5, 10)"), F.col("vec_id") % 5 == 0).count() == 0
    big = [(i, [float(2**23 + i), float(2**22 - 3 * i), float(i)]) for i in range(40)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in top_k(df, F.col("vec_id") % 5 == 0, k=7).collect()}
    assert got == brute_top([(i, v) for i, v in big], 7)


def test_top_k_of_one_vector_in_very_many_rows(spark, monkeypatch):
    """Equal rows fill several shards, and their queries go to several."""
    monkeypatch.setattr(pivot_index, "SHARD", 16)
    monkeypatch.setattr(pivot_index, "SLICE", 7)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i % 7), 1.0, -1.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in top_k(df, F.col("vec_id") % 5 == 0, k=5).collect()}
    assert got == brute_top(rows, 5)


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


# --- quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train = labels.where("doc_id % 3 <> 0")
    judged = classify(docs, train).join(labels.where("doc_id % 3 = 0"), "doc_id")
    r = judged.agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int")).alias("accuracy"), F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("keep").cast("int"))).alias("kept")).first()
    assert r.accuracy > 0.97 and r.kept > 0.98


def plain_posteriors(rows, site_weight):
    """(host_p, path_p, posterior) of each (id, host, path, evidence), sum by sum."""
    n = len(rows)
    mean = sum(r[3] for r in rows) / n

    def groups(key):
        out = defaultdict(list)
        for r in rows:
            out[key(r)].append(r[3])
        return out

    def prior(found):
        spread = sum(len(x) * (sum(x) / len(x) - mean) ** 2 for x in found.values()) / n - mean * (1 - mean) * len(found) / n
        return min(max(mean * (1 - mean) / max(spread, 1e-6) - 1, 2.0), 1000.0)

    hosts, paths = groups(lambda r: r[1]), groups(lambda r: (r[1], r[2]))
    hw, pw = prior(hosts), prior(paths)
    logit = lambda p: math.log(p / (1 - p))
    out = {}
    for i, h, p, e in rows:
        host = (sum(hosts[h]) + hw * mean) / (len(hosts[h]) + hw)
        path = (sum(paths[h, p]) + pw * host) / (len(paths[h, p]) + pw)
        shift = min(max(logit(min(max(path, 1e-4), 1 - 1e-4)) - logit(mean), -3.0), 3.0)
        out[i] = (host, path, 1 / (1 + math.exp(-(logit(e) + site_weight * shift))))
    return out


def test_posteriors_equal_plain_sums(spark):
    """Many sites of one to forty documents, of different quality, null ones among them."""
    r = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        host = None if i % 50 == 0 else f"h{int(r.paretovariate(0.7)) % 120}"
        path = None if i % 70 == 0 else f"p{i % 3}"
        good = r.random() < (0.9 if host and int(host[1:]) % 2 else 0.3)
        rows.append((i, ("many kinds of plain words stand in this sentence " if good else "BUY!! NOW!! $$$ ") * r.randint(1, 9) + str(i), path, host))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    got = classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain_posteriors([(x.doc_id, x.host, x.path, x.evidence) for x in got], quality.SITE_WEIGHT)
    assert len(got) == 900 and len({(x.host, x.path) for x in got}) > 100
    for x in got:
        assert (x.host_p, x.path_p, x.posterior) == pytest.approx(want[x.doc_id], abs=1e-6)
        assert x.keep == (x.posterior >= quality.THRESHOLD)


def test_sparse_sites_stay_near_the_prior(spark):
    rows = [(i, "good text of many kinds of words here", "x", "big", 0) for i in range(200)] + [(1000 + i, "BAD!! BAD!! ###", "x", "bad", 0) for i in range(200)] + [(5000, "BAD!! BAD!! ###", "x", "tiny", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.select("doc_id", (F.col("source") == "big").cast("int").alias("quality"), F.lit(0).alias("toxic")).where("doc_id % 2 = 0 and doc_id < 5000")
    p = {r.host: r.path_p for r in classify(docs, labels).select("host", "path_p").distinct().collect()}
    assert p["bad"] < 0.1 < p["tiny"] < 0.6 < p["big"]


def test_odd_quality_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert classify(docs, none).count() == len(odd_rows)
    one = spark.createDataFrame([(4, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert keep_good(docs, one).columns == docs.columns and keep_good(docs, one).count() == len(odd_rows)
    both = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (11, 1, 0)], "doc_id long, quality int, toxic int")
    assert classify(docs, both).where("posterior is null").count() == 0
    assert classify(docs.limit(0), both).count() == 0
