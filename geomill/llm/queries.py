"""The queries of these operators over the driver's tables, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.llm.cohorts import retention
from geomill.llm.exact_dedup import exact_duplicates
from geomill.llm.jaccard_join import linked_classes
from geomill.llm.merkle import manifest
from geomill.llm.packing import pack_documents
from geomill.llm.pivot_index import top_k
from geomill.llm.quality import classify
from geomill.llm.scratch import materialize, new_path
from geomill.llm.sentencepieces import encode_documents
from geomill.llm.substring_dedup import repeated_spans
from geomill.llm.suffix_tree import score_documents
from geomill.llm.token_counts import count_tokens
from geomill.llm.url_filter import filter_urls
from geomill.llm.warc import assemble, plan_captures, read_warc, write_warc

#: host/path of each rule, and whether it allows
URL_RULES = [("com/", True), ("example.com/en/", False), ("www.example.com/en/", True), ("net/es/", False), ("net/fr/", False)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(plan_captures(_table(spark, sf_dir, "pages")), path)
    captures = assemble(materialize(read_warc(spark, path, keep_block=False), "records"))
    page = lambda c: F.regexp_extract(c, r"^urn:capture:(-?\d+):", 1).try_cast("long")
    # a revisit has no payload: the size of the one it stands for is in its metadata
    told = F.regexp_extract(F.col("metadata")[0]["block"].cast("string"), r"payloadBytes: (\d+)", 1).cast("long")
    size = F.when(F.col("main.type") == "revisit", told).otherwise(F.col("main.payload_bytes"))
    return captures.select(page(F.col("capture_id")).alias("page_id"), size.alias("payload_bytes"), F.col("main.payload_digest").alias("payload_digest"), F.col("main.type").alias("record_type"), page(F.col("main.refers_to")).alias("refers_to"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(_table(spark, sf_dir, "documents")).drop("text_hash")


def op6_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_classes(_table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention(_table(spark, sf_dir, "clicks"), _table(spark, sf_dir, "clients"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_quality_classifier, op3_sentencepiece, op4_warc, op5_substring_dedup, op6_suffix_tree_scores, op7_jaccard_join, op8_best_fit_packing, op9_url_filters, op10_exact_top_k, op11_token_counts, op12_cohort_retention, op13_merkle_manifest)}



def _crc32(text: str) -> str:
    """SQL of the crc32 of an ASCII text: the reflected polynomial, bit by bit."""
    bit = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    byte = f"list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS UBIGINT[])), lambda x, i: {bit})"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda crc, b: {byte}), CAST(4294967295 AS UBIGINT))"


def _field(column: str, value: str = "") -> str:
    text = f"CAST({value or column} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


_LEAF = "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text"))) + ")"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op4_warc": """
        WITH t AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
             u AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM t)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM u""",
    # a component's smallest id spreads along links, past larger ids only
    "op7_jaccard_join": r"""
        WITH RECURSIVE
             t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
             s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM t),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
             l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
             e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             r(id, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id AND r.root < e.b),
             c AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
        SELECT t.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, t.doc_id) AS component_id FROM t LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = t.doc_id""",
    "op9_url_filters": r"""
        WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
             r(rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
             fit AS (SELECT u.*, rule_host || rule_path AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS k
                     FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1""",
    "op10_exact_top_k": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
             k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20""",
    "op12_cohort_retention": f"""
        WITH c AS (SELECT *, {_crc32("CAST(click_id AS VARCHAR)")} AS h FROM (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL)),
             k AS (SELECT *, coalesce(arrived_at + to_days(CAST(CASE WHEN h % 3 = 0 THEN h % 100 ELSE 0 END AS INTEGER)) < TIMESTAMP '2024-03-01 00:00:00', false) AS early FROM c),
             s AS (SELECT state, k.* FROM k JOIN (VALUES (0), (1)) v(state) ON state = 1 OR early),
             f AS (SELECT state, client_id, min(ts) AS start FROM s WHERE kind = 'purchase' GROUP BY 1, 2),
             m AS (SELECT client_id, count(DISTINCT epoch_us(start) // 259200000000) > 1 AS moved FROM f GROUP BY 1),
             p AS (SELECT state, client_id, epoch_us(start) // 259200000000 AS cohort, (epoch_us(ts) - epoch_us(start)) // 259200000000 AS period, sum(coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0)) AS cents
                   FROM s JOIN f USING (state, client_id) WHERE ts >= start GROUP BY 1, 2, 3, 4)
        SELECT state, coalesce(city, '') AS segment, cohort, period, count(*) AS users, CAST(sum({_crc32("CAST(p.client_id AS VARCHAR)")}) AS BIGINT) AS users_crc32,
               CAST(sum(CAST(moved AS INTEGER)) AS BIGINT) AS moved, CAST(sum(cents) AS BIGINT) AS cents
        FROM p JOIN m USING (client_id) LEFT JOIN clients USING (client_id) GROUP BY 1, 2, 3, 4""",
    # up: all nodes of the sources' trees; top: of the tree over them; path: what stands beside a leaf's ancestors
    "op13_merkle_manifest": f"""
        WITH RECURSIVE
             d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_LEAF} AS leaf,
                          CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_LEAF.replace(_field("text"), _field("text", _LOWER))} END AS changed FROM documents),
             l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
             up(tree, lvl, pos, n, dig) AS (SELECT tree, 0, pos, n, leaf FROM l
                   UNION ALL SELECT tree, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(dig, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 16, n),
             sub AS (SELECT tree, dig, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
             top(lvl, pos, n, dig) AS (SELECT 0, pos, n, dig FROM sub
                   UNION ALL SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(dig, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 16, n),
             beside AS (SELECT l.tree, l.pos, lvl, string_agg(dig, '' ORDER BY up.pos) FILTER (up.pos < l.pos >> (4 * lvl)) AS b, string_agg(dig, '' ORDER BY up.pos) FILTER (up.pos > l.pos >> (4 * lvl)) AS a
                        FROM l JOIN up ON up.tree = l.tree AND up.n > 1 AND up.pos // 16 = l.pos >> (4 * lvl + 4) GROUP BY 1, 2, 3
                        UNION ALL
                        SELECT l.tree, l.pos, 100 + lvl, string_agg(top.dig, '' ORDER BY top.pos) FILTER (top.pos < sub.pos >> (4 * lvl)), string_agg(top.dig, '' ORDER BY top.pos) FILTER (top.pos > sub.pos >> (4 * lvl))
                        FROM l JOIN sub USING (tree) JOIN top ON top.n > 1 AND top.pos // 16 = sub.pos >> (4 * lvl + 4) GROUP BY 1, 2, 3),
             path AS (SELECT tree, pos, coalesce(b, '') AS b, coalesce(a, '') AS a, row_number() OVER (PARTITION BY tree, pos ORDER BY lvl) - 1 AS step FROM beside),
             proof AS (SELECT tree, pos, sha256(string_agg(b || a, '' ORDER BY step)) AS proof_sha256, count(*) AS steps FROM path GROUP BY 1, 2),
             folded(tree, pos, step, dig) AS (SELECT tree, pos, 0, coalesce(changed, leaf) FROM l
                   UNION ALL SELECT f.tree, f.pos, f.step + 1, sha256(b || dig || a) FROM folded f JOIN path ON path.tree = f.tree AND path.pos = f.pos AND path.step = f.step)
        SELECT doc_id, leaf, sub.dig AS subroot, top.dig AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.dig AS folded_root, f.dig = top.dig AS verified
        FROM l JOIN sub USING (tree) JOIN top ON top.n = 1 LEFT JOIN proof ON proof.tree = l.tree AND proof.pos = l.pos JOIN folded f ON f.tree = l.tree AND f.pos = l.pos AND f.step = coalesce(steps, 0)""",
}
