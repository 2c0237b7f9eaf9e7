"""The stages one after another, each against its rule."""

import public_tokenizers
import pytest
from test_substring_dedup import plain_spans
from tokenizers import Tokenizer

import corpus_pipeline
from geomill.llm.jaccard_join import string_set
from geomill.llm.quality import THRESHOLD, classify
from geomill.llm.queries import QUERIES
from geomill.llm.substring_dedup import MIN_WORDS


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, sf).write.parquet(path)
        out.append((docs.toPandas(), spark.read.parquet(path).toPandas()))
        docs = spark.read.parquet(path)
    return out


def test_rejected_documents_go(spark, stages):
    before, after = stages[0]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").toPandas().set_index("doc_id")
    assert set(after.columns) == set(before.columns)
    left = labels[labels.index.isin(after.doc_id)]
    assert (left.quality == 1).mean() > 0.95
    clean = labels[(labels.quality == 1) & (labels.toxic == 0)]
    assert clean.index.isin(after.doc_id).mean() > 0.97


def test_those_that_stay_reach_the_threshold(spark, stages):
    """The stage keeps just what the classifier, whose posteriors are tested against plain sums, judges good."""
    sf = "/root/testdata/sf0.001"
    judged = classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    assert set(stages[0][1].doc_id) == set(judged.doc_id[judged.posterior >= THRESHOLD]) != set(judged.doc_id)


def test_no_equal_texts_stay(stages):
    before, after = stages[1]
    normal = lambda t: " ".join(t.split())
    assert after.text.map(normal).is_unique and set(after.text.map(normal)) == set(before.text.map(normal))


def test_no_near_copies_stay(stages):
    before, after = stages[2]
    sets = [string_set(t.encode(), 5) for t in after.text]
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            assert both * 100 < (len(sets[a]) + len(sets[b]) - both) * 80
    assert set(after.doc_id) <= set(before.doc_id) and list(after.columns) == list(before.columns)


def test_repeats_are_cut(stages):
    before, after = stages[3]
    assert set(after.doc_id) == set(before.doc_id) and (after.n_chars == after.text.str.len()).all()
    spans = {}
    for i, start, length, *_ in plain_spans(list(zip(before.doc_id, before.text, strict=True)), MIN_WORDS):
        spans.setdefault(i, []).append((start, start + length))
    assert spans
    left = dict(zip(after.doc_id, after.text, strict=True))
    for i, text in zip(before.doc_id, before.text, strict=True):
        raw, at, kept = text.encode(), 0, b""
        for s, e in sorted(spans.get(i, [])):
            kept, at = kept + raw[at:s], e
        assert left[i] == (kept + raw[at:]).decode()


def test_all_that_stays_is_packed(stages):
    before, after = stages[4]
    assert set(after.doc_id) == set(before.doc_id)
    filled = after.groupby("sequence_id").length.sum()
    assert filled.max() <= 4096 and len(filled) <= -(-filled.sum() // 4096) * 1.02 + 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in zip(before.doc_id, before.text, strict=True)}
    assert after.groupby("doc_id").length.sum().to_dict() == want


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == len(stages[-1][1])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
