import random

import numpy as np
import pytest

from geomill.llm import substring_dedup
from geomill.llm.substring_dedup import candidates, chunk_ends, drop_repeats, repeated_spans


def test_rolling_hash_equals_plain_sum(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(3000).replace(b"e", b" ").replace(b"a", b"\n"), np.uint8)
    want = []
    for i in range(len(data)):
        h = sum(int(substring_dedup._GEAR[data[i - j]]) << j for j in range(16) if i - j >= 0) & 0xFFFF
        if substring_dedup._SPACE[data[i]] and h * substring_dedup.ONE_IN < 1 << 16:
            want.append(i + 1)
    assert candidates(data).tolist() == want
    monkeypatch.setattr(substring_dedup, "BLOCK", 100)
    assert candidates(data).tolist() == want


def test_chunks_cover_the_text_between_characters():
    text = ("é" * 700 + " some words here " * 40 + "日本" * 300).encode()
    data = np.frombuffer(text, np.uint8)
    ends = chunk_ends(data, candidates(data).tolist())
    assert ends[-1] == len(text) and ends == sorted(set(ends))
    parts = [text[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
    assert all(len(p) <= substring_dedup.MOST for p in parts) and "".join(p.decode() for p in parts) == text.decode()


@pytest.fixture
def planted(words):
    """Documents of their own, ten passages of 51 to 90 words put into three of them each, and a common first line."""
    r = random.Random(9)
    texts = {i: ("A common line of few words.\n" if i % 2 else "") + words(r.randint(150, 400), 1000 + i) for i in range(60)}
    where = {}
    for k in range(10):
        passage, three = words(51 + 4 * k, 5000 + k), sorted(r.sample(range(60), 3))
        for i in three:
            w = texts[i].split(" ")
            at = r.randrange(len(w))
            texts[i] = " ".join([*w[:at], passage, *w[at:]])
        where[passage] = three
    return list(texts.items()), where


def test_planted_passages_are_found_and_clean_texts_left(documents, planted):
    rows, where = planted
    got = repeated_spans(documents(rows)).collect()
    pairs = {(r.doc_id, r.first_doc_id) for r in got}
    for three in where.values():
        assert all(any(d == i for d, _ in pairs) for i in three[1:]), three
    touched = {i for three in where.values() for i in three}
    assert {d for d, _ in pairs} <= touched
    texts = dict(rows)
    for r in got:
        span = texts[r.doc_id].encode()[r.start : r.start + r.length].decode()
        assert any(span.strip() in p for p in where) and len(span.split()) == r.n_words >= substring_dedup.MIN_WORDS


def plain_spans(rows, min_words):
    """Chunks of all texts in order of id, text and place: what was there before is a repeat, and neighbouring repeats are one span."""
    first, out = {}, set()
    for i, t in sorted(rows):
        data = np.frombuffer(t.encode(), np.uint8)
        ends = chunk_ends(data, candidates(data).tolist()) if len(data) else []
        run = []
        for s, e in [*zip([0, *ends], ends), (None, None)]:
            chunk = None if s is None else t.encode()[s:e]
            if chunk is not None and chunk in first:
                run.append((s, e, first[chunk]))
                continue
            if run:
                text = t.encode()[run[0][0] : run[-1][1]]
                words = sum(len(t.encode()[a:b].split()) for a, b, _ in run)
                if words >= min_words and len(run) > 1:
                    out.add((i, run[0][0], len(text), words, len(run), *run[0][2]))
            run = []
            if chunk is not None:
                first[chunk] = (i, s)
    return out


def test_spans_equal_a_plain_search(documents, words):
    r = random.Random(11)
    parts = [words(r.randint(5, 90), 70 + k) for k in range(25)]
    rows = [(i, " ".join(r.choice(parts) if r.random() < 0.4 else words(r.randint(3, 60), 10_000 + 50 * i + k) for k in range(r.randint(1, 12)))) for i in range(80)] + [(100 + i, "") for i in range(3)]
    got = {(x.doc_id, x.start, x.length, x.n_words, x.n_chunks, x.first_doc_id, x.first_start) for x in repeated_spans(documents(rows)).collect()}
    want = plain_spans(rows, substring_dedup.MIN_WORDS)
    assert got == want and len(want) > 50


def test_ids_have_to_be_integers(spark):
    with pytest.raises(TypeError, match="integers"):
        repeated_spans(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("few", [True, False])
def test_cut_texts(documents, planted, monkeypatch, few):
    if not few:
        monkeypatch.setattr(substring_dedup, "BROADCAST_SPANS", 0)
    rows, where = planted
    before, out = dict(rows), drop_repeats(documents(rows))
    assert out.columns == documents(rows).columns
    after = {r.doc_id: r for r in out.collect()}
    for passage, three in where.items():
        assert sum(passage in r.text for r in after.values()) <= 1
        assert all(passage not in after[i].text for i in three[1:])
    assert all(r.n_chars == len(r.text) for r in after.values())
    clean = set(before) - {i for three in where.values() for i in three}
    assert all(after[i].text == before[i] for i in clean)


def test_insertions_move_only_near_chunks(words):
    text = words(2000, 3).encode()

    def cut(t):
        data = np.frombuffer(t, np.uint8)
        ends = chunk_ends(data, candidates(data).tolist())
        return {t[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)}

    a, b = cut(text), cut(b"something new " + text)
    assert len(a - b) <= 4


def test_odd_rows(documents, odd_rows):
    out = drop_repeats(documents(odd_rows))
    rows = {(r.doc_id, (r.text or "")[:30]): r.text for r in out.collect()}
    assert out.count() == len(odd_rows)
    assert next(t for (i, _), t in rows.items() if i == 6) == dict(odd_rows)[6]
    assert sum(len(t) for (i, _), t in rows.items() if i == 7) < 300
    assert repeated_spans(documents([])).count() == 0 and drop_repeats(documents([])).count() == 0
