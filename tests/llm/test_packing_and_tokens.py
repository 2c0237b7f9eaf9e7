import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from geomill.llm import tokens
from geomill.llm.packing import best_fit, pack_documents
from geomill.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


TEXTS = ["", "  ", "The THE the, don't it's IT'S", "naïve Straße ÉTÉ İstanbul ΣΑΣ", "H̱ ẖ A\u0301b", "a<|endoftext|>b <|startoftext|>", "日本語 😀👍🏽 ▁ \u00a0x\u2003y", "12a3 #$%&!! x'''y ''s 'll", "\x00\x1c\x85", "word.,!word ...word é.é,è!", "ﬁ Å K ſ ǆ", "ñandú, ñ! ÀÉÎõü." * 30]
ADDED = [f(t) for t in ("<|startoftext|>", "<|endoftext|>") for f in (str, str.upper, str.title, str.swapcase, lambda t: "a" + t + "b.", lambda t: "A" + t.upper() + "B.", lambda t: f"The {t}, THE {t.upper()}!", lambda t: t[:5] + " " + t[5:])]


def test_ids_equal_the_library(library):
    r = random.Random(2)
    alphabet = "abcXYZ éÉßñÅİ\u0301\u0307.,!?'#<|>1 2\n\t日😀"
    texts = TEXTS + ADDED + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    got = WordEncoder(PATH).encode([t.encode() for t in texts])
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_small_cache(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    e = WordEncoder(PATH)
    for t in (TEXTS + ADDED) * 2:
        assert np.frombuffer(e.encode([t.encode()])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(score):
    r = np.random.default_rng(3)
    lengths = r.integers(1, 400, 500)
    s, o = best_fit(lengths, capacity=1000, documents=7, attention=300_000, score=score)
    assert np.bincount(s, lengths).max() <= 1000 and np.bincount(s).max() <= 7 and np.bincount(s, lengths**2).max() <= 300_000
    for k in np.unique(s):
        at = np.flatnonzero(s == k)
        at = at[np.argsort(o[at])]
        assert o[at].tolist() == (np.cumsum(lengths[at]) - lengths[at]).tolist()
    s, _ = best_fit(lengths, capacity=1000)
    assert s.max() + 1 <= np.ceil(lengths.sum() / 1000) + 1


def plain_best_fit(lengths, capacity, documents, attention, weights, score):
    """Every piece, longest first, looks at every open sequence with room; the first of the best ones gets it."""
    open_, place = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n, best, at = lengths[i], None, None
        for k, (t, d, a) in enumerate(open_):
            if t < n or d < 1 or a < n * n:
                continue
            if score == "norm":
                value = -sum(w * (x / cap) ** 2 for w, x, cap in zip(weights, (t - n, d - 1, a - n * n), (capacity, documents, attention), strict=True))
            else:
                value = sum(w * x * y / cap**2 for w, x, y, cap in zip(weights, (n, 1, n * n), (t, d, a), (capacity, documents, attention), strict=True))
            if best is None or value > best + 1e-12:
                best, at = value, k
        if at is None:
            open_.append([capacity, documents, attention])
            at = len(open_) - 1
        t, d, a = open_[at]
        place[i] = capacity - t
        open_[at] = [t - n, d - 1, a - n * n]
        place[i] = (at, place[i])
    return place, open_


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize(("documents", "attention"), [(4096, 4096**2), (5, 4096**2), (4096, 5_000_000), (6, 6_000_000)])
def test_best_fit_equals_a_plain_packer(score, documents, attention):
    """Loads, not members, are compared: of equal scores the one or the other sequence may get a piece."""
    r = np.random.default_rng(documents + attention)
    lengths = np.minimum(4095, r.lognormal(6.2, 1.0, 400).astype(np.int64) + 1)
    s, _ = best_fit(lengths, 4096, documents, attention, score=score)
    _, want = plain_best_fit(lengths.tolist(), 4096, documents, attention, (1.0, 0.05, 0.05), score)
    assert s.max() + 1 == len(want)
    assert sorted(np.bincount(s, lengths).astype(int)) == sorted(4096 - t for t, _, _ in want)


def test_each_capacity_can_decide():
    """On lengths like those of documents, tighter limits on documents and attention need more sequences."""
    lengths = np.minimum(4095, np.random.default_rng(8).lognormal(5.5, 1.0, 2000).astype(np.int64) + 1)
    need = [best_fit(lengths, 4096, d, a)[0].max() + 1 for d, a in ((4096, 4096**2), (6, 4096**2), (4096, 2_000_000))]
    assert need[0] <= np.ceil(lengths.sum() / 4096) * 1.01 + 1 and min(need[1:]) > need[0]


def test_ties_and_limits():
    s, o = best_fit(np.array([5, 5, 5, 5]), capacity=10)
    assert sorted(zip(s, o, strict=True)) == [(0, 0), (0, 5), (1, 0), (1, 5)]
    assert best_fit(np.empty(0, np.int64))[0].tolist() == []
    assert sorted(best_fit(np.array([8, 8, 8]), capacity=100, documents=1)[0]) == [0, 1, 2]


def test_pieces_make_up_the_documents(spark, documents, odd_rows, library):
    got = pack_documents(documents(odd_rows), PATH, keep_ids=True).toPandas()
    want = {}
    for i, t in odd_rows:
        want.setdefault(i, []).append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    assert set(got.doc_id.dropna()) | {None} == set(want)
    for i, docs in want.items():
        own = got[got.doc_id.isna()] if i is None else got[got.doc_id == i]
        ids = docs[0]
        assert sorted(zip(own.piece, own.start, own.length, strict=True)) == sorted((k, s, min(4096, len(ids) - s)) for _ in docs for k, s in enumerate(range(0, len(ids), 4096)))
        for r in own.itertuples():
            cut = ids[r.start : r.start + r.length].tobytes()
            assert r.ids == cut and r.ids_crc32 == zlib.crc32(cut)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 4096 and (g.offset == g.length.cumsum() - g.length).all()
    assert got.sequence_id.nunique() <= got[got.length == 4096].shape[0] + np.ceil(got[got.length < 4096].length.sum() / 4096) + 1
    assert pack_documents(documents([]), PATH).count() == 0
