import math
import zlib
from collections import Counter

import numpy as np
import pytest

from geomill.llm import suffix_tree
from geomill.llm.suffix_tree import SuffixTree, grams, score_documents


def plain_counts(streams, depth):
    out = {}
    for s in streams:
        s = b"\n" + s + b"\n"
        for i in range(1, len(s)):
            for k in range(min(depth, i) + 1):
                out.setdefault(s[i - k : i], np.zeros(256))[s[i]] += 1
    return out


def test_grams_count_every_position():
    streams, depth = [b"ab a", b"", b"abcabcabc"], 3
    got = {}
    for code in grams(streams, depth).tolist():
        context, b = (code >> 8).to_bytes(8, "big")[-depth:], code & 255
        for k in range(depth + 1):
            c = context[depth - k :]
            if 0 not in c:
                got.setdefault(c, np.zeros(256))[b] += 1
    want = plain_counts(streams, depth)
    assert got.keys() == want.keys() and all((got[c] == want[c]).all() for c in want)


def test_automaton_takes_the_longest_kept_suffix():
    r = np.random.default_rng(1)
    streams = [bytes(r.choice(list(b"abcd "), 400).tolist()).replace(b"ab", b"abab") for _ in range(20)]
    tree = SuffixTree(plain_counts(streams, 4))
    assert tree.contexts > 5
    # the distribution of each kept context, from its own state
    state = {b"": 0}
    for context in sorted(plain_counts(streams, 4), key=len):
        s = 0
        for b in context:
            s = tree.next[s, tree.classes[b]]
        state[context] = s
    for text in (b"abab dcba", b"", b"zz new bytes", streams[0]):
        own, s, total = b"\n" + text + b"\n", 0, 0.0
        s = tree.next[0, tree.classes[10]]
        for b in own[1:]:
            total += tree.logp[s, tree.classes[b]]
            s = tree.next[s, tree.classes[b]]
        assert tree.scores([text], 4)[0] == pytest.approx(total, rel=1e-6)


def test_probabilities_sum_to_one():
    tree = SuffixTree(plain_counts([b"abracadabra " * 30, b"alakazam " * 20], 4))
    unseen = 256 - int((tree.classes > 1).sum())
    sums = (10.0 ** tree.logp[:, 2:].astype(float)).sum(axis=1) + unseen * 10.0 ** tree.logp[:, 1].astype(float)
    assert np.allclose(sums, 1, atol=1e-5)


def test_long_texts_by_rows(monkeypatch):
    tree = SuffixTree(plain_counts([b"abracadabra " * 30], 4))
    text = b"abracadabra alaka " * 50
    whole = tree.scores([text], 4)[0]
    monkeypatch.setattr(suffix_tree, "ROW", 7)
    monkeypatch.setattr(suffix_tree, "ROWS", 5)
    assert tree.scores([b"x", text], 4)[1] == pytest.approx(whole)


@pytest.mark.parametrize("common", [200_000, 10])
def test_base_scores_equal_brute_force(documents, odd_rows, words, monkeypatch, common):
    monkeypatch.setattr(suffix_tree, "COMMON", common)
    rows = [*odd_rows, *[(100 + i, words(60, i)) for i in range(40)]]
    own = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = Counter(w for i, ws in own if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    got = sorted(score_documents(documents(rows)).collect(), key=lambda r: (repr(r.doc_id), r.n_tokens))
    want = sorted(own, key=lambda x: (repr(x[0]), len(x[1])))
    assert len(got) == len(want)
    for r, (i, ws) in zip(got, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held(i), len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score < 0


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = score_documents(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r.s > r.b


def test_scores_equal_those_of_the_whole_tree(documents, odd_rows, words):
    """Every context seen twice may stay, however small its share, and the tables give the automaton's scores."""
    rows = [*odd_rows, *[(100 + i, words(300, i)) for i in range(40)]]
    streams = [b" ".join((t or "").encode().lower().split()) for _, t in rows]
    train = [s for (i, _), s in zip(rows, streams, strict=True) if not suffix_tree.is_held_out(i)]
    counts = {c: n for c, n in plain_counts(train, suffix_tree.DEPTH).items() if not c or (n.sum() >= suffix_tree.LEAST_COUNT and 0 not in c)}
    want = SuffixTree(counts).scores(streams)
    got = sorted((repr(r.doc_id), r.n_tokens, r.score) for r in score_documents(documents(rows)).collect())
    own = sorted((repr(i), len(s.split()) + 1, w) for (i, _), s, w in zip(rows, streams, want, strict=True))
    assert [g[:2] for g in got] == [w[:2] for w in own]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in own], rel=1e-5)


def test_a_context_stays_whatever_the_size_of_the_corpus():
    """A rare context that tells the next byte is not pushed out by more text of another kind."""
    rare = [b"qqzzyyx"] * 20
    for more in (100, 20_000):
        codes, n = np.unique(suffix_tree.turned(grams([*rare, *[b"ab cd ef gh"] * more], 6), 6), return_counts=True)
        low, below = np.unique(codes >> np.uint64(40) << np.uint64(8) | codes & np.uint64(255), return_inverse=True)
        _, pairs, p = suffix_tree.grow(low, np.bincount(below, n), suffix_tree.LOW, 0)
        levels, _, _ = suffix_tree.grow(codes, n, 6, suffix_tree.LOW, p, pairs)
        assert int.from_bytes(b"zqq", "big") in levels[3][0].tolist()


def test_empty(documents):
    assert score_documents(documents([])).count() == 0
