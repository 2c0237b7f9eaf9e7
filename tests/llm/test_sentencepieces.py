import random
import time

import numpy as np
import public_tokenizers
import pytest

from geomill.llm import sentencepieces
from geomill.llm.sentencepieces import SPACE, Pieces, decode_ids, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return Pieces(PATH)


def full_search(p, text):
    """The best path by one table over the whole text."""
    best, back = [0.0], [0]
    for end in range(1, len(text) + 1):
        options = []
        for s in range(max(0, end - p.longest), end):
            score = p.scores.get(text[s:end], p.missing if s == end - 1 else None)
            if score is not None:
                options.append((best[s] + score, -s))
        top, s = max(options)
        best.append(top)
        back.append(-s)
    out, at = [], len(text)
    while at:
        out.append(text[back[at] : at])
        at = back[at]
    return out[::-1]


def texts():
    r = random.Random(5)
    alphabet = ["the", "ing", " ", "  ", "a", "e", "s", "tion", "\n", "é", "日", "😀", SPACE, "!", "0", "th"]
    return ["", " ", "Hello world", "a\nb  c", "\x00", *["".join(r.choices(alphabet, k=r.randint(1, 60))) for _ in range(300)]]


def test_streaming_equals_the_full_search(pieces):
    for t in texts():
        t = SPACE + t.replace(" ", SPACE)
        got = [piece for piece, _ in pieces.search(t)]
        assert "".join(got) == t
        score = lambda path: sum(pieces.scores.get(x, pieces.missing) for x in path)
        want = full_search(pieces, t)
        assert got == want or abs(score(got) - score(want)) < 1e-6 * abs(score(want)), t


def test_stretches_change_nothing(pieces):
    for t in texts():
        whole = [i for piece, k in (pieces.search(SPACE + t.replace(" ", SPACE)) if t else ()) for i in ([k] if k is not None else [pieces.byte_ids[b] for b in piece.encode()])]
        assert np.frombuffer(pieces.encode(t), "<u4").tolist() == whole, t


@pytest.mark.parametrize(("text", "meets"), [("the" * 40_000, True), ("a" * 100_000, False), ("." * 100_000, True), ("日a" * 50_000, True)])
def test_window_stays_short(pieces, text, meets):
    """Scores are kept for what the longest piece reaches, boundaries for surviving paths alone; the time is linear."""
    found, widest, pending, began = pieces.search(text), 0, 0, time.process_time()
    length = 0
    for piece, _ in found:
        length += len(piece)
        if found.gi_frame is not None and length < len(text) - pieces.longest:
            widest, pending = max(widest, len(found.gi_frame.f_locals["best"])), max(pending, len(found.gi_frame.f_locals["start"]))
    assert length == len(text) and widest <= pieces.longest + 1 and pending <= (16 * pieces.longest if meets else len(text))
    assert time.process_time() - began < 8


def test_decode_drops_the_first_mark_only(pieces):
    packed = lambda *names: np.array([pieces.ids[n] if isinstance(n, str) else n for n in names], "<u4").tobytes()
    assert pieces.decode(packed("the")) == "the" and pieces.decode(packed(SPACE + "the")) == "the"
    assert pieces.decode(packed(1, SPACE + "the", SPACE + "the")) == "the the" and pieces.decode(packed(pieces.byte_ids[32], "the")) == " the"
    assert pieces.decode(b"") == "" and pieces.decode(packed(SPACE)) == ""


def test_round_trip(spark, documents, odd_rows, monkeypatch):
    monkeypatch.setattr(sentencepieces, "CACHE", 5)
    enc = encode_documents(documents(odd_rows), PATH, keep_ids=True)
    rows = enc.collect()
    assert len(rows) == len(odd_rows) and all(r.round_trip for r in rows)
    back = sorted(r.text for r in decode_ids(enc, PATH).collect())
    assert back == sorted((t or "").replace(SPACE, " ") for _, t in odd_rows)
    assert encode_documents(documents([]), PATH).count() == 0
