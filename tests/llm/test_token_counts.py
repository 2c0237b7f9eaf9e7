import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from geomill.llm import token_counts
from geomill.llm.token_counts import Pretokens, count_tokens, frequent_pretokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "\n\n  a", "it's IT'S 'tis we'll'x  '' 's", "a<|endoftext|>b<|endoftext|>", "<|endoftext|", "<<|endoftext|>|endoftext|>", "  <|endoftext|>  \n", "12 345a6 ½ ²  Ⅷ", "\x00\x1c\x1f\x85   ​﻿", "naïve Straße É́", "日本語、テスト。 한국어", "😀👍🏽 ▁", "࢏\U00033450 ꟎x", "x" * 3000, "a \t b\r\n\r\n c   "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    alphabet = "abcXYZ éÉßñ́.,!?'#<|>1 2\n\t\x1c  日😀࢏²"
    return TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(1500)]


def of(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("frequent", [{}, {"a": 1, " ": 1, "'s": 1, "\n\n": 1}])
def test_counts_equal_the_library(library, texts, frequent):
    own = Pretokens(PATH)
    for t in texts:
        assert own.count(t, frequent) == of(library, t), t


def test_parts_and_small_caches(library, texts, monkeypatch):
    monkeypatch.setattr(token_counts, "PART", 7)
    monkeypatch.setattr(token_counts, "CACHE", 6)
    own = Pretokens(PATH)
    for t in texts[:400]:
        assert own.count(t, {}) == of(library, t), t
    assert len(own.known) <= 4


def test_characters_taken_for_known_are_classed_alike():
    own = Pretokens(PATH)
    for c in filter(token_counts.KNOWN.fullmatch, map(chr, range(0x10000))):
        t = f"a{c}1{c}; {c}{c} "
        split = token_counts._ASCII if t.isascii() else token_counts._ANY
        assert split.findall(t) == [t[a:b] for _, (a, b) in own.tokenizer.pre_tokenizer.pre_tokenize_str(t)], hex(ord(c))


@pytest.mark.parametrize("share", [1, 3, 50_000])
def test_rows(spark, documents, odd_rows, library, share):
    got = sorted(map(tuple, count_tokens(documents(odd_rows), PATH, share=share).collect()), key=repr)
    want = [(i, len((t or "").encode()), n := of(library, t or ""), n > 512) for i, t in odd_rows]
    assert got == sorted(want, key=repr)


def test_other_ids_and_empty(spark, documents):
    assert count_tokens(documents([]), PATH).collect() == []
    df = spark.createDataFrame([("x", "a b"), (None, None)], "n_tokens string, over_limit string")
    assert {tuple(r) for r in count_tokens(df, PATH, limit=1, id_col="n_tokens", text_col="over_limit").collect()} == {("x", 3, 2, True), (None, 0, 0, False)}


def test_table_of_frequent_pretokens(spark, library):
    rows = [(" the" * 300 + f" word{i}x" + " rarely",) for i in range(40)]
    got = frequent_pretokens(spark.createDataFrame(rows, "text string").repartition(8), PATH, share=400)
    assert got == {t: of(library, t) for t in (" the", " rarely", " word", "x")}


def test_counting_is_bounded(spark, monkeypatch):
    rows = [(" ".join(f"w{i}x{k}" for k in range(50)) + " the" * 50,) for i in range(30)]
    docs = spark.createDataFrame(rows, "text string").coalesce(1)
    assert " the" in frequent_pretokens(docs, PATH, share=10)
