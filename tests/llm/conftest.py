"""Document tables with the cases that every operator has to stand."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, id string, sha string, hit string"


def table(spark, rows, schema="doc_id long, text string"):
    """rows as documents, with extra columns whose names clash with those that operators use inside."""
    full = [(i, t, "en", f"s{(i or 0) % 3}", len(t) if t is not None else None, "x", "x", "x", "x", "x") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def words():
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(2000)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))


@pytest.fixture(scope="session")
def odd_rows(words):
    """Null ids and texts, blanks, one word, a very long text, a word without end, repeated rows, copies, marks."""
    long = words(30_000, 1)
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "two words"), (6, long), (7, long), (8, "x" * 200_000), (None, "null id here"), (9, "same row"), (9, "same row"), (10, "Same\u00a0é ▁ 日本 😀 <|endoftext|> it's A\u0301"), (11, words(80, 2)), (12, words(80, 2)), (13, "\x00 nul\x00")]


@pytest.fixture
def documents(spark):
    return lambda rows: table(spark, rows)
