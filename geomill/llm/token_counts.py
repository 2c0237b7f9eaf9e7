"""Token counts of whole texts by a byte-level BPE file, by a two-tier look-up of pre-token lengths.

A text's tokens are those of its pre-tokens, one after another, so its count is the sum
of their lengths in tokens. Tier 1 is a broadcast hash table with the lengths of
frequent pre-tokens; tier 2 is a cache in each worker, which encodes what the table
lacks. Pre-tokens are looked up where their text is and never shuffle.

What is frequent is counted over all texts: each task counts its pre-tokens in a
bounded table and gives out those with a share of its own text of at least one in
``SHARE``, so at most that many rows; of their sums those with a share of all text of at
least one in ``SHARE`` make the table, so at most that many entries of at most
``KEY_CHARS`` characters. What the table holds decides only where a length is found.

Pre-tokens are found by the file's published pattern. ASCII texts, which are most, take
``re``; others ``regex``; and a text with characters outside ``KNOWN``, whose classes
could differ between the versions of Unicode that the libraries were made with, takes
the tokenizer's own pre-tokenizer. Added tokens are cut out first, as the library does.
Long texts are counted in parts cut before a space between two other characters, where a
pre-token always begins.

Defined cases: a null text counts as empty and has no tokens; ids are passed on as they
are, null or repeated; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.llm import memory
from geomill.llm.scratch import materialize

#: Of how many pre-tokens one has to be the same for it to be frequent.
SHARE = 50_000
#: Longer pre-tokens are in neither tier.
KEY_CHARS = 48
#: Entries of a worker's cache (two generations of half as many), and of a task's table of counts.
CACHE, COUNTED = 400_000, 400_000
#: Characters that are taken apart at once.
PART = 1 << 20
# The pattern of pre-tokens, and characters that all versions of Unicode since 6 class alike.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN = regex.compile(r"[\u0000-\u0527\u2000-\u2064\u20a0-\u20b9\u2190-\u21ff\u3000-\u303f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fcb\uac00-\ud7a3]*+")

_ASCII = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII)
_ANY = regex.compile(PATTERN)
_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")


class Pretokens:
    """Texts to pre-tokens, and these to lengths, by the tokenizer file at path."""

    _shared: dict[str, Pretokens] = {}

    @classmethod
    def of(cls, path: str) -> Pretokens:
        """The worker's own for this file."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Added tokens that are cut out just as they are; others send a text that may hold one to the library.
        self.plain = [t.content for t in added if not (t.single_word or t.lstrip or t.rstrip or t.normalized)]
        self.whole = len(self.plain) < len(list(added))
        self.added = regex.compile("|".join(map(regex.escape, sorted(self.plain, key=len, reverse=True)))) if self.plain else None
        self.known, self.old = _Lengths(self), {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """What stands between added tokens, and how many these are."""
        if not self.added or not any(t in text for t in self.plain):
            return [text], 0
        pieces = self.added.split(text)
        return pieces, len(pieces) - 1

    def split(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text without added tokens, in lists of bounded length wherever it can be cut."""
        at = 0
        while at < len(text):
            to = len(text)
            if to - at > PART and (cut := _CUT.search(text, at + PART)):
                to = cut.start()
            part = text[at:to] if (at, to) != (0, len(text)) else text
            if part.isascii():
                yield _ASCII.findall(part)
            elif KNOWN.fullmatch(part):
                yield _ANY.findall(part)
            else:
                yield [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
            at = to

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str, frequent: dict[str, int]) -> int:
        if self.whole:
            return self.encoded(text)
        pieces, n = self.pieces(text)
        for piece in pieces:
            for tokens in self.split(piece):
                found = list(map(frequent.get, tokens))
                n += sum(filter(None, found))
                n += sum(map(self.known.__getitem__, [t for t, k in zip(tokens, found, strict=True) if k is None]))
        return n


class _Lengths(dict):
    """The second tier: lengths of pre-tokens, encoded when first asked for."""

    def __init__(self, own: Pretokens) -> None:
        super().__init__()
        self.own = own

    def __missing__(self, token: str) -> int:
        n = self.own.old.get(token) or self.own.encoded(token)
        if len(token) <= KEY_CHARS:
            if len(self) >= CACHE // 2:
                self.own.old = dict(self)
                self.clear()
            self[token] = n
        return n


memory.kept["token_counts"] = Pretokens._shared


def frequent_pretokens(texts: DataFrame, path: str, share: int = SHARE) -> dict[str, int]:
    """The lengths of the pre-tokens that make up at least one in ``share`` of all in texts (text)."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, total = Pretokens.of(path), Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for piece in own.pieces(text)[0]:
                    for tokens in own.split(piece):
                        total += len(tokens)
                        seen.update(tokens)
                        if len(seen) > COUNTED:
                            seen = Counter({t: n for t, n in seen.items() if n * share >= total and len(t) <= KEY_CHARS})
        out = {t: n for t, n in seen.items() if n * share >= total and len(t) <= KEY_CHARS}
        if total:
            yield pa.RecordBatch.from_pydict({"token": [None, *out], "n": [total, *out.values()]}, pa.schema([("token", pa.string()), ("n", pa.int64())]))
        memory.give_back("token_counts")

    sums = materialize(texts.mapInArrow(tally, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")), "pretokens")
    total = (sums.where("token is null").first() or [None, 0])[1]
    own = Pretokens(path)
    return {r["token"]: own.encoded(r["token"]) for r in sums.where(F.col("token").isNotNull() & (F.col("n") * share >= total)).toLocalIterator()}


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: the tokens of each text as the library gives them for the file at path, without special ones of its own."""
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_pretokens(texts.select("text"), path, share))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = Pretokens.of(path), frequent.value
        for batch in batches:
            n = pa.array([own.count(t, table) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])
        memory.give_back("token_counts")

    sized = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = sized.mapInArrow(count, f"doc_id {dict(texts.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
