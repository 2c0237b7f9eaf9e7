"""Token ids of texts by a public tokenizer file, with a bounded cache of words.

The tokenizer drops white space and never joins across it, so a text's ids are its
words' ids one after another. Words are encoded by the ``tokenizers`` library once and
kept, as packed ids, in a dictionary of at most ``CACHE_WORDS`` entries per worker.
Texts are lower-cased (A-Z) before the look-up only where they hold no combining
marks (there, composing and then lower-casing could differ) and no beginning of an added
token (those are matched in the text as it stands). This is for byte-level BPE files
that compose, lower-case and split letters from marks, as ``word_bpe_49k.json``.
"""

from __future__ import annotations

import os
import re
import struct
from itertools import compress

from geomill.llm import memory

CACHE_WORDS = 300_000
#: Never part of a contraction: behind letters they are a token of their own.
MARKS = b".,!#$%&*?;:"
#: Longer words are encoded, but not kept.
CACHE_WORD_BYTES = 64
#: Letters that are composed and that lower-case to one letter.
LATIN = re.compile("[a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_PACKS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def packed(ids: list[int]) -> bytes:
    return _PACKS[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    _shared: dict[str, WordEncoder] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The worker's encoder for this file; it lives as long as the worker."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {}
        # byte-level models write a byte that has no printable character of its own as one from U+0100 on
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self.byte_chars = {b: 256 + k for k, b in enumerate(hidden)}
        added = {t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()}
        #: The first two bytes of each added token, where they hold no letter of either case.
        self.marked = sorted({t[:2] for t in added}) if all(t[:2].lower() == t[:2].upper() for t in added) else [b""]

    def _letters(self, word: str) -> bytes | None:
        """Ids of a word that is letters alone and that neither composing nor splitting would change, straight from the model; else None."""
        if not word.isascii():
            if not LATIN.fullmatch(word):
                return None
            word = word.encode().decode("iso-8859-1").translate(self.byte_chars)
        return packed([t.id for t in self.tokenize(word)])

    def _word(self, w: bytes) -> bytes | None:
        """Ids of letters, or of letters and marks behind them; None of anything else."""
        if w.isalpha():  # in bytes: ASCII letters
            return packed([t.id for t in self.tokenize(w.decode().lower())])
        letters = w.rstrip(MARKS)
        word = letters.decode("utf-8", "replace").lower()
        if not word.isalpha():
            return None
        ids = self.known.get(letters) or self.old.get(letters) or self._letters(word)
        if ids is None or len(letters) == len(w):
            return ids
        # two tokens of the pre-tokenizer
        tail = w[len(letters) :]
        if tail not in self.tails:
            if len(self.tails) >= 10_000:
                self.tails.clear()
            self.tails[tail] = packed(self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids)
        return ids + self.tails[tail]

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words not in the cache; those worth it go there."""
        out, other, old, new = {}, [], self.old.get, self._word
        for w in words:
            ids = old(w) or new(w)
            if ids is None:
                other.append(w)
            else:
                out[w] = ids
        for at in range(0, len(other), 4096):
            part = other[at : at + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                out[w] = packed(e.ids)
        if len(self.known) + len(out) > CACHE_WORDS // 2:
            self.old, self.known = self.known, {}
        self.known.update(out if max(map(len, out), default=0) <= CACHE_WORD_BYTES else {w: ids for w, ids in out.items() if len(w) <= CACHE_WORD_BYTES})
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out = []
        for text in texts:
            as_is = b"\xcc" in text or b"\xcd" in text or any(m in text for m in self.marked)
            words = (text if as_is else text.lower()).split()
            ids = list(map(self.known.get, words))
            if None in ids:
                new = self._learn(list(dict.fromkeys(compress(words, [x is None for x in ids]))))
                ids = [new[w] if x is None else x for w, x in zip(words, ids, strict=True)]
            out.append(b"".join(ids))
        return out


memory.kept["tokens"] = WordEncoder._shared
