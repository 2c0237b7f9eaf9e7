"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text's spaces become U+2581, one more stands before it, and the pieces with the
largest sum of scores are taken; characters that no piece covers cost
``MISSING`` below the least score and are written as their UTF-8 byte pieces. Of equal
sums the longer last piece wins. These are the pieces and scores of the model file,
whatever algorithm it was trained for.

The search is one pass over the characters. It keeps scores only for the positions that
the longest piece still reaches (``longest + 1`` of them). Boundaries behind these stay
as long as some surviving path goes through them: each counts the boundaries that lead
back to it, and without any it is dropped. When the last committed boundary is out of
reach and one path alone leads on from it, all survivors have converged, and that
piece's id is committed. Each boundary comes and goes once, so the time is linear. (Two
paths that never meet, as the odd and the even one through a run of one letter, both stay
until the end: their boundaries are all that can outgrow the window.)

A place that no piece spans (before a space that follows something else, around a
character that only stands alone) is passed by every path: it is such a boundary before
the search comes to it. So a text is searched from one to the next, and what a
short stretch between two gave is remembered, at most ``CACHE`` of them per worker, the
newer half first.

Defined cases: a null text is an empty one and has no ids; an empty table gives an
empty result; a U+2581 in a text comes back as a space; repeated rows are encoded
each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, MISSING, CACHE, CACHE_CHARS = "▁", 10.0, 700_000, 48
LEAST = float("-inf")


class Pieces:
    """A model file's pieces, with the Viterbi search over them."""

    _shared: dict[str, Pieces] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text: list[str | bytes] = []
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.text.append("")
            else:
                self.text.append(piece)
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
        self.longest = max(map(len, self.scores), default=1)
        self.missing = min(self.scores.values(), default=0.0) - MISSING
        inner = {c for p in self.scores if len(p) > 1 for c in p}
        crossed = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.scores)
        alone = "" if "\n" in inner else "\n"
        self.stretches = re.compile(f".+|{SPACE}" if crossed else f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|{alone}" if alone else ""), re.DOTALL)
        #: what each beginning of a piece scores as a piece of its own, or None
        self.parts: dict[str, float | None] = {p[:k]: None for p in self.scores for k in range(1, len(p))} | self.scores
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def search(self, text: str) -> Iterator[tuple[str, int | None]]:
        """(piece, id or None) of the best path, committed as soon as all surviving paths agree."""
        get, ids, scores, missing, longest, n = self.parts.get, self.ids.get, self.scores, self.missing, self.longest, len(text)
        closes = n > longest  # else all is in reach to the end
        best = dict.fromkeys(range(longest), LEAST) if closes else [LEAST] * (n + 1)  # of the positions in reach
        start: dict[int, int] | list[int] = {} if closes else [0] * (n + 1)  # where the best last piece to a position starts
        behind = {0: 0}  # how many boundaries lead back to a position, and
        ahead = {0: 0}  # the sum of these
        best[0] = 0.0
        base = 0  # all before it is committed
        for at in range(n):
            if closes:
                best[at + longest] = LEAST
            top = best[at]
            if text[at] not in scores and top + missing > best[at + 1]:
                best[at + 1], start[at + 1] = top + missing, at
            for end in range(at + 1, n + 1):
                score = get(text[at:end], False)
                if score is False:  # no piece begins like this
                    break
                if score is not None and top + score > best[end]:
                    best[end], start[end] = top + score, at
            if not closes:
                continue
            # the next position's best path is settled
            own = start[at + 1]
            behind[own] += 1
            ahead[own] += at + 1
            behind[at + 1] = ahead[at + 1] = 0
            del best[at]
            gone = at + 1 - longest
            while gone > base and not behind[gone]:  # no path goes through it
                up = start.pop(gone)
                behind[up] -= 1
                ahead[up] -= gone
                del behind[gone], ahead[gone]
                gone = up
            while base <= at + 1 - longest and behind[base] == 1:
                to = ahead[base]
                yield text[base:to], ids(text[base:to])
                del behind[base], ahead[base], start[to]
                base, lift = to, best[at + 1]
                for p in best:  # sums stay small
                    best[p] -= lift
        rest, end = [], n
        while end > base:
            rest.append((text[start[end] : end], ids(text[start[end] : end])))
            end = start[end]
        yield from reversed(rest)

    def _stretch(self, text: str) -> bytes:
        ids: list[int] = []
        for piece, i in self.search(text):
            if i is None:
                ids.extend(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))
            else:
                ids.append(i)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        parts = self.stretches.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(self.known.get, parts))
        for k, x in enumerate(found):
            if x is None:
                found[k] = ids = self.known.get(parts[k]) or self.old.get(parts[k]) or self._stretch(parts[k])
                if len(parts[k]) <= CACHE_CHARS:
                    if len(self.known) >= CACHE // 2:
                        self.old, self.known = self.known, {}
                    self.known[parts[k]] = ids
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        """The text of the ids, without the space that the first piece's U+2581 stands for."""
        numbers, table = np.frombuffer(ids, "<u4").tolist(), self.decoded
        out = b"".join([table[i] for i in numbers])
        first = next((i for i in numbers if table[i]), None)
        marked = first is not None and isinstance(self.text[first], str) and self.text[first][0] == SPACE
        return (out[1:] if marked else out).decode("utf-8", "replace")

    @property
    def decoded(self) -> list[bytes]:
        if not hasattr(self, "_decoded"):
            self._decoded = [p if isinstance(p, bytes) else p.replace(SPACE, " ").encode() for p in self.text]
        return self._decoded


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, round_trip of each row (and ids as packed bytes)."""
    id_type = dict(docs.dtypes)[id_col]
    names = ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip", *(["ids"] if keep_ids else [])]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [pieces.encode(t) for t in texts]
                back = [pieces.decode(i) for i in ids]
                columns = [
                    part.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]),
                    pa.array([b == t.replace(SPACE, " ") for b, t in zip(back, texts, strict=True)], pa.bool_()),
                    *([pa.array(ids, pa.binary())] if keep_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    ddl = f"doc_id {id_type}, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + (", ids binary" if keep_ids else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, ddl)


def decode_ids(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows with packed ids."""
    id_type = dict(rows.dtypes)[id_col]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces.decode(i or b"") for i in batch.column(1).to_pylist()])], names=["doc_id", "text"])

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(decode, f"doc_id {id_type}, text string")
