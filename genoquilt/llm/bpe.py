"""Byte-level BPE encoding and decoding as a monoid tree reduction.

An element of the monoid is a stretch of text with its token ids; ``join`` combines the ids of two
neighbouring stretches into those of their concatenation, so a text is encoded by halving it down to
leaves and joining upwards. A join re-encodes a window around the seam that grows until the tokens
outside it are proven to stay:

* Between pre-tokens: where a non-space character is followed by a blank or a line end, every
  alternative of the split pattern ends a match, and the scan starts afresh there whatever stands
  before. So tokens beyond such a place on either side cannot change.
* Inside one very long pre-token (no such place near the seam): a token sequence is the BPE encoding
  of its bytes exactly if each two adjacent tokens encode to themselves, so the window has settled
  once the pairs across both of its edges do.

Decoding concatenates the bytes of leaves up the same tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

LEAF_CHARS = 2048
#: Longer stretches without a sure boundary are split into pre-tokens here and merged by ``encode_piece``.
LONG_CHARS = 4096
LEAF_BYTES = 512
#: White space as the split pattern's engine knows it (Unicode White_Space).
_SPACE = r"\t-\r \x85\xa0  -     　"
_BLANKS = " \n\t\r"


class TreeBPE:
    """Encoder and decoder for one rank file. ``encode(text)`` equals the rank library's ``encode_ordinary``."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._leaf = self._library.encode_ordinary
        self._piece = self._library._encode_single_piece
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.size_of = [len(b) for b in self.bytes_of]
        if max(self.size_of) >= LEAF_BYTES:
            raise ValueError("a token is as long as a leaf")
        self._split = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))

    # -- encoding -----------------------------------------------------------------------------
    def encode(self, text: str | None) -> list[int]:
        return self._encode(text, 0, len(text)) if text else []

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= LEAF_CHARS:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        reach, a, b = 32, -1, -1
        while a < 0 or b < 0:
            if a < 0:
                a = self._sure_before(text, max(lo, mid - reach), mid)
                if a < 0 and mid - reach <= lo:
                    a = lo
            if b < 0:
                b = self._sure_after(text, mid, min(hi, mid + reach))
                if b < 0 and mid + reach >= hi:
                    b = hi
            reach *= 2
        window = text[a:b]
        middle = self._leaf(window) if b - a <= LONG_CHARS else [i for m in self._split.finditer(window) for i in self.encode_piece(m[0].encode())]
        return left[: self._drop(left, len(text[a:mid].encode()), -1)] + middle + right[self._drop(right, len(text[mid:b].encode()), 1) :]

    @staticmethod
    def _sure_before(text: str, lo: int, hi: int) -> int:
        """The last place in (lo, hi] where a blank follows a non-space character; -1 if none. hi counts too."""
        if hi < len(text) and text[hi] in _BLANKS and not text[hi - 1].isspace():
            return hi
        at = hi
        while (at := max(text.rfind(c, lo + 1, at) for c in _BLANKS)) > lo:
            if not text[at - 1].isspace():
                return at
        return -1

    @staticmethod
    def _sure_after(text: str, lo: int, hi: int) -> int:
        """The first such place in (lo, hi); -1 if none."""
        at = lo
        while found := [x for c in _BLANKS if (x := text.find(c, at + 1, hi)) >= 0]:
            at = min(found)
            if not text[at - 1].isspace():
                return at
        return -1

    def _drop(self, ids: list[int], n_bytes: int, step: int) -> int:
        """The index at which ``n_bytes`` of tokens end, from the start (step 1) or from the end (step -1)."""
        at, size = (0 if step > 0 else len(ids)), self.size_of
        while n_bytes > 0:
            n_bytes -= size[ids[at if step > 0 else at - 1]]
            at += step
        if n_bytes:
            raise AssertionError("a sure boundary cuts a token")
        return at

    def encode_piece(self, piece: bytes) -> list[int]:
        """The merges of one pre-token, by halves."""
        if len(piece) <= LEAF_BYTES:
            return self._piece(piece)
        mid = len(piece) // 2
        return self._join_piece(self.encode_piece(piece[:mid]), self.encode_piece(piece[mid:]))

    def _join_piece(self, left: list[int], right: list[int]) -> list[int]:
        reach, b = 8, self.bytes_of
        while True:
            at, to = max(0, len(left) - reach), min(len(right), reach)
            raw = b"".join(b[i] for i in left[at:]) + b"".join(b[i] for i in right[:to])
            if at == 0 and to == len(right) and len(raw) > LEAF_BYTES:  # all of it: only the merges themselves decide
                return self._piece(raw)
            middle = self._piece(raw)
            if (at == 0 or self._stays(left[at - 1], middle[0])) and (to == len(right) or self._stays(middle[-1], right[to])):
                return left[:at] + middle + right[to:]
            reach *= 2

    def _stays(self, x: int, y: int) -> bool:
        return self._piece(self.bytes_of[x] + self.bytes_of[y]) == [x, y]

    # -- decoding -----------------------------------------------------------------------------
    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> TreeBPE:
    """One encoder a Python worker."""
    return TreeBPE(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids array<int>, decoded binary) for each row: ids of the whole text and their bytes.

    A null text counts as empty: no ids. Rows stay as they are, repeated ones and null ids too; other
    columns are not read. No shuffle; a task holds one text's ids and 256 rows of results at a time.
    """
    schema = pa.schema([("id", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def make():
        bpe = encoder(path, pattern)

        def apply(rows):
            ids = [bpe.encode(t) for t in rows["text"]]
            return {"id": rows["id"], "token_ids": ids, "decoded": [bpe.decode(i) for i in ids]}

        return apply

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return out.mapInArrow(arrow_rows(make, schema, 256), "id long, token_ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids_sha256, decoded_sha256) for each row: ``encode_documents`` with the digests taken
    in the same pass, so that ids and bytes need not cross to the JVM. Edge cases as there."""
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def make():
        bpe = encoder(path, pattern)
        names = [str(i) for i in range(len(bpe.bytes_of))]

        def one(text):
            ids = bpe.encode(text)
            return len(ids), hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

        def apply(rows):
            n, a, b = zip(*map(one, rows["text"])) if rows["text"] else ((), (), ())
            return {"id": rows["id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

        return apply

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return out.mapInArrow(arrow_rows(make, schema), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
