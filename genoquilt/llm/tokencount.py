"""Token counts with a whole-token shortcut, for BPE piece models with white space escaped as U+2581.

Offline proof, made when a worker loads the model: (1) no piece holds U+2581 after another character, so
no merge crosses from a word to the white space after it, and the text falls apart into pre-tokens there;
(2) no piece holds a line feed, so that one stands alone as its byte token, or a full stop or comma after a
letter, so that words end before these; (3) each piece that, as a
pre-token, encodes to itself alone counts 1. Pre-tokens among (3) are counted by look-up; only the rest
are merged, by the library, once each while they stay in a bounded cache.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, arrow_rows, hold

SPACE = "▁"
#: Bytes of pre-tokens' counts that a worker remembers beyond the proven ones.
CACHE_BYTES = 48 << 20
CACHE_CHARS = 40
_LETTER = "A-Za-z\u00c0-\u024f"
_WORD_THEN_STOP = re.compile(f"[{_LETTER}][.,]")


class PieceCounter:
    """``count(text)``: how many ids the model gives the whole text, without begin or end tokens."""

    def __init__(self, path: str):
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self._model
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        words = [p for p in pieces if p.strip(SPACE)]
        if any(SPACE in p[1:] for p in words) or any("\n" in p for p in pieces) or any(_WORD_THEN_STOP.search(p) for p in pieces):
            raise ValueError("this model's pieces cross pre-tokens")
        if [m.id_to_piece(i) for i in m.encode("a")] != [SPACE + "a"] or [m.id_to_piece(i) for i in m.encode("\naＡ  \n")] != [SPACE, "<0x0A>", *self._pieces("aＡ"), SPACE * 2, "<0x0A>"]:
            raise ValueError("this model normalises texts; only identity with a dummy prefix is handled")
        self._split = re.compile(f"(?:{SPACE}+|[^{SPACE}\n])(?:[^{SPACE}\n.,]+|(?<![{_LETTER}])[.,])*|\n").findall
        self.whole = {p: 1 for p, n in zip(pieces, self._merge(pieces)) if n == 1} | {"\n": 1}
        self._cache = Bounded(CACHE_BYTES, lambda part, _: 160 + 2 * len(part))
        self._cache.update(self.whole)

    def _pieces(self, text: str) -> list[str]:
        return [self._model.id_to_piece(i) for i in self._model.encode("\n" + text)][2:]

    def _merge(self, pre_tokens: list[str]) -> list[int]:
        """Behind a line feed a pre-token stands alone, whether it starts with white space or not; the prefix and
        the line feed are two tokens more."""
        return [len(x) - 2 for x in self._model.encode(["\n" + p.replace(SPACE, " ") for p in pre_tokens], num_threads=1)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self._split(SPACE + text.replace(" ", SPACE))
        known = self._cache
        try:
            return sum(map(known.__getitem__, parts))
        except KeyError:
            pass
        rest = list({p for p in parts if p not in known})
        merged = dict(zip(rest, self._merge(rest)))
        n = sum(known[p] if p in known else merged[p] for p in parts)
        for p, k in merged.items():
            if len(p) <= CACHE_CHARS:
                known.keep(p, k)
        return n


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, n_tokens long, over_limit boolean) for each row.

    A null or empty text has 0 bytes and 0 tokens. Rows stay as they are, repeated ones and null ids too;
    other columns are not read. No shuffle.
    """
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def make():
        hold("tokencount", counter.cache_clear)
        count = counter(path).count
        return lambda rows: {"id": rows["id"], "n_bytes": [len(t.encode()) if t else 0 for t in rows["text"]], "n_tokens": [count(t) for t in rows["text"]]}

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(arrow_rows(make, schema), "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
