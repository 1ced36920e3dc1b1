"""Best-fit decreasing packing of documents into token sequences.

Lengths are whole numbers up to the capacity, so the exact packing of any corpus depends on a histogram of
at most ``capacity`` lengths. The driver packs that histogram: lengths descending, each into the open
sequence with the least room that suffices, found by a segment tree over remaining capacities in
logarithmic time; equal lengths meeting equal sequences are placed as one run. The runs (length, first rank,
sequence, offset) are then looked up by each piece's rank among the pieces of its length. Ranks are counted
in two steps, within hash buckets and over buckets, so no length's pieces ever meet in one task.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from tokenizers.pre_tokenizers import Sequence, Split
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bounded, arrow_rows, cut, hold, shuffle_partitions

#: Bytes of pre-tokens' ids that a worker remembers.
CACHE_BYTES = 48 << 20
CACHE_CHARS = 40
#: Characters of the texts that are encoded together, besides the last one's; pre-tokens that the library gets at once.
GROUP_CHARS = 2 << 20
CALL_PARTS = 1024
#: Runs sent to every task at most (40 bytes each); beyond that they are joined instead.
MAX_BROADCAST_RUNS = 1_000_000


# -- tokenising -----------------------------------------------------------------------------------
class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to the library's for the whole text.

    The pre-tokenizer drops white space and matches never cross it, so the words of many texts are taken apart at white space and
    each different one is lower-cased and split into pre-tokens once, in Arrow. Each different pre-token is looked up once; unknown
    ones go to the library in one text, whose ids fall apart at the tokens that end a pre-token. Words, then texts, take their ids
    from there. That holds for texts of Latin letters and signs (``_PLAIN``), which lower-case letter by letter and are in normal
    form; texts with other characters, or with a special token's string, go to the library whole.
    """

    _PLAIN = re.compile(r"[\t-\r -~\xa0-įı-ɏ‐-…€]*")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self._library = tokenizers.Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._split = json.loads(self._library.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._of_parts = tokenizers.Tokenizer(self._library.model)  # for pre-tokens in normal form, with blanks between
        self._of_parts.pre_tokenizer = Sequence([Split(" ", "removed"), self._library.pre_tokenizer[1]])
        self._ends = np.zeros(self._library.get_vocab_size(True), bool)
        for token, i in self._library.get_vocab(False).items():
            self._ends[i] = token.endswith("</w>")
        self._parts = Bounded(CACHE_BYTES, lambda part, ids: 200 + len(part) + len(ids))

    @staticmethod
    def _encode(library: tokenizers.Tokenizer, text: str) -> bytes:
        return np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _apart(self, parts: list[str]) -> list[bytes] | None:
        """Each pre-token's ids; None if the ids do not fall apart into as many."""
        raw = b"".join([self._encode(self._of_parts, " ".join(parts[k : k + CALL_PARTS])) for k in range(0, len(parts), CALL_PARTS)])
        ends = np.flatnonzero(self._ends[np.frombuffer(raw, "<u4")]) + 1
        if len(ends) != len(parts):
            return None
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of ``_PLAIN`` texts without special tokens' strings."""
        words = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        which = words.flatten().dictionary_encode()
        # a part after the last separator, and a word before or after outer white space, is empty and has no ids
        split = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(which.dictionary), self._split, "\\0\n"), "\n")
        of_words = split.flatten().dictionary_encode()
        parts, known = of_words.dictionary.to_numpy(zero_copy_only=False).tolist(), self._parts
        ids = [known.get(p) if p else b"" for p in parts]
        unknown = [k for k, x in enumerate(ids) if x is None]
        learnt = self._apart([parts[k] for k in unknown])
        if learnt is None:
            return [self._encode(self._library, t) for t in texts]
        for k, x in zip(unknown, learnt):
            ids[k] = x
            if len(parts[k]) <= CACHE_CHARS:
                known.keep(parts[k], x)
        by_word = _joined(pa.array(ids, pa.large_binary()).take(of_words.indices), split.offsets)
        by_text = _joined(by_word.take(which.indices), words.offsets)
        return by_text.to_pylist()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of each, together."""
        out, plain, size = [b""] * len(texts), [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self._PLAIN.fullmatch(text) or any(s in text for s in self._special):
                out[i] = self._encode(self._library, text)
                continue
            plain.append(i)
            size += len(text)
            if size >= GROUP_CHARS:
                self._fill(out, texts, plain)
                plain, size = [], 0
        self._fill(out, texts, plain)
        return out

    def _fill(self, out: list[bytes], texts: list[str | None], which: list[int]) -> None:
        for i, ids in zip(which, self._encode_plain([texts[i] for i in which])):
            out[i] = ids

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


def _joined(values: pa.LargeBinaryArray, offsets: pa.Array) -> pa.LargeBinaryArray:
    """Binary values, concatenated between each two offsets."""
    _, at, data = values.buffers()
    ends = np.frombuffer(at, np.int64, len(values) + 1, 8 * values.offset)[offsets.to_numpy()]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), data])


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece int, start long, length long, ids_crc32 long[, token_ids binary]): each document's ids and one
    ``end_id``, cut into pieces of ``capacity`` where it is longer. A null or empty text is the end id alone.
    ``token_ids``: little-endian unsigned 32-bit. No shuffle; repeated rows and null ids give their own pieces.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(*_pieces(path, capacity, end_id, with_ids)).withColumnRenamed("id", id_col)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    """What makes pieces of (id, text), and their schema."""
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("token_ids", pa.binary())] * with_ids)

    def make():
        hold("packing", word_encoder.cache_clear)
        encode, end, step = word_encoder(path).encode_all, np.array([end_id], "<u4").tobytes(), 4 * capacity

        def apply(rows):
            out = {f.name: [] for f in schema}
            for i, ids in zip(rows["id"], encode(rows["text"])):
                raw = ids + end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    for name, v in zip(out, (i, k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        out[name].append(v)
            return out

        return apply

    return arrow_rows(make, schema), "id long, piece int, start long, length long, ids_crc32 long" + ", token_ids binary" * with_ids


# -- the packing plan -----------------------------------------------------------------------------
class CapacityTree:
    """How many open sequences have each remaining capacity; finds the least capacity that is at least x and
    taken, in logarithmic time."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.n)

    def put(self, at: int, is_open: bool) -> None:
        at += self.n
        self.any[at] = is_open
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def least(self, x: int) -> int | None:
        at = x + self.n
        while not self.any[at]:
            while at % 2:  # a right child: its parent's range ends here
                at //= 2
                if at <= 1:
                    return None
            at += 1
        while at < self.n:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.n


def best_fit_runs(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, per sequence, offset): the pieces of that length with these
    ranks go to consecutive sequences, ``per sequence`` to each, the first at ``offset``. The packing is that of
    best-fit decreasing piece by piece. Its size depends on the lengths that occur, not on how many pieces there are."""
    tree = CapacityTree(capacity)
    room: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> (first sequence, count)
    runs, used = [], 0

    def give(left: int, first: int, count: int) -> None:
        if left > 0 and count > 0:
            if left not in room:
                room[left] = []
                tree.put(left, True)
            mine = room[left]
            if mine and mine[-1][0] + mine[-1][1] == first:
                mine[-1] = (mine[-1][0], mine[-1][1] + count)
            else:
                mine.append((first, count))

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError("a length is not within the capacity")
        while rank < n:
            left = tree.least(length)
            if left is None:
                per = capacity // length
                left, first, count = capacity, used, -(-(n - rank) // per)
                used += count
            else:
                mine = room[left]
                first, count = mine.pop()
                if not mine:
                    del room[left]
                    tree.put(left, False)
            per = left // length
            full = min(count, (n - rank) // per)
            if full:
                runs.append((length, rank, full * per, first, per, capacity - left))
                rank += full * per
                give(left - per * length, first, full)
            if full < count:
                if rest := n - rank:  # fewer than one sequence takes
                    rest = min(rest, per)
                    runs.append((length, rank, rest, first + full, per, capacity - left))
                    rank += rest
                    give(left - rest * length, first + full, 1)
                    full += 1
                give(left, first + full, count - full)
    return np.array(runs, np.int64).reshape(-1, 6)


def place(pieces: DataFrame, capacity: int, keys: list[str], length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` must be a table that reads the same each time.

    Pieces of one length are interchangeable; ``keys`` only order them. Lengths null or outside 1..capacity
    raise. An empty table stays empty.
    """
    spark = pieces.sparkSession
    buckets = shuffle_partitions(spark)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    sizes = cut(dealt.groupBy(F.col(length_col).alias("_length"), "_bucket").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    histogram = {r[0]: r[1] for r in sizes.groupBy("_length").agg(F.sum("_n")).collect()}  # at most ``capacity`` rows
    if any(x is None or not 0 < x <= capacity for x in histogram):
        raise ValueError("a length is null or not within the capacity")
    runs = best_fit_runs(histogram, capacity)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_length", "_bucket", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(length_col, "_bucket").orderBy(*keys))
    ranked = dealt.withColumn("_within", within - 1)
    ranked = ranked.join(starts, (ranked[length_col] == starts["_length"]) & ranked["_bucket"].eqNullSafe(starts["_bucket"])).select(*pieces.columns, (F.col("_before") + F.col("_within")).alias("_rank"))
    if len(runs) > MAX_BROADCAST_RUNS:
        plan = spark.createDataFrame([tuple(map(int, r)) for r in runs], "_l long, _first long, _n long, _seq long, _per long, _at long")
        hit = ranked.join(plan, (F.col(length_col) == F.col("_l")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_n")))
        j = F.col("_rank") - F.col("_first")
        return hit.select(*pieces.columns, (F.col("_seq") + F.floor(j / F.col("_per"))).alias("sequence_id"), (F.col("_at") + F.pmod(j, F.col("_per")) * F.col(length_col)).alias("offset"))
    shared, names = spark.sparkContext.broadcast(runs), list(pieces.columns)  # bounded by MAX_BROADCAST_RUNS

    def look_up(batches):
        r = shared.value
        order = np.lexsort((r[:, 1], r[:, 0]))
        r = r[order]
        span = int(r[:, 1].max(initial=0)) + 2  # (length, rank) as one ordered number: exact below 2**63 / capacity pieces
        keys_ = r[:, 0] * span + r[:, 1]
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (length_col, "_rank"))
            at = np.searchsorted(keys_, length * span + np.minimum(rank, span - 1), side="right") - 1
            hit = r[at]
            j = rank - hit[:, 1]
            cols = [b.column(n) for n in names] + [pa.array(hit[:, 3] + j // hit[:, 4]), pa.array(hit[:, 5] + j % hit[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    schema = pieces.limit(0).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ranked.mapInArrow(look_up, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``token_pieces`` with ``sequence_id long`` and ``offset long``: sequences of at most ``capacity`` tokens,
    gapless from offset 0, as few as best-fit decreasing makes.

    Null and empty texts pack as their end id; repeated rows are packed each; an empty table gives no rows.
    The pieces are written once to the shared folder, as ranks need a table that reads the same each time.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = cut(slim, "pieces", *_pieces(path, capacity, end_id, with_ids)).withColumnRenamed("id", id_col)
    return place(pieces, capacity, [id_col, "piece", "ids_crc32"])
