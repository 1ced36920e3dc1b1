"""Substring de-duplication by content-defined chunks.

A gear rolling hash over the last sixteen bytes places chunk ends at white space, so equal passages fall into
equal chunks wherever they stand, and insertions shift only the chunks that they touch. Chunks are
digested; of each digest the first occurrence by (document, place) stays. A later occurrence knows how its first one is
aligned with it: in which document, how many bytes before. Where consecutive chunks of a document are later occurrences, and
those of one alignment hold enough words, they span a repeated passage. Short chunks may have stood elsewhere
before; they neither make nor break a span.

Digests are 64 bits; a wrong span would need several consecutive collisions. Counting occurrences combines on
the map side. Of later occurrences, those of the few digests that make a large share of all chunks meet their first one by a
broadcast that this share bounds, all others by an equi-join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, forget, fresh

WINDOW = 16
#: One white space in five ends a chunk; without any, a chunk ends after MAX_BYTES.
ONE_IN, MAX_BYTES = 5, 2048
#: Words that a span needs: chunks hold whole words, so a passage of 51 loses a few words at either end.
MIN_WORDS = 16
_GEAR = np.random.default_rng(64).integers(0, 2**32, 256, np.uint32)
_GEAR[0] = 0  # texts are joined by zero bytes
_LENGTH_BITS = 16
#: A digest with at least this share of all chunks is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 5000


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Places after which a chunk ends, in bytes; a text's own end not counted."""
    h, n = _GEAR[data], 1
    while n < WINDOW:  # the rolling sum of _GEAR[byte] << age, doubling the ages covered
        shifted = np.zeros_like(h)
        shifted[n:] = h[:-n] << np.uint32(n)
        h = h + shifted
        n *= 2
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    return np.flatnonzero(blank & (h < np.uint32(2**32 // ONE_IN))) + 1


def split(raw: bytes, ends: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each chunk. Longer stretches than MAX_BYTES are cut there, at a character's first byte."""
    out, at = [], 0
    for end in [*ends.tolist(), len(raw)]:
        while end - at > MAX_BYTES:
            to = at + MAX_BYTES
            while raw[to] & 0xC0 == 0x80:
                to += 1
            if to >= end:
                break
            out.append((at, to))
            at = to
        if end > at:
            out.append((at, end))
            at = end
    return out


def _chunks(batches):
    """(digest, doc, mark, place): place is start << 16 | length, and mark a hash of the text."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            raws = [(d, m, t.encode()) for d, m, t in zip(*(part.column(n).to_pylist() for n in ("doc", "mark", "text"))) if t]
            ends = chunk_ends(np.frombuffer(b"".join(r + bytes(WINDOW) for _, _, r in raws), np.uint8)) if raws else np.zeros(0, np.int64)
            digests, places, counts, base = [], [], [], 0
            for _, _, raw in raws:
                a, b = np.searchsorted(ends, (base + 1, base + len(raw)))
                found = split(raw, ends[a:b] - base)
                digests += [xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in found]
                places += [s << _LENGTH_BITS | e - s for s, e in found]
                counts.append(len(found))
                base += len(raw) + WINDOW
            docs, marks = (np.repeat(np.array([r[i] for r in raws], np.int64), counts) for i in (0, 1))
            columns = [np.array(digests, np.uint64).view(np.int64), docs, marks.astype(np.int32), np.array(places, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["digest", "doc", "mark", "place"])


def _mark(text: Column) -> Column:
    """32 bits that tell texts of one id apart."""
    return F.hash(text)


def later_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, places array<struct<place, along>>) of the documents with chunks that stand earlier in the corpus too;
    ``along`` is the alignment with the first occurrence."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null").withColumn("mark", _mark(F.col("text")))
    chunks = cut(rows, "chunks", _chunks, "digest long, doc long, mark int, place long")
    at = F.struct("doc", "mark", "place")
    first = cut(chunks.groupBy("digest").agg(F.min(at).alias("p0"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first")
    hot = F.col("n") >= max(1000, int(chunks.count() * HOT_SHARE))
    dealt = chunks.join(F.broadcast(first.where(hot).select("digest", "p0")), "digest", "left")
    rest = dealt.where("p0 is null").drop("p0").join(first.where(~hot).select("digest", "p0").hint("merge"), "digest")
    later = dealt.where("p0 is not null").unionByName(rest).where(at != F.col("p0"))
    start = lambda place: F.shiftright(place, _LENGTH_BITS)
    along = F.xxhash64("p0.doc", "p0.mark", start(F.col("place")) - start(F.col("p0.place")))
    found = later.select("doc", "mark", F.struct("place", along.alias("along")).alias("at"))
    # a document's own chunks: bounded by its text, however often its row repeats
    out = cut(found.groupBy("doc", "mark").agg(F.collect_set("at").alias("places")), "later")
    forget(chunks, first)
    return out


def spans(text: str, places: list[dict] | None, min_words: int) -> list[tuple[int, int]]:
    """Byte spans of repeated passages: within runs of consecutive places, from the first to the last chunk of each
    alignment whose chunks hold enough words."""
    out = []
    raw = text.encode() if places else b""
    run: dict[int, list[int]] = {}  # alignment -> start, end, words
    reached = -1
    for p in [*sorted(((p["place"] >> _LENGTH_BITS, p["place"] & (1 << _LENGTH_BITS) - 1, p["along"]) for p in places or ())), None]:
        if p is None or p[0] != reached:
            out += [(s, e) for s, e, words in run.values() if words >= min_words]
            run = {}
        if p is not None:
            s, length, along = p
            mine = run.setdefault(along, [s, s, 0])
            mine[1], mine[2], reached = s + length, mine[2] + len(raw[s : s + length].split()), s + length
    joined: list[tuple[int, int]] = []
    for s, e in sorted(out):
        if joined and s <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(e, joined[-1][1]))
        else:
            joined.append((s, e))
    return joined


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    raw, out, at = text.encode(), [], 0
    for s, e in cuts:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]]).decode("utf-8", "ignore")


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the document's places as the last column, whatever the others are called."""
    doc, mark, places = (fresh(docs, n) for n in ("_doc", "_mark", "_places"))
    found = later_occurrences(docs, id_col, text_col).toDF(doc, mark, places)
    same = (docs[id_col].cast("long") == found[doc]) & (_mark(docs[text_col]) == found[mark])
    return docs.join(found.hint("merge"), same, "left").drop(doc, mark)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes long, n_spans long, repeated_bytes long, spans array<struct<start,end>>, kept_sha256 string) for each
    row: byte spans that repeat an earlier passage, and the digest of the text without them.

    A document is an id with a text: rows that repeat both count once, so a repeated row is not removed, and rows that
    share an id but not the text are documents of their own, ordered by a hash of the text. The earliest
    occurrence by (id, text, place) is no repetition. Null and empty texts have 0 bytes and no spans; rows with
    a null id are left whole and not compared. Other columns are ignored. An empty table gives no rows.
    """
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string())])

    def make():
        def apply(rows):
            texts = [t or "" for t in rows["text"]]
            cuts = [spans(t, p, min_words) for t, p in zip(texts, rows["_places"])]
            kept = [hashlib.sha256(without(t, c).encode()).hexdigest() for t, c in zip(texts, cuts)]
            return {"id": rows["id"], "n_bytes": [len(t.encode()) for t in texts], "spans": [[{"start": s, "end": e} for s, e in c] for c in cuts], "kept_sha256": kept}

        return apply

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = _joined(slim, "id", "text").mapInArrow(arrow_rows(make, schema, 256), "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string")
    repeated = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(F.col("id").alias(id_col), "n_bytes", F.size("spans").cast("long").alias("n_spans"), repeated.alias("repeated_bytes"), "spans", "kept_sha256")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut out of their texts; all rows and other columns stay. Cases as above; a null
    text stays null."""
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                texts, places = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                texts = [without(t, spans(t, p, min_words)) if t and p else t for t, p in zip(texts, places)]
                cols = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(cols, names=whole.schema.names[:-1])

    return _joined(docs, id_col, text_col).mapInArrow(run, docs.schema)
