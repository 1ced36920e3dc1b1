"""Operators 1, 3 and 8 against their libraries, on whole tables and on odd texts."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers

from genoquilt.llm import bpe, packing, queries, tokencount

ODD = [None, "", " ", "\n", "a", "  two  blanks ", "tab\tnl\r\n x", "don't we'll 'S", "日本語 テキスト", "é é ﬁ İı Σς ß", "😀e‍", "<|endoftext|> <s> <unk> <0x0A>", "\x00\x1c\x85 ", "▁▁ a▁b", "x" * 9000, " " * 5000 + "y", "ab'" * 3000, "word " * 5000, "1234567890" * 700, "!?" * 4000, "a.b,c.,d" * 20]


def table(spark):
    rows = [(i, t, "en", 7, 1) for i, t in enumerate(ODD)] + [(3, ODD[3], "en", 7, 1), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, start int, n_tokens int")


def fuzz(n=400):
    rng = random.Random(5)
    kinds = ["ab ", "a", " \n\t", "abc'\n ", "é日a1!' ", "the of.,' ", "▁ a.,", "😀é \r"]
    return ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.choice((1, 3, 20, 300)))) for _ in range(n)] + ["".join(rng.choice(k) for _ in range(rng.choice((2049, 6000, 20000)))) for k in kinds]


def test_bpe_equals_library_and_round_trips():
    b = bpe.encoder(queries.RANKS, P.PATTERN)
    for t in [*ODD, *fuzz()]:
        ids = b.encode(t)
        assert ids == b._library.encode_ordinary(t or ""), (t or "")[:50]
        assert b.decode(ids) == (t or "").encode()


def test_every_token_is_reached_by_merges():
    b = bpe.encoder(queries.RANKS, P.PATTERN)
    ranks = {x: i for i, x in enumerate(b.bytes_of)}
    for token in ranks:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            assert best < 1 << 30
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_one_long_pre_token_joins_by_halves():
    b = bpe.encoder(queries.RANKS, P.PATTERN)
    for raw in (b"thequick" * 400, b"a" * 3000, bytes(range(256)) * 12):
        assert b.encode_piece(raw) == b._piece(raw)


def test_op1(spark, sf_dir):
    lib = bpe.encoder(queries.RANKS, P.PATTERN)._library
    for docs in (table(spark), queries.table(spark, sf_dir, "documents")):
        want = sorted(((i, len(x := lib.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs.select("doc_id", "text").collect()), key=str)
        got = bpe.round_trip_digests(docs, queries.RANKS, P.PATTERN)
        assert sorted(map(tuple, got.collect()), key=str) == want
    whole = bpe.encode_documents(table(spark), queries.RANKS, P.PATTERN).where("doc_id = 8").first()
    assert bytes(whole["decoded"]).decode() == ODD[8] and whole["token_ids"] == lib.encode_ordinary(ODD[8])
    assert bpe.round_trip_digests(table(spark).limit(0), queries.RANKS, P.PATTERN).count() == 0


def test_counts_equal_library():
    m = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    c = tokencount.counter(queries.PIECES)
    for t in [*ODD, *fuzz()]:
        assert c.count(t) == len(m.encode(t or "")), (t or "")[:50]


def test_op8(spark, sf_dir):
    m = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    for docs in (table(spark), queries.table(spark, sf_dir, "documents")):
        got = tokencount.count_tokens(docs, queries.PIECES, 4096)
        want = [(i, len((t or "").encode()), n := len(m.encode(t or "")), n > 4096) for i, t in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert tokencount.count_tokens(table(spark).limit(0), queries.PIECES).count() == 0


def _library_ids(t, text):
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def test_words_equal_library():
    t, w = tokenizers.Tokenizer.from_file(queries.WORDS), packing.word_encoder(queries.WORDS)
    for text in [*ODD, *fuzz(), "naïve café … “x” €5 ­soft"]:
        assert np.frombuffer(w.encode(text), "<u4").tolist() + [1] == _library_ids(t, text), (text or "")[:50]


def test_words_of_a_batch_are_looked_up_once(monkeypatch):
    class Counted(dict):
        asked = []

        def get(self, part):
            self.asked.append(part)
            return super().get(part)

        def keep(self, part, ids):
            self[part] = ids

    w, t = packing.WordEncoder(queries.WORDS), tokenizers.Tokenizer.from_file(queries.WORDS)
    calls, real = [], w._encode
    monkeypatch.setattr(w, "_parts", Counted())
    monkeypatch.setattr(w, "_encode", lambda library, text: calls.append(text) or real(library, text))
    texts = ["The cat's hat, the HAT.", "the cat", " a hat's cat\n", None, "The the THE"] * 50
    want = [_library_ids(t, x)[:-1] for x in texts]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in w.encode_all(texts)] == want
        assert sorted(Counted.asked) == sorted(["the", "cat", "'s", "hat", ",", ".", "a"])
        Counted.asked.clear()
    assert len(calls) == 1


def test_plain_characters_together_equal_library(monkeypatch):
    t, plain = tokenizers.Tokenizer.from_file(queries.WORDS), [c for c in map(chr, range(0x3000)) if packing.WordEncoder._PLAIN.fullmatch(c)]
    rng = random.Random(7)
    texts = [x for c in plain for x in (c, f"a{c}1", f"1{c}'S{c}", f"!{c}!{c.upper()} don'{c}t")] + ["".join(rng.choices(plain, k=300)) for _ in range(100)] + ODD
    want = [_library_ids(t, x)[:-1] for x in texts]
    for chars in (packing.GROUP_CHARS, 1000):
        monkeypatch.setattr(packing, "GROUP_CHARS", chars)
        assert [np.frombuffer(x, "<u4").tolist() for x in packing.WordEncoder(queries.WORDS).encode_all(texts)] == want


@pytest.mark.parametrize("capacity", [16, 4096])
def test_op3(spark, sf_dir, capacity):
    t = tokenizers.Tokenizer.from_file(queries.WORDS)
    docs = table(spark) if capacity == 16 else queries.table(spark, sf_dir, "documents")
    got = packing.pack_documents(docs, queries.WORDS, capacity=capacity).collect()
    want = []
    for i, text in docs.select("doc_id", "text").collect():
        ids = _library_ids(t, text)
        want += [(i, k, a, len(p := ids[a : a + capacity]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    _packed(got, capacity)
    assert len({r["sequence_id"] for r in got}) == plain_best_fit([r["length"] for r in got], capacity)
    assert packing.pack_documents(docs.limit(0), queries.WORDS, capacity=capacity).count() == 0


def _packed(rows, capacity):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity


def plain_best_fit(lengths, capacity):
    """Piece by piece, each into the tightest open sequence."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            i = min(fits, key=lambda i: room[i])
            room[i] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_runs_equal_piece_by_piece():
    rng = np.random.default_rng(3)
    for capacity, n in ((10, 300), (64, 500), (100, 1000), (7, 0)):
        lengths = rng.integers(1, capacity + 1, n).tolist()
        hist = {x: lengths.count(x) for x in set(lengths)}
        runs = packing.best_fit_runs(hist, capacity)
        assert sum(r[2] for r in runs) == n
        used = {int(r[3] + j // r[4]) for r in runs for j in range(r[2])}
        assert len(used) == plain_best_fit(lengths, capacity)


def test_place_by_join_equals_broadcast(spark, monkeypatch):
    rows = [(i, int(x)) for i, x in enumerate(np.random.default_rng(1).integers(1, 50, 300))]
    df = spark.createDataFrame(rows, "doc_id long, length long")
    a = sorted(map(tuple, packing.place(df, 64, ["doc_id"]).collect()))
    monkeypatch.setattr(packing, "MAX_BROADCAST_RUNS", 0)
    assert sorted(map(tuple, packing.place(df, 64, ["doc_id"]).collect())) == a
    with pytest.raises(ValueError):
        packing.place(spark.createDataFrame([(1, 99)], "doc_id long, length long"), 64, ["doc_id"])
