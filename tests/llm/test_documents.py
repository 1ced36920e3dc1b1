"""Operators 5, 6, 7, 9, 10 and the pipeline against brute force and planted cases."""

import json
import math
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from genoquilt.llm import chat, chunkdedup, graph, licenses, neardup, queries, toxicity

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(rng, n):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 8))) for _ in range(n)]


def shingles(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {("short", *w)} if w else set()


def brute_components(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() for n, a in enumerate(h) for b in h[n + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


@pytest.mark.parametrize("k", [4, 5])
def test_op5_whole_table(spark, sf_dir, k):
    docs = queries.table(spark, sf_dir, "documents")
    got = neardup.near_duplicates(docs, k=k)
    assert sorted(map(tuple, got.collect())) == brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()], k)


def near_copies(rng):
    """A large group around one text, a chain, short texts, copies, and others."""
    base, rows = words(rng, 120), []
    for _ in range(260):
        w = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            w[rng.randrange(len(w))] = words(rng, 1)[0]
        rows.append(" ".join(w))
    w = words(rng, 80)
    for _ in range(12):
        w = w[2:] + words(rng, 2)
        rows.append(" ".join(w).title())
    rows += ["one two", "ONE\ttwo\n", "one two three", "É é", "é É", "É É"] + [" ".join(words(rng, rng.randint(1, 60))) for _ in range(60)]
    rows += [rows[0]] * 30 + [rows[-3]] * 5
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_op5_large_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 24)
    monkeypatch.setattr(neardup, "SMALL_NODE", 8)
    rows = near_copies(random.Random(8))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4)
    assert sorted(map(tuple, got.collect())) == brute_components(rows, 4)


def test_op5_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "a b c d e", 0), (4, "a b c d e", 0), (None, "a b c d e", 0), (9, "A b c d e", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc int")
    got = sorted(map(tuple, neardup.near_duplicates(docs, k=4).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False), (None, 2, None, True)], key=str)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_op5_shared_ids(spark):
    rng = random.Random(3)
    a, b = (" ".join(words(rng, 40)) for _ in range(2))
    rows = [(0, b), (0, a), (1, b), (1, a), (2, a), (None, b), (None, a + " x")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4)
    want = [(0, 37, 0, True)] * 2 + [(1, 37, 0, False)] * 2 + [(2, 37, 0, False), (None, 37, None, True), (None, 38, None, True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_op5_recall_at_the_threshold_within_a_passage_group(spark):
    """Pairs at 0.80 to 0.82 among documents that all share a passage of half their length."""
    rng = random.Random(4)
    passage, rows = words(rng, 60), []
    for i in range(600):
        own = words(rng, 60)
        rows.append((2 * i, " ".join(passage + own)))
        if i < 200:  # 117 shingles of four, 104 shared: 104 / 130 = 0.8
            rows.append((2 * i + 1, " ".join(passage + own[:47] + words(rng, 13))))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    found = sum(r["component_id"] == r["doc_id"] - 1 for r in got if r["doc_id"] % 2)
    assert found >= 198 and all(r["kept"] for r in got if not r["doc_id"] % 2)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 60)] + [(None, 3)]
    up = list(range(700))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((i, find(i)) for i in nodes)


def test_components_short_lists_take_one_table(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(400)] + [(rng.randrange(-900, -1), rng.randrange(-900, -1)) for _ in range(700)] + [(7, 7), (None, 3), (500, None)]
    table, written, real = spark.createDataFrame(edges, "a long, b long"), [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name: written.append(name) or real(df, name))
    short = sorted(map(tuple, graph.components(table).collect()))
    assert len(written) == 1  # before, a table a round
    assert short == sorted(map(tuple, graph.components(table, few=0).collect())) and len(written) > 3
    assert dict(short)[400] == 0 and 500 not in dict(short)
    assert graph.components(table.where("a = 7")).count() == 2 and graph.components(table.limit(0)).count() == 0


def test_op6_segments_equal_brute_force():
    rng = random.Random(3)
    m = toxicity.ToxicModel({"bad": 2.0, "vile*": 1.5}, -0.4, 1.0, 0.1, (0.0, 1.0, 1.0))
    for _ in range(200):
        text = [rng.choice(["ok", "ok", "fine", "bad", "vileness"]) for _ in range(rng.randint(0, 25))]
        s = [{"bad": 2.0, "vileness": 1.5}[w] / (text[: i + 1].count(w)) if w in ("bad", "vileness") else -0.4 for i, w in enumerate(text)]

        def maximal(lo, hi):  # the definition: the best segment, then both sides of it
            best = max(((sum(s[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            return [] if best[0] <= 0 else maximal(lo, best[3]) + [(best[3], best[4] - 1, best[0])] + maximal(best[4], hi)

        got = m.segments(m.hits(text))
        want = maximal(0, len(s))
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_op6_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = queries.table(spark, d, "documents"), queries.table(spark, d, "labels")
    got = toxicity.score_documents(docs, toxicity.fit(docs, labels), 0.7, with_passages=True).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == r["toxic"] for r in got)
    tp = sum(r["predicted"] and r["toxic"] for r in got)
    assert hit >= 0.97 * len(got) and tp >= 0.83 * sum(r["toxic"] for r in got) and tp >= 0.95 * sum(r["predicted"] for r in got)
    assert all(0 <= r["score"] <= 1 for r in got) and any(r["passages"] for r in got if r["toxic"])


def test_op6_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good day", 1), (2, None, 1), (3, "", 1), (None, "x", 1), (1, "good day", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        m = toxicity.fit(docs, some)
        got = toxicity.score_documents(docs, m).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
        assert toxicity.score_documents(docs.limit(0), m).count() == 0


def test_op6_counts_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    common, vile = words(rng, 80), ["vileness", "vilest", "été"]
    rows = [(" ".join([*rng.choices(common, k=30), *rng.choices(vile, k=2 * (i % 5 == 0 or i % 17 == 0))]), int(i % 5 == 0), i % 2) for i in range(300)] + [(None, 0, 1), ("", 1, 0)]
    total = tuple(sum((t, h) == (toxic, half) for _, t, h in rows) for half in (0, 1) for toxic in (1, 0))
    sums = {}
    for text, toxic, half in rows:
        found = set((text or "").split())
        for w in found | {x[:n] + "*" for x in found for n in toxicity.STARTS if len(x) >= n}:
            sums.setdefault(w, [0, 0, 0, 0])[2 * half + 1 - toxic] += 1

    def clear(t, o, nt, no):
        base = nt / (nt + no)
        return t >= 3 and t - base * (t + o) >= toxicity.LEAST_Z * math.sqrt(base * (1 - base) * (t + o))

    want = {(w, *v) for w, v in sums.items() if clear(v[0] + v[2], v[1] + v[3], total[0] + total[2], total[1] + total[3]) or clear(*v[:2], *total[:2]) or clear(*v[2:], *total[2:])}
    monkeypatch.setattr(toxicity, "FLUSH", 60)
    batches = [pa.RecordBatch.from_pydict(dict(zip(("text", "toxic", "half"), map(list, zip(*rows[i : i + 70]))))) for i in range(0, len(rows), 70)]
    parts = list(toxicity._counts(batches))
    assert len(parts) > 2 and max(b.num_rows for b in parts) <= toxicity.PARTS
    dealt = spark.createDataFrame(pa.Table.from_batches(parts).cast(pa.schema([("part", pa.int32()), ("counts", pa.binary())])))
    got = dealt.groupBy("part").applyInArrow(toxicity._summed(total), "word string, t0 long, o0 long, t1 long, o1 long").collect()
    assert len(want) > 3 and len(got) == len(want) and {tuple(r) for r in got} == want


def test_op6_fit_writes_one_table(spark, monkeypatch):
    written, cut = [], toxicity.cut
    monkeypatch.setattr(toxicity, "cut", lambda df, name: written.append(name) or cut(df, name))
    rows = [(i, "vile words" if i % 5 == 0 else "kind words", int(i % 5 == 0)) for i in range(300)]
    m = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"))
    assert written == ["labelled"] and m.odds("vile") > 0 and not m.odds("kind")


def test_op7_planted_passages(spark):
    rng = random.Random(6)
    passage = " ".join(words(rng, 60))
    line = "This work is licensed under the GNU General Public License, version 3."
    clean = [(i, " ".join(words(rng, rng.randint(30, 300))) + "\n" + line) for i in range(40)]
    holders = [(100 + i, " ".join([*words(rng, 50 + 7 * i), passage, *words(rng, 40)])) for i in range(8)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in clean + holders], "doc_id long, text string, _places int")
    got = {r["doc_id"]: r for r in chunkdedup.repeated_passages(docs).collect()}
    assert all(got[i]["n_spans"] == 0 for i, _ in clean) and got[100]["n_spans"] == 0
    for i, t in holders[1:]:
        at = len(t[: t.index(passage)].encode())
        assert got[i]["n_spans"] == 1 and got[i]["spans"][0]["start"] >= at and got[i]["spans"][0]["end"] <= at + len(passage) + 1
    kept = {r["doc_id"]: r for r in chunkdedup.remove_repeats(docs).collect()}
    assert all(kept[i]["text"] == t for i, t in clean + holders[:1]) and all(passage not in kept[i]["text"] for i, _ in holders[1:])
    assert all(r["_places"] == 1 for r in kept.values())


def test_op7_chunks_cover_texts_and_odd_rows(spark):
    for t in ("", "a", "é" * 5000, "x" * 7000 + " y", " ".join(words(random.Random(1), 500))):
        raw = t.encode()
        parts = chunkdedup.split(raw, chunkdedup.chunk_ends(np.frombuffer(raw, np.uint8)) if raw else np.zeros(0, int))
        assert b"".join(raw[s:e] for s, e in parts) == raw
        [raw[s:e].decode() for s, e in parts]
    long = " ".join(words(random.Random(2), 200))
    docs = spark.createDataFrame([(1, long), (1, long), (2, None), (3, ""), (None, long), (4, long), (5, "é " * 40)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_bytes"], r["repeated_bytes"]) for r in chunkdedup.repeated_passages(docs).collect()), key=str)
    n = len(long)
    assert [g for g in got if g[0] != 5] == sorted([(1, n, 0), (1, n, 0), (2, 0, 0), (3, 0, 0), (None, n, 0), (4, n, n)], key=str)
    assert chunkdedup.repeated_passages(docs.limit(0)).count() == 0


def brute_spans(rows, min_words):
    """Spans of all rows by the definition: chunks, first occurrences by (id, text hash, place), runs, alignments."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t})
    chunks, first = {}, {}
    for d in docs:
        raw = d[1].encode()
        chunks[d] = [(s, e, raw[s:e]) for s, e in chunkdedup.split(raw, chunkdedup.chunk_ends(np.frombuffer(raw, np.uint8)))]
        for s, e, c in chunks[d]:
            first.setdefault(c, (d, s))
    out = {}
    for d in docs:
        found, run, reached = set(), {}, None
        for s, e, c in [*chunks[d], (None, None, None)]:
            if s is None or first[c] == (d, s) or s != reached and reached is not None:
                found |= {(x[0], x[1]) for x in run.values() if x[2] >= min_words}
                run = {}
            if s is not None and first[c] != (d, s):
                x = run.setdefault((first[c][0], s - first[c][1]), [s, s, 0])
                x[1], x[2], reached = e, x[2] + len(c.split()), e
        out[d] = sorted(found)
    return out


def test_op7_against_brute_force(spark):
    rng = random.Random(9)
    passages = [" ".join(words(rng, rng.randint(10, 90))) for _ in range(6)]
    common = words(rng, 12)
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choice(common) if rng.random() < 0.3 else w for w in words(rng, rng.randint(5, 60))) for _ in range(3)]
        rows.append((i, f" {rng.choice(passages)} ".join(parts)))
    rows += [rows[3], (None, rows[3][1]), (70, None), (71, ""), (72, rows[5][1])]
    got = chunkdedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_spans(rows, chunkdedup.MIN_WORDS)
    texts = dict(r for r in rows if r[0] is not None)
    assert len(got) == len(rows) and any(r["n_spans"] for r in got)
    for r in got:
        spans = want.get((r["doc_id"], texts.get(r["doc_id"])), [])
        covered = {x for s, e in spans for x in range(s, e)}
        assert {x for p in r["spans"] for x in range(p["start"], p["end"])} == covered and r["repeated_bytes"] == len(covered)


def test_op7_shared_ids(spark):
    rng = random.Random(12)
    a, b, c = (" ".join(words(rng, 120)) for _ in range(3))
    passage = a[300:700]
    rows = [(0, a), (5, f"{b[:200]} {passage} {b[200:]}"), (5, c * 2)]
    got = {r["text"]: r for r in chunkdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert a in got and c * 2 not in got and any(b[:100] in t and passage not in t for t in got)


def test_op9_links_orders_and_validates(spark):
    call = lambda i, name, args: "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": args}) + "</tool_call>"
    rows = [
        (1, 0, "user", 'Say "hi"\n'), (1, 3, "assistant", "Let me see. " + call("c1", "add", {"b": 2, "a": 1}) + call("c2", "add", {"a": "x"})),
        (1, 1, "tool", json.dumps({"tool_call_id": "c1", "content": "3"})), (1, 4, "tool", json.dumps({"tool_call_id": "c9", "content": "?"})),
        (2, 0, "assistant", call("c1", "none", {})), (2, 1, "assistant", "<tool_call>not json</tool_call>"), (2, 2, None, None), (None, None, "tool", "x"),
        (3, 0, "assistant", call("k", "add", {"a": 1, "b": 2})), (3, 1, "tool", json.dumps({"tool_call_id": "k", "content": "3"})),
    ]
    msgs = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, place int")
    tools = spark.createDataFrame([("add", ["a", "b"], {"a": "integer", "b": "integer"})], "name string, required array<string>, types map<string,string>")
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_chats(msgs, tools).collect()}
    assert len(got) == len(rows)
    first = got[1, 3]
    assert first["n_calls"] == 2 and first["linked"] is False and first["valid"] is False
    assert first["message"] == '{"content":"Let me see.","role":"assistant","tool_calls":[{"arguments":{"a":1,"b":2},"id":"c1","name":"add"},{"arguments":{"a":"x"},"id":"c2","name":"add"}]}'
    assert got[1, 1]["linked"] is True and got[1, 1]["place"] == 3 and json.loads(got[1, 1]["message"]) == {"content": "3", "role": "tool", "tool_call_id": "c1"}
    assert got[1, 4]["linked"] is False and got[2, 0]["valid"] is False and got[2, 0]["linked"] is False and got[2, 1]["n_calls"] == 1
    assert got[3, 0]["linked"] is True and got[3, 0]["valid"] is True
    assert json.loads(got[1, 0]["message"]) == {"content": 'Say "hi"\n', "role": "user"} and got[2, 2]["message"] == '{"content":"","role":""}'
    assert chat.format_chats(msgs.limit(0), tools).count() == 0


def test_op9_repeated_rows_and_null_keys(spark):
    call = lambda i: f'<tool_call>{{"id":"{i}","name":"f","arguments":{{}}}}</tool_call>'
    answer = lambda i: json.dumps({"tool_call_id": i, "content": "y"})
    rows = [(1, 5, "assistant", call("p")), (1, 5, "assistant", call("p")), (1, 5, "assistant", "other " + call("q")), (1, 2, "tool", answer("p"))]
    rows += [(None, None, "assistant", call("n")), (None, 3, "tool", answer("n")), (1, 7, "tool", answer("n")), (2, None, "tool", answer("m")), (2, 4, "assistant", call("m"))]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    first = [r for r in got if r["turn"] == 5]
    assert [r["n_calls"] for r in first] == [1] * 3 and sorted(r["linked"] for r in first) == [False, True, True]
    assert all(('"p"' in r["message"]) == r["linked"] and ('"other"' in r["message"]) != r["linked"] for r in first)
    by = {(r["conv_id"], r["turn"], r["role"]): r for r in got}
    assert by[1, 2, "tool"]["place"] == 5 and by[1, 2, "tool"]["linked"] and by[None, 3, "tool"]["linked"] and not by[1, 7, "tool"]["linked"]
    assert by[None, None, "assistant"]["n_calls"] == 1 and by[None, None, "assistant"]["place"] == -1 and "tool_call>" not in by[None, None, "assistant"]["message"]
    assert by[2, None, "tool"]["place"] == 4 and by[2, 4, "assistant"]["linked"]


def test_op9_query_links_and_validates(spark, tmp_path):
    call = lambda i, name, args: "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": args}) + "</tool_call>"
    rows = [(1, 0, "assistant", call("p", "refund", {"order": 3, "amount": 2.5})), (1, 1, "tool", json.dumps({"tool_call_id": "p", "content": "done"}))]
    rows += [(2, 5, "assistant", call("q", "lookup", {"order": "3"})), (2, 2, "tool", json.dumps({"tool_call_id": "q", "content": "?"}))]
    rows += [(3, 0, "assistant", call("r", "ghost", {})), (3, 1, "user", "hello")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): (r["place"], r["linked"], r["valid"]) for r in queries.op9_chat_formatting(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): (0, True, True), (1, 1): (1, True, None), (2, 5): (5, True, False), (2, 2): (5, True, None), (3, 0): (0, False, False), (3, 1): (1, None, None)}


def test_op10(spark):
    mit = next(t for i, t in licenses.NOTICES if t.startswith("MIT License"))
    docs = spark.createDataFrame(
        [(1, mit.upper().replace("<year>", "2020"), 0), (2, "Prose.\n licensed under the APACHE Licence; v2.0\nAll rights reserved!", 0), (3, None, 0), (4, "", 0), (5, "...", 0), (6, "released under the mit license", 0), (6, "released under the mit license", 0), (None, "x", 0)],
        "doc_id long, text string, license int",
    )
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs, licenses.known_digests(spark)).collect()}
    assert got[1]["text_license"] == "MIT" and got[6]["text_license"] == "MIT" and got[6]["n_lines"] == 1
    assert got[2]["line_licenses"] == ["Apache-2.0", "LicenseRef-all-rights-reserved"] and got[2]["text_license"] is None
    assert got[3]["text_digest"] is None and got[5]["text_license"] is None and got[4]["n_lines"] == 0
    assert licenses.scan_licenses(docs.limit(0), licenses.known_digests(spark)).count() == 0


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, _doc int, _places int, salt int, doc int, t1 int"


def odd_documents(spark):
    rng = random.Random(5)
    a, b = (" ".join(words(rng, 60)) for _ in range(2))
    rows = [(0, b), (1, b), (1, a), (2, a), (2, a), (None, a), (None, None), (3, None), (3, ""), (4, " \n"), (4, " \n"), (None, "é " * 30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 4, 5) for i, t in rows], EXTRA)
    return docs, a, b


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    docs, a, b = odd_documents(spark)
    names = sorted(docs.columns)
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    clean = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert clean.columns == docs.columns and pairs(clean) == pairs(docs)
    once = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    wordless = [(None, None), (3, None), (3, ""), (4, " \n"), (4, " \n")]
    assert once.columns == docs.columns and pairs(once) == sorted([(0, b), (1, a), (None, "é " * 30), *wordless], key=str)
    cleaned = corpus_pipeline.cut_repeats(spark, docs, sf_dir)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    assert {r["text"] for r in cleaned.where("doc_id = 0").collect()} == {b} and cleaned.where("doc_id is null and text is not null").count() == 2
    packed = corpus_pipeline.pack(spark, docs, sf_dir)
    assert packed.count() == docs.count() and packed.select("sequence_id").distinct().count() == 1
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_duplicates, corpus_pipeline.cut_repeats):
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0 and sorted(empty.columns) == names
    assert corpus_pipeline.pack(spark, docs.limit(0), sf_dir).count() == 0


def test_pipeline(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    once = corpus_pipeline.drop_near_duplicates(spark, kept, sf_dir)
    want = {i for i, _, _, own in brute_components([tuple(r) for r in kept.select("doc_id", "text").collect()], 5) if own}
    assert {r["doc_id"] for r in once.collect()} == want and once.count() == len(want)
    cleaned = corpus_pipeline.cut_repeats(spark, once, sf_dir)
    assert cleaned.columns == docs.columns and cleaned.count() == len(want) and cleaned.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == want
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_op10_full_texts(spark):
    bodies = {i: b[0] for i, _, b in licenses.TEXTS}
    mit = bodies["MIT"]
    wrapped = mit.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS OR\nCOPYRIGHT HOLDERS")
    rows = [("MIT", f"Copyright (c) 2020 A. Person\n\n{mit}"), ("MIT", f"The MIT License (MIT)\n\nCopyright 2020 A. Person\n\n{wrapped}"), ("MIT", f"MIT License Copyright (c) 2020 A. Person {' '.join(mit.split())}"), ("MIT", f"Copyright A. Person and others\n\n{mit}")]
    rows += [(i, f"{title}\n\nCopyright (c) 2001, 2020, The Example Authors\nAll rights reserved.\n\n{b}") for i, titles, texts in licenses.TEXTS for title in ["", *titles] for b in texts]
    common = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    paths = [(i, Path("/usr/share/common-licenses") / name) for name, i in common.items()]
    rows += [(i, p.read_text()) for i, p in paths if p.exists()]
    rows += [(None, mit.replace("COPYRIGHT HOLDERS BE LIABLE", "")), (None, f"{mit}\n\nMore words."), (None, f"Copyright holders of it\n\n{mit}"), (None, "Copyright (c) 2020 A. Person"), (None, None), (None, "")]
    docs = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id int, text string")
    got = {r["doc_id"]: r["text_license"] for r in licenses.scan_licenses(docs, licenses.known_digests(spark)).collect()}
    assert [got[n] for n in range(len(rows))] == [i for i, _ in rows]
