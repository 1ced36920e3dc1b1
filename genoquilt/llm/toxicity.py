"""Toxicity by maximum-scoring segments over token log-odds.

Fit: each word and word start of three to seven letters gets its log-odds of standing in toxic rather than other
labelled documents, under a Dirichlet prior centred on the next shorter start and for the shortest on the corpus
(informative priors as in Monroe et al. 2008); those clearly above zero form the lexicon. A token scores by its longest
entry, less at each repetition; every other token scores slightly below zero, by the log-ratio of not hitting
the lexicon. Scan: all maximal-scoring segments in linear time
(Ruzzo and Tompa 1999); a segment of score s among n tokens is expected K n exp(-lambda s) times by chance
(Karlin and Altschul 1990), and significant ones are the toxic passages. A document's score is a logistic
calibration of its best passage's extreme-value significance and the number of passages.
"""

from __future__ import annotations

import dataclasses
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Remembered, arrow_rows, cut, forget, hold

#: Labelled documents that the fit reads at most, chosen by hash of the id.
FIT_DOCUMENTS = 200_000
#: Weight of the prior, in documents; z above which an entry counts; expected chance passages below which one is significant.
PRIOR_DOCUMENTS, LEAST_Z, LEAST_EVALUE = 4.0, 4.0, 0.05
STARTS = (7, 6, 5, 4, 3)
#: Words that a task counts before it hands them on, parts that they are dealt to; bytes of words' odds that a worker remembers.
FLUSH, PARTS, CACHE_BYTES = 200_000, 256, 24 << 20
COUNTS = pa.schema([("word", pa.string()), ("kind", pa.int8()), ("n", pa.int64())])
_WORD = re.compile(r"[^\W_]+")


@dataclasses.dataclass
class ToxicModel:
    """Lexicon (words, and word starts marked by a trailing ``*``), background score, extreme-value parameters and
    the calibration's weights. Its size is bounded by what FIT_DOCUMENTS documents hold."""

    lexicon: dict[str, float]
    background: float
    decay: float
    scale: float
    weights: tuple[float, float, float]

    def odds(self, word: str) -> float:
        """The word's longest entry; 0 without one."""
        for key in (word, *(word[:n] + "*" for n in STARTS if len(word) >= n)):
            if key in self.lexicon:
                return self.lexicon[key]
        return 0.0

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        if not hasattr(self, "_known"):
            self._known = Remembered(self.odds, CACHE_BYTES, lambda word, _: 160 + len(word))
            hold("toxicity", lambda: self.__dict__.pop("_known", None))
        scores = list(map(self._known.__getitem__, words))
        if not any(scores):
            return []
        out, before = [], {}
        for i, s in enumerate(scores):
            if s:
                w = words[i]
                before[w] = before.get(w, 0) + 1
                out.append((i, s / before[w]))
        return out

    def segments(self, hits: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
        """All maximal-scoring segments (first word, last word, score). Tokens between hits all score the background,
        so the scan steps from hit to hit; amortised linear."""
        stack: list[list] = []  # first, last, total before, total after
        total, at = 0.0, 0
        for i, s in hits:
            total += self.background * (i - at)
            at = i + 1
            new = [i, i, total, total + s]
            total += s
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= new[2]:
                    j -= 1
                if j < 0 or stack[j][3] >= new[3]:
                    stack.append(new)
                    break
                new = [stack[j][0], new[1], stack[j][2], new[3]]
                del stack[j:]
        return [(a, b, y - x) for a, b, x, y in stack]

    def expected(self, score: float, n: int) -> float:
        """Log of how many segments of this score chance makes among n tokens."""
        return math.log(self.scale) + math.log(max(n, 1)) - self.decay * score

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Score from 0 to 1, and the significant passages (first word, end word, score, log of the expected number)."""
        words = _WORD.findall(text.lower()) if text else []
        found = [(a, b + 1, s, self.expected(s, len(words))) for a, b, s in self.segments(self.hits(words))]
        return _logistic(self.weights, features(found)), [f for f in found if f[3] <= math.log(LEAST_EVALUE)]


def features(found: list[tuple[int, int, float, float]]) -> tuple[float, float]:
    """Surprise of the best segment (minus log of its expected number, within bounds), and how many are significant."""
    best = min((f[3] for f in found), default=math.inf)
    return min(40.0, max(-10.0, -best)) / 10, math.log1p(sum(f[3] <= math.log(LEAST_EVALUE) for f in found))


def _logistic(w, x) -> float:
    z = w[0] + w[1] * x[0] + w[2] * x[1]
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def held_out(id_col: Column) -> Column:
    """Rows that the fit must not read: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _counts(batches):
    """(part, counts): in how many documents of each kind (0 and 1 toxic and other ones of the first half, 2 and 3 of the second) each
    word or word start stands, by task. ``counts`` holds a part's (word, kind, n) as an Arrow stream, so that Spark moves a few
    hundred rows a task and its JVM sums none."""
    seen: tuple[Counter, ...] = tuple(Counter() for _ in range(4))

    def out():
        words = [w for c in seen for w in c]
        part = np.fromiter((zlib.crc32(w.encode()) % PARTS for w in words), np.int32, len(words))
        order = np.argsort(part, kind="stable")
        n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in seen])
        counts = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.repeat(np.arange(4, dtype=np.int8), list(map(len, seen)))), pa.array(n)], schema=COUNTS).take(pa.array(order))
        ends = np.searchsorted(part[order], np.arange(PARTS + 1))
        some = [k for k in range(PARTS) if ends[k] < ends[k + 1]]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_packed(counts.slice(ends[k], ends[k + 1] - ends[k])) for k in some], pa.binary())], names=["part", "counts"])

    for whole in batches:
        for lo in range(0, whole.num_rows, 512):  # bounds the Python objects alive at once
            batch = whole.slice(lo, 512)
            for text, toxic, half in zip(*(batch.column(n).to_pylist() for n in ("text", "toxic", "half"))):
                words = set(_WORD.findall(text.lower())) if text else set()
                words |= {w[:n] + "*" for n in STARTS for w in words if len(w) >= n}
                seen[2 * half + (not toxic)].update(words)
                if sum(map(len, seen)) > FLUSH:
                    yield out()
                    for c in seen:
                        c.clear()
    if any(seen):
        yield out()


def _packed(counts: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, counts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(counts)
    return sink.getvalue().to_pybytes()


def _summed(total: tuple[int, int, int, int]):
    """For ``applyInArrow``: a part's words that are clear in either half or in both, with their sums over all tasks by kind.
    ``total``: the documents of each kind."""

    def clear(t, o, n_toxic, n_other):
        base = n_toxic / max(1, n_toxic + n_other)
        return (t >= 3) & (t - base * (t + o) >= LEAST_Z * np.sqrt(base * (1 - base) * (t + o)))

    def run(part: pa.Table) -> pa.Table:
        every = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in part.column("counts")]).combine_chunks()
        words = every.column("word").combine_chunks().dictionary_encode()
        sums = np.zeros((len(words.dictionary), 4), np.int64)
        np.add.at(sums, (words.indices.to_numpy(), every.column("kind").to_numpy()), every.column("n").to_numpy())
        t0, o0, t1, o1 = sums.T
        found = np.flatnonzero(clear(t0 + t1, o0 + o1, total[0] + total[2], total[1] + total[3]) | clear(t0, o0, *total[:2]) | clear(t1, o1, *total[2:]))
        return pa.table([words.dictionary.take(pa.array(found)), *sums[found].T.copy()], names=["word", "t0", "o0", "t1", "o1"])

    return run


def _lexicon(rows: dict[str, tuple[int, int]], nt: int, no: int) -> tuple[dict[str, float], list[tuple[float, float]]]:
    """Entries with their log-odds, and (rate among other documents, log-odds) of the words."""
    if not nt or not no:
        return {}, []
    base = nt / (nt + no)
    out, rates, mean = {}, [], {}
    for key in sorted(rows, key=lambda k: (len(k.rstrip("*")), not k.endswith("*"))):  # shorter starts first, a word after the start of its length
        t, o = rows[key]
        if t < 3 or t - base * (t + o) < LEAST_Z * math.sqrt(base * (1 - base) * (t + o)):
            continue
        stem = key.rstrip("*")
        parent = next((mean[p] for m in range(len(stem), min(STARTS) - 1, -1) if (p := stem[:m] + "*") != key and p in mean), base)
        prior = min(parent, max(base, 0.8))
        mean[key] = (t + PRIOR_DOCUMENTS * prior) / (t + o + PRIOR_DOCUMENTS)
        odds = math.log(mean[key] / (1 - mean[key])) - math.log(base / (1 - base))
        if odds > 0:
            out[key] = odds
            if not key.endswith("*"):
                rates.append((o / no, odds))
    return out, rates


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_documents: int = FIT_DOCUMENTS) -> ToxicModel:
    """Fits on labelled documents outside the held-out third. Labels null or of null ids are left out; an id with
    several labels counts as toxic if one says so. Without a toxic or without another document nothing is toxic.

    The lexicon comes from all of them; background, extreme values and calibration from scoring each half of them by
    the other half's lexicon, so that they hold for texts the lexicon has not seen. What reaches the driver (entries
    that stand in three toxic documents at least, and a row a document) is bounded by ``max_documents``.
    """
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    some = some.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("id"), "id").limit(max_documents).withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").select("text", "toxic", "half")  # bounded by max_documents rows of 16 bytes
    texts = cut(texts, "labelled")  # read three times

    n = {(r["half"], r["toxic"]): r["count"] for r in texts.groupBy("half", "toxic").count().collect()}
    total = tuple(n.get((half, toxic), 0) for half in (0, 1) for toxic in (1, 0))
    nt, no = total[0] + total[2], total[1] + total[3]
    if not nt or not no:
        forget(texts)
        return ToxicModel({}, 0.0, 1.0, 1.0, (4.0 if nt else -4.0, 0.0, 0.0))

    counted = texts.mapInArrow(_counts, "part int, counts binary").groupBy("part")
    kept = counted.applyInArrow(_summed(total), "word string, t0 long, o0 long, t1 long, o1 long").collect()
    every, rates = _lexicon({r["word"]: (r["t0"] + r["t1"], r["o0"] + r["o1"]) for r in kept}, nt, no)
    halves = [_lexicon({r["word"]: (r[f"t{h}"], r[f"o{h}"]) for r in kept}, *total[2 * h : 2 * h + 2])[0] for h in (0, 1)]
    background = -0.02
    schema = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("n_hits", pa.int64()), ("scores", pa.list_(pa.float64()))])

    def scan(background):
        models = [ToxicModel(halves[1 - h], background, 1.0, 1.0, (0.0, 0.0, 0.0)) for h in (0, 1)]

        def make():
            def one(text, half):
                words = _WORD.findall(text.lower()) if text else []
                hits = models[half].hits(words)
                return len(words), len(hits), [s for _, _, s in models[half].segments(hits)]

            def apply(rows):
                got = list(map(one, rows["text"], rows["half"]))
                return {"toxic": rows["toxic"], "n": [g[0] for g in got], "n_hits": [g[1] for g in got], "scores": [g[2] for g in got]}

            return apply

        return texts.mapInArrow(arrow_rows(make, schema), "toxic int, n long, n_hits long, scores array<double>")

    sums = {r["toxic"]: r for r in scan(background).groupBy("toxic").agg(F.sum("n").alias("n"), F.sum("n_hits").alias("h")).collect()}
    rate = {t: (sums[t]["h"] + 0.5) / (sums[t]["n"] + 1) if t in sums else 0.0 for t in (0, 1)}
    background = min(-0.002, math.log((1 - rate[1]) / (1 - rate[0])))
    # lambda: the positive root of sum p exp(lambda s) = 1 over the token scores of other documents; K from their segments
    share = rate[0] / max(1e-12, sum(o for o, _ in rates))
    p = np.array([o * share for o, _ in rates] + [0.0]) + 1e-9
    s = np.array([x for _, x in rates] + [1.0])
    low, high = 1e-3, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        above = float((p * np.exp(np.minimum(mid * s, 500))).sum() + (1 - p.sum()) * math.exp(mid * background)) > 1
        low, high = (low, mid) if above else (mid, high)
    decay = min(max(low, 0.2), 2.0)
    seen = scan(background).select("toxic", "n", "scores").collect()  # a row a document of the bounded sample
    chance = [x for r in seen if not r["toxic"] for x in r["scores"]]
    tokens = sum(r["n"] for r in seen if not r["toxic"])
    scale = max(1e-9, (len(chance) + 0.5) / (tokens + 1) * math.exp(decay * min(chance, default=1.0)))
    model = ToxicModel(every, background, decay, scale, (0.0, 0.0, 0.0))
    found = [features([(0, 0, x, model.expected(x, r["n"])) for x in r["scores"]]) for r in seen]
    model.weights = _fit_logistic(np.array(found), np.array([r["toxic"] for r in seen], float))
    forget(texts)
    return model


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Newton steps for a ridge-penalised logistic regression with an intercept."""
    x1, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    penalty = np.diag([1e-6, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -40, 40)))
        step = np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + penalty, x1.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def score_documents(docs: DataFrame, model: ToxicModel, threshold: float = 0.7, with_passages: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out boolean, score double, predicted int[, passages]) for each row. ``passages``: array of (first_word,
    end_word, score, log_expected), words counted from 0. Nothing but the text decides a score. A null text counts
    as empty and scores like a text without hits; a null id is not held out; repeated rows are scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see ToxicModel
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())] + [("passages", pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("log_expected", pa.float64())])))] * with_passages)

    def make():
        judge = shared.value.judge

        def apply(rows):
            got = [judge(t) for t in rows["text"]]
            out = {"id": rows["id"], "score": [g[0] for g in got]}
            if with_passages:
                out["passages"] = [[dict(zip(("first_word", "end_word", "score", "log_expected"), p)) for p in g[1]] for g in got]
            return out

        return apply

    sql = "id long, score double" + ", passages array<struct<first_word:int,end_word:int,score:double,log_expected:double>>" * with_passages
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(arrow_rows(make, schema), sql)
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *["passages"] * with_passages)


def keep_clean(docs: DataFrame, model: ToxicModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below the threshold. A null
    text scores as an empty one, like a text without hits; repeated rows are judged each alike; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = shared.value.judge
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                yield batch.filter(pa.array([judge(t)[0] < threshold for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
