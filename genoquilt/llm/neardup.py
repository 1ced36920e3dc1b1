"""MinHash near-duplicates by chosen-path set similarity join.

Documents are sets of word shingles. Equal sets collapse first into classes. Then several independent trees branch the
classes: a node of a tree selects one or two coordinates of the MinHash signature, and a document goes to the child that
its minwise token there names. Nodes of few documents are compared exhaustively and branch no further;
larger ones branch on, to a fixed depth, unless a child keeps most of its parent's documents: these are alike, and
form a group as they are. Pairs whose signatures agree well enough inside a node join
candidate groups; every group is then decided on the full sets, all pairs of it, so that a link depends
on its exact similarity alone. Groups beyond a block's size are compared block by block with shared pivots, and
documents outside the group's largest component are then compared with all blocks. Links become components.

Recall: a pair at the threshold of 0.8 misses a tree's first branching with probability 0.2 or 0.04, 0.16 on average, so
all of eight trees with less than 1e-6. In nodes too large to be compared it is kept to the twelfth level with probability
0.32 a tree (all trees miss it with 0.05), unless both ends meet in a smaller or denser node before. Signatures of such a
pair agree in fewer than 36 of 64 coordinates with a probability of 4e-6, and only small nodes look at signatures.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Remembered, cut, forget, fresh, hold, merged
from .graph import components, hot_keys, spread_join

SIGNATURE = 64
TREES, DEPTH, SMALL_NODE = 8, 12, 48
#: Pairs whose signatures agree in a smaller share are not candidates: at 0.8, 64 coordinates and five deviations.
ESTIMATE_MARGIN = 0.25
BLOCK = 192
#: A child with this share of its parent's documents does not branch further. Copies at 0.8 of one text keep 0.89 of
#: its tokens; documents that share a passage fall below and branch on.
DENSE = 0.75
#: Documents outside their group's largest component meet the group in parts of this many documents and bytes of sets.
PART, PART_BYTES = 1024, 8 << 20
#: Distinct shingles that one product of a block's incidence matrix takes.
SHINGLES = 4096
#: Bytes of word hashes that a worker remembers.
CACHE_BYTES = 32 << 20
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _words() -> Remembered:
    """word -> hash."""
    return Remembered(xxhash.xxh3_64_intdigest, CACHE_BYTES, lambda word, _: 170 + len(word))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles of k words: A-Z lower-cased, words between
    ASCII white space; with fewer words the whole sequence is one shingle; without words the set is empty."""
    get, counts, flat = _words().__getitem__, [], []
    for t in texts:
        words = t.encode().lower().split() if t else ()
        flat.extend(map(get, words))
        counts.append(len(words))
    hashes = np.array(flat, np.uint64)
    n = len(hashes)
    at, out = 0, []
    if n:
        rolled = _mix(hashes)
        full = rolled[: max(0, n - k + 1)].copy()
        for j in range(1, k):
            full = _mix(full * _STEP + rolled[j : j + len(full)])
    for c in counts:
        if c == 0:
            out.append(np.zeros(0, np.uint64))
        elif c < k:
            h = rolled[at : at + 1].copy()
            for j in range(1, c):
                h = _mix(h * _STEP + rolled[at + j : at + j + 1])
            out.append(_mix(h + np.uint64(c)))  # a whole text of c words equals no shingle of k
        else:
            out.append(np.unique(full[at : at + c - k + 1]))
        at += c
    return out


def signatures(sets: list[np.ndarray], t: int = SIGNATURE) -> np.ndarray:
    """MinHash signatures (rows, t) of uint32; the sets must not be empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    rng = np.random.default_rng(20)
    mult = rng.integers(1, 2**63, t, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), t), np.uint32)
    for i in range(t):
        out[:, i] = np.minimum.reduceat((flat * mult[i]) >> np.uint64(32), starts)
    return out


def _sketch_udf(k: int):
    """(doc, t1, t2) as they are, with the set's size, digest (d1, d2) and signature."""

    def run(batches):
        hold("neardup", _words.cache_clear)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets(part.column("text").to_pylist(), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = [None] * len(sets)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full])):
                        sig[i] = row.tobytes()
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                names = ["doc", "t1", "t2"]
                own = [pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + own, names=[*names, "n", "d1", "d2", "sig"])

    return run


def _roots(trees: int):
    """The first branching: (seed of the child, coordinate) pairs of all trees."""
    out = []
    for tree in range(trees):
        node = _mix(np.array([tree + 1], np.uint64) * _STEP)
        out += [(int(node[0]), c) for c in _choices(node)[0]]
    return out


def _choices(nodes: np.ndarray, t: int = SIGNATURE) -> list[list[int]]:
    """The coordinates at which each node branches: two for every fourth node, 1.25 on average (one over the threshold)."""
    a, b = _mix(nodes + np.uint64(1)), _mix(nodes + np.uint64(2))
    two = (_mix(nodes + np.uint64(3)) & np.uint64(3)) == 0
    first, second = a % np.uint64(t), b % np.uint64(t - 1)
    second = second + (second >= first).astype(np.uint64)
    return [[int(x), int(y)] if z else [int(x)] for x, y, z in zip(first, second, two)]


def _first_children(trees: int):
    def run(batches):
        roots = _roots(trees)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.uint64)
            for node, c in roots:
                child = _mix((sig[:, c] + np.uint64(c << 32)) * _STEP ^ np.uint64(node))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("doc")], names=["node", "doc"])

    return run


def _next_children(batches):
    for batch in batches:
        nodes = batch.column("node").to_numpy().view(np.uint64)
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.uint64)
        own, which = np.unique(nodes, return_inverse=True)
        picks = _choices(own)
        for j in range(2):
            c = np.array([p[j] if j < len(p) else -1 for p in picks])[which]
            rows = np.flatnonzero(c >= 0)
            child = _mix((sig[rows, c[rows]] + (c[rows].astype(np.uint64) << np.uint64(32))) * _STEP ^ nodes[rows])
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("doc").take(pa.array(rows)), batch.column("c").take(pa.array(rows))], names=["node", "doc", "above"])


def _find(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def _likely(least: float):
    """Of each small node, compared exhaustively: the links of a spanning forest of the pairs with signatures alike."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for members in batch.column("members").to_pylist():
                docs = [m["doc"] for m in members]
                sig = np.frombuffer(b"".join(m["sig"] for m in members), np.uint32).reshape(len(docs), -1)
                up = list(range(len(docs)))
                for i in range(1, len(docs)):
                    same = (sig[:i] == sig[i]).mean(axis=1)
                    for j in np.flatnonzero(same >= least).tolist():
                        if (x := _find(up, i)) != (y := _find(up, j)):
                            up[x] = y
                            a.append(docs[i])
                            b.append(docs[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _candidate_links(reps: DataFrame, total: int, trees: int, depth: int, least: float) -> DataFrame:
    """Links between documents that may be similar: (a, b)."""
    members = cut(reps, "children", _first_children(trees), "node long, doc long")
    above, lists, stars, rows = F.lit(total), [], [], 2 * trees * total
    for level in range(1, depth + 1):
        counts = members.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        hot = hot_keys(counts, "node", total)  # a level has about as many rows as there are documents, or trees times as many
        last, sized = members, cut(merged(spread_join(members.withColumn("above", above), counts, "node", hot, "doc"), rows), "members")
        forget(last)
        lists.append(sized.where(F.col("c") <= SMALL_NODE).groupBy("node").agg(F.sort_array(F.collect_list("doc")).alias("docs")).select("docs"))
        big = sized.where(F.col("c") > SMALL_NODE)
        ends = F.col("c") >= DENSE * F.col("above") if level < depth else F.lit(True)
        heads = big.where(ends).groupBy("node").agg(F.min("doc").alias("a"))
        stars.append(spread_join(big.where(ends), heads, "node", hot, "doc").where("a <> doc").select("a", F.col("doc").alias("b")))
        big = big.where(~ends)
        if level == depth or big.isEmpty():
            break
        members = big.join(reps.select("doc", "sig").hint("merge"), "doc").select("node", "doc", "c", "sig")
        members, above = cut(merged(members, rows), "children", _next_children, "node long, doc long, above long"), F.col("above")
    nodes = lists[0]
    for x in lists[1:]:
        nodes = nodes.unionByName(x)
    nodes = nodes.distinct()  # trees find the same groups again and again
    each = nodes.select(F.xxhash64("docs").alias("k"), F.size("docs").alias("c"), F.explode("docs").alias("doc"))
    held = each.join(reps.select("doc", "sig").hint("merge"), "doc").groupBy("k", "c").agg(F.collect_list(F.struct("doc", "sig")).alias("members"))
    links = held.select("members").mapInArrow(_likely(least), "a long, b long")
    for x in stars:
        links = links.unionByName(x)
    return links.distinct()


def _full_sets(k: int):
    def run(batches):
        hold("neardup", _words.cache_clear)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets(part.column("text").to_pylist(), k)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "shingles"])

    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``left`` with those at ``right``: products of incidence matrices, some
    thousand distinct shingles at a time."""
    out = np.zeros((len(left), len(right)), np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.concatenate([[False], flat[1:] != flat[:-1]]), dtype=np.int32)
    del flat, order
    shared = np.bincount(column)[column] > 1  # a shingle of one document meets none
    owner, column = owner[shared], column[shared]
    if not len(owner):
        return out
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    for lo in range(0, int(column[-1]) + 1, SHINGLES):
        a, b = np.searchsorted(column, (lo, lo + SHINGLES))
        held = np.zeros((len(sets), SHINGLES), np.float32)
        held[owner[a:b], column[a:b] - lo] = 1
        out += (held[left] @ held[right].T).astype(np.int64)
    return out


def _linker(percent: int):
    """The links of all pairs of a block, decided on their full sets, as far as they connect anything. With visitors
    (``asks``) only pairs of a visitor and a host are of interest."""

    def run(tab: pa.Table) -> pa.Table:
        rows = {}  # a document can be visitor and host
        for doc, ask, raw in zip(tab.column("doc").to_pylist(), tab.column("asks").to_pylist(), tab.column("shingles")):
            if (doc, ask) not in rows:
                rows[doc, ask] = np.frombuffer(raw.as_buffer(), np.uint64)
        docs, asks, sets = [d for d, _ in rows], np.array([k for _, k in rows]), list(rows.values())
        a, b = [], []
        if len(docs) > 1:
            every = np.arange(len(docs))
            left, right = (every[asks], every[~asks]) if asks.any() else (every, every)
            n = np.array([len(x) for x in sets])
            both = _overlaps(sets, left, right)
            union = n[left][:, None] + n[right][None, :] - both
            up = list(range(len(docs)))
            for i, j in zip(*np.nonzero(100 * both >= percent * union)):
                i, j = int(left[i]), int(right[j])
                if (x := _find(up, i)) != (y := _find(up, j)):
                    up[x] = y
                    if docs[i] != docs[j]:
                        a.append(docs[i])
                        b.append(docs[j])
        cluster = tab.column("cluster")[0].as_py()
        return pa.table({"cluster": pa.array([cluster] * len(a), pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _decided(sets: DataFrame, assigned: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that hold on the full sets; ``assigned`` is (doc, cluster, block, sub, asks)."""
    found = sets.join(assigned.hint("merge"), "doc").groupBy("cluster", "block", "sub").applyInArrow(_linker(percent), "cluster long, a long, b long")
    return found.select("a", "b").distinct()  # a shuffle, so the workers that decide are not beside those that write


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, t1, t2, text): the id and two hashes of the text, which together name a document whatever ids are shared."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def _components(rows: DataFrame, sketches: DataFrame, k: int, percent: int, trees: int, depth: int) -> DataFrame:
    """(d1, d2, component): the component of each class, that is of each set digest, of the sketches that are not
    empty. Classes have numbers of their own, so documents that share an id stay apart."""
    best = F.min(F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "t1", "t2")).alias("rep")
    numbered = sketches.where("n > 0").groupBy("d1", "d2").agg(best, F.first("sig").alias("sig"), F.first("n").alias("n"))
    classes = cut(numbered.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay
    reps = classes.select(F.col("node").alias("doc"), "sig")
    total = reps.count()
    most = 2 * trees * total
    links = components(_candidate_links(reps, total, trees, depth, percent / 100 - ESTIMATE_MARGIN), rows=most)
    clusters = cut(merged(links.select(F.col("node").alias("doc"), F.col("component").alias("cluster")), most), "clusters")

    pivot = [F.min(F.struct(F.xxhash64("doc", F.lit(s)).alias("h"), "doc"))["doc"].alias(f"p{s}") for s in range(4)]
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), *pivot)
    sizes = sizes.withColumn("blocks", F.when(F.col("m") <= BLOCK, 1).otherwise(F.ceil(F.col("m") / (BLOCK // 2))).cast("int"))
    hot = hot_keys(sizes.withColumnRenamed("m", "c"), "cluster", clusters.count())
    placed = spread_join(clusters, sizes.select("cluster", "blocks"), "cluster", hot, "doc")
    block = F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("doc", F.lit(9)), F.col("blocks"))).cast("int")
    placed = placed.select("doc", "cluster", block.alias("block"), "blocks")
    wide = cut(merged(sizes.where("blocks > 1"), most), "wide")  # groups beyond a block
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pivots = wide.select(F.explode(F.array_distinct(F.array("p0", "p1", "p2", "p3"))).alias("doc"), "cluster", blocks.alias("block"))
    plain = [F.lit(0).alias("sub"), F.lit(False).alias("asks")]
    assigned = placed.select("doc", "cluster", "block", *plain).unionByName(pivots.select("doc", "cluster", "block", *plain)).distinct()

    # the texts move once, whatever their number: a broadcast of the ids would grow with the corpus
    name = [F.col(f"rep.{c}").alias(f"r_{c}") for c in ("doc", "t1", "t2")]
    chosen = clusters.join(classes.select(F.col("node").alias("doc"), "rep").hint("merge"), "doc").select(F.col("doc").alias("node"), *name)
    same = F.col("doc").eqNullSafe(F.col("r_doc")) & (F.col("t1") == F.col("r_t1")) & (F.col("t2") == F.col("r_t2"))
    texts = rows.join(chosen.hint("merge"), same).select(F.col("node").alias("doc"), "text")
    sets = cut(texts, "sets", _full_sets(k), "doc long, shingles binary")  # repeated rows repeat their set
    held = cut(merged(_decided(sets, assigned, percent), most), "links")
    found = components(held, rows=most)
    if not wide.isEmpty():
        inside = placed.where("blocks > 1")
        found = cut(merged(found, most), "components")
        named = inside.join(found.withColumnRenamed("node", "doc").hint("merge"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        counted = named.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("c"))
        main = counted.groupBy("cluster").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
        apart = cut(merged(spread_join(named, main, "cluster", hot, "doc").where("component <> main").select("doc", "cluster", "blocks"), most), "apart")
        if not apart.isEmpty():
            size = F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.sum("n") * 8 / PART_BYTES)).cast("int")
            lengths = classes.select(F.col("node").alias("doc"), "n")
            asking = apart.join(lengths, "doc").groupBy("cluster").agg(size.alias("subs"))
            parts = inside.join(lengths, "doc").groupBy("cluster").agg(size.alias("parts")).join(asking, "cluster")
            own = lambda seed, n: F.pmod(F.xxhash64("doc", F.lit(seed)), F.col(n)).cast("int")
            every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            guests = spread_join(apart, parts, "cluster", hot, "doc").select("doc", "cluster", every("parts").alias("block"), own(5, "subs").alias("sub"), F.lit(True).alias("asks"))
            hosts = spread_join(inside, parts, "cluster", hot, "doc").select("doc", "cluster", own(9, "parts").alias("block"), every("subs").alias("sub"), F.lit(False).alias("asks"))
            more = cut(merged(_decided(sets, guests.unionByName(hosts), percent), most), "links")
            found = components(held.unionByName(more), rows=most)
            forget(more)
        forget(apart)
    found = cut(merged(found, most), "found")
    forget(held, sets, wide, clusters)
    return classes.join(found, "node", "left").select("d1", "d2", "rep", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = TREES, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, n_shingles long, component_id long, kept boolean) for each row: the size of its shingle set, the
    smallest id reachable over links (100 * intersection >= percent * union), and whether that is its own.

    A null or empty text has the empty set and links with nothing; a null id has a null component, is kept and takes no
    part in links. Repeated rows are answered each; rows that share an id but not the text are answered each by its own
    text. An empty table gives no rows; other columns are ignored. Tables and
    links of all documents stay distributed; a task holds one block's sets at a time.
    """
    rows = _keyed(docs, id_col, text_col)
    sketches = cut(rows, "sketches", _sketch_udf(k), "doc long, t1 long, t2 long, n long, d1 long, d2 long, sig binary")
    classes = _components(rows, sketches.where("doc is not null"), k, percent, trees, depth)
    least = classes.groupBy("component").agg(F.min("rep.doc").alias("least"))
    by_class = classes.select("d1", "d2", "component").join(least, "component").select("d1", "d2", "least")
    out = sketches.select("doc", "n", "d1", "d2").join(by_class, ["d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("least")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = TREES, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that stay when each group of linked documents keeps one: the row with the
    smallest id, nulls last, of several with that id the one with the smallest hash of its text.

    Rows are told apart by id and text, so no text is lost to another one with its id; of rows that repeat both, one
    stays. Rows with a null id take part like others. Null texts and texts without words are linked with nothing and
    stay, all of them. An empty table stays empty.
    """
    rows = _keyed(docs, id_col, text_col)
    sketches = cut(rows, "sketches", _sketch_udf(k), "doc long, t1 long, t2 long, n long, d1 long, d2 long, sig binary")
    classes = _components(rows, sketches, k, percent, trees, depth)
    names = [fresh(docs, n) for n in ("_doc", "_t1", "_t2")]
    best = classes.groupBy("component").agg(F.min("rep").alias("rep")).select(*(F.col(f"rep.{c}").alias(n) for c, n in zip(("doc", "t1", "t2"), names)))
    text = docs[text_col]
    same = docs[id_col].cast("long").eqNullSafe(best[names[0]]) & (F.xxhash64(text) == best[names[1]]) & (F.xxhash64(F.lit(1), text) == best[names[2]])
    kept = docs.where(has_words(F.col(text_col))).join(best.hint("merge"), same)
    # rows that repeat id and text: the first by a hash of what can be hashed; Spark limits each group before the shuffle
    order, n = [F.xxhash64(*(c for c, t in docs.dtypes if "map<" not in t and "variant" not in t))], fresh(docs, "_n")
    kept = kept.withColumn(n, F.row_number().over(Window.partitionBy(*names).orderBy(*order))).where(F.col(n) == 1)
    return kept.drop(*names, n).unionByName(docs.where(~has_words(F.col(text_col))))
