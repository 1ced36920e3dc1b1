"""KING-robust kinship and unrelated subsets over long dosages (sample, marker, g in 0, 1, 2 or null).

Counts of pairs come from Gram products of indicator blocks. Dosages, not pairs, are shuffled: all markers of one tile
of pairs meet in one task, which emits finished pairs. (Manichaikul et al. 2010.)
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import blocks_of

#: Kinship above which a pair counts as duplicate, first, second and third degree.
THRESHOLDS = {"duplicate": 0.354, "first": 0.177, "second": 0.0884, "third": 0.0442}


#: Samples along the side of one tile of pairs, at most; a task holds four counts for each pair of one tile.
TILE = 2048
#: Sides that samples are cut into, so that few samples with many markers meet in several tasks too, and the least worth one.
SIDES, LEAST_TILE = 8, 256
#: Bytes of dosages (one each) in one product, and pairs in one batch that leaves a task.
PRODUCT_BYTES, BATCH_PAIRS = 4 << 20, 1 << 18
#: Codes of dosages other than 0, 1 and 2: not observed, and observed with another value.
MISSING, OTHER = 3, 4


def kinship_pairs(markers: DataFrame, n: int, above: float | None = None, tile: int | None = None) -> DataFrame:
    """(i, j, n_het_i, n_het_j, n_hethet, n_homopp, phi) for each pair i < j of the n samples of a marker-major
    table, over markers observed in both; phi is null if neither is heterozygous anywhere. Only pairs ``above`` a kinship, if
    given; others do not leave Python. With t tiles along a side each dosage is shuffled as a byte t + 1 times, and pairs never."""
    tile = tile or min(TILE, max(LEAST_TILE, -(-n // SIDES)))
    sides = -(-n // tile)
    blocks = markers.select("g").mapInArrow(lambda batches: _split(batches, n, tile), "a int, b int, x binary, y binary")
    met = blocks.repartition(max(1, sides * (sides + 1) // 2), "a", "b").sortWithinPartitions("a", "b")
    counts = ("n_het_i", "n_het_j", "n_hethet", "n_homopp")
    pairs = met.mapInArrow(lambda batches: _count(batches, n, tile, above), "i int, j int, " + ", ".join(f"{c} int" for c in counts) + ", phi double")
    return pairs.select(*(F.col(c).cast("long").alias(c) for c in ("i", "j", *counts)), "phi")


def _split(batches, n: int, tile: int):
    """For each block of markers and each tile, the coded dosages of the tile's two slices of samples; one on the diagonal."""
    starts = range(0, n, tile)
    for batch in batches:
        for _, g in blocks_of(batch, n, max(1, PRODUCT_BYTES // tile)):
            codes = np.full(g.shape, OTHER, np.int8)
            codes[np.isnan(g)] = MISSING
            for k in (0, 1, 2):
                codes[g == k] = k
            slices = [codes[:, a : a + tile].tobytes() for a in starts]
            for a, x in enumerate(slices):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a] * (len(slices) - a), pa.int32()), pa.array(range(a, len(slices)), pa.int32()), pa.array([x] * (len(slices) - a), pa.binary()), pa.array([None, *slices[a + 1 :]], pa.binary())],
                    names=["a", "b", "x", "y"],
                )


def _count(batches, n: int, tile: int, above: float | None):
    """The pairs of each tile, whose blocks follow one another."""
    at, held, size, sums = None, [], 0, None

    def add():
        (a, b), (x, y) = at, (np.concatenate(z) for z in zip(*held))
        # float32 holds whole counts exactly up to 2 ** 24, more than the markers of one product
        is_x, is_y = ([(g == k).astype(np.float32) for k in (0, 1, 2)] for g in (x, y))
        products = [
            is_x[1].T @ (y != MISSING).astype(np.float32), (x != MISSING).astype(np.float32).T @ is_y[1],
            is_x[1].T @ is_y[1], is_x[0].T @ is_y[2] + is_x[2].T @ is_y[0],
        ]
        return [p.astype(np.int32) if s is None else s + p.astype(np.int32) for s, p in zip(sums or [None] * 4, products)]

    for batch in batches:
        for r in range(batch.num_rows):
            here = (batch.column("a")[r].as_py(), batch.column("b")[r].as_py())
            if at is not None and (here != at or size > PRODUCT_BYTES):
                sums, held, size = add(), [], 0
                if here != at:
                    yield from _pairs(at[0] * tile, at[1] * tile, sums, above)
                    sums = None
            at = here
            x, y = (None if v is None else np.frombuffer(v, np.int8).reshape(-1, min(tile, n - k * tile)) for v, k in zip((batch.column("x")[r].as_py(), batch.column("y")[r].as_py()), here))
            held.append((x, x if y is None else y))
            size += x.size
    if at is not None:
        sums = add()
        yield from _pairs(at[0] * tile, at[1] * tile, sums, above)


def _pairs(first_i: int, first_j: int, sums: list[np.ndarray], above: float | None):
    rows, columns = sums[0].shape
    strip = max(1, BATCH_PAIRS // columns)
    for top in range(0, rows, strip):
        hi, hj, both, opposite = (s[top : top + strip] for s in sums)
        low = np.minimum(hi, hj).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            phi = (both - 2.0 * opposite) / (2 * low) + 0.5 - (hi.astype(float) + hj) / (4 * low)
        i, j = first_i + top + np.arange(len(hi), dtype=np.int32)[:, None], first_j + np.arange(columns, dtype=np.int32)[None, :]
        keep = j > i
        if above is not None:
            keep &= (low > 0) & (phi > above)
        if not keep.any():
            continue
        whole = keep.all()
        i, j, hi, hj, both, opposite, phi, low = ((z.ravel() if whole else z[keep]) for z in (*np.broadcast_arrays(i, j), hi, hj, both, opposite, phi, low))
        arrays = [*map(pa.array, (i, j, hi, hj, both, opposite)), pa.array(phi, mask=low == 0)]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "n_het_i", "n_het_j", "n_hethet", "n_homopp", "phi"])


def unrelated(pairs: DataFrame, n: int, cutoff: float = THRESHOLDS["second"]) -> list[int]:
    """Samples kept: while a pair exceeds the cutoff, the sample in most such pairs goes (the last of equals). The driver
    holds some numbers a sample; the links, four bytes for each end, lie in a temporary file of the driver."""
    end = lambda a, b: F.struct(F.col(a).alias("s"), F.col(b).alias("other"))
    ends = pairs.where(F.col("phi") > cutoff).select(F.inline(F.array(end("i", "j"), end("j", "i"))))
    lists = ends.groupBy("s").agg(F.collect_set(F.col("other").cast("int")).alias("others"))

    def pack(batches):
        for batch in batches:
            packed = [np.asarray(others.values, np.int32).tobytes() for others in batch.column("others")]
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(packed, pa.binary())], names=["s", "others"])

    # from the last sample to the first, so that the first maximum is the last of equals
    start, count, total = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    with tempfile.TemporaryFile() as file:
        for r in lists.mapInArrow(pack, "s long, others binary").toLocalIterator():
            at = n - 1 - r["s"]
            start[at], count[at] = total, len(r["others"]) // 4
            total += int(count[at])
            file.write(r["others"])
        file.flush()
        links = np.memmap(file, np.int32, "r") if total else np.zeros(0, np.int32)
        left, gone = count.astype(np.int32), np.zeros(n, bool)
        while n and left[worst := int(left.argmax())] > 0:
            left[n - 1 - links[start[worst] : start[worst] + count[worst]]] -= 1
            left[worst], gone[worst] = np.iinfo(np.int32).min // 2, True
    return np.flatnonzero(~gone[::-1]).tolist()
