"""Exact lists of the most similar vectors: every two blocks of vectors are compared, but for those that a bound rules out.

A block holds up to ``ROWS`` vectors of one cell, with a floor for each: a cosine that its list's
last entry reaches for certain, known from a graph. Two blocks are compared by a matrix product in
single precision; whatever is not below the floors by more than its error is computed again in
double precision. Nothing is left out but what cannot be in a list: pairs below both floors, and
blocks and vectors which, by the triangle inequality of angles, have only such pairs.

Blocks meet in a Cartesian product that reads them as written, so nothing is shuffled but what is
found. The work is quadratic in the collection where the bound rules out nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block, vectors of it that are compared at a time, and candidates held before they are computed exactly.
ROWS, TILE, HELD = 12_288, 256, 1 << 20
#: Blocks that a task holds decoded.
KNOWN = 12
#: More than the errors of a product of unit vectors in single precision, and of an angle taken from one.
SLACK, ANGLE = 1e-5, 5e-3
BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("raw", pa.binary()), ("floors", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("floor", pa.float64())])
BLOCK_SQL = "block long, ids binary, raw binary, floors binary, centre array<double>, radius double, floor double"
FOUND = pa.schema([("vec", pa.int64()), ("near", pa.int64()), ("cosine", pa.float64())])


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Unit float32 rows."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired float32 rows, summed in the order of the elements as SQL's list_cosine_similarity does."""
    a, b = np.ascontiguousarray(a.T, dtype=np.float64), np.ascontiguousarray(b.T, dtype=np.float64)
    dot, aa, bb = (np.zeros(a.shape[1]) for _ in range(3))
    for x, y in zip(a, b):
        dot += x * y
        aa += x * x
        bb += y * y
    return np.clip(dot / np.sqrt(aa * bb), -1.0, 1.0)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def packed(part: int, ids: np.ndarray, raw: np.ndarray, x: np.ndarray, floors: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The members of a part as blocks, those nearest to the middle first."""
    mean = x.astype(np.float64).sum(axis=0)
    norm = np.linalg.norm(mean)
    middle = mean / norm if norm > 1e-6 else x[0].astype(np.float64)
    order = np.argsort(-(x @ middle), kind="stable")
    for n, a in enumerate(range(0, len(order), ROWS)):
        rows = order[a : a + ROWS]
        radius = float(_angle((x[rows] @ middle).min()))
        values = [part << 20 | n, ids[rows].tobytes(), raw[rows].tobytes(), floors[rows].astype(np.float32).tobytes(), middle.tolist(), radius, float(floors[rows].min())]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, BLOCK.types)], schema=BLOCK)


def _comparer(dim: int, k: int, least: float):
    """What of two blocks may be in a list, with exact cosines: at most ``k`` a vector."""

    class Block:
        def __init__(self, row: dict, side: str):
            self.block = row["block" + side]
            self.ids = np.frombuffer(row["ids" + side], dtype=np.int64)
            self.raw = np.frombuffer(row["raw" + side], dtype=np.float32).reshape(-1, dim)
            self.x = unit_rows(self.raw)
            self.floors = np.frombuffer(row["floors" + side], dtype=np.float32) - np.float32(SLACK)
            self.centre, self.radius, self.floor = np.array(row["centre" + side], dtype=np.float32), row["radius" + side], row["floor" + side]

        def reached(self, other: Block) -> np.ndarray:
            """Vectors that may be near enough to one of the other block."""
            apart = np.maximum(0, _angle(self.x @ other.centre) - other.radius - ANGLE)
            return np.flatnonzero(np.cos(apart) >= np.minimum(self.floors, other.floor - SLACK))

    def hits(s: np.ndarray, floors: np.ndarray, own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``s`` that reach the floors of their rows; the floor of a row with many rises to its ``k``-th best first."""
        rows = np.flatnonzero(s.max(axis=1) >= floors)
        if not len(rows):
            return rows, rows
        s, floors = s[rows], floors[rows]
        good = s >= floors[:, None]
        many = np.flatnonzero(good.sum(axis=1) > max(64, 4 * k))
        for m in many:
            kept = s[m][others != own[rows[m]]]
            if len(kept) > k:
                good[m] = s[m] >= max(floors[m], np.partition(kept, len(kept) - k)[len(kept) - k] - np.float32(2 * SLACK))
        i, j = np.divmod(np.flatnonzero(good), s.shape[1])
        apart = own[rows[i]] != others[j]
        return rows[i[apart]], j[apart]

    def best(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` best of each vector of ``a``, of equally similar ones those with the smallest ids."""
        cos = np.concatenate([cosines(a.raw[i[n : n + 65536]], b.raw[j[n : n + 65536]]) for n in range(0, len(i), 65536)] or [np.empty(0)])
        keep = cos >= least
        i, j, cos = i[keep], j[keep], cos[keep]
        order = np.lexsort((b.ids[j], -cos, i))
        i, j, cos = i[order], j[order], cos[order]
        _, starts, counts = np.unique(i, return_index=True, return_counts=True)
        first = np.arange(len(i)) - np.repeat(starts, counts) < k
        return i[first], j[first], cos[first]

    class Lists:
        """What one block's vectors have found in the other so far."""

        def __init__(self, a: Block, b: Block):
            self.a, self.b, self.held, self.size = a, b, [], 0

        def add(self, i: np.ndarray, j: np.ndarray) -> None:
            self.held.append((i, j))
            self.size += len(i)
            if self.size > HELD:
                i, j, _ = self.merged()
                self.held, self.size = [(i, j)], 0

        def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return best(self.a, self.b, np.concatenate([h[0] for h in self.held]), np.concatenate([h[1] for h in self.held]))

        def rows(self) -> Iterator[pa.RecordBatch]:
            if self.held:
                i, j, cos = self.merged()
                yield pa.RecordBatch.from_arrays([pa.array(self.a.ids[i]), pa.array(self.b.ids[j]), pa.array(cos)], schema=FOUND)

    def compared(a: Block, b: Block) -> Iterator[pa.RecordBatch]:
        there, back = Lists(a, b), Lists(b, a)
        left, right = a.reached(b), b.reached(a)
        if not len(left) or not len(right):
            return
        y, y_ids, y_floors = np.ascontiguousarray(b.x[right].T), b.ids[right], b.floors[right]
        lowest = float(y_floors.min())
        space = np.empty((TILE, len(right)), dtype=np.float32)
        for n in range(0, len(left), TILE):
            rows = left[n : n + TILE]
            s = np.matmul(a.x[rows], y, out=space[: len(rows)])
            floors = a.floors[rows]
            near = np.flatnonzero(s.max(axis=1) >= np.minimum(floors, lowest))
            if not len(near):
                continue
            s, rows, floors = s[near], rows[near], floors[near]
            i, j = hits(s, floors, a.ids[rows], y_ids)
            there.add(rows[i], right[j])
            if a is not b:
                j, i = hits(s.T, y_floors, y_ids, a.ids[rows])
                back.add(right[j], rows[i])
        yield from there.rows()
        yield from back.rows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Block] = {}
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n] for c in ("block", "other")}
                pair = []
                for side, number in (("", row["block"].as_py()), ("_b", row["other"].as_py())):
                    if number not in known:
                        if len(known) >= KNOWN:
                            known.pop(next(iter(known)))
                        source = {c + side: batch.column(c + side)[n].as_py() for c in BLOCK.names if c != "block"}
                        known[number] = Block(source | {"block" + side: number}, side)
                    pair.append(known[number])
                yield from compared(*pair)

    return run


def exact_lists(blocks: DataFrame, dim: int, k: int, least: float) -> DataFrame:
    """``(vec, near, cosine)``: the ``k`` most similar others of each vector of the written ``blocks``, from ``least`` on."""
    far = blocks.select(F.col("block").alias("other"), *[F.col(c).alias(c + "_b") for c in BLOCK.names if c != "block"])
    one, two = F.col("block"), F.col("other")
    # each two blocks once, whichever way round, so that no task has much more than its share
    once = (one == two) | ((one < two) == (F.pmod(F.xxhash64(F.least(one, two), F.greatest(one, two)), F.lit(2)) == 0))
    dot = F.aggregate(F.zip_with("centre", "centre_b", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("radius") - F.col("radius_b")
    near = apart - F.lit(2 * ANGLE) <= F.acos(F.greatest(F.lit(-1.0), F.least("floor", "floor_b") - F.lit(SLACK)))
    both = blocks.hint("shuffle_replicate_nl").join(far, once & ((one == two) | near))
    found = both.mapInArrow(_comparer(dim, k, least), "vec long, near long, cosine double")
    place = F.row_number().over(Window.partitionBy("vec").orderBy(F.col("cosine").desc(), "near"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")
