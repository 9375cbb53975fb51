"""The k most similar vectors for every vector: floors from a navigable graph per shard, then exact lists.

The graphs tell how similar the last entry of a vector's list is at least, its floor; what reaches
the floors is then found among all vectors (``pairs.py``), so no list depends on what a graph or the
choice of shards misses. Only the time does. Where few pairs have the cosine that is asked for, that
cosine is the floor and no graph is built.

Shards are cells of a quantiser, so that a vector needs to be looked for in few of them. The
quantiser is fitted on a bounded sample (at most ``SAMPLE`` rows); every vector is indexed, in the
graph of its nearest cell, and searched there and in the graphs of further near cells: those whose
centroid is nearly as similar as that of the nearest, so a vector inside a cell needs few and one
at a border more, with a higher floor for it. How nearly follows from ``mean_probes``, the number of searches that a vector of
the sample has on average. What a search finds counts for both ends. Cells have about
``shard_rows`` vectors whatever the size of the collection, so the graphs' work per vector does not grow with
it, apart from the choice of the cells; that of the exact lists does.

Each vector is shuffled once per probe; one task builds a shard's graph as flat neighbour arrays
and answers the searches in it, so nothing is broadcast but the centroids (at most ``CELLS``), and
a task that is lost is simply run again. In a cell that many vectors probe a part of them is searched,
and a cell that cannot be divided by direction (near-equal vectors) is divided by hash; both may
only lower floors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import join_by_term
from ..session import ship, spread, written
from .graph import Graph, merge_best
from .pairs import BLOCK_SQL, SLACK, exact_lists, packed, unit_rows

#: Bounds of the quantiser: rows it is fitted on and its cells.
SAMPLE, CELLS = 131_072, 16_384
#: Searches that one task answers, and how many times a shard's size they may be in any case.
ANSWERS, REPAID = 100_000, 8
ROUTED = pa.schema([("part", pa.int32()), ("home", pa.bool_()), ("vec_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("raw", pa.binary())])
#: Elements are rounded to a ``GRID``-th where cells are chosen: products of such are exact in single precision, so copies get one cell whatever they are computed with.
GRID = 2048


def usable_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """``(vec_id, elements, k1, k2)`` of the vectors with exactly ``dim`` finite elements that are not all zero and have an id.

    ``k1, k2`` tell vectors with different elements apart (128 bits of hash).
    """
    e = F.col("elements").cast("array<float>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("elements") == dim)).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("elements"))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("elements", lambda x: x != 0))
    return rows.select("vec_id", "elements", F.xxhash64("elements").alias("k1"), F.xxhash64(F.lit(1), "elements").alias("k2"))


def _rows(elements: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Float32 rows of a column of lists."""
    flat = elements.combine_chunks() if isinstance(elements, pa.ChunkedArray) else elements
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Quantiser:
    """Directions whose nearest vectors form a cell each, and how the cells are dealt to tasks.

    A cell of an estimated ``subs * shard_rows`` vectors is divided by hash if directions cannot
    divide it; one in ``blocks`` of the searches of vectors from other cells is made in it.
    """

    def __init__(self, sample: np.ndarray, rows: int, shard_rows: int, probes: int, mean_probes: float):
        wanted = min(max(1, -(-rows // shard_rows)), CELLS, len(sample))
        self.centroids = self._fitted(sample, wanted)
        cells = len(self.centroids)
        self.probes = min(probes, cells)
        self.slack = np.inf
        near, _, gap = self._near(sample)
        if mean_probes < self.probes:
            self.slack = float(np.partition(gap.ravel(), max(0, int(mean_probes * len(sample)) - 1))[max(0, int(mean_probes * len(sample)) - 1)])
        kept = gap <= self.slack
        scale = rows / max(1, len(sample))
        homes = np.bincount(near[:, 0], minlength=cells) * scale
        asked = np.bincount(near[kept], minlength=cells) * scale
        self.subs = np.where(homes > 4 * shard_rows, np.ceil(homes / shard_rows), 1).astype(np.int64)
        self.blocks = np.maximum(1, np.ceil(asked / self.subs / max(ANSWERS, REPAID * shard_rows))).astype(np.int64)
        sizes = self.subs * self.blocks
        self.base = np.cumsum(sizes) - sizes
        self.parts = int(sizes.sum())

    @staticmethod
    def _lloyd(sample: np.ndarray, centroids: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for left in range(rounds, -1, -1):
            cell = np.concatenate([np.argmax(sample[a : a + 4096] @ centroids.T, axis=1) for a in range(0, len(sample), 4096)])
            if not left:
                return centroids, cell
            order = np.argsort(cell, kind="stable")
            heads, starts = np.unique(cell[order], return_index=True)
            mean = np.add.reduceat(sample[order].astype(np.float64), starts, axis=0)
            norm = np.linalg.norm(mean, axis=1, keepdims=True)
            centroids = centroids.copy()
            centroids[heads] = np.where(norm > 1e-9, mean / np.where(norm > 1e-9, norm, 1), centroids[heads]).astype(np.float32)

    def _fitted(self, sample: np.ndarray, wanted: int) -> np.ndarray:
        """Spherical k-means; cells with more than 1.5 times their share are divided further."""
        if wanted <= 1:
            return sample[:1]
        centroids, cell = self._lloyd(sample, sample[np.linspace(0, len(sample) - 1, wanted).astype(int)], 8)
        for _ in range(3):
            counts = np.bincount(cell, minlength=len(centroids))
            extra = []
            for c in np.flatnonzero(counts > 1.5 * len(sample) / wanted):
                inside = np.flatnonzero(cell == c)
                n = min(len(inside), -(-counts[c] * wanted // len(sample)) - 1)
                extra.append(sample[inside[np.linspace(0, len(inside) - 1, max(1, n)).astype(int)]])
            if not extra:
                break
            centroids, cell = self._lloyd(sample, np.concatenate([centroids, *extra])[: 2 * CELLS], 3)
        used = np.bincount(cell, minlength=len(centroids)) > 0
        return centroids[used]

    def _near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``probes`` nearest cells of each row, nearest first, which of them are searched, and by how much each is less similar than the first."""
        cells, gaps = [np.empty((0, self.probes), dtype=np.int64)], [np.empty((0, self.probes), dtype=np.float32)]
        grid = np.rint(self.centroids * GRID).T
        for a in range(0, len(x), 1024):
            s = np.rint(x[a : a + 1024] * GRID) @ grid / np.float32(GRID * GRID)
            top = np.argpartition(-s, self.probes - 1, axis=1)[:, : self.probes]
            near = np.take_along_axis(s, top, 1)
            order = np.argsort(-near, axis=1, kind="stable")
            near = np.take_along_axis(near, order, 1)
            cells.append(np.take_along_axis(top, order, 1))
            gaps.append(near[:, :1] - near)
        gap = np.concatenate(gaps)
        return np.concatenate(cells), gap <= self.slack, gap

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of each row, nearest first, and which of them it is searched in."""
        return self._near(x)[:2]


def _router(q: Quantiser, dim: int):
    """Rows for the shard that a vector belongs to and for those it is searched in. Copies within a batch go on as the smallest id."""

    def routed(rows: np.ndarray, part: np.ndarray, home: np.ndarray, ids, k1, k2, elements) -> pa.RecordBatch:
        data = pa.py_buffer(elements[rows].tobytes())
        offsets = pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * (4 * dim)).tobytes())
        raw = pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, data])
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(home), pa.array(ids[rows]), pa.array(k1[rows]), pa.array(k2[rows]), raw], schema=ROUTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, k1, k2 = (batch.column(c).to_numpy() for c in ("vec_id", "k1", "k2"))
            if not len(ids):
                continue
            elements = _rows(batch.column("elements"), dim)
            order = np.lexsort((ids, k2, k1))
            first = np.ones(len(ids), dtype=bool)
            first[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
            one = order[first]
            cells, searched = q.nearest(unit_rows(elements[one]))
            at = k2[one].view(np.uint64)
            every, keys = one, at
            for n in range(cells.shape[1]):
                kept = searched[:, n]
                cell, one, at = cells[kept, n], every[kept], keys[kept]
                subs, blocks = q.subs[cell].astype(np.uint64), q.blocks[cell].astype(np.uint64)
                start = q.base[cell] + (at % subs).astype(np.int64) * q.blocks[cell]
                mine = np.ones(len(one), dtype=bool)
                if n:  # searches beyond a task's share would only raise floors further
                    mine = at // subs % blocks == 0
                yield routed(one[mine], start[mine], np.full(int(mine.sum()), not n), ids, k1, k2, elements)

    return run


def _shard(dim: int, m: int, build_beam: int, beam: int, k: int, least: float, graphs: bool):
    """Build a part's graph from its members and answer all searches of the part, members' own included: members with their floors, in blocks. Without ``graphs`` floors are ``least``."""

    def distinct(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, k1, k2 = (t.column(c).to_numpy() for c in ("vec_id", "k1", "k2"))
        order = np.lexsort((ids, k2, k1))
        first = np.ones(len(ids), dtype=bool)
        first[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
        one = np.sort(order[first]) if len(ids) else order
        one = one[np.argsort(ids[one], kind="stable")]  # the graph does not depend on the order of arrival
        flat = np.frombuffer(b"".join(t.column("raw").to_pylist()), dtype=np.float32).reshape(-1, dim)
        return ids[one], flat[one]

    def answered(part: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, raw = distinct(rows.filter(rows.column("home")))
        if not len(ids):
            return
        x = unit_rows(raw)
        floors = np.full(len(x), least)
        if graphs:
            floors = raised(ids, x, *distinct(rows.filter(pa.compute.invert(rows.column("home")))))
        yield from packed(part, ids, raw, x, floors)

    def raised(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray) -> np.ndarray:
        g = Graph(x, ids, m, build_beam)
        place, cos = g.search(x, k + 1, beam + 1)
        cos[place == np.arange(len(x))[:, None]] = -4.0  # itself
        place[cos < -3.5] = -1
        order = np.argsort(-cos, axis=1, kind="stable")[:, :k]
        place, cos = np.take_along_axis(place, order, 1), np.take_along_axis(cos, order, 1)
        found, found_cos = g.search(unit_rows(y), k, beam)
        # the other way round: members of which a searching vector is among the best
        i, c = np.nonzero((found >= 0) & (found_cos >= least - 1e-3))
        j = found[i, c]
        better = found_cos[i, c] > cos[j, -1]
        i, j, score = i[better], j[better], found_cos[i, c][better]
        both, both_cos = place.astype(np.int64), cos
        merge_best(both, both_cos, j, len(x) + i, score)
        floors = np.where(both[:, -1] >= 0, np.maximum(both_cos[:, -1] - np.float32(SLACK), least), least)
        every, times = np.unique(np.concatenate([ids, others]), return_counts=True)
        floors[np.isin(ids, every[times > 1])] = least  # an id with several vectors: one may be in the other's list
        return floors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a part is bounded: a shard and the searches dealt to it
        if held:
            rows = pa.Table.from_batches(held)
            parts = rows.column("part").to_numpy()
            for p in np.unique(parts):
                yield from answered(int(p), rows.filter(pa.array(parts == p)))

    return run


def _sampled(rows: DataFrame, n: int, dim: int, shard_rows: int) -> np.ndarray:
    """Unit rows of the ``n`` usable vectors with the smallest hashes of their ids: at most ``SAMPLE``."""
    wanted = min(SAMPLE, max(4096, 256 * -(-n // shard_rows)))
    unit = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30))
    some = rows.where(unit < F.lit(int(min(1.0, wanted / max(1, n)) * (1 << 30)))).select("elements").limit(2 * wanted).toArrow()
    sample = np.unique(unit_rows(_rows(some.column("elements"), dim)), axis=0) if some.num_rows else np.eye(1, dim, dtype=np.float32)
    np.random.default_rng(3).shuffle(sample)
    return sample


def fitted(rows: DataFrame, n: int, dim: int, shard_rows: int, probes: int = 8, mean_probes: float = 2.25) -> Quantiser:
    """The quantiser for ``n`` usable vectors."""
    return Quantiser(_sampled(rows, n, dim, shard_rows), n, shard_rows, probes, mean_probes)


def _partners(sample: np.ndarray, n: int, least: float) -> float:
    """How many others a vector has on average from a cosine of ``least`` on, by 4096 vectors of the sample."""
    x = sample[:4096]
    return (float((x @ x.T >= least).sum()) - len(x)) / max(1, len(x) * (len(x) - 1)) * n


def _apart(rows: DataFrame) -> DataFrame:
    """Vectors of an id that has several are no copies of other ids' vectors: their lists leave out the id's other vectors."""
    key = F.struct("k1", "k2")
    several = written(rows.groupBy("vec_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").select(F.col("vec_id").alias("id")), "several")
    if several.isEmpty():
        return rows
    joined = rows.join(several, rows.vec_id == several.id, "left")
    return joined.select("vec_id", "elements", F.when(F.col("id").isNull(), F.col("k1")).otherwise(F.xxhash64("k1", "vec_id")).alias("k1"), "k2")


def nearest(vectors: DataFrame, k: int = 10, dim: int = 64, least: float = -1.0, shard_rows: int = 12_000, probes: int = 8, mean_probes: float = 2.25, m: int = 16, build_beam: int = 16, beam: int = 12) -> DataFrame:
    """``(vec_id, near_id, cosine)``: for each usable vector its ``k`` most similar others, exactly.

    Vectors that are null, of another length, all zero or not finite take no part; rows that are
    repeated whole count once. Of equally similar vectors the smaller ids come first. ``least``
    leaves out pairs below a cosine. Vectors with identical elements are one entry of a graph; each
    copy's list then starts with other copies, so a group of copies of any size adds at most ``k``
    rows a copy, and no pairs of a group are formed. An empty table gives an empty result. For its
    floor a vector is searched in ``mean_probes`` shards on average and in ``probes`` at most; these,
    ``shard_rows`` and the graph's ``m`` and beams change the time that a call takes, not its result.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = _apart(usable_vectors(vectors, dim))
    n = vectors.count()
    sample = _sampled(rows, n, dim, shard_rows)
    graphs = _partners(sample, n, least) > 4 * k  # otherwise least is floor enough
    q = Quantiser(sample, n, shard_rows, probes if graphs else 1, mean_probes)
    routed = spread(rows).mapInArrow(_router(q, dim), "part int, home boolean, vec_id long, k1 long, k2 long, raw binary")
    blocks = written(routed.repartitionById(q.parts, "part").mapInArrow(_shard(dim, m, build_beam, beam, k, least, graphs), BLOCK_SQL), "blocks")
    top = written(exact_lists(blocks, dim, k, least), "lists")  # the comparisons are made once

    keyed = rows.select(F.concat_ws(":", "k1", "k2").alias("key"), "vec_id")
    several = keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.max("vec_id").alias("last"), F.count(F.lit(1)).alias("n"))
    groups = written(several.where("rep <> last").select("key", "rep", "n"), "copies")
    if groups.isEmpty():
        return top.select(F.col("vec").alias("vec_id"), F.col("near").alias("near_id"), "cosine")
    members = join_by_term(keyed, groups, "key", "n", "vec_id", kept=True).where("rep is not null").select("rep", "vec_id").distinct()
    return _with_copies(written(members, "members"), top, k)


def _with_copies(members: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Give every copy its list, from the lists of the first of each group of copies."""
    early = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    firsts = written(early.groupBy("rep").agg(F.sort_array(F.collect_list("vec_id")).alias("firsts")), "firsts")

    entry = "array<struct<c:double,i:bigint>>"
    near = found.join(firsts.withColumnRenamed("rep", "near"), "near", "left")
    near = near.select("vec", "cosine", F.explode(F.coalesce("firsts", F.array("near"))).alias("near"))
    # a list has at most k * (k + 1) entries, as neighbours' copies may lengthen it
    lists = near.groupBy("vec").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("near").alias("i")))).alias("l"))
    own = firsts.select(F.col("rep").alias("vec"), F.transform("firsts", lambda i: F.struct(F.lit(-1.0).alias("c"), i.alias("i"))).alias("o"))
    none = F.array().cast(entry)
    lists = lists.join(own, "vec", "full").select("vec", F.sort_array(F.concat(F.coalesce("o", none), F.coalesce("l", none))).alias("l"), F.col("o").isNotNull().alias("grouped"))

    alone = lists.where(~F.col("grouped")).select(F.col("vec").alias("vec_id"), "l")
    counts = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    shared = lists.where("grouped").withColumnRenamed("vec", "rep").join(counts, "rep").select("rep", "n", "l")
    copies = join_by_term(members, shared, "rep", "n", "vec_id").select("vec_id", "l")
    top = alone.unionByName(copies).select("vec_id", F.explode(F.slice(F.filter("l", lambda e: e["i"] != F.col("vec_id")), 1, k)).alias("e"))
    return top.select("vec_id", F.col("e.i").alias("near_id"), (-F.col("e.c")).alias("cosine"))


def similar_pairs(vectors: DataFrame, least: float, **how) -> DataFrame:
    """``(vec_a, vec_b)``, smaller id first, for vectors of which one is among the most similar of the other, with a cosine of at least ``least``."""
    near = nearest(vectors, least=least, **how)
    return near.select(F.least("vec_id", "near_id").alias("vec_a"), F.greatest("vec_id", "near_id").alias("vec_b")).distinct()
