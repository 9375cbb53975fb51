"""Long verbatim spans shared between texts, by relative Lempel-Ziv parsing.

A document is factored against the indexed texts of a reference block: each factor is the longest
stretch, from where the parse stands, that occurs in the reference. Factors of the wanted length
are shared spans. A span may also lie across a factor's end, where the greedy parse changed its
source; so the windows that cross a factor boundary are looked up one by one. Together that finds
every position at which a span of the wanted length starts.

Which blocks a document must be factored against is decided without comparing all with all:
texts are sampled by the minimum of the hashes of all short windows in a longer one (winnowing), and
two texts that share a span of the wanted length are bound to share such an anchor. A text is a
reference in the block of the smallest anchor that it shares, so the texts of a family lie in one
block, and is sent once to each block in which it has partners, however many those are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import join_by_term
from ..session import written

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept and lengthened as needed."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE, dtype=np.uint64), np.full(size, INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[0] = have = (np.cumprod(up), np.cumprod(down))
    return have[0][:n], have[1][:n]


class Hashes:
    """Hashes of all windows of a text, of any width, from one prefix sum."""

    def __init__(self, codes: np.ndarray):
        a = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(31)
        a *= np.uint64(0x94D049BB133111EB)
        a ^= a >> np.uint64(29)
        up, self.down = _powers(len(a))
        self.sum = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(a * up)])

    def of(self, width: int) -> np.ndarray:
        n = len(self.sum) - width
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        h = (self.sum[width:] - self.sum[:-width]) * self.down[:n]
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    done, m = 1, h
    while done < width:
        step = min(done, width - done)
        m = np.minimum(m[: len(m) - step], m[step:])
        done += step
    return m


def anchors(codes: np.ndarray, length: int) -> np.ndarray:
    """Distinct anchor hashes of a text: every stretch of ``length`` contains one, chosen by its content alone."""
    seed = length // 2
    h = Hashes(codes).of(seed)
    return np.unique(window_minima(h, length - seed + 1)) if len(h) >= length - seed + 1 else np.empty(0, dtype=np.uint64)


class Reference:
    """An indexed reference text."""

    def __init__(self, codes: np.ndarray, length: int):
        self.codes, self.length, self.seed = codes, length, length // 2
        hashes = Hashes(codes)
        seeds = hashes.of(self.seed)
        self.order = np.argsort(seeds, kind="stable")
        self.seeds = seeds[self.order]
        self.windows = np.sort(hashes.of(length))

    def _extent(self, doc: np.ndarray, i: int, j: int) -> int:
        """How far the document from i and the reference from j agree."""
        size, done = 256, 0
        while True:
            a, b = doc[i + done : i + done + size], self.codes[j + done : j + done + size]
            n = min(len(a), len(b))
            if not n:
                return done
            differ = np.flatnonzero(a[:n] != b[:n])
            if len(differ):
                return done + int(differ[0])
            done, size = done + n, size * 2

    def factors(self, doc: np.ndarray, seeds: np.ndarray, tries: int = 64) -> list[tuple[int, int]]:
        """Greedy factors (start, end) of at least a seed's length, in order. Of more than ``tries`` occurrences of a seed that many are compared for the longest; which one is taken does not change the spans found."""
        lo, hi = np.searchsorted(self.seeds, seeds, "left"), np.searchsorted(self.seeds, seeds, "right")
        may = np.flatnonzero(hi > lo)
        out, i, at = [], 0, 0
        while at < len(may):
            i = int(may[at])
            best = max(self._extent(doc, i, int(self.order[o])) for o in range(lo[i], min(hi[i], lo[i] + tries)))
            if best >= self.seed:
                out.append((i, i + best))
                at = int(np.searchsorted(may, i + best))
            else:
                at += 1  # equal hashes of different text
        return out

    def shared(self, doc: np.ndarray) -> np.ndarray:
        """Starts, in the document, of all windows of the wanted length that occur in the reference."""
        length, hashes = self.length, Hashes(doc)
        windows = hashes.of(length)
        starts = np.zeros(len(windows), dtype=bool)
        if not len(windows) or not len(self.windows):
            return np.empty(0, dtype=np.int64)
        for a, b in self.factors(doc, hashes.of(self.seed)):
            if b - a >= length:
                starts[a : b - length + 1] = True
            # windows that cross the factor's start or end
            for edge in (a, b):
                lo, hi = max(0, edge - length + 1), min(len(windows), edge)
                if lo < hi:
                    found = np.searchsorted(self.windows, windows[lo:hi])
                    starts[lo:hi] |= self.windows[np.minimum(found, len(self.windows) - 1)] == windows[lo:hi]
        return np.flatnonzero(starts)


def merged_spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Windows that touch or overlap, put together: (start, end) in order."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist()))


def text_classes(documents: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Distinct texts of at least ``length`` code points, ``(cls, text, copies)``, and ``(doc_id, cls)`` of their documents.

    ``cls`` is the smallest doc_id with that text (told apart by SHA-256). Copies meet before the
    shuffle, so a group of copies of any size is one row per task. Rows without doc_id or text are left out.
    """
    rows = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= length)).select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    # one aggregation by hash alone with a fixed-width buffer; the text follows by the chosen document
    ids = rows.groupBy("sha").agg(F.min("doc_id").alias("cls"), F.count(F.lit(1)).alias("copies"))
    texts = rows.groupBy("sha").agg(F.min(F.struct("doc_id", "text")).alias("m"), F.count(F.lit(1)).alias("copies")).select(F.col("m.doc_id").alias("cls"), F.col("m.text").alias("text"), "copies")
    several = ids.where("copies > 1")
    member = join_by_term(rows.select("sha", "doc_id"), several, "sha", "copies", "doc_id").where("cls is not null").select("doc_id", "cls").distinct()
    return texts, member


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [anchors(code_points(t), length) for t in part.column("text").to_pylist()]
                sizes = [len(f) for f in found]
                cls = np.repeat(part.column("cls").to_numpy(), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, dtype=np.uint64)]).view(np.int64)), pa.array(cls)], names=["anchor", "cls"])

    return run


def _window_rows(length: int):
    """Hashes of the windows of the wanted length that contain one of a text's given anchors, at all their places; ``one`` marks a single row of each window and text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seed = length // 2
        for frame in frames:
            for cls, text, wanted in zip(frame["cls"], frame["text"], frame["wanted"]):
                hashes = Hashes(code_points(text))
                at = np.flatnonzero(np.isin(hashes.of(seed), np.asarray(wanted, dtype=np.int64).view(np.uint64)))
                windows = hashes.of(length)
                touched = np.zeros(len(windows) + 1, dtype=np.int64)
                np.add.at(touched, np.maximum(at - (length - seed), 0), 1)
                np.add.at(touched, np.minimum(at + 1, len(windows)), -1)
                keep = np.flatnonzero(np.cumsum(touched)[:-1] > 0)
                if len(keep):
                    one = np.zeros(len(keep), dtype=bool)
                    one[np.unique(windows[keep], return_index=True)[1]] = True
                    yield pd.DataFrame({"window": windows[keep].view(np.int64), "cls": cls, "at": keep, "one": one})

    return run


def _block_factors(length: int):
    """Factor each text against the references of its block that it has to do with.

    Rows come sorted by block, references first; a block's references are indexed when they are first
    needed, once each, and the other texts stream past them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cls", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
        block, codes, indexed, waiting, rows = None, {}, {}, [], []

        def parse(cls: int, doc: np.ndarray, partners: list[int]) -> None:
            for other in partners:
                if other not in indexed:
                    indexed[other] = Reference(codes[other], length)
                starts = indexed[other].shared(doc)
                rows.extend((min(cls, other), max(cls, other), cls, x, y) for x, y in merged_spans(starts, length))

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

        def settle() -> None:
            for cls, partners in waiting:
                parse(cls, codes[cls], partners)
            waiting.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for row in batch.slice(start, 64).to_pylist():
                    if row["block"] != block:
                        settle()
                        block, codes, indexed = row["block"], {}, {}
                    doc = code_points(row["text"])
                    if row["reference"]:
                        codes[row["cls"]] = doc
                        waiting.append((row["cls"], row["partners"] or []))
                    else:
                        settle()  # all references are there
                        parse(row["cls"], doc, row["partners"])
                if len(rows) > 10_000:
                    yield flushed()
        settle()
        yield flushed()

    return run


def _pairs_within(rows: DataFrame, sizes: DataFrame, block: int = 256) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of the ``cls`` with one window; ``sizes`` is ``(window, n)`` of the windows that count.

    The texts of a window are spread over blocks of about ``block``, and each two blocks meet under a
    key of their own, so that no task holds a large group. Pairs come once for each window.
    """
    member = join_by_term(rows, sizes, "window", "n", "cls").where("n is not null").withColumn("blocks", F.ceil(F.col("n") / block))
    member = member.withColumn("k", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    low = member.select("window", F.col("cls").alias("x"), F.col("k").alias("p"), F.explode(F.sequence(F.col("k"), F.col("blocks") - 1)).alias("q"))
    high = member.select("window", F.col("cls").alias("y"), F.col("k").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k"))).alias("p"))
    met = low.join(high, ["window", "p", "q"]).where("p < q or x < y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def shared_spans(texts: DataFrame, length: int = 200, group: int = 32) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b)``, a < b, between distinct texts that share a span, and ``(cls, first, last)`` of the shared spans.

    ``texts`` is ``(cls, text, copies)``, read several times: a written table. Up to ``group``
    texts with an anchor in common are factored against one another in the block of the reference.
    Where more texts have an anchor, factoring each against each would be quadratic in their number even where
    they share nothing of the wanted length; there the windows around the anchor are compared by hash
    and all texts with the same window are linked, pair by pair. Either way finds every link.
    """
    rows = texts.select("cls", "text").mapInArrow(_anchor_rows(length), "anchor long, cls long")
    near = Window.partitionBy("anchor").orderBy("cls")
    few = rows.withColumn("r", F.row_number().over(near)).where(F.col("r") <= group + 1)
    few = few.groupBy("anchor").agg(F.sort_array(F.collect_list("cls")).alias("all")).where(F.size("all") > 1)
    few = written(few, "anchors")

    usual = few.where(F.size("all") <= group)
    homes = usual.select("anchor", F.explode("all").alias("cls")).groupBy("cls").agg(F.min("anchor").alias("block"))
    first = usual.select("all", F.posexplode("all").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("all", F.col("i") + 2, group)).alias("b")).distinct()
    both_ways = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    asked = both_ways.join(homes.withColumnRenamed("cls", "b"), "b").groupBy("block", F.col("a").alias("cls")).agg(F.collect_list("b").alias("partners"))
    roles = homes.withColumn("reference", F.lit(True)).join(asked, ["block", "cls"], "full").select("block", "cls", F.coalesce("reference", F.lit(False)).alias("reference"), "partners")
    placed = texts.select("cls", "text").join(roles, "cls").repartition("block").sortWithinPartitions("block", F.col("reference").desc())
    factored = placed.select("block", "cls", "text", "reference", "partners").mapInArrow(_block_factors(length), "a long, b long, cls long, first int, last int")

    found = written(factored, "factors")
    hot = few.where(F.size("all") > group).select("anchor")
    if hot.isEmpty():  # saves a second pass over the texts, which would find nothing
        return found.select("a", "b").distinct(), found.select("cls", "first", "last").distinct()
    many = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group)
    wanted = join_by_term(rows, many, "anchor", "n", "cls").where("n is not null").groupBy("cls").agg(F.collect_list("anchor").alias("wanted"))
    windows = written(texts.select("cls", "text").join(wanted, "cls").mapInPandas(_window_rows(length), "window long, cls long, at int, one boolean"), "windows")
    members = windows.where("one").select("window", "cls")
    sizes = members.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cls")).alias("h1"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("h2")).where("n > 1")
    sizes = written(sizes, "window-sizes")
    alike = sizes.groupBy("n", "h1", "h2").agg(F.min("window").alias("window"))  # windows with the same texts give the same pairs
    close = _pairs_within(members, alike.select("window", "n"))
    in_groups = join_by_term(windows, sizes.select("window", "n"), "window", "n", "cls", kept=True).where("n is not null").select("cls", F.col("at").alias("first"), (F.col("at") + length).cast("int").alias("last"))

    links = found.select("a", "b").unionByName(close).distinct()
    return links, found.select("cls", "first", "last").unionByName(in_groups).distinct()


def shared_links(documents: DataFrame, length: int = 200, group: int = 32) -> DataFrame:
    """``(cls_a, cls_b)``, smaller first, of different texts that share a span, each named by the smallest doc_id that has it.

    With the ``cls`` of every document, which ``shared_characters`` gives, this is all there is to know of
    which documents share a span, in a size that groups of copies do not blow up: two documents do if
    they have one ``cls`` or theirs are linked.
    """
    texts, _ = text_classes(documents, length)
    links, _ = shared_spans(written(texts, "texts"), length, group)
    return links.select(F.col("a").alias("cls_a"), F.col("b").alias("cls_b"))


def shared_pairs(documents: DataFrame, length: int = 200, group: int = 32) -> DataFrame:
    """``(doc_a, doc_b)``, smaller id first, of documents whose texts share a verbatim span of at least ``length`` code points.

    Between different texts every link of ``shared_spans`` is given. Documents with one and the same
    text are each paired with the first of them; up to ``group`` copies of either text are also
    paired with all documents their text is linked to, beyond that the first stands for its copies
    (``shared_links`` and ``cls`` tell of all others).
    """
    texts, member = text_classes(documents, length)
    texts, member = written(texts, "texts"), written(member, "copies")
    links, _ = shared_spans(texts, length, group)
    by = Window.partitionBy("cls").orderBy("doc_id")
    early = member.withColumn("r", F.row_number().over(by)).where(F.col("r") <= group).groupBy("cls").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))
    spread = links
    for side in ("a", "b"):
        spread = spread.join(early.select(F.col("cls").alias(side), F.col("docs").alias(f"docs_{side}")), side, "left")
    spread = spread.select(F.explode(F.coalesce("docs_a", F.array("a"))).alias("x"), F.coalesce("docs_b", F.array("b")).alias("docs_b")).select("x", F.explode("docs_b").alias("y"))
    among = early.select("docs", F.posexplode("docs").alias("i", "x")).select("x", F.explode(F.slice("docs", F.col("i") + 2, group)).alias("y"))
    copies = member.where(F.col("doc_id") > F.col("cls")).select(F.col("cls").alias("x"), F.col("doc_id").alias("y"))
    both = spread.unionByName(among).unionByName(copies)
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def shared_characters(documents: DataFrame, length: int = 200, group: int = 32) -> DataFrame:
    """``(doc_id, cls, n_chars, shared_chars)`` for every document with an id: how many of its code points stand, in spans of at least ``length``, in another document too.

    ``cls`` is the smallest doc_id with the same text, where the text is that long, else its own. Texts that
    have copies are shared as a whole; null texts have 0 characters.
    """
    texts, member = text_classes(documents, length)
    texts, member = written(texts, "texts"), written(member, "copies")
    _, spans = shared_spans(texts, length, group)
    # union of intervals: a span opens a new stretch where it starts behind all before it
    by = Window.partitionBy("cls").orderBy("first", "last")
    before = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("from", F.greatest(F.col("first"), F.coalesce(before, F.lit(0)))).groupBy("cls").agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.col("from"))).alias("covered"))
    docs = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    known = docs.join(member, "doc_id", "left").withColumn("copied", F.col("cls").isNotNull()).withColumn("cls", F.coalesce("cls", "doc_id"))
    alone = known.where(~F.col("copied")).join(covered, "cls", "left")
    whole = known.where("copied").withColumn("covered", F.col("n_chars"))
    return alone.unionByName(whole, allowMissingColumns=True).select("doc_id", "cls", "n_chars", F.coalesce("covered", F.lit(0)).cast("long").alias("shared_chars"))
