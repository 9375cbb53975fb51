"""Whole batches of queries scored against whole collections, block by block.

Documents are coded once, a row each: the wanted terms with their counts and the wanted keys (fragments
and sound codes) as numbers. A task goes through documents with one group of queries: it forms a matrix of the
group's lines (a line is a query term with its weights) by documents, adds up each query's lines, and hands on
only what is asked for. Neither postings nor pairs of query and document are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pds
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch, written
from . import search as S

#: Cells of a matrix of lines by documents that a task holds, and cells of queries by documents that are added up at a time.
CELLS, STEP = 6_000_000, 400_000
#: Rows of results that a task holds for its queries, rows of what they ask for, documents that it goes through for them.
HELD, ASKED, DOCS = 1_000_000, 300_000, 2_000_000
#: Terms whose keys a coding task remembers.
REMEMBERED = 500_000

_SOUNDS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")


def sound_code(term: str) -> str:
    """``text.soundex`` of one term."""
    letters = re.sub("[^A-Z]", "", term.upper())
    digits = re.sub(r"(.)\1+", r"\1", letters.translate(_SOUNDS))
    return (letters[:1] + digits[1:].replace("0", "")[:3]).ljust(4, "0") if letters else ""


def keys_of(term: str) -> set[str]:
    """The term, its prefixes as in ``text.edge_ngrams``, and its sound code; codes begin with a capital, terms never do."""
    return {term, sound_code(term), *(term[:n] for n in range(3, min(len(term), 10)))} - {""}


def _address(path: str) -> str:
    return path if "://" in path or not path.startswith("file:") else "file://" + path[5:]


def _kept(df: DataFrame, what: str) -> str:
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return _address(path)


def _read(uri: str, columns: list[str] | None = None) -> pa.Table | None:
    """A written table, or None where nothing was written for a group."""
    fs, root = pyarrow.fs.FileSystem.from_uri(uri)
    if fs.get_file_info(root).type == pyarrow.fs.FileType.NotFound:
        return None
    return pds.dataset(root, filesystem=fs, format="parquet").to_table(columns=columns, use_threads=False)


def _names(uri: str | None) -> pa.Array:
    """Names in the order of their numbers."""
    t = _read(uri) if uri else None
    return pa.array(sorted(t.column(0).to_pylist()) if t else [], type=pa.string())


def _place(of: pa.Array | pa.ChunkedArray, among: pa.Array) -> np.ndarray:
    """Number of each name, -1 where it has none."""
    found = pc.fill_null(pc.index_in(of, value_set=among), -1)
    return (found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found).to_numpy(zero_copy_only=False).astype(np.int64)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges ``first[i] ... first[i] + n[i] - 1`` one after the other."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


class Coded(NamedTuple):
    """Documents as numbers: rows ``(doc_id, dl, terms, tfs, keys)`` and the names that the numbers stand for."""

    rows: DataFrame
    terms: str | None
    keys: str | None
    kind: str
    docs: int


def coded(docs: DataFrame, terms: DataFrame | None = None, keys: DataFrame | None = None) -> Coded:
    """``docs`` is ``(doc_id, toks)``, or ``(doc_id, toks, tfs, dl)`` with distinct terms; ``terms`` and ``keys`` are what is wanted of them, one column each."""
    kind = dict(docs.dtypes)["doc_id"]
    terms_at, keys_at = (None if x is None else _kept(x.toDF("name").where("name is not null").distinct(), "names") for x in (terms, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, keys = _names(terms_at), _names(keys_at)
        number, known = {k: i for i, k in enumerate(keys.to_pylist())}, {}
        lists = lambda doc, n, x: pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), type=pa.int32()), pa.array(x, type=pa.int32()))

        for batch in batches:
            if not batch.num_rows:
                continue
            toks, n = batch.column("toks"), batch.num_rows
            sizes = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False)
            entry = pc.dictionary_encode(toks.flatten())
            words, word = entry.dictionary, entry.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(n), sizes)
            times = batch.column("tfs").flatten().to_numpy(zero_copy_only=False) if "tfs" in batch.schema.names else np.ones(len(doc), dtype=np.int64)
            dl = batch.column("dl").to_numpy(zero_copy_only=False) if "dl" in batch.schema.names else sizes
            t = _place(words, terms)[word] if len(words) else word
            some = t >= 0
            cell, where = np.unique(doc[some] * max(1, len(terms)) + t[some], return_inverse=True)
            tf = np.bincount(where, weights=times[some], minlength=len(cell))
            d, t = np.divmod(cell, max(1, len(terms)))
            out = [batch.column("doc_id"), pa.array(dl, type=pa.int64()), lists(d, n, t), lists(d, n, tf.astype(np.int64))]
            if number:
                if len(known) > REMEMBERED:
                    known.clear()
                for w in words.to_pylist():
                    if w not in known:
                        known[w] = [number[k] for k in keys_of(w) if k in number]
                has = [known[w] for w in words.to_pylist()]
                many = np.array([len(x) for x in has], dtype=np.int64)
                flat = np.array([k for x in has for k in x], dtype=np.int64)
                d, w = np.divmod(np.unique(doc * max(1, len(words)) + word), max(1, len(words)))
                d, k = np.repeat(d, many[w]), flat[_spread((np.cumsum(many) - many)[w], many[w])]
                d, k = np.divmod(np.unique(d * len(number) + k), len(number))
            else:
                d = k = np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*out, lists(d, n, k)], names=["doc_id", "dl", "terms", "tfs", "keys"])

    rows = written(docs.where("doc_id is not null").mapInArrow(run, f"doc_id {kind}, dl long, terms array<int>, tfs array<int>, keys array<int>"), "coded")
    return Coded(rows, terms_at, keys_at, kind, rows.count())


class Weighted(NamedTuple):
    """A sum over terms: ``(query_id, term, w)`` times what a posting counts for."""

    asked: DataFrame
    impact: Callable[[np.ndarray, np.ndarray], np.ndarray]

    def kept(self, groups: int, coded: Coded):
        return _grouped(self.asked.select("query_id", "term", F.col("w").cast("double")), groups), coded.terms, None, self.impact


class Keyed(NamedTuple):
    """A sum over keys: ``(query_id, term)`` through ``(term, key, w)``; ``once``: of a term's keys that a document has, one counts."""

    asked: DataFrame
    features: DataFrame
    once: bool = False

    def kept(self, groups: int, coded: Coded):
        return _grouped(self.asked.select("query_id", "term").distinct(), groups), coded.keys, _kept(self.features.select("term", "key", F.col("w").cast("double")), "features"), self.once


def _grouped(df: DataFrame, groups: int) -> str:
    """Rows written by group of queries."""
    path = scratch(df.sparkSession, "grouped")
    by = df.withColumn("g", F.pmod(F.xxhash64(F.col("query_id").cast("long")), F.lit(groups)).cast("int"))
    by.repartition(min(groups, 200), "g").write.partitionBy("g").parquet(path)
    return _address(path)


class Lines:
    """A group's lines: which keys count how much for which line, which lines make up a query."""

    def __init__(self, queries: np.ndarray, asked: pa.Table, names: pa.Array, features: pa.Table | None):
        at = np.searchsorted(queries, asked.column("query_id").to_numpy())
        if features is None:
            number, w = _place(asked.column("term"), names), asked.column("w").to_numpy()
            at, number, w = (x[number >= 0] for x in (at, number, w))
            order = np.lexsort((w, number))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (np.diff(number[order]) != 0) | (np.diff(w[order]) != 0)
            line = np.empty(len(order), dtype=np.int64)
            line[order] = np.cumsum(new) - 1
            self.key, self.weight = number[order][new], w[order][new]
            self.line, self.n = np.arange(len(self.key)), len(self.key)
        else:
            own = pc.unique(asked.column("term"))
            line, self.n = _place(asked.column("term"), own), len(own)
            of, key, w = _place(features.column("term"), own), _place(features.column("key"), names), features.column("w").to_numpy()
            some = np.flatnonzero((of >= 0) & (key >= 0))
            some = some[np.argsort(key[some], kind="stable")]
            self.key, self.line, self.weight = key[some], of[some], w[some]
        self.first = np.searchsorted(self.key, np.arange(len(names) + 1))
        order = np.argsort(at, kind="stable")
        at, line = at[order], line[order]
        self.many = np.bincount(at, minlength=len(queries))
        self.of = np.full((len(queries), max(1, self.many.max(initial=0))), self.n)  # the line after the last is all 0
        self.of[at, np.arange(len(at)) - np.searchsorted(at, at)] = line

    def ordered(self, order: np.ndarray) -> None:
        self.of, self.many = self.of[order], self.many[order]

    def matrix(self, doc: np.ndarray, key: np.ndarray, value: np.ndarray | None, docs: int, once: bool) -> np.ndarray:
        out = np.zeros((self.n + 1) * docs)
        n = self.first[key + 1] - self.first[key]
        upto = np.cumsum(n)
        cuts = np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, CELLS), "right")
        for a, b in zip(cuts, [*cuts[1:], len(n)]):
            hit = _spread(self.first[key[a:b]], n[a:b])
            cell = self.line[hit] * docs + np.repeat(doc[a:b], n[a:b])
            weight = self.weight[hit] if value is None else self.weight[hit] * np.repeat(value[a:b], n[a:b])
            if once:
                out[cell] = weight
            elif len(cell) * 8 < len(out):
                np.add.at(out, cell, weight)
            else:
                out += np.bincount(cell, weights=weight, minlength=len(out))
        return out.reshape(self.n + 1, docs)

    def sums(self, matrix: np.ndarray, a: int, b: int) -> np.ndarray:
        of = self.of[a:b, : max(1, self.many[a:b].max(initial=0))]
        total = matrix[of[:, 0]]
        more = np.empty_like(total)
        for j in range(1, of.shape[1]):
            np.take(matrix, of[:, j], axis=0, out=more, mode="clip")
            total += more
        return total


def _added(x: np.ndarray, queries: slice) -> np.ndarray:
    return x


class All:
    """``(query_id, doc_id, score)`` of all documents with any match, in decimal places that are kept."""

    columns, held, by_documents = "score double", 0, True

    def __init__(self, digits: int):
        self.scale = 10.0**digits

    def kept(self, groups: int) -> All:
        return self

    def started(self, g: int, queries: np.ndarray) -> None:
        self.queries = queries

    def take(self, a: int, score: np.ndarray, docs: np.ndarray) -> Iterator[list]:
        some = score > 0
        query = np.repeat(self.queries[a : a + len(score)], np.count_nonzero(some, axis=1))
        yield [query, np.broadcast_to(docs, score.shape)[some], np.floor(score[some] * self.scale + 0.5) / self.scale]

    def ended(self) -> Iterator[list]:
        return iter(())


class Best:
    """``(query_id, doc_id, score)`` of the best ``k`` of a task, equal scores by id; with ``ties`` also all that equal the last.

    Scores are rounded to ``digits``. With ``shares``, ``(query_id, most)``, the order is that of
    the share ``part`` of the query's most, rounded once more.
    """

    columns, by_documents = "score double", False

    def __init__(self, k: int, digits: int = 6, ties: bool = False, shares: DataFrame | None = None, part: float = 1.0):
        self.k, self.held, self.digits, self.ties, self.shares, self.part = k, k, digits, ties, shares, part

    def kept(self, groups: int) -> Best:
        out = Best(self.k, self.digits, self.ties, None, self.part)
        out.at = None if self.shares is None else _grouped(self.shares.select("query_id", F.col("most").cast("double")), groups)
        return out

    def started(self, g: int, queries: np.ndarray) -> None:
        self.queries, self.most = queries, None
        if self.at is not None:
            self.most = np.full(len(queries), np.nan)
            if (t := _read(f"{self.at}/g={g}")) is not None:
                q = t.column("query_id").to_numpy()
                here = np.isin(q, queries)
                by = np.argsort(queries)
                self.most[by[np.searchsorted(queries, q[here], sorter=by)]] = t.column("most").to_numpy()[here]
        self.least = np.full(len(queries), 0.5 * 10.0**-self.digits * (1 - 1e-9))  # of a score that can still matter
        self.have: list[tuple] = []
        self.more = 0

    def take(self, a: int, score: np.ndarray, docs: np.ndarray) -> Iterator[list]:
        least = self.least[a : a + len(score)]
        some = score >= least[:, None]
        if score.shape[1] > self.k and (n := np.count_nonzero(some)) > 2 * self.k * len(score) and self.most is None and n > score.size // 20:
            least = np.maximum(least, np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k] - 10.0**-self.digits)
            some = score >= least[:, None]
        cell = np.flatnonzero(some)
        if len(cell):
            r, c = np.divmod(cell, score.shape[1])
            x = np.round(score.ravel()[cell], self.digits)
            if self.most is not None:
                x = np.round(self.part * x / self.most[a + r], 6)
            self.have.append((a + r, docs[c], x))
            self.more += len(r)
            if self.more > max(200_000, self.k * len(self.queries)):
                self._pressed()
        return iter(())

    def _pressed(self) -> None:
        q, d, x = (np.concatenate(v) for v in zip(*self.have))
        order = np.lexsort((np.unique(d, return_inverse=True)[1] if d.dtype == object else d, -x, q))
        q, d, x = q[order], d[order], x[order]
        first = np.searchsorted(q, np.arange(len(self.least)))
        place = np.arange(len(q)) - first[q]
        full = np.flatnonzero(np.bincount(q, minlength=len(self.least)) >= self.k)
        last = np.full(len(self.least), -np.inf)
        last[full] = x[first[full] + self.k - 1]
        keep = place < self.k
        if self.ties:
            keep |= x == last[q]
        # what rounds to the last place's score may still matter
        least = last[full] - 0.5001 * 10.0**-self.digits
        if self.most is not None:
            least = (last[full] - 0.6e-6) * self.most[full] / self.part - 0.6e-6
        self.least[full] = np.maximum(self.least[full], least)
        self.have, self.more = [(q[keep], d[keep], x[keep])], 0

    def ended(self) -> Iterator[list]:
        if self.have:
            self._pressed()
            q, d, x = self.have[0]
            for i in range(0, len(q), 100_000):
                yield [self.queries[q[i : i + 100_000]], d[i : i + 100_000], x[i : i + 100_000]]


class Scores:
    """``(query_id, doc_id, score)`` of given pairs ``(query_id, doc_id)``, where the score is above 0."""

    columns, held, by_documents = "score double", 0, False

    def __init__(self, pairs: DataFrame, digits: int = 6):
        self.pairs, self.digits = pairs, digits

    def kept(self, groups: int) -> Scores:
        out = Scores(None, self.digits)
        out.at = _grouped(self.pairs.select("query_id", "doc_id").distinct(), groups)
        return out

    def started(self, g: int, queries: np.ndarray) -> None:
        self.queries, t = queries, _read(f"{self.at}/g={g}")
        self.by: dict = {}
        if t is not None:
            by = np.argsort(queries)
            q = t.column("query_id").to_numpy()
            at = by[np.minimum(np.searchsorted(queries, q, sorter=by), len(queries) - 1)]
            for i, d in zip(np.where(queries[at] == q, at, -1).tolist(), t.column("doc_id").to_pylist()):
                if i >= 0:
                    self.by.setdefault(d, []).append(i)

    def take(self, a: int, score: np.ndarray, docs: np.ndarray) -> Iterator[list]:
        if a == 0:  # the first queries of a block of documents
            pairs = [(i, c) for c, d in enumerate(docs.tolist()) for i in self.by.get(d, ())]
            pairs.sort()
            self.line, self.doc = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        lo, hi = np.searchsorted(self.line, [a, a + len(score)])
        r, c = self.line[lo:hi], self.doc[lo:hi]
        x = np.round(score[r - a, c], self.digits)
        yield [self.queries[r[x > 0]], docs[c[x > 0]], x[x > 0]]

    def ended(self) -> Iterator[list]:
        return iter(())


class Ahead:
    """``(query_id, doc_id, score, above, ahead)``: for given ``(query_id, doc_id, score)`` how many documents of a task have more, and how many more or (with ``ties``) as much and a smaller id."""

    columns, held, by_documents = "score double, above long, ahead long", 0, False

    def __init__(self, marks: DataFrame, digits: int = 6, ties: bool = True):
        self.marks, self.digits, self.ties = marks, digits, ties

    def kept(self, groups: int) -> Ahead:
        out = Ahead(None, self.digits, self.ties)
        out.at = _grouped(self.marks.select("query_id", "doc_id", "score"), groups)
        return out

    def started(self, g: int, queries: np.ndarray) -> None:
        t = _read(f"{self.at}/g={g}")
        self.queries = queries
        q = t.column("query_id").to_numpy() if t is not None else np.empty(0, dtype=np.int64)
        by = np.argsort(queries)
        at = by[np.minimum(np.searchsorted(queries, q, sorter=by), len(queries) - 1)]
        here = np.flatnonzero(queries[at] == q)
        x = t.column("score").to_numpy()[here] if t is not None else np.empty(0)
        order = np.lexsort((x, at[here]))
        self.at_line, self.mark = at[here][order], x[order]
        self.doc = t.column("doc_id").to_numpy(zero_copy_only=False)[here][order] if t is not None else np.empty(0, dtype=np.int64)
        self.above, self.equal = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        self.first = np.searchsorted(self.at_line, np.arange(len(queries) + 1))

    def take(self, a: int, score: np.ndarray, docs: np.ndarray) -> Iterator[list]:
        half = 0.5 * 10.0**-self.digits
        # one mark of each query at a time, as a column of thresholds; queries with many marks by search
        many = np.diff(self.first[a : a + len(score) + 1])
        for r in np.flatnonzero(many > 8).tolist():
            i, j = self.first[a + r], self.first[a + r + 1]
            marks = self.mark[i:j]
            row = score[r][score[r] > marks[0] - half]
            at = np.bincount(np.searchsorted(marks + half, row), minlength=len(marks) + 1)
            self.above[i:j] += at[::-1].cumsum()[::-1][1:]
            if not self.ties:
                continue
            at = np.flatnonzero(score[r] > marks[0] - half)
            near = np.searchsorted(marks + half, score[r][at])  # the first mark that is not below
            fits = near < len(marks)
            fits[fits] = marks[near[fits]] - half <= score[r][at[fits]]
            for c, m in zip(at[fits].tolist(), near[fits].tolist()):
                while m < len(marks) and marks[m] - half <= score[r, c]:
                    self.equal[i + m] += docs[c] < self.doc[i + m]
                    m += 1
        for j in range(min(8, many.max(initial=0))):
            r = np.flatnonzero((many > j) & (many <= 8))
            at = self.first[a + r] + j
            rows = score if len(r) == len(score) else score[r]
            n = np.count_nonzero(rows > (self.mark[at] + half)[:, None], axis=1)
            self.above[at] += n
            if not self.ties:
                continue
            tied = np.flatnonzero(np.count_nonzero(rows >= (self.mark[at] - half)[:, None], axis=1) > n)
            for i in tied.tolist():
                same = (rows[i] >= self.mark[at[i]] - half) & (rows[i] <= self.mark[at[i]] + half)
                self.equal[at[i]] += np.count_nonzero(docs[same] < self.doc[at[i]])
        return iter(())

    def ended(self) -> Iterator[list]:
        if len(self.mark):
            yield [self.queries[self.at_line], self.doc, self.mark, self.above, self.above + self.equal]


def scan(docs: Coded, sides: list, finish, combine=_added) -> DataFrame:
    """What ``finish`` makes of the scores: those of the one side, or ``combine`` of the sides' matrices (queries by documents).

    Tasks are parts of the documents by groups of queries. Where results are few for a query its
    documents stay together; a group grows neither beyond ``ASKED`` rows of what it asks for nor beyond ``HELD`` results.
    """
    spark = docs.rows.sparkSession
    asked = [s._replace(asked=written(s.asked, "asked")) for s in sides]
    sizes = [s.asked.agg(F.count(F.lit(1)), F.countDistinct("query_id")).first() for s in asked]
    rows, queries = max(x[0] for x in sizes), sum(x[1] for x in sizes)
    tasks = max(4, 2 * spark.sparkContext.defaultParallelism)
    files = max(1, len(docs.rows.inputFiles()))
    parts = files if finish.by_documents else min(files, -(-docs.docs // DOCS)) or 1
    groups = max(1, -(-tasks // parts), -(-rows // ASKED), -(-queries * finish.held // HELD))
    groups = max(1, min(groups, queries))
    kept = [s.kept(groups, docs) for s in asked]
    made = finish.kept(groups)
    schema = f"query_id long, doc_id {docs.kind}, {finish.columns}"
    uri = _address(docs.rows.inputFiles()[0].rsplit("/", 1)[0]) if docs.docs else None
    if uri is not None and uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (i for b in batches for i in b.column(0).to_pylist()):
            yield from task(*divmod(number, parts))

    def task(g: int, p: int) -> Iterator[pa.RecordBatch]:
        tables = [_read(f"{at}/g={g}") for at, *_ in kept]
        if all(t is None for t in tables) or uri is None:
            return
        ids = np.unique(np.concatenate([t.column("query_id").to_numpy() for t in tables if t is not None]))
        lines = []
        for t, (_, names, features, _) in zip(tables, kept):
            t = t if t is not None else next(x for x in tables if x is not None).slice(0, 0)
            if features is None and "w" not in t.column_names:
                t = t.append_column("w", pa.array([], type=pa.float64()))
            lines.append(Lines(ids, t, _names(names), _read(features) if features else None))
        order = np.argsort(-lines[0].many, kind="stable")
        ids = ids[order]
        for x in lines:
            x.ordered(order)
        made.started(g, ids)
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        every = sorted(pds.dataset(root, filesystem=fs, format="parquet").files)
        block = max(1, CELLS // (sum(x.n for x in lines) + len(lines)))
        step = lambda n: max(1, STEP // n)
        kind = pa.string() if docs_kind == "string" else pa.int32() if docs_kind == "int" else pa.int64()
        batch = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0], type=pa.int64()), pa.array(x[1], type=kind), *map(pa.array, x[2:])], names=columns)
        mine = pds.dataset([f for i, f in enumerate(every) if i % parts == p], filesystem=fs, format="parquet")
        for rows in _blocks(mine.to_batches(batch_size=min(block, 20_000), use_threads=False, batch_readahead=1, fragment_readahead=1), block):
            names, n = rows.column("doc_id").to_numpy(zero_copy_only=False), rows.num_rows
            flat = lambda c: (np.repeat(np.arange(n), pc.list_value_length(rows.column(c)).to_numpy()), rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64))  # noqa: E731, B023
            matrices = []
            for x, (_, _, features, how) in zip(lines, kept):
                doc, key = flat("terms" if features is None else "keys")
                value = how(flat("tfs")[1].astype(np.float64), rows.column("dl").to_numpy().astype(np.float64)[doc]) if features is None else None
                matrices.append(x.matrix(doc, key, value, n, features is not None and how))
            for a in range(0, len(ids), step(n)):
                b = min(len(ids), a + step(n))
                score = combine(*[x.sums(m, a, b) for x, m in zip(lines, matrices)], slice(a, b))
                for out in made.take(a, score, names):
                    if len(out[0]):
                        yield batch(out)
        for out in made.ended():
            yield batch(out)

    docs_kind, columns = docs.kind, ["query_id", "doc_id", *re.findall(r"(\w+) (?:double|long)", finish.columns)]
    return spark.range(0, groups * parts, 1, groups * parts).mapInArrow(run, schema)


def _blocks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    """Rows in tables of ``n``."""
    have: list[pa.RecordBatch] = []
    for b in batches:
        have.append(b)
        if sum(x.num_rows for x in have) >= n:
            t = pa.Table.from_batches(have)
            while t.num_rows >= n:
                yield t.slice(0, n)
                t = t.slice(n)
            have = t.to_batches()
    if sum(x.num_rows for x in have):
        yield pa.Table.from_batches(have)


def bm25_impact(n: int, total_len: int, k1: float, b: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What a posting counts for, apart from the term's weight."""
    mean = total_len / n if n and total_len else 1.0
    return lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))


def ranks(docs: Coded, side: Weighted, pairs: DataFrame, digits: int = 6) -> DataFrame:
    """``(query_id, doc_id, score, rank, above)`` of given pairs among all scored documents, without any list being formed; pairs without a score are left out.

    ``rank`` counts equal scores by id, ``above`` only what is more.
    """
    pairs = written(pairs.select("query_id", "doc_id").distinct(), "pairs")
    mine = side._replace(asked=written(_only([side], pairs, "left_semi")[0].asked, "asked"))
    marks = written(scores(docs, [mine], pairs, digits=digits), "marks")
    found = scan(docs, [mine], Ahead(marks, digits))
    total = found.groupBy("query_id", "doc_id", "score").agg(F.sum("above").alias("above"), F.sum("ahead").alias("ahead"))
    return total.select("query_id", "doc_id", "score", (F.col("ahead") + 1).alias("rank"), "above")


def scores(docs: Coded, sides: list, pairs: DataFrame, combine=_added, digits: int = 6) -> DataFrame:
    """``(query_id, doc_id, score)`` of given pairs; only their documents are gone through."""
    pairs = written(pairs.select("query_id", "doc_id"), "pairs")
    few = written(docs.rows.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), "coded")
    own = docs._replace(rows=few, docs=few.count())
    return scan(own, _only(sides, pairs, "left_semi"), Scores(pairs, digits), combine)


def best(docs: Coded, sides: list, k: int, combine=_added, digits: int = 6) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the best ``k`` documents of each query."""
    return S.top(scan(docs, sides, Best(k, digits), combine), k)


def keyed(bm25: np.ndarray, coverage: np.ndarray, queries: slice) -> np.ndarray:
    """``search.hybrid_keys`` of two matrices, scores rounded to 6 digits and coverage to 4. Keys of coverage are a billionth more, as one that rounds to 0 is in the list."""
    low = np.floor(coverage * 1e4 + 0.5) / 1e4
    high = np.round(bm25, 6)
    return np.where(high > 0, 1 + high, np.where(low > 0, np.floor(low * 1e-9 * 1e9 + 0.5) / 1e9 + 1e-9, 0.0))


def keyed_exactly(bm25: np.ndarray, coverage: np.ndarray, queries: slice) -> np.ndarray:
    """``keyed`` of two matrices as they are."""
    return np.where(bm25 > 0, 1 + bm25, np.where(coverage > 0, np.floor(coverage * 1e-9 * 1e9 + 0.5) / 1e9 + 1e-9, 0.0))


def found(coverage: np.ndarray, queries: slice) -> np.ndarray:
    """The same for every document with any match."""
    return (coverage > 0).astype(np.float64)


def _only(sides: list, queries: DataFrame, how: str) -> list:
    return [s._replace(asked=s.asked.join(queries.select("query_id"), "query_id", how)) for s in sides]


def fused(docs: Coded, sides: list, vec: DataFrame, combine=_added, digits: int = 6, k: float = 20.0, w_kw: float = 1.0, w_vec: float = 2.0, n: int = 10) -> DataFrame:
    """``search.rrf`` of the scores with ``vec``; the first list is never formed.

    Where there is a ``fusion_depth``, each of the second list's first ``n`` has more than a document of the first
    list alone can have. So a second list with n places gives the whole result; if it is shorter, the
    first list's best n fill it up. Places in the first list are found by counting. Without a depth the lists are fused whole.
    """
    depth = S.fusion_depth(n, k, w_kw, w_vec)
    if depth is None:
        return S.rrf(scan(docs, sides, All(digits), combine), vec, k, w_kw, w_vec, n)
    vec = written(S.top(vec.select("query_id", "doc_id", "score"), depth), "second-list")
    full = vec.where(F.col("rank") == n)
    first = written(best(docs, _only(sides, full, "left_anti"), n, combine, digits).drop("rank"), "first-list")
    more = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    placed = first.withColumn("above", F.rank().over(more) - 1)
    mine = scores(docs, sides, vec, combine, digits).join(first, ["query_id", "doc_id"], "left_anti")
    mine = written(mine, "places")
    marks = mine.groupBy("query_id", "score").agg(F.min("doc_id").alias("doc_id"))
    above = scan(docs, _only(sides, mine, "left_semi"), Ahead(marks, digits, ties=False), combine)
    above = above.groupBy("query_id", "score").agg(F.sum("above").alias("above"))
    every = placed.unionByName(mine.join(above, ["query_id", "score"]).select(*placed.columns))
    rows = every.join(vec.withColumnRenamed("score", "v").withColumnRenamed("rank", "rb"), ["query_id", "doc_id"], "full")
    tied = Window.partitionBy("query_id", "score").orderBy(F.coalesce("v", F.lit(0.0)).desc(), "doc_id")
    ra = F.when(F.col("score").isNotNull(), F.col("above") + F.row_number().over(tied))
    term = lambda r, w: F.coalesce(w / (k + r), F.lit(0.0))
    scored = rows.withColumn("ra", ra).select("query_id", "doc_id", F.round(term(F.col("ra"), w_kw) + term(F.col("rb"), w_vec), 9).alias("score"))
    return S.top(scored, n)


def blended(docs: Coded, side: Weighted, vec: DataFrame, k: int = 10) -> DataFrame:
    """``search.blend`` of the sums, rounded to 6 digits, with the list ``vec``; the first list is never formed.

    A document that is not in ``vec`` has its share of the query's most only, so it is among the
    best k by that share or not among the best at all.
    """
    most = written(scan(docs, [side], Best(1)).groupBy("query_id").agg(F.max("score").alias("most")), "most")
    vec = written(vec.select("query_id", "doc_id", F.col("score").alias("vec")), "second-list")
    first = S.top(scan(docs, [side], Best(k, shares=most, part=0.6)), k).drop("rank")
    kw = scores(docs, [side], vec).withColumnRenamed("score", "kw")
    both = vec.join(kw, ["query_id", "doc_id"], "left").join(vec.groupBy("query_id").agg(F.max("vec").alias("mv")), "query_id").join(most, "query_id", "left")
    share = lambda c, m, w: F.coalesce(F.when(F.col(m) > 0, w * F.col(c) / F.col(m)), F.lit(0.0))
    both = both.select("query_id", "doc_id", F.round(share("kw", "most", 0.6) + share("vec", "mv", 0.4), 6).alias("score"))
    rest = first.join(vec, ["query_id", "doc_id"], "left_anti").select(*both.columns)
    return S.top(both.unionByName(rest).where("score > 0"), k)


def places(docs: Coded, sides: list, vec: DataFrame, depth: int, combine=_added, digits: int = 6) -> DataFrame:
    """``(query_id, doc_id, ra, rb)``: places down to ``depth`` in the list of the scores, equal ones by ``vec``, then id, and in the list ``vec``."""
    vec = written(vec.select("query_id", "doc_id", F.col("score").alias("v")), "second-list")
    first = scan(docs, sides, Best(depth, digits, ties=True), combine).join(vec, ["query_id", "doc_id"], "left")
    a = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.coalesce("v", F.lit(0.0)).desc(), "doc_id")
    b = Window.partitionBy("query_id").orderBy(F.col("v").desc(), "doc_id")
    first = first.select("query_id", "doc_id", F.row_number().over(a).alias("ra")).where(F.col("ra") <= depth)
    second = vec.select("query_id", "doc_id", F.row_number().over(b).alias("rb")).where(F.col("rb") <= depth)
    return first.join(second, ["query_id", "doc_id"], "full")


def lexical_only(docs: Coded, bm25: Weighted, keys: Keyed, k: float = 20.0, n: int = 10, digits: int = 6) -> DataFrame:
    """``search.lexical_ranking``: only where BM25 gives fewer than ``n`` documents are candidates without a score looked for."""
    scored = written(best(docs, [bm25], n, digits=digits), "scored")
    full = scored.where(F.col("rank") == n)
    rest = scan(docs, _only([keys], full, "left_anti"), Best(2 * n), found)
    rest = rest.join(scored, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.lit(0.0).alias("score"))
    every = S.top(scored.select("query_id", "doc_id", "score").unionByName(rest), n)
    return every.select("query_id", "doc_id", "rank", F.round(1 / (k + F.col("rank")), 9).alias("score"))


def expansion(docs: DataFrame, terms: DataFrame, neighbours: DataFrame) -> tuple[Coded, list]:
    """What ``search.neural_expansion`` scores: 20000 for each neighbour that a document holds, itself or its first three letters as a fragment."""
    near = written(terms.select("query_id", "term").distinct().join(neighbours, "term").select("query_id", F.col("near").alias("term")).distinct(), "near")
    every = F.when(F.length("term") > 3, F.array(F.col("term"), F.substring("term", 1, 3))).otherwise(F.array("term"))
    keys = written(near.select("term").distinct().select("term", F.explode(every).alias("key")).withColumn("w", F.lit(20000.0)), "keys")
    return coded(docs, None, keys.select("key")), [Keyed(near, keys, once=True)]
