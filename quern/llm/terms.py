"""Term statistics over analysed records ``(doc_id, revision, tokens, indexed_at)``."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_by_term
from ..session import written


def current_records(doc_tokens: DataFrame) -> DataFrame:
    """``(doc_id, tokens)`` of the highest revision of each record, without removed ones.

    Null tokens in that revision mean removed. Rows that share the highest revision are settled by
    ``indexed_at``, then by the tokens themselves. Null and empty tokens are taken out, so a record
    may come out with an empty array; it still counts as a record. Rows without a doc_id are left out.
    """
    best = F.max(F.struct("revision", "indexed_at", "tokens")).alias("b")
    rows = doc_tokens.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(best).where(F.col("b.tokens").isNotNull())
    return rows.select("doc_id", F.filter("b.tokens", lambda t: t.isNotNull() & (t != "")).alias("tokens"))


TF = pa.schema([("doc_id", pa.int64()), ("doc_len", pa.int32()), ("term", pa.string()), ("tf", pa.int64()), ("first", pa.bool_())])


def _combined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of a batch of records: their sizes, and line, dictionary of terms, code and number of each distinct term of a record."""
    tokens = batch.column("tokens")
    sizes = np.diff(tokens.offsets.to_numpy())
    coded = tokens.flatten().dictionary_encode()
    width = max(1, len(coded.dictionary))
    line = np.repeat(np.arange(len(sizes)), sizes)
    pair, n = np.unique(line * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    line, code = np.divmod(pair, width)
    return sizes, line, coded.dictionary, code, n


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, line, names, code, n = _combined(batch)
        empty = np.flatnonzero(sizes == 0)
        every = np.concatenate([line, empty])
        first = np.ones(len(every), dtype=bool)
        first[1 : len(line)] = line[1:] != line[:-1]
        term = pa.concat_arrays([names.take(pa.array(code)), pa.nulls(len(empty), pa.string())])
        ids = batch.column("doc_id").take(pa.array(every)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes[every].astype(np.int32)), term, pa.array(np.concatenate([n, np.zeros(len(empty), np.int64)])), pa.array(first)], schema=TF)


def log_entropy(records: DataFrame) -> DataFrame:
    """``(doc_id, term, tf, doc_len, gf, df, weight, records)`` for each term of each record.

    weight = ln(1 + tf) * (1 - H / ln N) with H the entropy of the term's spread over records and N
    the number of records; with one record the second factor is 1. Two aggregations give all of it:
    H = ln gf - sum(tf ln tf) / gf needs no share per record. The first, of a record's tokens, needs no
    shuffle, as a record is one row; its result is written, with a mark on one row of each record (one without a term
    for a record without tokens), so N is a count of marks and the records are read once. The weights of heavy terms are broadcast
    (at most 1000 by definition), the others joined by a shuffle (see ``join_by_term``).
    """
    every = written(records.select("doc_id", "tokens").mapInArrow(_term_rows, "doc_id long, doc_len int, term string, tf long, first boolean"), "tf")
    n = every.agg(F.count(F.when(F.col("first"), 1)).alias("records"))
    tf = every.where(F.col("term").isNotNull()).drop("first")
    stats = tf.groupBy("term").agg(F.sum("tf").alias("gf"), F.count(F.lit(1)).alias("df"), F.sum(F.col("tf") * F.log("tf")).alias("__s"))
    entropy = F.log("gf") - F.col("__s") / F.col("gf")
    stats = stats.crossJoin(F.broadcast(n)).select("term", "gf", "df", F.when(F.col("records") > 1, F.greatest(F.lit(0.0), 1 - entropy / F.log("records"))).otherwise(F.lit(1.0)).alias("g"), "records")
    rows = join_by_term(tf, stats, "term", "df", "doc_id")
    return rows.select("doc_id", "term", "tf", "doc_len", "gf", "df", (F.log1p("tf") * F.col("g")).alias("weight"), "records")


def distinctive(records: DataFrame, least_tf: int = 3, least_percent: int = 5, records_of_term: tuple[int, int] = (2, 5)) -> DataFrame:
    """``log_entropy`` rows of the terms that set a record apart.

    A term in at most m records has an entropy of at most ln m, so at ``least_tf`` occurrences its
    weight is at least ln(1 + least_tf) * (1 - ln m / ln N): terms of that weight are the candidates.
    Of them count those that come often enough, make up enough of the record and are shared by the wanted
    number of records.
    """
    low, high = records_of_term
    bound = math.log1p(least_tf) * F.when(F.col("records") > 1, 1 - math.log(high) / F.log("records")).otherwise(1.0) - 1e-9
    heavy = log_entropy(records).where(F.col("weight") >= bound)
    return heavy.where((F.col("tf") >= least_tf) & (F.col("tf") * 100 >= F.col("doc_len") * least_percent) & F.col("df").between(low, high))


SEEN = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


class LastSeen:
    """Per term, its occurrences, its records and the record it was last seen in: no set of records is kept.

    Tokens must come ordered by record. A token opens a new record of its term exactly if the
    record last seen with the term is another.
    """

    def __init__(self) -> None:
        self.place: dict[str | None, int] = {}
        self.occurrences, self.records, self.last = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def add(self, terms: pa.Array, record: np.ndarray, n: np.ndarray) -> None:
        """Take in tokens: their terms, records and numbers of occurrences."""
        coded = terms.dictionary_encode("encode")  # a row without a term counts its record
        names = coded.dictionary.to_pylist()
        at = np.fromiter((self.place.setdefault(t, len(self.place)) for t in names), np.int64, len(names))
        while len(self.place) > len(self.last):
            for c in ("occurrences", "records", "last"):
                setattr(self, c, np.concatenate([getattr(self, c), np.zeros(len(self.last) if c != "last" else len(getattr(self, c)), np.int64)]))
        code = at[coded.indices.to_numpy(zero_copy_only=False)]
        order = np.argsort(code, kind="stable")  # by term, within a term still by record
        code, record, n = code[order], record[order], n[order]
        opens = np.ones(len(code), dtype=bool)
        first = np.ones(len(code), dtype=bool)
        first[1:] = code[1:] != code[:-1]
        opens[1:] = first[1:] | (record[1:] != record[:-1])
        head = np.flatnonzero(first)
        seen = self.records[code[head]] > 0
        opens[head[seen]] = self.last[code[head[seen]]] != record[head[seen]]
        self.occurrences[code[head]] += np.add.reduceat(n, head)
        self.records[code[head]] += np.add.reduceat(opens.astype(np.int64), head)
        self.last[code[head]] = record[np.append(head[1:], len(code)) - 1]

    def rows(self) -> pa.RecordBatch:
        n = len(self.place)
        return pa.RecordBatch.from_arrays([pa.array(list(self.place), pa.string()), pa.array(self.occurrences[:n]), pa.array(self.records[:n])], schema=SEEN)


def _tokens(parts: int, salts: int):
    """A record's tokens, equal ones as one row with their number, with the part that their term goes to; one row without a term for each record."""
    schema = pa.schema([("part", pa.int32()), ("term", pa.string()), ("record", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, line, names, code, n = _combined(batch)
            h = np.fromiter((zlib.crc32(t.encode()) for t in names.to_pylist()), np.int64, len(names))
            ids = batch.column("doc_id").to_numpy()
            record = np.concatenate([ids[line], ids])
            hashed = np.concatenate([h[code], np.zeros(len(sizes), np.int64)])
            part = (hashed + (record * 2654435761 >> 7) % salts * 40503) % parts
            term = pa.concat_arrays([names.take(pa.array(code)), pa.nulls(len(sizes), pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), term, pa.array(record), pa.array(np.concatenate([n, np.zeros(len(sizes), np.int64)]))], schema=schema)

    return run


def _counted(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = LastSeen()
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if len(seen.place) > most:
                # the triples are handed on between two records, so that none is counted in both halves
                record = batch.column("record").to_numpy()
                new = int(np.searchsorted(record, last, "right"))
                if new < len(record):
                    if new:
                        seen.add(batch.column("term").slice(0, new), record[:new], batch.column("n").to_numpy()[:new])
                        batch = batch.slice(new)
                    yield seen.rows()
                    seen = LastSeen()
            record = batch.column("record").to_numpy()
            seen.add(batch.column("term"), record, batch.column("n").to_numpy())
            last = record[-1]
        if seen.place:
            yield seen.rows()

    return run


def counted(records: DataFrame, most: int = 1_000_000, salts: int = 16) -> DataFrame:
    """``term_counts`` with one more row, without a term, whose ``records`` is the number of all records."""
    parts = max(salts, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tokens = records.select("doc_id", "tokens").mapInArrow(_tokens(parts, salts), "part int, term string, record long, n long")
    ordered = tokens.repartitionById(parts, "part").sortWithinPartitions("record")
    partial = ordered.select("term", "record", "n").mapInArrow(_counted(most), "term string, occurrences long, records long")
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_counts(records: DataFrame, most: int = 1_000_000, salts: int = 16) -> DataFrame:
    """``(term, occurrences, records)`` of each distinct term, by last-seen counters.

    Equal tokens of a record are combined where they are read. Tokens are hash-partitioned by term and,
    within a partition, ordered by record; each term then has one triple: occurrences, records, last
    record. A term's records are dealt to ``salts`` partitions by their ids, so a term in every record
    is no single task's, and the triples of the salts, which share no record, add up. A record's tokens
    may come in several rows. ``most`` bounds the terms that a task holds; beyond it triples are handed on.
    """
    return counted(records, most, salts).where(F.col("term").isNotNull())


def marked_terms(records: DataFrame, rare_records: int = 1, common_percent: int = 30) -> DataFrame:
    """``term_counts`` with ``mark``: rare (in at most ``rare_records``), common (in at least that share of all records) or null.

    Records with no tokens count towards the share. Where a tiny collection makes a term both, it is rare.
    """
    every = written(counted(records), "counts")
    n = every.where(F.col("term").isNull()).select(F.col("records").alias("__n"))
    rare = F.col("records") <= rare_records
    common = F.col("records") * 100 >= F.col("__n") * common_percent
    return every.where(F.col("term").isNotNull()).crossJoin(F.broadcast(n)).select("term", "occurrences", "records", F.when(rare, "rare").when(common, "common").alias("mark"))
