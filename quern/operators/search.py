"""Lexical retrieval, scoring and fusion for batches of queries. Every frame carries ``query_id``.

Postings are joined on terms, so the cost is that of the postings hit; whether the queries' side is
broadcast is decided by its measured size. Rankings keep no more
than the wanted places of a query per task before their shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written

K1, B = 1.2, 0.75
#: Longest term whose deletions are listed.
LISTED = 24
#: Most rows of what a batch of queries wants that are broadcast.
MOST_WANTED = 500_000
#: Cells of a matrix of queries by documents that one step of a task scores.
CELLS = 4_000_000


def top(scores: DataFrame, k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """The best ``k`` of each query with ``rank``; equal scores by key."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(tf: DataFrame) -> DataFrame:
    """``(query_id, term, cnt)`` from ``term_freq`` over queries."""
    return tf.select("query_id", "term", F.col("tf").alias("cnt"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def by_document(want: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """Postings ``(key, doc_id, ...)`` joined to what queries want of them, ``(query_id, key, ...)``, clustered by document.

    What is wanted is measured: up to ``MOST_WANTED`` rows it is broadcast, so that only postings
    that some query wants are shuffled, by document, and the sums per query and document that follow need no
    further shuffle. No task gets all postings of a common key. Beyond that both sides are shuffled by key.
    """
    want = written(want, "wanted")
    if want.count() > MOST_WANTED:
        return want.join(postings, key)
    hit = postings.join(F.broadcast(want.select(key).distinct()), key, "left_semi").repartition("doc_id")
    return hit.join(F.broadcast(want), key)


def _hits(weight: DataFrame, tf: DataFrame, lengths: DataFrame | None, candidates: DataFrame | None) -> DataFrame:
    hits = by_document(weight, tf, "term")
    if "dl" not in tf.columns:
        hits = hits.join(lengths, "doc_id")
    return hits if candidates is None else hits.join(candidates.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")


def bm25_weights(terms: DataFrame, vocab: DataFrame, stats: DataFrame) -> DataFrame:
    """``(query_id, term, w, avgdl)``: what a query gives for a term."""
    return terms.join(vocab.select("term", "df"), "term").crossJoin(F.broadcast(stats)).select("query_id", "term", (F.col("cnt") * idf(F.col("n"), F.col("df"))).alias("w"), (F.col("total_len") / F.col("n")).alias("avgdl"))


def tfidf_weights(terms: DataFrame, vocab: DataFrame, stats: DataFrame) -> DataFrame:
    return terms.join(vocab.select("term", "df"), "term").crossJoin(F.broadcast(stats)).select("query_id", "term", (F.col("cnt") * F.log(F.col("n") / F.col("df"))).alias("w"))


def bm25_impact(k1: float = K1, b: float = B) -> Column:
    """What a posting counts for, apart from the term's weight."""
    f = F.col("tf")
    return f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def bm25(terms: DataFrame, tf: DataFrame, vocab: DataFrame, lengths: DataFrame | None, stats: DataFrame, k1: float = K1, b: float = B, candidates: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id, score)`` of documents with any term, score above 0; of ``candidates`` (query_id, doc_id) only, if given.

    ``lengths`` may be None where ``tf`` has ``dl``. Statistics are those of the whole collection in any case.
    """
    hits = _hits(bm25_weights(terms, vocab, stats), tf, lengths, candidates)
    return hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * bm25_impact(k1, b)).alias("score")).where("score > 0")


def tfidf(terms: DataFrame, tf: DataFrame, vocab: DataFrame, lengths: DataFrame | None, stats: DataFrame) -> DataFrame:
    hits = _hits(tfidf_weights(terms, vocab, stats), tf, lengths, None)
    return hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("tf") / F.col("dl")).alias("score")).where("score > 0")


def _keep_best(k: int):
    def finish(queries: np.ndarray, docs: np.ndarray, score: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        keep = score > 0
        if len(docs) > k:
            keep &= score >= np.partition(score, len(docs) - k, axis=1)[:, len(docs) - k, None]
        r, c = np.nonzero(keep)
        order = np.lexsort((c, -score[r, c], r))  # documents ascend, so equal scores go by id
        r, c = r[order], c[order]
        fits = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c = r[fits], c[fits]
        return pa.RecordBatch.from_arrays([pa.array(queries[r]), pa.array(docs[c], type=kind), pa.array(score[r, c])], names=["query_id", "doc_id", "score"])

    return finish


def _count_above(uri: str):
    """For each ``(query_id, score)`` below ``uri``, how many documents of a block have more."""
    held: dict[int, np.ndarray] = {}

    def finish(queries: np.ndarray, docs: np.ndarray, score: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        if not held:
            fs, root = pyarrow.fs.FileSystem.from_uri(uri)
            t = pq.read_table(root, filesystem=fs, columns=["query_id", "score"], partitioning=None)
            q, x = t.column("query_id").to_numpy(), t.column("score").to_numpy()
            order = np.lexsort((x, q))
            q, x = q[order], x[order]
            heads, starts = np.unique(q, return_index=True)
            held.update({int(h): np.unique(v) for h, v in zip(heads, np.split(x, starts[1:]))})
        out = []
        for line, q in enumerate(queries.tolist()):
            if (marks := held.get(q)) is not None:
                # a score counts for all marks below it
                at = np.bincount(np.searchsorted(marks, score[line][score[line] > 0]), minlength=len(marks) + 1)
                out.append((q, marks, at[::-1].cumsum()[::-1][1:]))
        ids = np.repeat(np.array([q for q, _, _ in out], dtype=np.int64), [len(m) for _, m, _ in out])
        columns = [np.concatenate([x[i] for x in out]) if out else np.empty(0) for i in (1, 2)]
        some = columns[1] > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(columns[0][some].astype(np.float64)), pa.array(columns[1][some].astype(np.int64))], names=["query_id", "score", "above"])

    return finish


def _block_scorer(uri: str, digits: int, finish):
    """Score runs of documents against all queries at once, in a matrix of queries by documents, and hand on what ``finish`` makes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        wanted = pq.read_table(root, filesystem=fs, columns=["query_id", "term", "w"], partitioning=None).sort_by("term")
        coded = wanted.column("term").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        code = coded.indices.to_numpy(zero_copy_only=False)
        place = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        first = np.searchsorted(code, np.arange(len(place) + 1))
        queries, line = np.unique(wanted.column("query_id").to_numpy(), return_inverse=True)
        weight = wanted.column("w").to_numpy()
        most = max(1, CELLS // max(1, len(queries)))

        def scored(t: pa.Table) -> pa.RecordBatch:
            term = t.column("term").combine_chunks().dictionary_encode()
            term = term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term
            at = np.array([place[x] for x in term.dictionary.to_pylist()], dtype=np.int64)[term.indices.to_numpy(zero_copy_only=False)]
            docs, d = np.unique(t.column("doc_id").to_numpy(), return_inverse=True)
            n = first[at + 1] - first[at]
            hit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[at], n)
            cell = line[hit] * len(docs) + np.repeat(d, n)
            score = np.bincount(cell, weights=weight[hit] * np.repeat(t.column("impact").to_numpy(), n), minlength=len(queries) * len(docs))
            return finish(queries, docs, np.round(score, digits).reshape(len(queries), len(docs)), t.schema.field("doc_id").type)

        held: list[pa.Table] = []
        docs = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            held.append(t)
            docs += len(t.column("doc_id").unique())
            if docs > most:
                # up to the last document, which may go on in the next batch
                rows = pa.concat_tables(held)
                ids = rows.column("doc_id").to_numpy()
                starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                cuts = [*starts[:-1:most], starts[-1]]
                for a, b in zip(cuts, cuts[1:]):
                    yield scored(rows.slice(a, b - a))
                held, docs = [rows.slice(starts[-1])], 1
        if held:
            yield scored(pa.concat_tables(held))

    return run


def _uri(written_rows: DataFrame) -> str | None:
    """Where a written table lies, as Arrow names it; None if it has no files."""
    files = written_rows.inputFiles()
    path = files[0].rsplit("/", 1)[0] if files else None
    return path if path is None or not path.startswith("file:") else "file://" + path.removeprefix("file://").removeprefix("file:")


def _wanted_postings(weights: DataFrame, tf: DataFrame, impact: Column) -> DataFrame:
    """``(doc_id, term, impact)`` of the postings of any wanted term, clustered and sorted by document; ``weights`` are few enough to broadcast."""
    shared = [c for c in weights.columns if c not in ("query_id", "term", "w")]
    terms = weights.groupBy("term").agg(*[F.first(c).alias(c) for c in shared]) if shared else weights.select("term").distinct()
    hit = tf.join(F.broadcast(terms), "term").select("doc_id", "term", impact.cast("double").alias("impact"))
    return hit.repartition("doc_id").sortWithinPartitions("doc_id")


def best_scored(weights: DataFrame, tf: DataFrame, impact: Column, k: int, digits: int = 6) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the best ``k`` documents of each query by the sum of weight times impact, rounded to ``digits``.

    For when only the best are wanted. Postings that some query wants are shuffled by document; each
    task scores its documents in blocks of ``CELLS`` cells and hands on ``k`` a query and block, so
    pairs of query and document are never materialised. ``weights`` is ``(query_id, term, w)`` and what ``impact``
    needs besides ``tf``'s columns; beyond ``MOST_WANTED`` rows the sums are made by ``by_document``.
    """
    weights = written(weights, "wanted")
    if weights.count() > MOST_WANTED:
        sums = by_document(weights, tf, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * impact), digits).alias("score"))
        return top(sums.where("score > 0"), k)
    kind, uri = dict(tf.dtypes)["doc_id"], _uri(weights)
    if uri is None:
        return top(tf.sparkSession.createDataFrame([], f"query_id long, doc_id {kind}, score double"), k)
    found = _wanted_postings(weights, tf, impact).mapInArrow(_block_scorer(uri, digits, _keep_best(k)), f"query_id long, doc_id {kind}, score double")
    return top(found, k)


def best_fused(weights: DataFrame, tf: DataFrame, impact: Column, vec: DataFrame, k: float = 20.0, w_kw: float = 1.0, w_vec: float = 2.0, n: int = 10, digits: int = 6) -> DataFrame:
    """``rrf`` of the sums of weight times impact with ``vec``, without ever forming the first list.

    ``vec`` is the second list down to ``fusion_depth``. A result is in it, or else among the first
    list's best: one of the first n + depth. So those and the second list's documents are all that
    counts; places in the first list are found by counting, block by block, how many documents have more
    than each of these scores. Where no depth can be given, or the queries want too much to
    broadcast, the lists are fused whole.
    """
    weights = written(weights, "wanted")
    depth, kind, uri = fusion_depth(n, k, w_kw, w_vec), dict(tf.dtypes)["doc_id"], _uri(weights)
    if depth is None or uri is None or weights.count() > MOST_WANTED:
        sums = by_document(weights, tf, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * impact), digits).alias("score"))
        return rrf(sums.where("score > 0"), vec, k, w_kw, w_vec, n)
    vec = written(top(vec.select("query_id", "doc_id", "score"), depth), "second-list")
    postings = written(_wanted_postings(weights, tf, impact), "wanted-postings")
    again = lambda: postings.repartition("doc_id").sortWithinPartitions("doc_id")
    first = top(again().mapInArrow(_block_scorer(uri, digits, _keep_best(n + depth)), f"query_id long, doc_id {kind}, score double"), n + depth).drop("rank")
    first = written(first, "first-list")
    # scores of the second list's documents in the first: their postings only
    mine = vec.select("query_id", "doc_id").join(weights.select("query_id", "term", "w"), "query_id").join(postings, ["doc_id", "term"])
    mine = mine.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("impact")), digits).alias("score")).where("score > 0")
    every = written(first.unionByName(mine.join(first, ["query_id", "doc_id"], "left_anti")), "places")
    marks = _uri(every)
    if marks is None:
        return rrf(every, vec, k, w_kw, w_vec, n)
    above = again().mapInArrow(_block_scorer(uri, digits, _count_above(marks)), "query_id long, score double, above long")
    above = above.groupBy("query_id", "score").agg(F.sum("above").alias("above"))
    rows = every.join(above, ["query_id", "score"], "left").join(vec.withColumnRenamed("score", "v").withColumnRenamed("rank", "rb"), ["query_id", "doc_id"], "full")
    tied = Window.partitionBy("query_id", "score").orderBy(F.coalesce("v", F.lit(0.0)).desc(), "doc_id")
    ra = F.when(F.col("score").isNotNull(), F.coalesce("above", F.lit(0)) + F.row_number().over(tied))
    term = lambda r, w: F.coalesce(w / (k + r), F.lit(0.0))
    scored = rows.withColumn("ra", ra).select("query_id", "doc_id", F.round(term(F.col("ra"), w_kw) + term(F.col("rb"), w_vec), 9).alias("score"))
    return top(scored, n)


def coverage(terms: DataFrame, frags: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score)``: for each fragment of a query's terms, its share of the term in percent."""
    parts = terms.select("query_id", "term").distinct().select("query_id", "term", F.explode(T.edge_ngrams("term")).alias("fragment"))
    parts = parts.groupBy("query_id", "fragment").agg(F.sum(F.octet_length("fragment") / F.octet_length("term") * 100).alias("s"))
    return by_document(parts, frags, "fragment").groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"))


def sound_alike(terms: DataFrame, codes: DataFrame, weight: float = 0.3) -> DataFrame:
    mine = terms.select("query_id", "term").distinct().select("query_id", T.soundex("term").alias("code")).where("code <> ''").groupBy("query_id", "code").agg(F.count(F.lit(1)).alias("c"))
    return by_document(mine, codes, "code").groupBy("query_id", "doc_id").agg((F.sum("c") * weight).alias("score"))


def near_terms(wanted: DataFrame, vocab: DataFrame, distance: int = 2) -> DataFrame:
    """``(term, near, distance)``: vocabulary terms at edit distance 1 to ``distance`` of each wanted term.

    An equi-join on candidates, checked by the real distance; only vocabulary of a length that can
    match is expanded. Up to distance 2 and ``LISTED`` characters the key is what is left after
    deletions: two terms within the distance share one. Beyond, a wanted term is cut into distance + 1 parts, of
    which edits leave at least one as it was, moved by at most the distance; so the key is a part
    with its place and the vocabulary is expanded to its substrings of the parts' lengths. Terms too
    short to have that many parts are compared with the vocabulary of a length that can match.
    """
    w = wanted.select("term").distinct()
    near_length = F.sequence(F.greatest(F.length("term") - distance, F.lit(1)), F.length("term") + distance)
    lengths = w.select(F.explode(near_length).alias("n")).distinct()
    v = vocab.select(F.col("term").alias("near")).join(lengths, F.length("near") == F.col("n"), "left_semi")
    few = (F.length("term") <= LISTED - distance) & F.lit(distance <= 2)
    pairs = []
    if distance <= 2:
        kept = lambda df, c: df.select(c, F.explode(T.deletions(c, distance)).alias("v"))
        pairs.append(kept(w.where(few), "term").join(kept(v.where(F.length("near") <= LISTED), "near"), "v").select("term", "near").distinct())
    parted = F.length("term") > distance
    parts = w.where(~few & parted).select("term", F.explode(T.parts("term", distance + 1)).alias("p")).select("term", "p.part", "p.place")
    parts = parts.select("term", "part", F.explode(F.sequence(F.greatest(F.col("place") - distance, F.lit(1)), F.col("place") + distance)).alias("place"))
    sizes = parts.select(F.length("part").alias("size")).distinct()
    places = F.sequence(F.lit(1), F.length("near") - F.col("size") + 1)
    grams = v.crossJoin(F.broadcast(sizes)).where(F.length("near") >= F.col("size")).select("near", "size", F.explode(places).alias("place")).select("near", "place", F.expr("substring(near, place, size)").alias("part"))
    pairs.append(parts.join(grams, ["part", "place"]).select("term", "near").distinct())
    short = w.where(~few & ~parted).select("term", F.explode(near_length).alias("n"))
    pairs.append(short.join(v.select("near", F.length("near").alias("n")), "n").select("term", "near"))
    every = pairs[0]
    for p in pairs[1:]:
        every = every.unionByName(p)
    d = F.levenshtein("term", "near", distance)
    return every.withColumn("distance", d).where(F.col("distance") >= 1)


def typo_tolerant(terms: DataFrame, vocab: DataFrame, frags: DataFrame, distance: int = 2) -> DataFrame:
    """60 over the distance for each near vocabulary term, for documents that hold it as a fragment."""
    mine = terms.select("query_id", "term").distinct().where(F.length("term") >= 2)
    near = mine.join(near_terms(mine, vocab, distance), "term").groupBy("query_id", F.col("near").alias("fragment")).agg(F.sum(60 / F.col("distance")).alias("s"))
    return by_document(near, frags, "fragment").groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"))


def candidate_keys(terms: DataFrame, vocab: DataFrame, kinds: tuple[str, ...] = ("coverage", "sound", "typo"), distance: int = 2) -> DataFrame:
    """``(term, key, w)`` of the distinct terms: what a document that has the key, a fragment or a sound code, gets for the term. The weights of ``coverage``, ``sound_alike`` and ``typo_tolerant``."""
    own = terms.select("term").distinct()
    every = []
    if "coverage" in kinds:
        parts = own.select("term", F.explode(T.edge_ngrams("term")).alias("key"))
        every.append(parts.withColumn("w", F.octet_length("key") / F.octet_length("term") * 100))
    if "sound" in kinds:
        every.append(own.select("term", T.soundex("term").alias("key"), F.lit(0.3).alias("w")).where("key <> ''"))
    if "typo" in kinds:
        near = near_terms(own.where(F.length("term") >= 2), vocab, distance)
        every.append(near.select("term", F.col("near").alias("key"), (60 / F.col("distance")).alias("w")))
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return out.groupBy("term", "key").agg(F.sum("w").alias("w"))


def lexical_candidates(terms: DataFrame, vocab: DataFrame, frags: DataFrame, codes: DataFrame, distance: int = 2) -> DataFrame:
    """``(query_id, doc_id, coverage)``: the three kinds of match added up."""
    every = coverage(terms, frags).unionByName(sound_alike(terms, codes)).unionByName(typo_tolerant(terms, vocab, frags, distance))
    return every.groupBy("query_id", "doc_id").agg(F.sum("score").alias("coverage"))


def resolve(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(term, resolved)``: a known term itself, else the first known term it begins, else itself.

    A join on prefixes: the vocabulary is expanded to its prefixes of the lengths that are asked for.
    """
    w = terms.select("term").distinct()
    open_ = w.join(vocab.select("term"), "term", "left_anti")
    lengths = open_.select(F.length("term").alias("n")).distinct()
    begun = vocab.select(F.col("term").alias("full")).join(lengths, F.length("full") > F.col("n")).select("full", F.expr("substring(full, 1, n)").alias("term"))
    first = open_.join(begun, "term").groupBy("term").agg(F.min("full").alias("full"))
    return w.join(first, "term", "left").select("term", F.coalesce("full", "term").alias("resolved"))


def blend(kw: DataFrame, vec: DataFrame, k: int = 10) -> DataFrame:
    """0.6 and 0.4 of the two scores over their query's largest; above 0 only."""
    both = kw.withColumnRenamed("score", "kw").join(vec.withColumnRenamed("score", "vec"), ["query_id", "doc_id"], "full")
    most = both.groupBy("query_id").agg(F.max("kw").alias("mk"), F.max("vec").alias("mv"))
    part = lambda c, m, w: F.coalesce(F.when(F.col(m) > 0, w * F.col(c) / F.col(m)), F.lit(0.0))
    scored = both.join(most, "query_id").select("query_id", "doc_id", F.round(part("kw", "mk", 0.6) + part("vec", "mv", 0.4), 6).alias("score")).where("score > 0")
    return top(scored, k)


def rrf(kw: DataFrame, vec: DataFrame, k: float = 20.0, w_kw: float = 1.0, w_vec: float = 2.0, n: int = 10, depth: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of two lists ``(query_id, doc_id, score)``.

    Ranks are sequential: the first list by score, then the second's score, then id; the second by
    score, then id. Scores that agree to 9 digits are equal. ``depth`` cuts both lists before fusing.
    """
    kw = kw.join(vec.withColumnRenamed("score", "v"), ["query_id", "doc_id"], "left")
    a = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.round(F.coalesce("v", F.lit(0.0)), 9).desc(), "doc_id")
    b = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    first = kw.select("query_id", "doc_id", F.row_number().over(a).alias("ra"))
    second = vec.select("query_id", "doc_id", F.row_number().over(b).alias("rb"))
    if depth is not None:
        first, second = first.where(F.col("ra") <= depth), second.where(F.col("rb") <= depth)
    return fused_places(first.join(second, ["query_id", "doc_id"], "full"), k, w_kw, w_vec, n)


def fused_places(places: DataFrame, k: float = 20.0, w_kw: float = 1.0, w_vec: float = 2.0, n: int = 10) -> DataFrame:
    """The best ``n`` of ``(query_id, doc_id, ra, rb)`` by places in two lists, null where a document is in one only."""
    term = lambda r, w: F.coalesce(w / (k + F.col(r)), F.lit(0.0))
    scored = places.select("query_id", "doc_id", F.round(term("ra", w_kw) + term("rb", w_vec), 9).alias("score"))
    return top(scored, n)


def fusion_depth(n: int = 10, k: float = 20.0, w_kw: float = 1.0, w_vec: float = 2.0) -> int | None:
    """How many places of the second list can matter for the first ``n`` of ``rrf``; None if all can.

    The first ``n`` of the second list have ``w_vec / (k + n)`` each. A document further down needs
    the rest from the first list, which gives at most ``w_kw / (k + 1)``. What is beyond the depth
    can neither reach the first ``n`` nor, having the smaller score, come before one of them in a tie of the first list.
    """
    short = w_vec / (k + n) - w_kw / (k + 1)
    return max(n, math.ceil(w_vec / short - k)) + 1 if short > 1e-9 else None


def hybrid_keys(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """List key of lexical candidates: 1 + BM25 where there is one, else coverage times 1e-9; coverage above 0 only."""
    rows = candidates.where("coverage > 0").join(scores, ["query_id", "doc_id"], "left")
    return rows.select("query_id", "doc_id", F.when(F.col("score").isNotNull(), 1 + F.col("score")).otherwise(F.col("coverage") * 1e-9).alias("score"))


def lexical_ranking(candidates: DataFrame, scores: DataFrame, k: float = 20.0, n: int = 10) -> DataFrame:
    """Lexical-only results: candidates by BM25 (0 where none), then id, with the fused score of a single list."""
    rows = candidates.join(scores, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("bm25"))
    return top(rows, n, "bm25").select("query_id", "doc_id", "rank", F.round(1 / (k + F.col("rank")), 9).alias("score"))


def normalised(results: DataFrame) -> DataFrame:
    """Scores over the best of their query."""
    by = Window.partitionBy("query_id")
    return results.withColumn("score", T.normalised_score("score", F.max("score").over(by)))


def collapse(chunks: DataFrame, limit: int = 10) -> DataFrame:
    """Chunk hits ``(query_id, chunk_id, score, rank)`` to documents: the best score, the chunks in rank order."""
    rows = chunks.select("query_id", "score", "rank", T.parsed_chunk_id("chunk_id").alias("p"))
    grouped = rows.groupBy("query_id", F.col("p.orig_id").alias("doc_id")).agg(F.max("score").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "p.page", "p.idx"))), lambda c: F.struct(c["page"].alias("page"), c["idx"].alias("idx"))).alias("chunks"))
    return top(grouped, limit)


def neural_expansion(terms: DataFrame, neighbours: DataFrame, frags: DataFrame) -> DataFrame:
    """For queries without results: 20000 for each (neighbour, document) that holds the neighbour or its first three letters."""
    near = terms.select("query_id", "term").distinct().join(neighbours, "term").select("query_id", "near").distinct()
    want = near.select("query_id", "near", F.explode(F.when(F.length("near") > 3, F.array(F.col("near"), F.substring("near", 1, 3))).otherwise(F.array("near"))).alias("fragment"))
    hits = want.join(frags, "fragment").select("query_id", "near", "doc_id").distinct()
    return hits.groupBy("query_id", "doc_id").agg((F.count(F.lit(1)) * F.lit(20000.0)).alias("coverage"))
