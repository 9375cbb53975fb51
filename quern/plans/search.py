"""The search index facade: add, delete and search over a stored journal and stored index tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import stem_terms
from ..functions.vectors import embedded, seeded_embedder
from ..operators import index as X
from ..operators import scan as B
from ..operators import search as S
from ..operators.changefeed import BucketedTable
from ..operators.vectors import scan_top
from ..session import scratch, written
from ..sources.fs import SharedFiles

#: Version of the layout below an index's root, and segments that are merged into one.
FORMAT, MERGED = 1, 8
#: Index tables; all rows carry the document and the version of it that they are made of.
TABLES = {
    "lengths": "doc_id string, seq long, dl long",
    "tf": "doc_id string, seq long, dl long, term string, tf long",
    "frags": "doc_id string, seq long, fragment string",
    "codes": "doc_id string, seq long, code string",
    "vectors": "doc_id string, seq long, vector array<float>",
}
VOCAB = "term string, df long, occurrences long"


class SearchError(Exception):
    """A document or option that is not allowed, or an index that is closed or locked."""


class IncompatibleIndex(SearchError):
    """The stored index has another format version."""


class SearchIndex:
    """Documents in a bucketed table, and index tables in segments that are derived from it.

    ``embedder`` is an Arrow UDF of text to vector; without one the search is lexical only.

    Each batch is a version of the document table, numbered by its commit, so batches of several
    writers neither clash nor get lost. On first use after a change, the documents of the versions that
    the segments lack are analysed and embedded into a new segment; nothing else is. Rows of
    documents that were replaced or deleted are listed as dead, and the vocabulary's counts are stored
    as differences, so neither is recomputed. ``MERGED`` segments are rewritten as one. Segments
    are listed in a manifest of their own: a reopened index reads, it does not rebuild.

    With ``exclusive`` the index is locked until ``close``; a second exclusive opening is refused.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, embedder=None, lexical_only: bool = False, fuzzy_distance: int = 2, limit: int = 10, fusion_top: int = 10, dims: int | None = None, exclusive: bool = False):
        if not 0 <= fuzzy_distance or limit < 1:
            raise SearchError("fuzzy_distance and limit")
        self.spark, self.root = spark, (root or scratch(spark, "index")).rstrip("/")
        self.embedder = None if lexical_only else embedder or seeded_embedder()
        self.fuzzy, self.limit, self.fusion_top, self.dims = min(fuzzy_distance, 5), limit, fusion_top, dims
        self.docs, self.files = BucketedTable(spark, self.root), SharedFiles(spark, self.root)
        self.open, self.locked = True, False
        self._manifest()
        if exclusive:
            if not self.files.create_json("lock.json", {"owner": uuid.uuid4().hex}):
                raise SearchError("locked")
            self.locked = True

    def _usable(self) -> None:
        if not self.open:
            raise SearchError("closed")

    def close(self) -> None:
        if self.locked:
            self.files.delete("lock.json")
        self.open = self.locked = False

    # --- writing -------------------------------------------------------------------------------

    def add(self, doc_id: str, text: str, vector: list[float] | None = None) -> None:
        self.add_batch(self.spark.createDataFrame([(doc_id, text, vector)], "id string, text string, vector array<float>"))

    def add_batch(self, docs: DataFrame) -> int:
        """Upsert ``(id, text)``, or ``(id, text, vector)`` where some vectors are given; the whole batch is checked before anything is written.

        Of an id that comes repeatedly one row counts: the one with the largest text.
        """
        self._usable()
        given = F.col("vector").cast("array<float>") if "vector" in docs.columns else F.lit(None).cast("array<float>")
        rows = docs.select(F.col("id").cast("string").alias("id"), T.sanitised("text").alias("text"), given.alias("vector"))
        wrong = F.lit(False) if self.dims is None else F.coalesce(F.size("vector") != self.dims, F.lit(False)) & F.col("vector").isNotNull()
        bad = rows.where(~T.valid_id("id") | ~T.valid_text("text") | wrong).limit(1).collect()
        if bad:
            raise SearchError(f"not allowed: {bad[0].id!r}")
        return self._put(rows)

    def add_pages(self, pages: DataFrame) -> int:
        """Upsert pages ``(document_id, page, text)`` in overlapping word chunks; blank pages give none. Hits come back under the document."""
        self._usable()
        chunks = pages.select("document_id", "page", F.posexplode(T.word_chunks(T.sanitised("text"))).alias("index", "text"))
        return self._put(chunks.select(T.chunk_id("document_id", F.col("page"), F.col("index")).alias("id"), "text", F.lit(None).cast("array<float>").alias("vector")))

    def _put(self, rows: DataFrame) -> int:
        batch = uuid.uuid4().hex
        one = rows.groupBy("id").agg(F.max(F.struct("text", "vector")).alias("b")).select("id", "b.text", "b.vector")
        given = one.where("vector is not null").select(F.col("id").alias("doc_id"), "vector")
        if "vector" in rows.columns and not given.isEmpty():
            given.write.parquet(f"{self.root}/given/{batch}")
        put = one.select(F.lit("put").alias("op"), F.col("id").alias("key"), F.col("text").alias("value"))
        return self.docs.apply(put, batch, stamped=True)

    def delete(self, ids: list[str] | DataFrame) -> int:
        """Delete by id; chunks of a document go with it, ids that are not there are ignored."""
        self._usable()
        gone = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        gone, live = gone.select(F.col("id").alias("gone")).distinct(), self.docs.live().select("key")
        chunks = live.join(gone, F.split("key", r"\|\|")[0] == F.col("gone"), "left_semi")
        keys = chunks.unionByName(live.join(gone, F.col("key") == F.col("gone"), "left_semi")).distinct()
        return self.docs.apply(keys.select(F.lit("delete").alias("op"), "key", F.lit(None).cast("string").alias("value")), stamped=True)

    # --- index tables ----------------------------------------------------------------------------

    def _manifest(self) -> dict:
        """The newest list of segments; ``upto`` is the version of the documents that it covers."""
        have = [n for n in self.files.names("segments-log") if n.endswith(".json")]
        if not have:
            return {"format": FORMAT, "number": 0, "upto": 0, "segments": [], "n": 0, "total_len": 0, "vectors": self.embedder is not None}
        found = self.files.read_json(f"segments-log/{have[-1]}")
        if found.get("format") != FORMAT:
            raise IncompatibleIndex(f"index format {found.get('format')}, not {FORMAT}")
        return found

    def _stored(self, segments: list[str], name: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/segments/{s}/{name}" for s in segments if self.files.exists(f"segments/{s}/{name}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _current(self, m: dict, name: str) -> DataFrame:
        """A table's rows of the documents as they are."""
        rows = self._stored(m["segments"], name, TABLES[name])
        dead = [s for s in m["segments"] if self.files.exists(f"segments/{s}/dead")]
        return rows.join(self._stored(dead, "dead", "doc_id string, seq long"), ["doc_id", "seq"], "left_anti") if dead else rows

    def _vocab(self, m: dict) -> DataFrame:
        rows = self._stored(m["segments"], "vocab", VOCAB)
        if len(m["segments"]) < 2:
            return rows
        return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences")).where("df > 0")

    def _given(self, since: int, upto: int) -> DataFrame | None:
        """Vectors that callers gave with the batches of these versions."""
        parts = []
        for v in [v for v in self.docs.versions() if since < v <= upto]:
            name = self.docs.manifest(v)["batches"][-1:]
            if name and self.files.exists(f"given/{name[0]}"):
                parts.append(self.spark.read.schema("doc_id string, vector array<float>").parquet(f"{self.root}/given/{name[0]}").withColumn("seq", F.lit(v).cast("long")))
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def _refreshed(self) -> dict:
        """The manifest, after a segment was added for what has changed since the last one."""
        while True:
            m, now = self._manifest(), self.docs.manifest()
            if now is None or now["version"] <= m["upto"]:
                if len(m["segments"]) <= MERGED:
                    return m
                made = self._merged(m)
            else:
                made = self._segment(m, now["version"])
            if self.files.create_json(f"segments-log/{made['number']:010d}.json", made):
                continue
            self.files.delete(f"segments/{made['segments'][-1]}")  # another writer was first

    def _segment(self, m: dict, upto: int) -> dict:
        """Analyse and embed the documents of the versions after ``m`` up to ``upto``."""
        name = f"{upto:010d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.root}/segments/{name}"
        keep = lambda df, table: (df.write.parquet(f"{at}/{table}"), self.spark.read.schema(df.schema).parquet(f"{at}/{table}"))[1]
        changed = written(self.docs.state(upto).where(F.col("seq") > m["upto"]), "changed")
        docs = changed.where("not deleted").select(F.col("key").alias("doc_id"), "seq", F.col("value").alias("text"))
        tf = X.stemmed_terms(X.term_freq(X.analysed(docs)))
        tf = written(tf.join(tf.groupBy("doc_id").agg(F.sum("tf").alias("dl")), "doc_id").join(docs.select("doc_id", "seq"), "doc_id"), "tf")
        tf = keep(tf.select("doc_id", "seq", "dl", "term", "tf"), "tf")
        lengths = docs.select("doc_id", "seq").join(tf.select("doc_id", "dl").distinct(), "doc_id", "left").select("doc_id", "seq", F.coalesce("dl", F.lit(0).cast("long")).alias("dl"))
        lengths = keep(lengths, "lengths")
        keep(tf.select("doc_id", "seq", F.explode(T.edge_ngrams("term")).alias("fragment")).distinct(), "frags")
        keep(tf.select("doc_id", "seq", T.soundex("term").alias("code")).where("code <> ''").distinct(), "codes")
        if self.embedder is not None:
            given = self._given(m["upto"], upto)
            made = docs if given is None else docs.join(given, ["doc_id", "seq"], "left_anti")
            made = embedded(made, "text", self.embedder).select("doc_id", "seq", "vector")
            if given is not None:
                made = made.unionByName(given.join(docs.select("doc_id", "seq"), ["doc_id", "seq"], "left_semi").select("doc_id", "seq", "vector"))
            keep(made, "vectors")
        delta = X.vocabulary(tf)
        size = lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("l")).first()
        n, total = m["n"] + size.n, m["total_len"] + size.l
        if m["segments"]:
            dead = self._current(m, "lengths").join(changed.select(F.col("key").alias("doc_id")), "doc_id", "left_semi")
            dead = keep(dead.select("doc_id", "seq", "dl"), "dead")
            lost = dead.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("l")).first()
            n, total = n - lost.n, total - lost.l
            if lost.n:
                old = X.vocabulary(self._current(m, "tf").join(dead.select("doc_id", "seq"), ["doc_id", "seq"], "left_semi"))
                delta = delta.unionByName(old.select("term", (-F.col("df")).alias("df"), (-F.col("occurrences")).alias("occurrences")))
                delta = delta.groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences")).where("df <> 0 or occurrences <> 0")
            else:
                self.files.delete(f"segments/{name}/dead")
        keep(delta.select("term", "df", "occurrences"), "vocab")
        return m | {"number": m["number"] + 1, "upto": upto, "segments": [*m["segments"], name], "n": n, "total_len": total}

    def _merged(self, m: dict) -> dict:
        """All segments as one: rows are copied, nothing is analysed or embedded."""
        name = f"{m['upto']:010d}-{uuid.uuid4().hex[:8]}"
        for table in TABLES:
            if table != "vectors" or self.embedder is not None:
                self._current(m, table).write.parquet(f"{self.root}/segments/{name}/{table}")
        self._vocab(m).write.parquet(f"{self.root}/segments/{name}/vocab")
        return m | {"number": m["number"] + 1, "segments": [name]}

    def vacuum(self) -> int:
        """Bring the segments up to date, then delete the files of former versions and of merged segments; returns how many data files and segments went.

        Not to be run while another writer is at work.
        """
        m = self._refreshed()
        gone = [s for s in self.files.names("segments") if s not in m["segments"]]
        for s in gone:
            self.files.delete(f"segments/{s}")
        self.files.delete("given")  # all of it is in the segments now
        return len(gone) + self.docs.vacuum()

    # --- reading -------------------------------------------------------------------------------

    def tables(self) -> dict[str, DataFrame]:
        """The index tables of the documents as they are, and ``stats``."""
        m = self._refreshed()
        t = {name: self._current(m, name).drop("seq") for name in TABLES}
        return t | {"vocab": self._vocab(m), "stats": self.spark.createDataFrame([(m["n"], m["total_len"])], "n long, total_len long")}

    def query_tokens(self, queries: DataFrame, vocab: DataFrame, synonyms: bool = True) -> DataFrame:
        """``(query_id, pos, term, kind, cnt)``: analysed, stemmed, resolved against the vocabulary, widened by synonyms, without repeats; kind is word or synonym."""
        toks = X.token_positions(X.analysed(queries.select("query_id", "text"), "query_id"), "query_id")
        stems = toks.select("term").distinct().select("term", stem_terms("term").alias("stem")).where("stem <> ''")
        known = S.resolve(stems.select(F.col("stem").alias("term")), vocab)
        rows = toks.join(stems, "term").join(known.withColumnRenamed("term", "stem"), "stem")
        lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "resolved"))).alias("l"))
        wide = T.synonyms_of(F.col("l.resolved")) if synonyms else F.array_distinct("l.resolved")
        tagged = lists.select("query_id", F.col("l.resolved").alias("words"), F.posexplode(wide).alias("pos", "term"))
        return tagged.select("query_id", "pos", "term", F.when(F.array_contains("words", F.col("term")), "word").otherwise("synonym").alias("kind"), F.lit(1).alias("cnt"))

    def search(self, queries: str | DataFrame, limit: int | None = None, synonyms: bool = True) -> DataFrame:
        """``(query_id, id, score, rank, chunks)`` for one text or for ``(query_id, text)``; scores are relative to the query's best."""
        self._usable()
        t = self.tables()
        if isinstance(queries, str):
            queries = self.spark.createDataFrame([(0, queries)], "query_id long, text string")
        terms = written(self.query_tokens(queries, t["vocab"], synonyms), "terms")
        docs = t["tf"].groupBy("doc_id").agg(F.first("dl").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("l"))
        keys = written(S.candidate_keys(terms, t["vocab"], distance=self.fuzzy), "keys")
        coded = B.coded(docs.select("doc_id", "dl", F.col("l.term").alias("toks"), F.col("l.tf").alias("tfs")), terms.select("term"), keys.select("key"))
        bm25 = B.Weighted(S.bm25_weights(terms, t["vocab"], t["stats"]), B.bm25_impact(*t["stats"].first(), S.K1, S.B))
        if self.embedder is None:
            ranked = B.lexical_only(coded, bm25, B.Keyed(terms, keys), n=self.fusion_top, digits=9)
        else:
            ranked = B.fused(coded, [bm25, B.Keyed(terms, keys)], self._vectors(queries, t), B.keyed_exactly, 9, n=self.fusion_top)
        ranked = self._widened(written(ranked, "ranked"), queries, terms, t)
        hits = S.normalised(ranked).select("query_id", F.col("doc_id").alias("chunk_id"), "score", "rank")
        return S.collapse(hits, limit or self.limit).select("query_id", F.col("doc_id").alias("id"), "score", "rank", "chunks")

    def _vectors(self, queries: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
        """Dot products above 0, as far down as fusion can need them."""
        q = embedded(queries.select("query_id", "text"), "text", self.embedder).select("query_id", "vector")
        near = scan_top(q, t["vectors"].select(F.col("doc_id").alias("vec_id"), "vector"), S.fusion_depth(self.fusion_top), least=0.0)
        return near.select("query_id", F.col("vec_id").alias("doc_id"), "score")

    def _word_vectors(self, vocab: DataFrame) -> DataFrame:
        """``(term, vector)`` of the vocabulary; those that an earlier search embedded are read, the others added."""
        names = self.files.names("words")
        have = self.spark.read.schema("term string, vector array<float>").parquet(*[f"{self.root}/words/{n}" for n in names]) if names else None
        new = vocab.select("term") if have is None else vocab.select("term").join(have.select("term"), "term", "left_anti")
        if have is None or not new.isEmpty():
            path = f"{self.root}/words/{uuid.uuid4().hex}"
            embedded(new, "term", self.embedder).select("term", "vector").write.parquet(path)
            more = self.spark.read.schema("term string, vector array<float>").parquet(path)
            have = more if have is None else have.unionByName(more)
        return have.dropDuplicates(["term"]).join(vocab.select("term"), "term", "left_semi")

    def _widened(self, ranked: DataFrame, queries: DataFrame, terms: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
        """For queries without any result: documents of the vocabulary terms whose vectors are near the query's terms."""
        empty = queries.select("query_id").join(ranked, "query_id", "left_anti")
        if self.embedder is None or empty.isEmpty():
            return ranked
        left = terms.join(empty, "query_id", "left_semi")
        words = self._word_vectors(t["vocab"])
        asked = embedded(left.select("term").distinct(), "term", self.embedder).select(F.xxhash64("term").alias("query_id"), F.col("term").alias("asked"), "vector")
        near = scan_top(asked.select("query_id", "vector"), words.select(F.col("term").alias("vec_id"), "vector"), 6, least=0.0).where("score >= 0.70")
        pairs = near.join(asked.select("query_id", "asked"), "query_id").where("asked <> vec_id").select(F.col("asked").alias("term"), F.col("vec_id").alias("near"))
        more = S.neural_expansion(left, pairs, t["frags"]).withColumnRenamed("coverage", "score")
        return ranked.unionByName(S.top(more, self.fusion_top).select(*ranked.columns))
