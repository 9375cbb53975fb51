"""Queries of retrieval, vectors, fusion and quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..functions.embedders import wordpiece_ids
from ..functions.wordlists import STOP_WORDS, SYNONYMS
from ..operators import evaluate as E
from ..operators import index as X
from ..operators import scan as B
from ..operators import search as S
from ..operators.vectors import scan_top
from ..session import spread, table, written
from .search import SearchIndex
from .text_queries import CODE, EDGES, TOK, docs_of, query_terms_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


class Tables:
    """Index tables of the documents without stemming, and the terms of all search queries."""

    def __init__(self, spark: SparkSession, d: str):
        self.tf = written(X.postings(docs_of(spark, d)), "tf")  # the texts are read and analysed once
        self.vocab = written(X.vocabulary(self.tf), "vocab")
        n = table(spark, d, "documents").where("doc_id is not null").agg(F.count(F.lit(1)).alias("n"))
        self.stats = n.crossJoin(self.tf.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total_len")))
        self.terms = query_terms_of(spark, d)

    def bm25(self, k1: float = S.K1, b: float = S.B) -> DataFrame:
        return S.bm25(self.terms, self.tf, self.vocab, None, self.stats, k1, b)

    def rounded(self) -> DataFrame:
        return self.bm25().withColumn("score", F.round("score", 6))

    def best(self, k: int, k1: float = S.K1, b: float = S.B) -> DataFrame:
        """The best ``k`` by BM25, rounded as ``rounded``."""
        return S.best_scored(S.bm25_weights(self.terms, self.vocab, self.stats), self.tf, S.bm25_impact(k1, b), k)

    def candidates(self) -> DataFrame:
        return S.lexical_candidates(self.terms, self.vocab, X.fragments(self.tf), X.phonetic(self.tf))


class Blocks:
    """What scoring by blocks needs: the documents' terms, statistics and the terms of all search queries. No postings are formed."""

    def __init__(self, spark: SparkSession, d: str, terms: DataFrame | None = None):
        self.toks = written(docs_of(spark, d), "toks")
        self.vocab = written(self.toks.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "vocab")
        self.n, self.total = self.toks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("toks")), F.lit(0))).first()
        self.stats = spark.createDataFrame([(self.n, self.total)], "n long, total_len long")
        self.terms = written(query_terms_of(spark, d) if terms is None else terms, "terms")

    def coded(self, keys: DataFrame | None = None, terms: bool = True) -> B.Coded:
        return B.coded(self.toks, self.terms.select("term") if terms else None, keys)

    def bm25(self, k1: float = S.K1, b: float = S.B, terms: DataFrame | None = None) -> B.Weighted:
        return B.Weighted(S.bm25_weights(self.terms if terms is None else terms, self.vocab, self.stats), B.bm25_impact(self.n, self.total, k1, b))

    def keys(self, *kinds: str) -> DataFrame:
        """What documents get for keys that they have; all kinds of them unless named."""
        return written(S.candidate_keys(self.terms, self.vocab, kinds or ("coverage", "sound", "typo")), "keys")

    def matches(self, *kinds: str) -> DataFrame:
        """All pairs of query and document that match, rounded to 4 digits."""
        keys = self.keys(*kinds)
        return B.scan(self.coded(keys.select("key"), terms=False), [B.Keyed(self.terms, keys)], B.All(4))

    def ranks(self, pairs: DataFrame) -> DataFrame:
        return B.ranks(self.coded(), self.bm25(), pairs)


_BM = """, bm AS (SELECT query_id, doc_id, round(sum(cnt * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * {k} / (tf + {k1} * (1 - {b} + {b} * dl / (total_len / n)))), 6) AS score
 FROM qt JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), n GROUP BY ALL HAVING score > 0)"""
BM = _BM.format(k="2.2e0", k1="1.2e0", b="0.75e0")


def _top(source: str, k: int, columns: str = "query_id, doc_id, score, rank", score: str = "score") -> str:
    return f" SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, doc_id)::INT AS rank FROM {source}) WHERE rank <= {k}"


@query(TOK + BM + _top("bm", 10))
def bm25_search(spark, d):
    return Tables(spark, d).best(10)


_GRID = [(0.9, 0.4), (1.2, 0.75), (1.6, 0.9)]


@query(TOK + "".join(_BM.format(k=f"{k1 + 1}e0", k1=f"{k1}e0", b=f"{b}e0").replace("bm AS", f"bm{i} AS") + f", t{i} AS ({_top(f'bm{i}', 10)})" for i, (k1, b) in enumerate(_GRID))
    + " UNION ALL ".join(f" SELECT {k1}::DOUBLE AS k1, {b}::DOUBLE AS b, query_id, doc_id, score FROM t{i}" for i, (k1, b) in enumerate(_GRID)))
def bm25_param_grid(spark, d):
    t = Blocks(spark, d)
    coded = t.coded()
    parts = [B.best(coded, [t.bm25(k1, b)], 10).select(F.lit(k1).alias("k1"), F.lit(b).alias("b"), "query_id", "doc_id", "score") for k1, b in _GRID]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(TOK + ", s AS (SELECT query_id, doc_id, round(sum(cnt * tf / dl * ln(n / df)), 6) AS score FROM qt JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), n GROUP BY ALL HAVING score > 0)" + _top("s", 10))
def tfidf_search(spark, d):
    t = Tables(spark, d)
    return S.best_scored(S.tfidf_weights(t.terms, t.vocab, t.stats), t.tf, F.col("tf") / F.col("dl"), 10)


FR = f""", frag AS (SELECT DISTINCT doc_id, fragment FROM (SELECT doc_id, {EDGES} AS f FROM tf), unnest(f) AS u(fragment)),
qd AS (SELECT DISTINCT query_id, term FROM qt),
cov AS (SELECT query_id, doc_id, sum(length(fragment) / length(term) * 100) AS s FROM (SELECT query_id, term, unnest({EDGES}) AS fragment FROM qd) JOIN frag USING (fragment) GROUP BY ALL),
codes AS (SELECT DISTINCT code, doc_id FROM (SELECT doc_id, {CODE} AS code FROM tf) WHERE code <> ''),
pho AS (SELECT query_id, doc_id, count(*) * 0.3e0 AS s FROM (SELECT query_id, {CODE} AS code FROM qd) JOIN codes USING (code) GROUP BY ALL),
near AS (SELECT w.term, v.term AS fragment, levenshtein(w.term, v.term) AS distance FROM (SELECT DISTINCT term FROM qd) w JOIN df v ON abs(length(w.term) - length(v.term)) <= 2 AND levenshtein(w.term, v.term) BETWEEN 1 AND 2),
fuz AS (SELECT query_id, doc_id, sum(60 / distance) AS s FROM qd JOIN near USING (term) JOIN frag USING (fragment) WHERE length(term) >= 2 GROUP BY ALL),
cand AS (SELECT query_id, doc_id, sum(s) AS coverage FROM (FROM cov UNION ALL FROM pho UNION ALL FROM fuz) GROUP BY ALL)
"""


@query(TOK + FR + "SELECT query_id, doc_id, round(s, 4) AS score FROM cov")
def coverage_score(spark, d):
    return Blocks(spark, d).matches("coverage")


@query(TOK + FR + "SELECT query_id, doc_id, round(s, 4) AS score FROM pho")
def phonetic_score(spark, d):
    return Blocks(spark, d).matches("sound")


@query(TOK + FR + "SELECT query_id, doc_id, round(s, 4) AS score FROM fuz")
def fuzzy_score(spark, d):
    return Blocks(spark, d).matches("typo")


@query(TOK + FR + "SELECT query_id, doc_id, round(coverage, 4) AS coverage FROM cand")
def lexical_candidates(spark, d):
    return Blocks(spark, d).matches("coverage", "sound", "typo").withColumnRenamed("score", "coverage")


@query(TOK + BM + FR + ", k AS (SELECT query_id, doc_id, coalesce(score, 0) AS bm25 FROM cand LEFT JOIN bm USING (query_id, doc_id)), r AS (" + _top("k", 10, "query_id, doc_id, rank", "bm25") + ") SELECT *, round(1e0 / (20 + rank), 9) AS score FROM r")
def lexical_only_search(spark, d):
    t = Blocks(spark, d)
    keys = t.keys()
    return B.lexical_only(t.coded(keys.select("key")), t.bm25(), B.Keyed(t.terms, keys))


def _vectors(spark, d, every: int = 100):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return e.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector"), e


def _pairs(expr: str, least: str = "true", order: str = "score DESC", k: int = 10) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round({expr}, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, vec_id)::INT AS rank FROM s WHERE {least}) WHERE rank <= {k}"""


_A, _B = "q.embedding::DOUBLE[]", "v.embedding::DOUBLE[]"


@query(_pairs(f"list_dot_product({_A}, {_B})", "score > 0"))
def vector_dot_topk(spark, d):
    return scan_top(*_vectors(spark, d), least=0.0)


@query(_pairs(f"list_cosine_similarity({_A}, {_B})"))
def cosine_topk(spark, d):
    return scan_top(*_vectors(spark, d), metric="cosine")


@query(_pairs(f"list_distance({_A}, {_B})", order="score"))
def l2_topk(spark, d):
    return scan_top(*_vectors(spark, d), metric="l2")


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.magnitude("embedding"), 6).alias("norm"))


@query(_pairs(f"list_dot_product({_A}, {_B})", "score >= 0.30 AND query_id <> vec_id", k=5))
def neighbours_threshold(spark, d):
    near = scan_top(*_vectors(spark, d), k=6, least=0.0).where("query_id <> vec_id and score >= 0.30")
    return S.top(near.select("query_id", F.col("vec_id").alias("doc_id"), "score"), 5).withColumnRenamed("doc_id", "vec_id")


_STEP = "pow(2, greatest(floor(log2(abs(x))), -14) - 10)"  # of half precision at x


@query(f"SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: (CASE WHEN x = 0 THEN 0 ELSE round_even(x / {_STEP}, 0) * {_STEP} END)::FLOAT) AS embedding FROM embeddings")
def fp16_roundtrip(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.half_precision("embedding").alias("embedding"))


@query()
def deterministic_embed(spark, d):
    return table(spark, d, "documents").select("doc_id", V.seeded_embedder(64)("text").alias("vector"))


def _semantic(spark, d, depth: int | None = None) -> DataFrame:
    """The second list: the vector whose id is the query's against the vectors whose ids are documents'; all with a dot product above 0, or the best ``depth``."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    q = e.join(table(spark, d, "search_queries").select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "query_id")
    v = e.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return scan_top(q, v, depth, least=0.0).select("query_id", F.col("vec_id").alias("doc_id"), "score")


SEM = f""", sem AS (SELECT query_id, doc_id, score FROM (
 SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_dot_product({_A}, {_B}), 6) AS score FROM embeddings q JOIN embeddings v ON true
 WHERE q.vec_id IN (SELECT query_id FROM search_queries) AND v.vec_id IN (SELECT doc_id FROM documents)) WHERE score > 0)"""


def _fused(kw: str, k: float, w: float, n: int, depth: int | None = None) -> str:
    cut = f" WHERE r <= {depth}" if depth else ""
    return f"""SELECT query_id, doc_id, round(coalesce(1e0 / ({k}e0 + a.r), 0) + coalesce({w}e0 / ({k}e0 + b.r), 0), 9) AS score FROM
 (FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(x.score, 9) DESC, coalesce(sem.score, 0) DESC, doc_id) AS r FROM {kw} x LEFT JOIN sem USING (query_id, doc_id)){cut}) a
 FULL JOIN (FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM sem){cut}) b USING (query_id, doc_id)"""


@query(TOK + BM + SEM + ", f AS (" + _fused("bm", 20, 2, 10) + ")" + _top("f", 10))
def rrf_fuse(spark, d):
    t = Blocks(spark, d)
    return B.fused(t.coded(), [t.bm25()], _semantic(spark, d, S.fusion_depth()))


_RRF_GRID = [(10, 1.0), (20, 2.0), (60, 1.0)]


@query(TOK + BM + SEM + "".join(f", f{i} AS ({_fused('bm', k, w, 10, 500)}), t{i} AS ({_top(f'f{i}', 10)})" for i, (k, w) in enumerate(_RRF_GRID))
    + " UNION ALL ".join(f" SELECT {k} AS k, {w}::DOUBLE AS w_vec, query_id, doc_id, score FROM t{i}" for i, (k, w) in enumerate(_RRF_GRID)))
def rrf_grid(spark, d):
    t = Blocks(spark, d)
    places = written(B.places(t.coded(), [t.bm25()], _semantic(spark, d), 500), "places")
    parts = [S.fused_places(places, float(k), 1.0, w).select(F.lit(k).alias("k"), F.lit(w).alias("w_vec"), "query_id", "doc_id", "score") for k, w in _RRF_GRID]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(TOK + BM + FR + SEM + ", h AS (SELECT query_id, doc_id, CASE WHEN score IS NOT NULL THEN 1 + score ELSE round(coverage, 4) * 1e-9 END AS score FROM cand LEFT JOIN bm USING (query_id, doc_id) WHERE coverage > 0), f AS (" + _fused("h", 20, 2, 10) + ")" + _top("f", 10))
def hybrid_search(spark, d):
    t = Blocks(spark, d)
    keys = t.keys()
    return B.fused(t.coded(keys.select("key")), [t.bm25(), B.Keyed(t.terms, keys)], _semantic(spark, d, S.fusion_depth()), B.keyed, 9)


@query(TOK + BM + SEM + """, bb AS (SELECT query_id, doc_id, bm.score AS kw, sem.score AS vec FROM bm FULL JOIN sem USING (query_id, doc_id)),
m AS (SELECT query_id, max(kw) AS mk, max(vec) AS mv FROM bb GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(coalesce(CASE WHEN mk > 0 THEN 0.6e0 * kw / mk END, 0) + coalesce(CASE WHEN mv > 0 THEN 0.4e0 * vec / mv END, 0), 6) AS score FROM bb JOIN m USING (query_id) WHERE score > 0)""" + _top("s", 10))
def blend_score(spark, d):
    t = Blocks(spark, d)
    return B.blended(t.coded(), t.bm25(), _semantic(spark, d))


@query()
def neural_expansion(spark, d):
    """Documents reached through near vocabulary terms, for every query term; near is by the stand-in embedder."""
    t = Blocks(spark, d)
    embed = V.seeded_embedder(64)
    words = t.vocab.select("term", F.xxhash64("term").alias("vec_id"), embed("term").alias("vector"))
    asked = t.terms.select("term").distinct().select("term", F.xxhash64("term").alias("query_id"), embed("term").alias("vector"))
    near = scan_top(asked.select("query_id", "vector"), words.select("vec_id", "vector"), 6, least=0.0).where("query_id <> vec_id")
    pairs = near.join(asked.select("query_id", "term"), "query_id").join(words.select("vec_id", F.col("term").alias("near")), "vec_id").select("term", "near")
    return B.best(*B.expansion(t.toks, t.terms, pairs), 10)


@query(TOK + BM + """, h AS (""" + _top("bm", 10) + """), c AS (SELECT query_id, (doc_id // 10)::VARCHAR AS doc_id, max(score) AS score, list((doc_id % 10)::INT ORDER BY rank) AS idx FROM h GROUP BY ALL)
SELECT query_id, doc_id, score, idx FROM c""")
def collapse_chunks(spark, d):
    hits = Tables(spark, d).best(10)
    chunks = hits.select("query_id", T.chunk_id(F.floor(F.col("doc_id") / 10), F.lit(1), (F.col("doc_id") % 10).cast("int")).alias("chunk_id"), "score", "rank")
    return S.collapse(chunks).select("query_id", "doc_id", "score", F.col("chunks.idx").alias("idx"))


def _judged(spark, d) -> DataFrame:
    """A stand-in for judgements: the document with the highest vec score of each judged query."""
    rows = table(spark, d, "score_lists").join(table(spark, d, "search_queries").where("judged").select("query_id"), "query_id", "left_semi").where("not isnan(vec) and vec is not null")
    return rows.groupBy("query_id").agg(F.max_by("doc_id", F.struct(F.col("vec"), -F.col("doc_id"))).alias("doc_id"))


JUDGED = ", rel AS (SELECT query_id, doc_id FROM score_lists WHERE query_id IN (SELECT query_id FROM search_queries WHERE judged) AND NOT isnan(vec) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY vec DESC, doc_id) = 1), r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm), j AS (SELECT query_id, min(rank) AS k FROM rel JOIN documents USING (doc_id) LEFT JOIN r USING (query_id, doc_id) GROUP BY ALL)"


def _recall_sql(cuts) -> str:
    return TOK + BM + JUDGED + "SELECT count(*) AS queries, " + ", ".join(f"coalesce(avg(CASE WHEN k <= {n} THEN 1e0 ELSE 0 END), 0) AS recall_{n}" for n in cuts) + " FROM j"


@query(_recall_sql((10,)))
def recall_at_10(spark, d):
    return E.recall(Tables(spark, d).best(10), _judged(spark, d), table(spark, d, "documents"))


@query(_recall_sql((10, 20, 50, 100)))
def recall_curve(spark, d):
    rel = written(_judged(spark, d), "judged")
    return E.recall(Blocks(spark, d).ranks(rel), rel, table(spark, d, "documents"), (10, 20, 50, 100))


@query(TOK + BM + JUDGED + "SELECT query_id, CASE WHEN k = 1 THEN 'PASS' WHEN k <= 100 THEN 'RANK ' || k ELSE 'MISS' END AS verdict FROM j")
def query_suite(spark, d):
    rel = _judged(spark, d).join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi")
    rel = written(rel, "judged")
    return E.verdicts(Blocks(spark, d).ranks(rel).where("rank <= 100"), rel)


@query(TOK + BM + JUDGED + ", s AS (SELECT query_id, bm.score AS s FROM rel JOIN bm USING (query_id, doc_id)) SELECT query_id, (1 + count(*) FILTER (WHERE bm.score > s.s))::BIGINT AS gt_rank FROM s JOIN bm USING (query_id) GROUP BY query_id")
def gt_rank(spark, d):
    return Blocks(spark, d).ranks(_judged(spark, d)).select("query_id", (1 + F.col("above")).alias("gt_rank"))


_LISTS = ", ".join(f"coalesce(avg(CASE WHEN {l} <= {n} THEN 1e0 ELSE 0 END), 0) AS {l}_{n}" for l in ("lexical", "dense") for n in (10, 20, 50, 100))


@query(TOK + BM + SEM + JUDGED + f""", rd AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sem),
w AS (SELECT rel.query_id, min(r.rank) AS lexical, min(rd.rank) AS dense FROM rel JOIN documents USING (doc_id) LEFT JOIN r USING (query_id, doc_id) LEFT JOIN rd USING (query_id, doc_id) GROUP BY ALL)
SELECT count(*) AS queries, {_LISTS}, coalesce(avg(CASE WHEN lexical <= 10 OR dense <= 10 THEN 1e0 ELSE 0 END), 0) AS union_10,
 coalesce(avg(CASE WHEN lexical <= 10 AND dense <= 10 THEN 1e0 ELSE 0 END), 0) AS both_10,
 coalesce(avg(CASE WHEN coalesce(lexical <= 50, false) OR coalesce(dense <= 50, false) THEN 0 ELSE 1e0 END), 0) AS neither_50 FROM w""")
def recall_of_lists(spark, d):
    dense = _semantic(spark, d, 100)
    rel = written(_judged(spark, d), "judged")
    lists = {"lexical": Blocks(spark, d).ranks(rel), "dense": S.top(dense, 100)}
    return E.list_figures(lists, rel, table(spark, d, "documents"))


@query(TOK + BM + JUDGED + """, v AS (SELECT j.query_id, coalesce(ranker, 'none') AS category, k FROM j JOIN search_queries USING (query_id))
SELECT category, count(*) FILTER (WHERE k = 1) AS passed, count(*) FILTER (WHERE k BETWEEN 2 AND 100) AS ranked, count(*) FILTER (WHERE k IS NULL OR k > 100) AS missed, 0::BIGINT AS failed FROM v GROUP BY category""")
def suite_by_category(spark, d):
    kinds = table(spark, d, "search_queries").select("query_id", F.coalesce("ranker", F.lit("none")).alias("category"))
    rel = _judged(spark, d).join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi").join(kinds, "query_id")
    failed = table(spark, d, "search_queries").where("query_text is null").select("query_id")
    rel = written(rel, "judged")
    return E.by_category(E.verdicts(Blocks(spark, d).ranks(rel).where("rank <= 100"), rel, failed))


def _variants_sql() -> str:
    parts = []
    for i, (k1, b) in enumerate(_GRID):
        for syn in (False, True):
            qt = "wide" if syn else "plain"
            parts.append(f"""SELECT {k1}::DOUBLE AS k1, {b}::DOUBLE AS b, {str(syn).lower()} AS synonyms, count(*) AS queries, coalesce(avg(CASE WHEN k <= 10 THEN 1e0 ELSE 0 END), 0) AS recall_10 FROM (
 SELECT rel.query_id, min(rank) AS k FROM rel JOIN documents USING (doc_id) LEFT JOIN (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * {k1 + 1}e0 / (tf + {k1}e0 * (1 - {b}e0 + {b}e0 * dl / (total_len / n)))), 6) AS score
  FROM {qt} JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), n GROUP BY ALL HAVING score > 0)) r USING (query_id, doc_id) GROUP BY rel.query_id)""")
    rel = JUDGED.split(", r AS")[0]
    syn = ", ".join(f"('{k}', '{s}')" for k, v in SYNONYMS.items() for s in v)
    return TOK + f""", s(term, syn) AS (VALUES {syn}), plain AS (SELECT DISTINCT query_id, term FROM qt), wide AS (SELECT query_id, term FROM plain UNION SELECT query_id, syn FROM plain JOIN s USING (term)){rel}
""" + " UNION ALL ".join(parts)


@query(_variants_sql())
def bm25_variants(spark, d):
    """Recall@10 for each k1 and b, with and without synonyms; a query's distinct terms count once."""
    rel, docs = written(_judged(spark, d), "judged"), table(spark, d, "documents")
    plain = table(spark, d, "search_queries").join(rel.select("query_id").distinct(), "query_id", "left_semi").select("query_id", T.tokens("query_text").alias("toks"))
    asked = lambda toks: plain.select("query_id", F.explode(toks).alias("term")).withColumn("cnt", F.lit(1))
    t = Blocks(spark, d, asked(T.synonyms_of("toks")))  # these hold the plain terms
    coded, out = t.coded(), None
    for synonyms in (False, True):
        terms = t.terms if synonyms else written(asked(F.array_distinct("toks")), "terms")
        for k1, b in _GRID:
            row = E.recall(B.ranks(coded, t.bm25(k1, b, terms), rel), rel, docs).select(F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.lit(synonyms).alias("synonyms"), "queries", "recall_10")
            out = row if out is None else out.unionByName(row)
    return out


@query()
def wordpiece_lengths(spark, d):
    """Lengths of the documents in WordPiece ids and what padding costs, by a stand-in vocabulary of characters and stop words."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    names = ["[CLS]", "[SEP]", "[UNK]", *letters, *[f"##{c}" for c in letters], *(w for w in STOP_WORDS if len(w) > 1)]
    ids = wordpiece_ids({t: i for i, t in enumerate(names)})
    n = F.least(F.lit(256), F.ceil(F.size(ids("text")) / 8) * 8).cast("long")
    rows = written(spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), n.alias("n")), "lengths")
    return E.padded_lengths(rows)


@query()
def index_search(spark, d):
    """The whole path: documents added to an index, all search queries answered by it."""
    index = SearchIndex(spark, embedder=V.seeded_embedder(64))
    docs = table(spark, d, "documents").where(T.valid_text("text")).select(F.col("doc_id").cast("string").alias("id"), "text")
    index.add_batch(docs)
    return index.search(table(spark, d, "search_queries").select("query_id", F.col("query_text").alias("text")))
