import random

import pytest

from quern.functions import text as T
from quern.operators import index as X
from quern.operators import scan as B
from quern.operators import search as S
from quern.plans import search_queries as Q
from quern.session import written

F = S.F
SIZES = ((6_000_000, 1_000_000), (60, 40))


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents, statistics and queries; ties and exact copies abound."""
    r = random.Random(5)
    words = "apple apply applet grape graph maple staple table cable fable zq".split()
    docs = [(i, r.choices(words, k=r.randrange(0, 7))) for i in range(120)]
    toks = written(spark.createDataFrame(docs, "doc_id long, toks array<string>").repartition(3), "toks")
    tf = written(X.postings(toks), "tf")
    stats = X.corpus_stats(X.doc_lengths(toks))
    rows = [(q, t, r.randrange(1, 3)) for q in range(9) for t in r.sample([*words, "grappe", "tabel"], r.randrange(1, 5))] + [(20, "zq", 1), (21, "nothing", 1)]
    return toks, tf, X.vocabulary(tf), stats, spark.createDataFrame(rows, "query_id long, term string, cnt long")


def side(corpus):
    toks, _, vocab, stats, terms = corpus
    n, total = stats.first()
    return B.coded(toks, terms.select("term")), B.Weighted(S.bm25_weights(terms, vocab, stats), B.bm25_impact(n, total, 1.2, 0.75))


def whole(corpus):
    _, tf, vocab, stats, terms = corpus
    return written(S.bm25(terms, tf, vocab, None, stats).select("query_id", "doc_id", F.round("score", 6).alias("score")), "whole")


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture(params=SIZES)
def small(request, monkeypatch):
    monkeypatch.setattr(B, "CELLS", request.param[0])
    monkeypatch.setattr(B, "HELD", request.param[1])


def pairs_of(spark, n=120):
    r = random.Random(6)
    return spark.createDataFrame([(q, d, r.randrange(1, 40) / 40) for q in (0, 1, 2, 3, 20, 30) for d in r.sample(range(n), [90, 40, 4, 12, 30, 15][min(q, 5) if q < 20 else q // 10 + 2])], "query_id long, doc_id long, score double")


def test_ranks_of_pairs(spark, corpus, small):
    docs, bm25 = side(corpus)
    asked = pairs_of(spark)
    every = whole(corpus)
    above = every.alias("a").join(every.alias("b"), F.expr("a.query_id = b.query_id and b.score > a.score"), "left").groupBy("a.query_id", "a.doc_id").agg(F.count("b.score").alias("above"))
    want = S.top(every, 1000).join(above, ["query_id", "doc_id"]).join(asked.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    assert rows(B.ranks(docs, bm25, asked)) == rows(want.select("query_id", "doc_id", "score", "rank", "above"))


def test_best_of_all(corpus, small):
    docs, bm25 = side(corpus)
    assert rows(B.best(docs, [bm25], 4)) == rows(S.top(whole(corpus), 4))


@pytest.mark.parametrize("w", [2.0, 0.5])
def test_fused_and_blended(spark, corpus, small, w):
    docs, bm25 = side(corpus)
    vec = pairs_of(spark)
    assert rows(B.fused(docs, [bm25], vec, w_vec=w)) == rows(S.rrf(whole(corpus), vec, w_vec=w))
    if w == 2.0:
        assert rows(B.blended(docs, bm25, vec)) == rows(S.blend(whole(corpus), vec))
        places = written(B.places(docs, [bm25], vec, 12), "places")
        a = F.row_number().over(S.Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("v"), "doc_id"))
        want = whole(corpus).join(vec.withColumnRenamed("score", "v"), ["query_id", "doc_id"], "left").fillna({"v": 0.0}).withColumn("ra", a).where("ra <= 12")
        assert rows(places.where("ra is not null").select("query_id", "doc_id", "ra")) == rows(want.select("query_id", "doc_id", "ra"))


def test_candidates(spark, corpus, small):
    toks, tf, vocab, _, terms = corpus
    frags, codes = X.fragments(tf), X.phonetic(tf)
    kinds = {("coverage",): S.coverage(terms, frags), ("sound",): S.sound_alike(terms, codes), ("typo",): S.typo_tolerant(terms, vocab, frags)}
    kinds["coverage", "sound", "typo"] = found = written(S.lexical_candidates(terms, vocab, frags, codes), "found")
    for kind, want in kinds.items():
        keys = written(S.candidate_keys(terms, vocab, kind), "keys")
        got = B.scan(B.coded(toks, None, keys.select("key")), [B.Keyed(terms, keys)], B.All(4))
        assert rows(got) == rows(want.toDF("query_id", "doc_id", "s").select("query_id", "doc_id", F.round("s", 4)))
    docs, bm25 = B.coded(toks, terms.select("term"), keys.select("key")), side(corpus)[1]
    assert rows(B.lexical_only(docs, bm25, B.Keyed(terms, keys))) == rows(S.lexical_ranking(found, whole(corpus)))
    vec = pairs_of(spark)
    want = S.rrf(S.hybrid_keys(found.withColumn("coverage", F.round("coverage", 4)), whole(corpus)), vec)
    assert rows(B.fused(docs, [bm25, B.Keyed(terms, keys)], vec, B.keyed, 9)) == rows(want)


def test_expansion(spark, corpus, small):
    toks, tf, _, _, terms = corpus
    near = spark.createDataFrame([("apple", "apply"), ("apple", "grape"), ("maple", "apply"), ("zq", "zq"), ("table", "xyz")], "term string, near string")
    want = S.top(S.neural_expansion(terms, near, X.fragments(tf)).withColumnRenamed("coverage", "score"), 10)
    assert rows(B.best(*B.expansion(toks, terms, near), 10)) == rows(want)


def test_sound_codes(spark):
    names = "robert rupert thompson ashcraft tymczak pfister honeyman jackson a zz 4u 2024 aeiou bbb".split()
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.soundex("n").alias("c")).collect()
    assert {r.n: B.sound_code(r.n) for r in got} == {r.n: r.c for r in got}


def shuffled(spark, run) -> int:
    """Rows that the stages of ``run`` shuffle."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: [(x.stageId(), x.shuffleWriteRecords()) for x in (lambda s: map(s.apply, range(s.size())))(store.stageList(None, False, False, none, None))]
    last = max([i for i, _ in stages()], default=-1)
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for i, n in stages() if i > last)

@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """400 queries that each match all of 1500 documents."""
    at = str(tmp_path_factory.mktemp("many"))
    r = random.Random(9)
    words = [f"word{i}" for i in range(30)]
    docs = [(i, " ".join(["moon", *r.choices(words, k=8)])) for i in range(1, 1501)]
    queries = [(i, f"moon {words[i % 30]} {words[i % 7]}", "lexical", i % 2 == 0) for i in range(1, 401)]
    lists = [(q, r.randrange(1, 1501), r.random()) for q in range(1, 401) for _ in range(3)]
    for name, data, schema in (
        ("documents", docs, "doc_id long, text string"), ("search_queries", queries, "query_id long, query_text string, ranker string, judged boolean"),
        ("score_lists", lists, "query_id long, doc_id long, vec double"), ("embeddings", [(i, [r.random() - 0.5 for _ in range(4)]) for i in range(1, 60)], "vec_id long, embedding array<float>"),
    ):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


#: Most rows that a query may shuffle on these tables.
MOST = {
    "bm25_variants": 40_000,
    "recall_of_lists": 30_000,
    "rrf_fuse": 100_000,
    "query_suite": 30_000,
    "recall_curve": 30_000,
    "suite_by_category": 30_000,
    "blend_score": 100_000,
    "fuzzy_score": 20_000,
    "index_search": 600_000,
    "neural_expansion": 100_000,
    "bm25_param_grid": 40_000,
    "gt_rank": 15_000,
    "lexical_candidates": 20_000,
    "phonetic_score": 12_000,
    "coverage_score": 20_000,
    "hybrid_search": 200_000,
    "lexical_only_search": 100_000,
    "rrf_grid": 900_000,
}


@pytest.mark.parametrize("name", MOST)
def test_few_rows_are_shuffled(spark, many, name):
    assert shuffled(spark, lambda: Q.QUERIES[name](spark, many).write.format("noop").mode("overwrite").save()) < MOST[name]
