import os
import random
import string

import pytest

from quern.functions.vectors import embedded, seeded_embedder
from quern.operators import evaluate, search
from quern.operators import index as X
from quern.operators.vectors import scan_top
from quern.plans.search import IncompatibleIndex, SearchError, SearchIndex
from quern.plans.search_queries import QUERIES
from quern.sources import files
from quern.streaming import feed


def tables(spark, docs):
    toks = spark.createDataFrame([(d, t.split()) for d, t in docs.items()], "doc_id long, toks array<string>")
    tf = X.term_freq(toks)
    lengths = X.doc_lengths(toks)
    return tf, X.vocabulary(tf), lengths, X.corpus_stats(lengths)


def terms(spark, words):
    return spark.createDataFrame([(1, w, words.count(w)) for w in set(words)], "query_id long, term string, cnt long")


def test_golden_scores(spark):
    t = tables(spark, {1: "kubernetes cluster deploy pod", 2: "docker container image build", 3: "kubernetes pod service ingress"})
    got = {r.doc_id: r.score for r in search.bm25(terms(spark, ["kubernetes", "pod"]), *t).collect()}
    assert got == pytest.approx({1: 0.940007258, 3: 0.940007258})
    t = tables(spark, {1: "search search search index", 2: "search index", 3: "index store"})
    assert {r.doc_id: r.score for r in search.bm25(terms(spark, ["search"]), *t).collect()} == pytest.approx({1: 0.667101925, 2: 0.523548347})
    assert {r.doc_id: r.score for r in search.tfidf(terms(spark, ["search"]), *t).collect()} == pytest.approx({1: 0.304098831, 2: 0.202732554})


def test_scores_of_candidates_and_of_many_queries(spark, monkeypatch):
    t = tables(spark, {1: "kubernetes cluster deploy pod", 2: "docker container image build", 3: "kubernetes pod service ingress"})
    asked = terms(spark, ["kubernetes", "pod", "image"])
    every = {r.doc_id: r.score for r in search.bm25(asked, *t).collect()}
    some = spark.createDataFrame([(1, 3), (1, 2), (1, 9), (2, 1)], "query_id long, doc_id long")
    assert {r.doc_id: r.score for r in search.bm25(asked, *t, candidates=some).collect()} == {d: every[d] for d in (2, 3)}
    monkeypatch.setattr(search, "MOST_WANTED", 1)
    assert {r.doc_id: r.score for r in search.bm25(asked, *t).collect()} == pytest.approx(every)


def test_best_scored_equals_the_whole_list(spark, monkeypatch):
    r = random.Random(2)
    docs = {i: " ".join(r.choices("a b c d e f g h".split(), k=r.randrange(0, 9))) for i in range(200)}
    tf, vocab, lengths, stats = tables(spark, docs)
    tf = tf.join(lengths, "doc_id")
    asked = spark.createDataFrame([(q, t, r.randrange(1, 3)) for q in range(7) for t in r.sample("abcdefgh", 3)], "query_id long, term string, cnt long")
    whole = search.bm25(asked, tf, vocab, None, stats)
    want = sorted(map(tuple, search.top(whole.select("query_id", "doc_id", search.F.round("score", 6).alias("score")), 4).collect()))
    weights = search.bm25_weights(asked, vocab, stats)
    for cells, most in ((4_000_000, 1000), (30, 1000), (30, 1)):
        monkeypatch.setattr(search, "CELLS", cells)
        monkeypatch.setattr(search, "MOST_WANTED", most)
        assert sorted(map(tuple, search.best_scored(weights, tf, search.bm25_impact(), 4).collect())) == want
    assert search.best_scored(weights.limit(0), tf, search.bm25_impact(), 4).count() == 0


def test_best_fused_equals_fusing_whole_lists(spark, monkeypatch):
    r = random.Random(12)
    docs = {i: " ".join(r.choices("a b c d e f g h".split(), k=r.randrange(0, 7))) for i in range(300)}
    tf, vocab, lengths, stats = tables(spark, docs)
    tf = tf.join(lengths, "doc_id")
    asked = spark.createDataFrame([(q, t, 1) for q in range(6) for t in r.sample("abcdefgh", 3)] + [(9, "zzz", 1)], "query_id long, term string, cnt long")
    # some queries have a short second list, one none, one has nothing else
    vec = spark.createDataFrame([(q, i, r.randrange(1, 60) / 60) for q in (0, 1, 2, 3, 7) for i in r.sample(range(300), [250, 120, 5, 60, 0, 0, 0, 30][q])], "query_id long, doc_id long, score double")
    whole = search.bm25(asked, tf, vocab, None, stats).select("query_id", "doc_id", search.F.round("score", 6).alias("score"))
    weights = search.bm25_weights(asked, vocab, stats)
    for n, w, most in ((10, 2.0, 1000), (3, 2.0, 1000), (10, 0.5, 1000), (10, 2.0, 1)):
        want = sorted(map(tuple, search.rrf(whole, vec, w_vec=w, n=n).collect()))
        for cells in (4_000_000, 70):
            monkeypatch.setattr(search, "CELLS", cells)
            monkeypatch.setattr(search, "MOST_WANTED", most)
            assert sorted(map(tuple, search.best_fused(weights, tf, search.bm25_impact(), vec, w_vec=w, n=n).collect())) == want
    assert search.best_fused(weights.limit(0), tf, search.bm25_impact(), vec.limit(0)).count() == 0


def test_near_terms_against_brute_force(spark):
    r = random.Random(3)
    vocab = list({"".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(300)} | {"x" * 30, "x" * 29 + "y", "x" * 28})
    wanted = vocab[:40] + ["x" * 30, "zzz"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for most in (1, 2, 3, 5):
        got = {tuple(x) for x in search.near_terms(spark.createDataFrame([(w,) for w in wanted], "term string"), spark.createDataFrame([(v,) for v in vocab], "term string"), most).collect()}
        assert got == {(w, v, distance(w, v)) for w in set(wanted) for v in vocab if 1 <= distance(w, v) <= most}


def test_fusion_constants(spark):
    s = "query_id long, doc_id string, score double"
    kw, vec = spark.createDataFrame([(1, "a", 5.0), (1, "b", 5.0)], s), spark.createDataFrame([(1, "c", 0.9), (1, "a", 0.5)], s)
    got = {r.doc_id: (r.score, r.rank) for r in search.rrf(kw, vec).collect()}
    assert got == {"a": (pytest.approx(0.138528139), 1), "c": (pytest.approx(0.095238095), 2), "b": (pytest.approx(1 / 22), 3)}
    assert search.rrf(kw.limit(0), vec.limit(0)).count() == 0


def test_scan_of_unequal_and_null_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "query_id long, vector array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [])], "vec_id long, vector array<double>")
    got = [(r.query_id, r.vec_id, r.score, r["rank"]) for r in scan_top(q, v, least=0.0).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0, 1), (1, 4, 1.0, 2)]


def test_index_life(spark, root):
    ix = SearchIndex(spark, root, embedder=seeded_embedder(16), lexical_only=True)
    ix.add_batch(spark.createDataFrame([("k", "kubernetes cluster deployment"), ("d", "docker container image")], "id string, text string"))
    ix.add_pages(spark.createDataFrame([("p", 1, "pod ingress"), ("p", 2, "pod service"), ("p", 3, " "), ("p", 4, None)], "document_id string, page int, text string"))
    hits = ix.search("kubernetes").collect()
    assert hits[0].id == "k" and hits[0].score == 1.0
    assert ix.search("kubrnetes").collect()[0].id == "k"  # a typo
    pods = ix.search("pods").collect()
    assert pods[0].id == "p" and len(pods[0].chunks) == 2
    with pytest.raises(SearchError):
        ix.add("a||b", "x")
    with pytest.raises(SearchError):
        ix.add("a", " \n")
    asked = ix.query_tokens(spark.createDataFrame([(1, "cluster pods")], "query_id long, text string"), ix.tables()["vocab"])
    assert [(r.pos, r.term, r.kind) for r in asked.orderBy("pos").collect()][:2] == [(0, "cluster", "word"), (1, "distribut", "synonym")]
    assert [r.kind for r in asked.where("term = 'pod'").collect()] == ["word"]
    ix.delete(["p", "nobody"])
    assert ix.search("pod").where("id = 'p'").count() == 0 and ix.search("the of").count() == 0
    again = SearchIndex(spark, root, embedder=seeded_embedder(16))
    assert again.search("docker").collect()[0].id == "d" and again.docs.live().count() == 2
    ix.close()
    with pytest.raises(SearchError):
        ix.search("x")


def answers(ix, *texts):
    q = ix.spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    return sorted((r.query_id, r.id, round(r.score, 6), r["rank"]) for r in ix.search(q).collect())


def test_incremental_equals_one_batch_and_reopening_reads(spark, root, monkeypatch):
    r = random.Random(4)
    words = "search index query vector cluster kubernetes docker storage ranking token".split()
    docs = {f"d{i}": " ".join(r.choices(words, k=r.randrange(3, 12))) for i in range(30)}
    asked = ["kubernetes cluster", "serch vectors", "docker"]
    s = "id string, text string"
    grown = SearchIndex(spark, root + "/grown", embedder=seeded_embedder(16))
    grown.add_batch(spark.createDataFrame([(k, "old words " + v[:9]) for k, v in list(docs.items())[:20]] + [("gone", "docker docker")], s))
    answers(grown, "docker")
    grown.add_batch(spark.createDataFrame(list(docs.items())[10:], s))
    answers(grown, "docker")
    grown.delete(["gone"])
    grown.add_batch(spark.createDataFrame(list(docs.items())[:12], s))
    whole = SearchIndex(spark, root + "/whole", embedder=seeded_embedder(16))
    whole.add_batch(spark.createDataFrame(list(docs.items()), s))
    want = answers(whole, *asked)
    assert answers(grown, *asked) == want and len(grown._manifest()["segments"]) == 3
    a, b = (sorted(map(tuple, x.tables()["vocab"].collect())) for x in (grown, whole))
    assert a == b and grown.tables()["stats"].first() == whole.tables()["stats"].first()
    again = SearchIndex(spark, root + "/grown", embedder=seeded_embedder(16))
    monkeypatch.setattr(again, "_segment", None)  # a rebuild would fail
    assert answers(again, *asked) == want
    merged = again._merged(again._manifest())
    assert again.files.create_json(f"segments-log/{merged['number']:010d}.json", merged)
    assert answers(again, *asked) == want and len(again._manifest()["segments"]) == 1


def test_no_batch_is_lost(spark, root):
    a, b = SearchIndex(spark, root, lexical_only=True), SearchIndex(spark, root, lexical_only=True)
    a.add("one", "first words")
    b.add("two", "second words")  # opened before the other wrote
    a.add_batch(spark.createDataFrame([], "id string, text string"))
    c = SearchIndex(spark, root, lexical_only=True)
    c.add("three", "third words")
    for ix in (a, b, c):
        assert {x.id for x in ix.search("words").collect()} == {"one", "two", "three"}


def test_given_vectors_lock_and_format(spark, root):
    ix = SearchIndex(spark, root, embedder=seeded_embedder(4), dims=4, exclusive=True)
    ix.add("a", "alpha text", [0.0, 0.0, 0.0, 1.0])
    ix.add("b", "beta text")
    with pytest.raises(SearchError):
        ix.add("c", "gamma", [1.0])
    with pytest.raises(SearchError):
        SearchIndex(spark, root, exclusive=True)
    have = {r.doc_id: r.vector for r in ix.tables()["vectors"].collect()}
    assert have["a"] == [0.0, 0.0, 0.0, 1.0] and len(have["b"]) == 4
    ix.vacuum()
    assert {r.doc_id: r.vector for r in ix.tables()["vectors"].collect()} == have
    ix.add("a", "alpha text again")
    assert ix.vacuum() == 1  # the file that had the former text
    assert {r.doc_id: r.vector for r in ix.tables()["vectors"].collect()}["a"] != [0.0, 0.0, 0.0, 1.0]
    ix.close()
    SearchIndex(spark, root, exclusive=True).close()
    ix.files.create_json("segments-log/0000009999.json", {"format": 0})
    with pytest.raises(IncompatibleIndex):
        SearchIndex(spark, root)


def test_each_text_is_embedded_once(spark):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    seen = spark.sparkContext.accumulator(0)

    @pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return texts.map(lambda t: [float(len(t))])

    rows = spark.createDataFrame([(i, ["aa", "b", None, ""][i % 4], 9.0) for i in range(40)], "id long, text string, vector double")
    got = {(r.text, tuple(r.vector) if r.vector else None) for r in embedded(rows, "text", embed).collect()}
    assert got == {("aa", (2.0,)), ("b", (1.0,)), ("", (0.0,)), (None, None)} and seen.value == 3


def test_depth_of_fusion(spark):
    r = random.Random(8)
    s = "query_id long, doc_id long, score double"
    for n, w in ((10, 2.0), (3, 2.0), (10, 3.0), (10, 0.5)):
        ids = list(range(400))
        kw = spark.createDataFrame([(q, i, float(r.randrange(30))) for q in range(3) for i in r.sample(ids, 150)], s)
        vec = spark.createDataFrame([(q, i, r.randrange(1, 200) / 200) for q in range(3) for i in r.sample(ids, 350)], s)
        depth = search.fusion_depth(n, w_vec=w)
        assert (depth is None) == (w == 0.5)
        if depth is not None:
            cut = search.top(vec, depth).drop("rank")
            assert sorted(search.rrf(kw, vec, w_vec=w, n=n).collect()) == sorted(search.rrf(kw, cut, w_vec=w, n=n).collect())


def test_quality_figures(spark):
    res = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "query_id long, doc_id string, rank int")
    rel = spark.createDataFrame([(1, "b"), (2, "x"), (3, "gone")], "query_id long, doc_id string")
    corpus = spark.createDataFrame([("a",), ("b",), ("x",)], "doc_id string")
    assert tuple(evaluate.recall(res, rel, corpus).first()) == (2, 0.5)
    assert tuple(evaluate.recall(res, rel.limit(0), corpus).first()) == (0, 0.0)
    assert {r.query_id: r.verdict for r in evaluate.verdicts(res, rel).collect()} == {1: "RANK 2", 2: "MISS", 3: "MISS"}
    vals = spark.createDataFrame([("g", float(v)) for v in (5, 1, 1, 9)] + [("g", None)], "g string, v double")
    assert tuple(evaluate.nearest_rank_percentiles(vals, "v", ["g"]).first()) == ("g", 5.0, 9.0, 9.0)


def test_files_and_watchlist(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("hello")
    (tmp_path / "in" / "sub" / "b.HTML").write_text("<p>hi</p>")
    (tmp_path / "in" / "c.bin").write_text("no")
    got = files.directory(spark, str(tmp_path / "in"))
    from quern.functions.extract import extracted

    assert {os.path.basename(r.path): r.text for r in extracted(got).collect()} == {"a.txt": "hello", "b.HTML": "hi\n"}
    assert files.directory_size(spark, str(tmp_path / "in")).first().human == "16 B"
    (tmp_path / "t.tsv").write_text("1\ta b\tc\nbad\n2\tx\n")
    assert [tuple(r) for r in files.tsv(spark, str(tmp_path / "t.tsv")).collect()] == [("1", "a b\tc"), ("2", "x")]
    (tmp_path / "q.txt").write_text("1 0 a 1\n1 0 b 1\n2 0 c 0\nshort\n")
    assert [tuple(r) for r in files.qrels(spark, str(tmp_path / "q.txt")).collect()] == [("1", "b")]
    w = files.WatchList(str(tmp_path / "w.json"))
    assert w.add(str(tmp_path / "in")) and not w.add(str(tmp_path / "in")) and len(w.load()) == 1 and w.remove(str(tmp_path / "in")) and not w.load()
    with pytest.raises(NotADirectoryError):
        w.add(str(tmp_path / "none"))


def test_stream_replay(spark, tmp_path, root):
    rows = [(1, "create", "a.txt", "x"), (2, "write", "a.txt", "y"), (3, "create", "b.bin", "z"), (4, "create", "c.md", "c"), (5, "remove", "c.md", None), (6, "rename", "q.bin", None)]
    for i in (3, 0):
        spark.createDataFrame(rows[i : i + 3], "seq long, op string, path string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    got = feed.replayed(spark, str(tmp_path / "events"), "seq long, op string, path string, text string", feed.file_events, root + "/s", 1)
    assert [tuple(r) for r in got.collect()] == [("a.txt", 2, "y")] and string
    # a second stream into the same table, whose batches have the same numbers
    spark.createDataFrame([(9, "create", "d.md", "d")], "seq long, op string, path string, text string").coalesce(1).write.parquet(str(tmp_path / "more"))
    table = feed.BucketedTable(spark, root + "/s/table")
    more = spark.readStream.schema("seq long, op string, path string, text string").parquet(str(tmp_path / "more"))
    feed.apply_stream(feed.file_events(more), table, root + "/s/other").awaitTermination()
    assert sorted(r.key for r in table.live().collect()) == ["a.txt", "d.md"]


def test_fusion_of_a_document_far_down_the_vector_list(spark, tmp_path):
    n = 560  # document i is at place i of the vector list
    docs = spark.createDataFrame([(i, "zebra" if i == 60 else "moon", "en") for i in range(1, n)], "doc_id long, text string, lang string")
    vectors = spark.createDataFrame([(1000, [1.0])] + [(i, [1 - i / 1000]) for i in range(1, n)], "vec_id long, embedding array<float>")
    for name, df in {"documents": docs, "embeddings": vectors, "search_queries": spark.createDataFrame([(1000, "zebra")], "query_id long, query_text string")}.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, want in {"rrf_fuse": 1 / 21 + 2 / 80, "hybrid_search": 1 / 21 + 2 / 80, "blend_score": 0.6 + 0.4 * 0.94 / 0.999}.items():
        got = {r.doc_id: r.score for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert len(got) == 10 and got[60] == pytest.approx(want, abs=2e-6)
    grid = {(r.k, r.doc_id): r.score for r in QUERIES["rrf_grid"](spark, str(tmp_path)).collect()}
    assert [grid[k, 60] for k in (10, 20, 60)] == pytest.approx([1 / 11 + 1 / 70, 1 / 21 + 2 / 80, 1 / 61 + 1 / 120], abs=1e-8)
