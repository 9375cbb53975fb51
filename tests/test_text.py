import math

import numpy as np
import pytest

from quern.functions import embedders as E
from quern.functions import extract, stem
from quern.functions import text as T
from quern.functions import vectors as V
from pyspark.sql import functions as F


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in df.select("i", f("v").alias("r")).orderBy("i").collect()]


def test_tokens(spark):
    got = column(spark, ["parseHTTPRequest of the v2 étion", None, "", "the THE"], T.tokens)
    # capitals in a row are taken one by one, and single t and s are stop words
    assert got[0] == ["parse", "h", "p", "request", "v2", "tion"] and got[1:3] == [[], []]
    assert column(spark, ["Don't 12ab é漢 x+y"], T.lexer_tokens) == [["don", "'", "t", "12", "ab", "é漢", "x", "+", "y"]]


def test_soundex(spark):
    known = {"Robert": "R163", "Thompson": "T512", "": "", "ashcraft": "A226", "123": "", "éric": "R200"}
    assert column(spark, list(known), T.soundex) == list(known.values())


def test_edges_and_coverage_constant(spark):
    got = column(spark, ["ab", "abc", "kubernetes", "superlongword"], T.edge_ngrams)
    assert got[0] == ["ab"] and got[1] == ["abc"] and got[2] == ["kubernetes", *["kubernetes"[:n] for n in range(3, 10)]] and len(got[3]) == 8
    assert sum(len(x) / 8 * 100 for x in column(spark, ["clusters"], T.edge_ngrams)[0]) == 412.5


def test_stems():
    pairs = "running:run indexed:index searching:search clustering:cluster kubernetes:kubernet caresses:caress ties:tie cries:cri gas:gas this:this hoping:hope hopping:hop falling:fall generously:generous university:univers relational:relat conditional:condit happy:happi skies:sky news:news dying:die proceed:proceed agreed:agre sky:sky consign:consign consistency:consist knightly:knight"
    assert {p: stem.stem(p.split(":")[0]) for p in pairs.split()} == {p: p.split(":")[1] for p in pairs.split()}


@pytest.mark.parametrize("n", [0, 1, 2, 299, 300, 301, 350, 400, 500, 550, 551, 800, 801])
def test_word_chunks(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = column(spark, [" \n".join(words)], T.word_chunks)[0]
    want, s = [], 0
    while s < n:
        want.append(" ".join(words[s : s + 300]))
        if s + 300 >= n:
            break
        s += 250
    assert got == want


def test_ids_and_paths(spark):
    ids = ["", "a", "a|b", "a||b", "x" * 512, "x" * 513, "é" * 257, "a\tb", "a�", None]
    assert column(spark, ids, T.valid_id) == [False, True, True, False, True, False, False, False, False, False]
    got = column(spark, ["report.pdf||p3||c1||text||10.00,20.00,400.00,15.00", "doc||p1||c0", "doc", "d||px||c-||t||1,2"], T.parsed_chunk_id)
    assert [(r.orig_id, r.page, r.idx, r.bbox) for r in got] == [("report.pdf", 3, 1, [10.0, 20.0, 400.0, 15.0]), ("doc", 1, 0, None), ("doc", 0, 0, None), ("d", 0, 0, None)]
    assert column(spark, ["doc||p1||c0"], T.chunk_fields) == [None]
    assert column(spark, ["/home/user/Photos/2024/vacation/portrait_sunset-beach.jpg", "x.png", ""], T.path_words) == ["portrait sunset beach jpg vacation 2024 Photos", "x png", ""]


def test_scores(spark):
    df = spark.createDataFrame([(5.0, 10.0), (10.0, 10.0), (5.0, 0.0), (float("nan"), 10.0), (float("inf"), 10.0), (-5.0, 10.0), (15.0, 10.0)], "s double, m double")
    assert [r[0] for r in df.select(T.normalised_score("s", "m")).collect()] == [0.5, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = df.select(V.dot("a", "b"), V.cosine("a", "b"), V.l2("a", "b"), V.l2_normalised("a")).collect()
    assert [round(r[0], 6) for r in got] == [24, 0, 0, 0] and [round(r[1], 6) for r in got] == [0.96, 0, 0, 0]
    assert round(got[0][2], 6) == round(math.sqrt(2), 6) and got[2][2] > 1e38 and [round(x, 6) for x in got[0][3]] == [0.6, 0.8]
    h = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "h array<array<double>>, m array<int>")
    assert [r[0] for r in h.select(V.mean_pooled("h", "m")).collect()] == [[2.0, 3.0], [0.0, 0.0]]


def test_seeded_vectors():
    assert V.fnv64([b"", b"hello"]).tolist() == [14695981039346656037, 11831194018420276491]
    many = [b"hello"[: i % 6] * (i % 7) for i in range(100)] + [b"x" * 300]
    assert V.fnv64(many).tolist() == [V.fnv64([t])[0] for t in many] and len(V.fnv64([])) == 0
    assert np.allclose(V.seeded_vectors(["hello"], 4)[0], [0.65128702, -0.39551753, -0.49119005, 0.42204669], atol=1e-6)
    a = V.seeded_vectors(["hello", "world"])
    assert abs(float(a[0] @ a[1]) - 0.01526114) < 1e-5


def test_wordpieces_and_extractors():
    vocab = {t: i for i, t in enumerate(["[CLS]", "[SEP]", "[UNK]", "un", "##aff", "##able", "!", "a"])}
    pieces = E.WordPiece(vocab, 8)
    assert pieces.ids("Unaffable! a zzz") == [0, 3, 4, 5, 6, 7, 2, 1] == pieces.ids("unaffable! a zzz a a a a")
    assert pieces.ids(None) == pieces.ids(" ") == [0, 1] and pieces.split("A_b e\u0301x!+\u00a0c") == ["a", "_", "b", "e\u0301x", "!", "+", "c"]
    assert extract.visible_html("<title>T</title><p>a<b> b </b>&amp;<script>x</script><style>y</style><!-- c -->") == "T\na\nb\n&\n"
    assert extract.go_text('package main // say\nfunc Run(_ int) { x := "no" /* yes */ }') == "main\nsay\nyes\nmain Run int x "
    for broken in ("func f() {}", "package a; func (", 'package a; x := "no', "package a /* no", "package a; (]"):
        assert extract.go_text(broken) == broken


def test_synonyms_and_deletions(spark):
    df = spark.createDataFrame([(["learn", "model", "zzz"],)], "t array<string>")
    assert df.select(T.synonyms_of("t")).first()[0] == ["learn", "train", "model", "neural", "zzz"]
    assert set(column(spark, ["abc"], lambda c: T.deletions(c, 2))[0]) == {"abc", "ab", "ac", "bc", "a", "b", "c"}
    assert column(spark, [""], lambda c: T.deletions(c, 2))[0] == [""] and F is not None
