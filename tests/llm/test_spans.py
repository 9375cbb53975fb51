import random

import pytest

from quern.llm import spans

S = "doc_id long, text string"


def text(r, n):
    return "".join(r.choice("abcdefghij éß漢😀\n") for _ in range(n))


def brute(docs, length):
    grams = {d: {t[i : i + length] for i in range(len(t) - length + 1)} for d, t in docs.items() if t}
    pairs = {(a, b) for a in grams for b in grams if a < b and grams[a] & grams[b]}
    chars = {}
    for d, t in docs.items():
        cover = set()
        for i in range(len(t or "") - length + 1):
            if any(t[i : i + length] in grams[e] for e in grams if e != d):
                cover |= set(range(i, i + length))
        chars[d] = len(cover)
    return pairs, chars


@pytest.mark.parametrize("group", [32, 3])
def test_against_brute_force(spark, group):
    r = random.Random(7)
    docs = {i: text(r, r.randrange(60, 400)) for i in range(40)}
    for i in range(40, 70):  # parts of others, just long enough or just too short, at any place
        src = docs[r.randrange(40)]
        n = r.choice([39, 40, 41, 55, 150])
        at = r.randrange(max(1, len(src) - n))
        docs[i] = text(r, r.randrange(80)) + src[at : at + n] + text(r, r.randrange(80))
    common = text(r, 60)
    for i in range(70, 82):
        docs[i] = text(r, 50) + common[r.randrange(15) :] + text(r, 30)
    docs |= {90: "x" * 500, 91: "y" + "x" * 300, 92: "xy" * 100, 93: None, 94: "", 95: " " * 39, 96: "ab" * 19 + "xxx"}
    docs |= {100: docs[0], 101: docs[0]}
    df = spark.createDataFrame([(d, t, "c", 1, 2) for d, t in docs.items()] + [(100, docs[100], "c", 1, 2), (None, docs[0], "c", 1, 2)], S + ", cls string, first int, n_chars int")
    pairs, chars = brute(docs, 40)
    got = {tuple(x) for x in spans.shared_pairs(df, 40, group).collect()}
    if group == 32:
        assert got == pairs
    else:  # large groups are linked through their smallest text
        assert got <= pairs and {x for p in got for x in p} == {x for p in pairs for x in p}
        up = {d: d for d in docs}
        find = lambda d: d if up[d] == d else find(up[d])
        for a, b in got:
            up[find(a)] = find(b)
        assert all(find(a) == find(b) for a, b in pairs)
    have = {x.doc_id: x for x in spans.shared_characters(df.dropDuplicates(["doc_id"]), 40, group).collect()}
    assert {d: x.shared_chars for d, x in have.items()} == chars
    assert have[101].cls == 0 and have[93].n_chars == 0


def test_span_across_a_factor_boundary():
    # the greedy parse takes the first factor from one place of the reference and goes on at another
    r = random.Random(1)
    a, b, c = text(r, 60), text(r, 60), text(r, 60)
    ref = a + b[:30] + "!" + a[40:] + b + "?" + b[20:] + c
    doc = a[10:] + b + c
    got = spans.Reference(spans.code_points(ref), 60).shared(spans.code_points(doc)).tolist()
    assert got == [i for i in range(len(doc) - 59) if doc[i : i + 60] in ref]


def test_empty_table_and_a_long_text(spark):
    assert spans.shared_pairs(spark.createDataFrame([], S)).count() == 0
    long = "".join(chr(97 + (i * i // 7) % 26) for i in range(200_000))
    df = spark.createDataFrame([(1, long), (2, "z" + long[1000:150_000]), (3, "q" * 100_000)], S)
    assert [tuple(x) for x in spans.shared_pairs(df).collect()] == [(1, 2)]


def test_all_pairs_of_a_window_in_many_texts(spark):
    r = random.Random(5)
    common = text(r, 70)
    docs = {i: text(r, 30) + common[i % 3 :] + text(r, 20) for i in range(40)}
    df = spark.createDataFrame(list(docs.items()), S)
    got = {tuple(x) for x in spans.shared_pairs(df, 60).collect()}
    assert got == brute(docs, 60)[0] and len(got) == 40 * 39 // 2


def test_pairs_within_blocks(spark):
    rows = spark.createDataFrame([(w, i * w) for w in (1, 7) for i in range(1, 50 * w)], "window long, cls long")
    got = [tuple(x) for x in spans._pairs_within(rows, rows.groupBy("window").count().withColumnRenamed("count", "n"), 16).collect()]
    assert sorted(got) == sorted((a * w, b * w) for w in (1, 7) for a in range(1, 50 * w) for b in range(a + 1, 50 * w))


@pytest.mark.parametrize("group", [32, 3])
def test_passage_repeated_within_texts_of_a_large_group(spark, group):
    r = random.Random(9)
    common = text(r, 50)
    docs = {i: text(r, 30) + common + text(r, 60) + common + text(r, 20) + " " * 90 for i in range(36)}
    docs |= {50: "=" * 300, 51: common[:45] + " " * 10 + common, 52: text(r, 200)}
    have = {x.doc_id: x.shared_chars for x in spans.shared_characters(spark.createDataFrame(list(docs.items()), S), 40, group).collect()}
    assert have == brute(docs, 40)[1] and have[0] >= 190


def test_links_and_classes_tell_of_every_pair(spark):
    r = random.Random(11)
    copy = text(r, 300)
    docs = {i: copy for i in range(40)} | {50: text(r, 30) + copy[100:180] + text(r, 20), 51: text(r, 90), 52: text(r, 90) + copy[:70]}
    df = spark.createDataFrame(list(docs.items()), S)
    links = {tuple(x) for x in spans.shared_links(df, 60).collect()}
    cls = {x.doc_id: x.cls for x in spans.shared_characters(df, 60).collect()}
    said = {(a, b) for a in docs for b in docs if a < b and (cls[a] == cls[b] or tuple(sorted((cls[a], cls[b]))) in links)}
    assert said == brute(docs, 60)[0] and len(said) == 40 * 39 // 2 + 80
