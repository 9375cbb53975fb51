import random

from quern.llm import mix

D, W = "doc_id long, source string, size long", "source string, target_share double, max_repeats int"


def test_shares_repeats_and_left_out(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["big", "big", "big", "mid", "tiny"]), r.randrange(1, 200)) for i in range(6000)]
    rows = [x for x in rows if x[1] != "tiny" or x[0] % 20 == 0]
    rows += [(7000, None, 50), (7001, "other", 50), (7002, "big", None), (7003, "big", 0), (7004, "none", 9), (7005, "none", 9)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], D + ", passes int")
    w = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 6), ("absent", 0.1, 3), ("none", 0.0, 1), (None, 0.5, 1), ("other", None, 2)], W)
    got = mix.mix(docs, w).collect()
    cap = {"big": 1, "mid": 2, "tiny": 6}
    assert all(0 < x.copies <= cap[x.source] for x in got) and len({x.doc_id for x in got}) == len(got)
    rep = {x.source: x for x in mix.reached_shares(mix.mix(docs, w), w).collect()}
    for s in cap:
        assert abs(rep[s].actual_share - rep[s].target_share) < 0.01
        assert rep[s].size_used == sum(x.size * x.copies for x in got if x.source == s)
    assert rep["absent"].documents == 0 and rep["none"].size_used == 0
    short = {x.source: x for x in mix.reached_shares(mix.mix(docs, w, total=10**7), w).collect()}
    assert all(short[s].size_used == cap[s] * sum(x[2] or 0 for x in rows if x[1] == s) for s in cap)


def test_selected_size_is_within_one_document_of_the_rest(spark):
    docs = spark.createDataFrame([(i, "a", 10) for i in range(1000)] + [(i, "b", 10) for i in range(500)], D)
    w = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], W)
    got = mix.mix(docs, w).collect()
    assert sum(x.size for x in got if x.source == "b") == 5000
    assert 4990 <= sum(x.size for x in got if x.source == "a") <= 5000


def test_empty(spark):
    w = spark.createDataFrame([("a", 1.0, 1)], W)
    assert mix.mix(spark.createDataFrame([], D), w).count() == 0
    assert mix.mix(spark.createDataFrame([(1, "a", 5)], D), w.limit(0)).count() == 0
    assert mix.reached_shares(mix.mix(spark.createDataFrame([], D), w), w).collect()[0].actual_share == 0.0


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 5}", 1 + i % 7) for i in range(2000)], D)
    w = spark.createDataFrame([(f"s{k}", 0.2, k + 1) for k in range(5)], W)
    want = sorted(map(tuple, mix.mix(docs, w).collect()))
    rep = {x.source: x for x in mix.reached_shares(mix.mix(docs, w), w, docs).collect()}
    assert [s for s, x in rep.items() if x.limiting] == ["s0"] or sum(x.limiting for x in rep.values()) >= 1
    assert all(x.available == sum(1 + i % 7 for i in range(2000) if f"s{i % 5}" == s) for s, x in rep.items())
    monkeypatch.setattr(mix, "MOST_SOURCES", 2)
    assert sorted(map(tuple, mix.mix(docs, w).collect())) == want
