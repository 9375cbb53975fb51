import datetime as dt
import math
import random
from collections import Counter

import pytest

from quern.llm import terms

T = dt.datetime(2025, 1, 1)
S = "doc_id long, revision int, tokens array<string>, indexed_at timestamp"


@pytest.fixture()
def rows():
    r = random.Random(5)
    out = []
    for d in range(60):
        words = ["the"] * 3 + [f"w{int(r.paretovariate(0.7)) % 40}" for _ in range(r.randrange(30))] + [None, ""]
        out.append((d, 2, words, T))
        out.append((d, 1, ["old"], T + dt.timedelta(9)))
    out += [(70, 1, ["gone"], T), (70, 2, None, T), (71, 1, [], T), (72, 1, [None, ""], T), (None, 1, ["x"], T), out[0]]
    return out


def current(rows):
    best = {}
    for d, rev, toks, _ in rows:
        if d is not None and (d not in best or rev > best[d][0]):
            best[d] = (rev, toks)
    return {d: [t for t in toks if t] for d, (_, toks) in best.items() if toks is not None}


def test_weights_and_counts_against_brute_force(spark, rows):
    docs = current(rows)
    tf = {d: Counter(t) for d, t in docs.items()}
    gf, df = Counter(), Counter()
    for c in tf.values():
        gf.update(c)
        df.update(c.keys())
    recs = terms.current_records(spark.createDataFrame([(*r, 1, "x") for r in rows], S + ", tf int, term string"))
    got = {(r.doc_id, r.term): r for r in terms.log_entropy(recs).collect()}
    assert set(got) == {(d, t) for d, c in tf.items() for t in c}
    for (d, t), r in got.items():
        h = -sum(c[t] / gf[t] * math.log(c[t] / gf[t]) for c in tf.values() if c[t])
        assert math.isclose(r.weight, math.log(1 + tf[d][t]) * max(0, 1 - h / math.log(len(docs))), abs_tol=1e-9)
        assert (r.tf, r.df, r.gf, r.doc_len) == (tf[d][t], df[t], gf[t], len(docs[d]))
    counts = {r.term: (r.occurrences, r.records, r.mark) for r in terms.marked_terms(recs).collect()}
    assert counts == {t: (gf[t], df[t], "rare" if df[t] == 1 else "common" if df[t] * 100 >= 30 * len(docs) else None) for t in gf}
    assert {r.term: r.records for r in terms.term_counts(recs, most=5).collect()} == dict(df)


def test_empty_one_record_and_a_long_record(spark):
    none = terms.current_records(spark.createDataFrame([], S))
    assert terms.log_entropy(none).count() == 0 and terms.marked_terms(none).count() == 0
    one = terms.current_records(spark.createDataFrame([(1, 1, ["a", "a", "b" * 100_000], T)], S))
    assert {r.tf: round(r.weight, 9) for r in terms.log_entropy(one).collect()} == {2: round(math.log(3), 9), 1: round(math.log(2), 9)}
    assert {r.mark for r in terms.marked_terms(one).collect()} == {"rare"}


def test_a_record_in_several_rows_counts_once(spark):
    r = random.Random(6)
    rows = [(r.randrange(20), [r.choice("abcdefgh") for _ in range(r.randrange(6))]) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(5)
    want = {t: (sum(w.count(t) for _, w in rows), len({d for d, w in rows if t in w})) for t in "abcdefgh"}
    for most in (1_000_000, 2):
        assert {x.term: (x.occurrences, x.records) for x in terms.term_counts(df, most).collect()} == want


def test_distinctive_terms(spark, rows):
    recs = terms.current_records(spark.createDataFrame(rows, S))
    every = terms.log_entropy(recs).collect()
    for low, high in ((2, 5), (2, 30)):
        got = {(x.doc_id, x.term) for x in terms.distinctive(recs, 2, 5, (low, high)).collect()}
        assert got == {(x.doc_id, x.term) for x in every if x.tf >= 2 and x.tf * 20 >= x.doc_len and low <= x.df <= high} and got
