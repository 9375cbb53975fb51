import datetime as dt
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import split

T = dt.datetime(2025, 1, 1)
S = "document_id string, page int, text string, extracted_at timestamp"


def test_boundaries():
    text = 'One two. Three "four!" five (six?) \n seven\n \t\neight v1.2 nine) ten.” end'
    words = text.split()
    strength = split.boundaries(text)[2]
    assert [words[i] for i in range(1, len(words)) if strength[i] == 1] == ["Three", "five", "seven", "end"]
    assert [words[i] for i in range(1, len(words)) if strength[i] == 2] == ["eight"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.!?\"')]”’ \n\t\u00a0\x1c漢😀", max_size=40))
def test_boundaries_as_by_regular_expressions(text):
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    begins, ends, strength = split.boundaries(text)
    assert list(zip(begins.tolist(), ends.tolist())) == spans and len(strength) == len(spans) + 1
    for i in range(1, len(spans)):
        gap = text[spans[i - 1][1] : spans[i][0]]
        sentence = re.search(r"""[.!?]["')\]»”’]*$""", text[slice(*spans[i - 1])])
        assert strength[i] == (2 if re.search(r"\n[ \t]*\n", gap) else 1 if sentence else 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 0, 1, 2]), min_size=1, max_size=200), st.integers(1, 200), st.integers(1, 200))
def test_strongest_cut_is_rightmost_maximum(values, a, b):
    lo, hi = sorted((a % len(values), b % len(values)))
    place, kind = split.StrongestCut(np.array(values), len(values)).best(lo, hi)
    assert kind == max(values[lo : hi + 1]) and place == max(i for i in range(lo, hi + 1) if values[i] == kind)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 0, 0, 1, 2]), max_size=150))
def test_pieces_cover_the_text_with_overlap(values):
    strength = np.array([2, *values, 2])
    table = split.StrongestCut(strength, 20)
    cuts = split.cut_points(strength, table, 20, 10, 4)
    assert split.must_be_forced(strength, table, 20) == (np.diff(np.flatnonzero(strength)).max() > 20)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(strength) - 1
    for (a, b, kind), (c, _, _) in zip(cuts, cuts[1:]):
        assert c == b - 4 and 4 < b - a <= 20 and kind == strength[b] or kind == 0
        if kind == 0:  # a cut in mid-sentence only where no boundary would do
            assert not strength[a + 5 : a + 21].any() and b == a + 20


def test_pages(spark):
    r = random.Random(2)
    long = " ".join(f"w{i}" + ("." if r.random() < 0.05 else "") for i in range(5000))
    flat = "\n".join(f"w{i}" for i in range(301))
    rows = [("a", 1, long, T), ("a", 1, long, T), ("a", 2, None, T), ("a", 3, " \n\t", T), ("a", 4, "", T), ("b", 1, flat, T), ("b", 1, "old", T - dt.timedelta(1)), ("b", 2, "short text", None), (None, 1, "x", T), ("c", None, "x", T)]
    df = spark.createDataFrame([(*x, 5, "p") for x in rows], S + ", index int, piece string")
    out = split.split_texts(df).orderBy("document_id", "page", "index").collect()
    assert {(x.document_id, x.page) for x in out} == {("a", 1), ("b", 1), ("b", 2)}
    assert all(x.n_words == len(x.piece.split()) <= 300 for x in out)
    a = [x for x in out if x.document_id == "a"]
    assert [x["index"] for x in a] == list(range(len(a)))
    assert " ".join([a[0].piece, *[" ".join(x.piece.split()[50:]) for x in a[1:]]]) == long
    assert {(x.document_id, x.page) for x in out if x.forced} == {("b", 1)}
    assert split.split_texts(df.limit(0)).count() == 0
