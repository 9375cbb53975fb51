import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe

ENC = bpe.encoder()


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab 'sZé1\n\t  \x1c漢😀.<|>"), max_size=60), st.integers(1, 9))
def test_parts_and_merges_give_the_same_ids(text, size):
    whole = ENC.encode_ordinary(text)
    assert [i for p in bpe.safe_parts(text, size) for i in ENC.encode_ordinary(p)] == whole
    pieces = [m.group() for m in bpe._pieces().finditer(text)]
    assert "".join(pieces) == text and [i for p in pieces for i in bpe._merge_piece(ENC, p.encode())] == whole
    assert bpe.decode(whole, ENC).decode() == text


@pytest.mark.parametrize("text", ["ab" * 9000, "word " * 30_000, " " * 9000 + "x", "é漢" * 3000 + "\n" * 7000])
def test_long_texts(text):
    ids = bpe.encode(text, ENC)
    assert bpe.decode(ids, ENC).decode() == text
    if len(text) < 20_000:
        assert ids.tolist() == ENC.encode_ordinary(text)


def test_a_million_letters_in_one_run():
    text = "abcdefghij" * 100_000
    assert bpe.decode(bpe.encode(text, ENC), ENC) == text.encode()


def test_columns(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "<|endoftext|> hi", 7), (3, "<|endoftext|> hi", 7), (4, "x " * 40_000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.encode_column(df)
    assert out.columns == ["doc_id", "text", "ids"] and dict(out.dtypes)["ids"] == "array<int>"
    got = [r.ids for r in out.orderBy("doc_id").collect()]
    assert got[:2] == [[], []] and 50256 not in got[2] and got[2] == got[3]
    back = bpe.decode_column(out).orderBy("doc_id").collect()
    assert [bytes(r.bytes).decode() for r in back] == [t or "" for _, t, _ in rows]
    assert bpe.encode_column(df.limit(0)).count() == 0
    counts = bpe.encode_column(df, out="n", counts_only=True).orderBy("doc_id").collect()
    assert [r.n for r in counts] == [len(x) for x in got]


def test_every_vocabulary(spark):
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        assert np.array_equal(bpe.encode("Über 12 naïve", bpe.encoder(name=name)), bpe.encoder(name=name).encode_ordinary("Über 12 naïve"))
