"""Encoding texts with a public byte-level BPE vocabulary, and decoding ids."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabulary files are; a parameter of every operator here.
FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Fixed value: the public pre-split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this are split first; a single run longer than RUN is encoded by pre-split pieces.
PART, RUN = 100_000, 5_000
#: No piece of PATTERN has a space after a non-space, so text may be cut before such a space.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])(?=[ \n])")


@lru_cache(maxsize=4)
def encoder(folder: str = FOLDER, name: str = NAME):
    """The encoder of a rank file, built once per worker process."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _pieces(pattern: str = PATTERN):
    """The pattern for the regex module, whose own idea of white space is wider than the property."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def safe_parts(text: str, size: int = PART) -> Iterator[str]:
    """Parts of about ``size`` characters whose encodings put together are that of the whole."""
    start = 0
    while len(text) - start > size:
        m = SAFE.search(text, start + size)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def _merge_piece(enc, piece: bytes) -> list[int]:
    """Byte pair merges of one long piece in n log n: a heap of pairs over a linked list.

    The library's own merge rescans a piece for each merge, which takes hours on a piece of a million bytes.
    """
    import heapq

    ranks = enc._mergeable_ranks
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # where the token that starts at i ends; 0: no token starts there
    before = list(range(-1, n))

    def rank(i: int) -> int | None:
        j = end[i]
        return None if j >= n else ranks.get(piece[i : end[j]])

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, e = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != e or ranks.get(piece[i:e]) != r:
            continue
        end[i], end[j] = e, 0
        before[e] = i
        for k in (i, before[i]):
            if k >= 0 and (q := rank(k)) is not None:
                heapq.heappush(heap, (q, k, end[end[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def encode(text: str | None, enc) -> np.ndarray:
    """Ids of a text without special tokens; strings that look like those are ordinary text. Null and empty give none."""
    if not text:
        return np.empty(0, dtype=np.int32)
    if len(text) <= RUN:
        return np.asarray(enc.encode_ordinary(text), dtype=np.int32)
    out: list[int] = []
    for part in safe_parts(text):
        if _longest_run(part) <= RUN:
            out += enc.encode_ordinary(part)
        else:
            for m in _pieces().finditer(part):
                piece = m.group()
                out += enc.encode_ordinary(piece) if len(piece) <= RUN else _merge_piece(enc, piece.encode())
    return np.asarray(out, dtype=np.int32)


def _longest_run(text: str) -> int:
    """Length of the longest run of one kind, space or not."""
    return max((len(m.group()) for m in regex.finditer(r"\s+|\S+", text)), default=0)


def decode(ids, enc) -> bytes:
    """The raw bytes of some ids; only whole texts are sure to be valid UTF-8."""
    return b"".join(enc.decode_single_token_bytes(int(i)) for i in ids)


def _slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts have about ``most_bytes``, so that long texts do not pile up."""
    texts = batch.column(column)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
    groups = np.cumsum(sizes) // most_bytes
    starts = [0, *(np.flatnonzero(np.diff(groups)) + 1), batch.num_rows]
    for a, b in zip(starts[:-1], starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encode_column(df: DataFrame, text: str = "text", out: str = "ids", folder: str = FOLDER, name: str = NAME, counts_only: bool = False) -> DataFrame:
    """``df`` with ``out``: the ids of ``text`` (or their number). An existing column ``out`` is replaced.

    Null and empty texts give an empty list (0). One pass of Arrow batches, no shuffle.
    """
    df = df.drop(out)
    kind = T.LongType() if counts_only else T.ArrayType(T.IntegerType())
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        enc = encoder(folder, name)
        for whole in batches:
            for batch in _slices(whole, text):
                ids = [encode(t, enc) for t in batch.column(text).to_pylist()]
                lengths = np.array([len(x) for x in ids], dtype=np.int64)
                if counts_only:
                    column = pa.array(lengths)
                else:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                    column = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.empty(0, dtype=np.int32)]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def decode_column(df: DataFrame, ids: str = "ids", out: str = "bytes", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """``df`` with ``out``: the raw bytes of ``ids``; null ids give null."""
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for batch in batches:
            raw = [None if x is None else decode(x, enc) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)
