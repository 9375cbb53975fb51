"""Cutting long texts into pieces at natural boundaries, with overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as regular expressions have it, by code point; none lies above the ideographic space.
SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
#: What ends a sentence, and the closing marks that may follow it.
ENDS, CLOSING = np.array([ord(c) for c in ".!?"]), np.array([ord(c) for c in "\"')]»”’"])
NONE, SENTENCE, PARAGRAPH = 0, 1, 2


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the strength of the gap before word i at place i (ends are paragraphs)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = SPACE[np.minimum(c, len(SPACE) - 1)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    begins, ends = edge[::2], edge[1::2]
    n = len(begins)
    strength = np.zeros(n + 1, dtype=np.int64)
    # a sentence ends where a word does after its closing marks
    last, closing = ends - 1, np.isin(c, CLOSING)
    back = np.flatnonzero(closing[last])
    while len(back):
        last[back] -= 1
        back = back[last[back] >= begins[back]]
        back = back[closing[last[back]]]
    strength[1:][np.isin(c[np.maximum(last, 0)], ENDS) & (last >= begins)] = SENTENCE
    # a blank line: two line breaks in a row with nothing but spaces and tabs between
    lines = np.flatnonzero(c == 10)
    other = np.cumsum((c != 32) & (c != 9))
    blank = lines[:-1][other[lines[1:]] - other[lines[:-1]] == 1]
    strength[np.searchsorted(begins, blank)] = PARAGRAPH
    strength[0] = strength[n] = PARAGRAPH
    return begins, ends, strength


class StrongestCut:
    """Sparse table over boundary strengths: the strongest cut of any range of up to ``widest``, the rightmost of equals, in constant time."""

    def __init__(self, strength: np.ndarray, widest: int):
        level = strength.astype(np.int64) << 40 | np.arange(len(strength), dtype=np.int64)
        self.levels = [level]
        width = 1
        while 2 * width <= min(widest, len(strength)):
            level = np.maximum(level[: len(level) - width], level[width:])
            self.levels.append(level)
            width *= 2

    def best(self, lo, hi):
        """(place, strength) of the best cut in lo..hi, both ends included; for numbers, or for arrays of ranges of one width."""
        k = int(np.max(hi - lo) + 1).bit_length() - 1
        key = np.maximum(self.levels[k][lo], self.levels[k][hi - (1 << k) + 1])
        return key & (1 << 40) - 1, key >> 40


def cut_points(strength: np.ndarray, table: StrongestCut, most: int, least: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first word, end word, strength of the cut) of each piece.

    The cut is the strongest in the window ``least..most`` words after the piece's start, the
    rightmost of equals; if there is none, the strongest before that window which still leaves
    more than the overlap; if there is none either, the piece is full. The next piece starts ``overlap`` words back.
    """
    n, start, out = len(strength) - 1, 0, []
    while n - start > most:
        cut, kind = table.best(start + least, start + most)
        if kind == NONE and least > overlap + 1:
            early, other = table.best(start + overlap + 1, start + least - 1)
            if other != NONE:
                cut, kind = early, other
        out.append((start, int(cut), int(kind)))
        start = int(cut) - overlap
    if n:
        out.append((start, n, PARAGRAPH))
    return out


def must_be_forced(strength: np.ndarray, table: StrongestCut, most: int) -> bool:
    """Whether after some boundary none of the next ``most`` places is one, so that no piece from there ends naturally."""
    start = np.flatnonzero(strength)
    start = start[start + most < len(strength)]
    return bool(len(start)) and bool((table.best(start + 1, start + most)[1] == NONE).any())


def split_texts(pages: DataFrame, most: int = 300, overlap: int = 50, least: int = 150) -> DataFrame:
    """``(document_id, page, index, first_word, n_words, cut, forced, piece)`` of each page's current text.

    A page's current text is that of its latest ``extracted_at`` (then the larger text); rows
    without a document or page are left out, null, empty and blank texts give no piece, texts of up
    to ``most`` words one. ``cut`` tells what ends the piece (2 paragraph or end, 1 sentence, 0 neither);
    ``forced`` tells that the page cannot be split at natural boundaries alone. The text between
    a piece's words is kept as it was. Extra columns are ignored.
    """
    if not 0 <= overlap < least <= most:
        raise ValueError("0 <= overlap < least <= most")

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, page, text in zip(frame["document_id"], frame["page"], frame["text"]):
                begins, ends, strength = boundaries(text)
                table = StrongestCut(strength, most)
                forced = must_be_forced(strength, table, most)
                for i, (a, b, kind) in enumerate(cut_points(strength, table, most, least, overlap)):
                    rows.append((doc, page, i, a, b - a, kind, forced, text[begins[a] : ends[b - 1]]))
            yield pd.DataFrame(rows, columns=["document_id", "page", "index", "first_word", "n_words", "cut", "forced", "piece"])

    best = F.max(F.struct("extracted_at", "text")).alias("b")
    now = pages.where(F.col("document_id").isNotNull() & F.col("page").isNotNull()).groupBy("document_id", "page").agg(best)
    now = now.select("document_id", "page", F.col("b.text").alias("text")).where(F.col("text").rlike(r"\S"))
    return now.mapInPandas(pieces, "document_id string, page int, index int, first_word int, n_words int, cut int, forced boolean, piece string")
