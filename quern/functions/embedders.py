"""Embedders as Arrow UDFs of text to vector: a local ONNX model, an HTTP service; WordPiece ids for models."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from urllib.request import Request, urlopen

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType, IntegerType

# Vector lengths of known models of the HTTP service.
DIMENSIONS = {"nomic-embed-text": 768, "mxbai-embed-large": 1024, "all-minilm": 384}
_RUN = re.compile(r"[^\W_]+|\S", re.UNICODE)


def dimensions(model: str) -> int:
    """Vector length of a known model, else 0."""
    return DIMENSIONS.get(model, 0)


def _punctuation(ch: str) -> bool:
    return unicodedata.category(ch)[0] in "PS"


class WordPiece:
    """Ids of a text: lower case, split at white space and around punctuation and symbols, longest known piece first.

    ``vocab`` is a file with one piece a line, or a dict. A word with a part that is not known is
    one [UNK]. Words are cut once each, as most of a corpus are repeats.
    """

    def __init__(self, vocab: str | dict[str, int], most: int = 256, kept: int = 100_000):
        if isinstance(vocab, str):
            with open(vocab, encoding="utf-8") as f:
                vocab = {line.rstrip("\n"): i for i, line in enumerate(f)}
        self.vocab, self.most = vocab, most
        self.longest = max(map(len, vocab), default=1)
        self.word = lru_cache(kept)(self._word)

    def _word(self, word: str) -> tuple[int, ...]:
        ids, start, mark = [], 0, ""
        while start < len(word):
            for end in range(min(len(word), start + self.longest), start, -1):
                if (found := self.vocab.get(mark + word[start:end])) is not None:
                    break
            else:
                return (self.vocab["[UNK]"],)
            ids.append(found)
            start, mark = end, "##"
        return tuple(ids)

    @staticmethod
    def split(text: str) -> list[str]:
        found = _RUN.findall(text.lower())
        if all(len(p) > 1 or p.isalnum() or _punctuation(p) for p in found):
            return found
        out = []  # marks that are neither letters nor punctuation stay with their word
        for chunk in text.lower().split():
            word = ""
            for ch in chunk:
                if _punctuation(ch):
                    out += [word, ch] if word else [ch]
                    word = ""
                else:
                    word += ch
            if word:
                out.append(word)
        return out

    def ids(self, text: str | None) -> list[int]:
        """[CLS], the pieces, [SEP]: at most ``most`` in all; null is like an empty text."""
        pieces = [i for w in self.split(text or "") for i in self.word(w)]
        return [self.vocab["[CLS]"], *pieces[: self.most - 2], self.vocab["[SEP]"]]


def wordpiece_ids(vocab: str | dict[str, int], most: int = 256):
    """A column of WordPiece ids; a vocabulary file must lie on every worker."""
    held: list[WordPiece] = []

    @pandas_udf(ArrayType(IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(WordPiece(vocab, most))
        return texts.map(held[0].ids)

    return encode


def padded_length(n: int, most: int = 256) -> int:
    """The length that an input of ``n`` ids is padded to: the next multiple of 8."""
    return min(most, -(-n // 8) * 8)


def mean_of_tokens(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit mean vectors of the tokens that are no padding; zeros stay zeros."""
    total = (hidden * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.where(norm > 0, norm, 1)).astype(np.float32)


def onnx_embedder(model: str, vocab: str | dict[str, int], batch: int = 64, most: int = 256):
    """Vectors of a sentence model in ONNX: WordPiece, inference, mean of the tokens, unit length.

    ``model`` and ``vocab`` are files on every worker. Texts run in batches of like length, padded to a multiple of 8.
    """
    held: list = []

    @pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        if not held:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1  # the executor's cores are taken by tasks
            held.extend([onnxruntime.InferenceSession(model, options), WordPiece(vocab, most)])
        session, pieces = held
        names = {i.name for i in session.get_inputs()}
        ids = [pieces.ids(t) for t in texts]
        order = np.argsort([len(i) for i in ids], kind="stable")
        out: list = [None] * len(ids)
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            width = padded_length(max(len(ids[i]) for i in part), most)
            block = np.zeros((len(part), width), dtype=np.int64)
            mask = np.zeros_like(block)
            for line, i in enumerate(part):
                block[line, : len(ids[i])], mask[line, : len(ids[i])] = ids[i], 1
            every = {"input_ids": block, "attention_mask": mask, "token_type_ids": np.zeros_like(block)}
            hidden = session.run(None, {n: v for n, v in every.items() if n in names})[0]
            for i, v in zip(part, mean_of_tokens(np.asarray(hidden, dtype=np.float32), mask)):
                out[i] = v
        return pd.Series(out)

    return embed


def http_embedder(base: str = "http://localhost:11434", model: str = "nomic-embed-text", timeout: float = 30.0):
    """Vectors of an HTTP embedding service (one prompt a request); a text that fails has a null vector, which matches nothing."""

    @pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        def one(text):
            body = json.dumps({"model": model, "prompt": text or ""}).encode()
            request = Request(f"{base}/api/embeddings", body, {"Content-Type": "application/json"})
            try:
                with urlopen(request, timeout=timeout) as answer:
                    return json.load(answer)["embedding"]
            except (OSError, ValueError, KeyError):
                return None

        return texts.map(one)

    return embed
