"""Vector functions: column expressions for a row's own vectors, Arrow UDFs where NumPy is needed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

FLOATS = ArrayType(FloatType())


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    """Inner product in double; 0 for unequal lengths, nulls or empty vectors."""
    p = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.coalesce(F.when(F.size(_c(a)) == F.size(_c(b)), _sum(p)), F.lit(0.0))


def magnitude(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    m = magnitude(a) * magnitude(b)
    return F.when(m > 0, dot(a, b) / m).otherwise(0.0)


def l2(a, b) -> Column:
    """Euclidean distance; the largest float for unequal lengths."""
    p = F.zip_with(_c(a), _c(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.coalesce(F.when(F.size(_c(a)) == F.size(_c(b)), F.sqrt(_sum(p))), F.lit(3.4028234663852886e38))


def l2_normalised(a) -> Column:
    """Unit vector; a zero vector stays."""
    m = magnitude(a)
    return F.when(m > 0, F.transform(_c(a), lambda x: x / m)).otherwise(F.transform(_c(a), lambda x: x.cast("double")))


def mean_pooled(hidden, mask) -> Column:
    """Mean of the token vectors whose mask is not 0; zeros where all are padding."""
    kept = F.transform(F.filter(F.arrays_zip(_c(hidden).alias("h"), _c(mask).alias("m")), lambda z: z["m"] != 0), lambda z: z["h"])
    zero = F.transform(_c(hidden)[0], lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


@pandas_udf(FLOATS)
def half_precision(vectors: pd.Series) -> pd.Series:
    """Values after a round trip through 16-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype=np.float16).astype(np.float32))


def fnv64(texts: list[bytes]) -> np.ndarray:
    """FNV-1a hashes, all texts a byte further at each step: the longest go first, so those still going are a prefix."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    h = np.full(len(texts), 0xCBF29CE484222325, dtype=np.uint64)
    prime, at = 0x100000001B3, 0
    while len(sizes) and (going := int(np.searchsorted(-sizes, -at, "left"))) >= 16:
        h[:going] = (h[:going] ^ flat[starts[:going] + at]) * np.uint64(prime)
        at += 1
    for i in np.flatnonzero(sizes > at):  # the last few, much longer than the rest
        x = int(h[i])
        for byte in flat[starts[i] + at : starts[i] + sizes[i]].tolist():
            x = (x ^ byte) * prime & 0xFFFFFFFFFFFFFFFF
        h[i] = x
    out = np.empty_like(h)
    out[order] = h
    return out


def seeded_vectors(texts: list[str], dims: int = 384) -> np.ndarray:
    """A unit vector per text, from a shift-register sequence seeded by the text's FNV-1a hash; all texts step together."""
    state = fnv64([t.encode() for t in texts])
    out = np.empty((len(texts), dims), dtype=np.float32)
    for i in range(dims):
        state ^= state << np.uint64(13)
        state ^= state >> np.uint64(7)
        state ^= state << np.uint64(17)
        out[:, i] = state.view(np.int64).astype(np.float32) / np.float32(2.0**63)
    norm = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)
    return out / np.where(norm > 0, norm, 1)[:, None]


def seeded_embedder(dims: int = 384):
    """The stand-in embedder; any function of a series of texts to a series of vectors takes its place."""

    @pandas_udf(FLOATS)
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(seeded_vectors([t or "" for t in texts], dims)))

    return embed


def embedded(rows: DataFrame, column: str, embedder) -> DataFrame:
    """``rows`` with ``vector``, by an Arrow UDF of text to vector that sees each distinct text once.

    Texts meet by a 128-bit hash, so only one copy of each is passed on, in batches of like
    length, which is what padding models want. Null texts have a null vector; a failing embedder fails
    the job and leaves nothing behind.
    """
    key = [F.xxhash64(column).alias("__a"), F.xxhash64(F.lit(1), column).alias("__b")]
    one = rows.where(F.col(column).isNotNull()).select(*key, F.col(column).alias("__text")).groupBy("__a", "__b").agg(F.min("__text").alias("__text"))
    made = one.sortWithinPartitions(F.length("__text")).select("__a", "__b", embedder("__text").alias("vector"))
    named = rows.drop("vector").select("*", *[F.when(F.col(column).isNotNull(), k).alias(n) for k, n in zip(key, ("__a", "__b"))])
    return named.join(made, ["__a", "__b"], "left").drop("__a", "__b")
