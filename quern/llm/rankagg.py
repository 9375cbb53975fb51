"""One ranking from several scores on unlike scales, by robust rank aggregation.

Only the order within each score list counts, so no score leads by its range. An item's normalised
ranks are sorted; under the null hypothesis of random lists the k-th smallest of them follows a
beta distribution, and the smallest of these probabilities, corrected for the number of lists, is
the item's significance. List weights generalise the number of lists: a list of weight w stands
for w equal lists (w need not be whole, as the beta distribution is not confined to that).

The minimum hangs on a single order statistic: what an item reaches in its other lists does not
count, so an item that is first in three lists and tenth in one can fall behind one that is third
in all. The significance is therefore stabilised as by a jackknife: it is evaluated for every
pair of lists alone, the others left out, and the geometric mean of these is what ranks.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..operators.skew import rank_descending
from ..session import written

#: Score columns, and which of a ranker's weights goes with each.
LISTS = {"kw": "w_kw", "coverage": "w_kw", "tfidf": "w_kw", "vec": "w_vec"}


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, for arrays of equal length."""
    a, b, x = (np.asarray(v, dtype=np.float64) for v in (a, b, x))
    flip = x > (a + 1) / (a + b + 2)  # the fraction converges fast on this side only
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    pairs, which = np.unique(np.stack([p, q]), axis=1, return_inverse=True)
    beta = np.array([math.lgamma(u + v) - math.lgamma(u) - math.lgamma(v) for u, v in pairs.T])[which.ravel()]
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(beta + p * np.log(y) + q * np.log1p(-y)) / p
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 200):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    part = np.where(y <= 0, 0.0, front * h)
    return np.clip(np.where(flip, 1 - part, part), 0.0, 1.0)


def least_probability(ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per row, the smallest beta probability of its weighted, sorted normalised ranks."""
    order = np.argsort(ranks, axis=1, kind="stable")
    r, w = np.take_along_axis(ranks, order, 1), np.take_along_axis(weights, order, 1)
    upto = np.cumsum(w, axis=1)
    p = beta_cdf(upto.ravel(), (upto[:, -1:] - upto + 1).ravel(), r.ravel()).reshape(r.shape)
    return p.min(axis=1)


def stable_probability(ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per row, the geometric mean over all pairs of lists of the least probability within the pair."""
    n, lists = ranks.shape
    pairs = list(combinations(range(lists), 2))
    r, w = np.concatenate([ranks[:, p] for p in pairs]), np.concatenate([weights[:, p] for p in pairs])
    logs = np.log(np.maximum(least_probability(r, w), 1e-300)).reshape(len(pairs), n)
    return np.exp(np.round(logs.mean(axis=0), 12))  # so that equal items stay equal whatever the order of their lists


@pandas_udf(DoubleType())
def _significance(kw: pd.Series, coverage: pd.Series, tfidf: pd.Series, vec: pd.Series, w_kw: pd.Series, w_vec: pd.Series) -> pd.Series:
    ranks = np.stack([kw, coverage, tfidf, vec], axis=1)
    weights = np.stack([w_kw, w_kw, w_kw, w_vec], axis=1)
    return pd.Series(stable_probability(ranks, weights) if len(ranks) else np.empty(0))


def latest_candidates(scores: DataFrame) -> DataFrame:
    """The last scored row of each (query_id, doc_id), with absent scores as null.

    Absent is null, NaN, infinite or not above zero. Of rows scored at the same time the larger
    scores count; a null time is the earliest. Rows without a query or document id are left out.
    """
    best = F.max(F.struct("scored_at", *LISTS)).alias("b")
    rows = scores.where(F.col("query_id").isNotNull() & F.col("doc_id").isNotNull()).groupBy("query_id", "doc_id").agg(best)

    def usable(c: str):
        v = F.col(f"b.{c}").cast("double")
        return F.when(~F.isnan(v) & (v > 0) & (v < float("inf")), v).alias(c)

    return rows.select("query_id", "doc_id", *[usable(c) for c in LISTS])


def ranker_weights(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """``(query_id, w_kw, w_vec)``; a weight that is null, not a number, not above zero or of an unknown ranker is 1."""

    def usable(c: str):
        v = F.col(c).cast("double")
        return F.coalesce(F.when(~F.isnan(v) & (v > 0) & (v < float("inf")), v), F.lit(1.0)).alias(c)

    one = weights.groupBy("ranker").agg(F.max("w_kw").alias("w_kw"), F.max("w_vec").alias("w_vec"))
    return queries.select("query_id", "ranker").dropDuplicates(["query_id"]).join(one, "ranker", "left").select("query_id", usable("w_kw"), usable("w_vec"))


def aggregate_ranks(scores: DataFrame, queries: DataFrame, weights: DataFrame, cut: int = 200_000) -> DataFrame:
    """``(query_id, doc_id, significance, mean_rank)`` for each candidate of the given queries.

    A candidate's normalised rank in a list is its place (ties share the middle one) over the
    number of the query's candidates, and 1 where the score is absent. ``significance`` is the
    stabilised minimum times the two lists of a pair, at most 1; smaller is better. Candidates of
    queries that are not in ``queries`` are left out; extra columns are ignored. A query of more
    than ``cut`` candidates is ranked in slices (see ``rank_descending``), with the same result.
    """
    wanted = ranker_weights(queries, weights)
    rows = written(latest_candidates(scores).join(wanted, "query_id"), "candidates")  # read four times
    sizes = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.where(F.col("n") > cut)

    by = Window.partitionBy("query_id")
    usual = rows.join(hot.select("query_id"), "query_id", "left_anti").withColumn("n", F.count(F.lit(1)).over(by))
    for c in LISTS:
        down = by.orderBy(F.col(c).desc_nulls_last())
        usual = usual.withColumn(f"r_{c}", F.rank().over(down) + (F.count(c).over(down.rangeBetween(0, 0)) - 1) / 2)
    # nulls are told apart only after ranking, so that each list keeps its own
    usual = usual.select("query_id", "doc_id", "w_kw", "w_vec", *[F.when(F.col(c).isNull(), 1.0).otherwise(F.col(f"r_{c}") / F.col("n")).alias(c) for c in LISTS])

    large = rows.join(hot, "query_id")
    long = large.select("query_id", "doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("list"), F.col(c).alias("score")) for c in LISTS])).alias("e")).select("query_id", "doc_id", "e.*").where("score is not null")
    placed = rank_descending(long, ["query_id", "list"], "score", "doc_id", cut)
    wide = placed.groupBy("query_id", "doc_id").agg(*[F.max(F.when(F.col("list") == c, F.col("rank_mid"))).alias(f"r_{c}") for c in LISTS])
    large = large.select("query_id", "doc_id", "w_kw", "w_vec", "n").join(wide, ["query_id", "doc_id"], "left")
    large = large.select("query_id", "doc_id", "w_kw", "w_vec", *[F.coalesce(F.col(f"r_{c}") / F.col("n"), F.lit(1.0)).alias(c) for c in LISTS])

    both = usual.unionByName(large)
    mean = sum(F.col(c) * F.col(w) for c, w in LISTS.items()) / (3 * F.col("w_kw") + F.col("w_vec"))
    least = _significance(*LISTS, "w_kw", "w_vec")
    return both.select("query_id", "doc_id", least.alias("least"), mean.alias("mean_rank")).select("query_id", "doc_id", F.least(F.lit(1.0), F.col("least") * 2).alias("significance"), "least", "mean_rank")


def ranking(scores: DataFrame, queries: DataFrame, weights: DataFrame, top: int | None = None, cut: int = 200_000) -> DataFrame:
    """``aggregate_ranks`` with ``position`` from 1 within each query: by significance, mean rank, doc_id.

    With ``top``, only the leading ones; each map task then keeps no more than that of a query before
    the shuffle. Without it, the positions of all candidates need a sort per query.
    """
    order = Window.partitionBy("query_id").orderBy("least", "mean_rank", "doc_id")
    rows = aggregate_ranks(scores, queries, weights, cut).withColumn("position", F.row_number().over(order))
    if top is not None:
        rows = rows.where(F.col("position") <= top)
    return rows.select("query_id", "doc_id", "position", "significance", "mean_rank")
