"""Retrieval quality and latency figures."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def recall(results: DataFrame, qrels: DataFrame, corpus: DataFrame, cuts: tuple[int, ...] = (10,)) -> DataFrame:
    """One row: evaluated queries and the share with a relevant document among the first n, for each cut.

    Only relevant documents that are in the corpus count, and only queries that have one; 0 where there is none.
    """
    known = qrels.join(corpus.select("doc_id"), "doc_id", "left_semi")
    best = known.join(results.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("r"))
    share = lambda n: F.coalesce(F.avg(F.when(F.col("r") <= n, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"recall_{n}")
    return best.agg(F.count(F.lit(1)).alias("queries"), *[share(n) for n in cuts])


def nearest_rank_percentiles(values: DataFrame, column: str, group: list[str], shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The value at place floor(n * share) (from 0) of each group's sorted values; nulls left out.

    Values are counted first, so equal ones take one row, and ``cut`` places are found by running counts.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy(*group)
    run = counts.withColumn("upto", F.sum("c").over(by.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(by))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col(column))).alias(f"p{round(p * 100)}")
    return run.groupBy(*group).agg(*[at(p) for p in shares])


def list_figures(lists: dict[str, DataFrame], qrels: DataFrame, corpus: DataFrame, cuts: tuple[int, ...] = (10, 20, 50, 100)) -> DataFrame:
    """One row on two lists ``(query_id, doc_id, rank)`` of the same queries: ``queries``, ``<list>_<cut>``, ``union_10``, ``both_10``, ``neither_50``.

    Shares of the queries that have a relevant document in the corpus; 0 where there is none.
    """
    base = qrels.join(corpus.select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id")
    best = base.select("query_id").distinct()
    for name, rows in lists.items():
        at = base.join(rows.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias(name))
        best = best.join(at, "query_id", "left")
    within = lambda name, n: F.coalesce(F.col(name) <= n, F.lit(False))
    share = lambda c, alias: F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0)).alias(alias)
    every = lambda n, f: f(*[within(name, n) for name in lists])
    union, both = lambda *c: functools.reduce(Column.__or__, c), lambda *c: functools.reduce(Column.__and__, c)
    return best.agg(
        F.count(F.lit(1)).alias("queries"),
        *[share(within(name, n), f"{name}_{n}") for name in lists for n in cuts],
        share(every(10, union), "union_10"), share(every(10, both), "both_10"), share(~every(50, union), "neither_50"),
    )


def padded_lengths(lengths: DataFrame, batch: int = 64) -> DataFrame:
    """One row on input lengths ``(id, n)``: count, mean, percentiles and the mean padded length of batches of ``batch``, by id and by length.

    Batches by length are the places of the sorted lengths; equal lengths are counted first, so
    nothing but the distinct lengths is sorted. Batches by id are numbered by a running count over ranges of ids.
    """
    counts = lengths.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    run = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as there are distinct lengths
    upto = counts.withColumn("upto", F.sum("c").over(run))
    total = lengths.agg(F.count(F.lit(1)).alias("total"))
    placed = upto.crossJoin(F.broadcast(total)).withColumn("from", F.col("upto") - F.col("c"))
    # a length decides its batch's maximum only where it is the batch's last
    ends = F.expr(f"floor((upto - 1) / {batch})")
    per = placed.select("n", "c", "upto", "total", F.explode(F.sequence(F.floor(F.col("from") / batch), ends)).alias("b"))
    size = F.least((F.col("b") + 1) * batch, F.col("total")) - F.col("b") * batch
    last = per.groupBy("b").agg((F.max("n") * F.max(size)).alias("cells"))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * p), F.col("n"))).alias(f"p{round(p * 100)}")
    figures = placed.agg(F.max("total").alias("texts"), (F.sum(F.col("n") * F.col("c")) / F.max("total")).alias("mean"), at(0.5), at(0.95), at(0.99), F.max("n").alias("longest"))
    by_id = _numbered(lengths).groupBy(F.floor(F.col("place") / batch).alias("b")).agg((F.max("n") * F.count(F.lit(1))).alias("cells"))
    mean = lambda df, name: df.agg(F.sum("cells").alias("cells")).crossJoin(F.broadcast(total)).select((F.col("cells") / F.col("total")).alias(name))
    return figures.crossJoin(mean(by_id, "padded_by_id")).crossJoin(mean(last, "padded_by_length"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place`` from 0 in the order of ``id``: sorted by ranges, whose sizes give the first place of each."""
    ordered = written(rows.orderBy("id").withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()), "ordered")
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("c"), F.min("i").alias("i0"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    starts = sizes.select("part", "i0", before.alias("start"))
    return ordered.join(F.broadcast(starts), "part").select(*rows.columns, (F.col("start") + F.col("i") - F.col("i0")).alias("place"))


def verdicts(results: DataFrame, expected: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """``(query_id, verdict)``, with ``category`` if ``expected`` has one: PASS for first place, RANK n for a later one, MISS for none, ERROR for ``errors`` (query_id)."""
    keys = ["query_id"] + (["category"] if "category" in expected.columns else [])
    found = expected.join(results.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left").groupBy(*keys).agg(F.min("rank").alias("r"))
    verdict = F.when(F.col("r") == 1, "PASS").when(F.col("r").isNotNull(), F.concat(F.lit("RANK "), F.col("r").cast("string"))).otherwise("MISS")
    if errors is None:
        return found.select(*keys, verdict.alias("verdict"))
    failed = errors.select("query_id").distinct().withColumn("failed", F.lit(True))
    return found.join(failed, "query_id", "left").select(*keys, F.when(F.col("failed"), "ERROR").otherwise(verdict).alias("verdict"))


def by_category(verdicts: DataFrame) -> DataFrame:
    """``(category, passed, ranked, missed, failed)``."""
    n = lambda start: F.count(F.when(F.col("verdict").startswith(start), 1))
    return verdicts.groupBy("category").agg(n("PASS").alias("passed"), n("RANK").alias("ranked"), n("MISS").alias("missed"), n("ERROR").alias("failed"))
