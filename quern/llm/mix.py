"""Mixing sources to target shares of the total size, by hash thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Bits of the hash that one histogram resolves, and the number of nested histograms.
BITS, LEVELS = 12, 4
#: Most sources whose thresholds are broadcast; those of more are joined.
MOST_SOURCES = 100_000


def _digit(level: int):
    """The hash digit of a level, the first being the most significant."""
    return F.shiftrightunsigned(F.col("__h"), 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _held(per_source: DataFrame, few: bool) -> DataFrame:
    """One row per source, planned and run once: as a local relation where there are ``few``, else as a written table."""
    if not few:
        return written(per_source, "per-source")
    return per_source.sparkSession.createDataFrame(per_source.collect(), per_source.schema)


def plan_budgets(sizes: DataFrame, weights: DataFrame, total: float | None = None) -> DataFrame:
    """``(source, target_share, available, budget, passes, rest)`` for each source with a share.

    Without ``total`` the mixture is the largest in which every source that has any size reaches
    its share within its ``max_repeats``. ``passes`` is how often the whole source is used,
    ``rest`` the size still to be selected for one further use. A source whose cap is too small for a given
    ``total`` is used up to the cap and falls short. Null or negative shares and caps below one count as no share.
    """
    plan = weights.where((F.col("target_share") > 0) & (F.col("max_repeats") >= 1) & F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.sum("size").alias("available"))
    plan = plan.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    if total is None:
        reach = F.when(F.col("available") > 0, F.col("available") * F.col("max_repeats") / F.col("target_share"))
        limit = plan.agg(F.coalesce(F.min(reach), F.lit(0.0)).alias("__total"))
    else:
        limit = plan.agg(F.lit(float(total)).alias("__total"))
    plan = plan.crossJoin(F.broadcast(limit))
    # a hair is taken off so that a source exactly at its cap is not asked for more through rounding
    budget = F.floor(F.col("__total") * F.col("target_share") + 1e-6)
    plan = plan.withColumn("budget", budget)
    passes = F.when(F.col("available") > 0, F.least(F.col("max_repeats"), F.floor(F.col("budget") / F.col("available")))).otherwise(0).cast("int")
    plan = plan.withColumn("passes", passes)
    rest = F.when(F.col("passes") < F.col("max_repeats"), F.least(F.col("available"), F.col("budget") - F.col("passes") * F.col("available"))).otherwise(0)
    return plan.withColumn("rest", rest.cast("long")).select("source", "target_share", "available", "budget", "passes", "rest")


def mix(sizes: DataFrame, weights: DataFrame, total: float | None = None, seed: int = 17) -> DataFrame:
    """``(doc_id, source, size, copies)`` for each document that is used; ``sizes`` is ``(doc_id, source, size)``.

    The hash of a document decides whether it is in its source's rest: those below a threshold are.
    The threshold comes from nested histograms. The first adds up sizes by source and the hash's
    first 12 bits; the bucket in which the rest is reached is refined by the next 12 bits, and so on.
    Each histogram has at most 4096 rows a source and combines before its shuffle, so neither a hot
    source nor the number of documents matters, and nothing is sorted. The selected size falls short
    of the rest by less than one document, or one group of documents with equal hash. Documents
    without a source or of a source without a share take no part; sizes that are null count as 0.
    ``sizes`` is read three times and should be a written table; the finer histograms read only the
    documents of the boundary buckets. Thresholds of up to ``MOST_SOURCES`` sources are broadcast, those
    of more are joined.
    """
    few = weights.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    sent = F.broadcast if few else lambda df: df
    rows = sizes.where(F.col("source").isNotNull()).select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    budgets = _held(plan_budgets(rows, weights, total), few)
    docs = rows.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", "source"))
    edge = budgets.select("source", F.col("rest").alias("__left"))
    inside = docs
    for level in range(LEVELS):
        if level == 1:  # from here on only the boundary buckets count
            inside = docs.join(sent(edge.select("source", "__d0")), "source").where(_digit(0) == F.col("__d0")).select(*docs.columns)
            inside = written(inside, "boundary")
        at = inside.join(sent(edge), "source")
        for k in range(level):
            at = at.where(_digit(k) == F.col(f"__d{k}"))
        known = [f"__d{k}" for k in range(level)]
        bars = at.groupBy("source", "__left", *known, _digit(level).alias("__d")).agg(F.sum("size").alias("__size"))
        upto = Window.partitionBy("source").orderBy("__d")
        bars = bars.withColumn("__upto", F.sum("__size").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        # the first bar that does not fit is the boundary; where all fit, it lies beyond the last
        fits = F.col("__upto") <= F.col("__left")
        step = bars.groupBy("source", "__left", *known).agg(
            F.coalesce(F.min(F.when(~fits, F.col("__d"))), F.lit(1 << BITS)).alias(f"__d{level}"),
            F.coalesce(F.max(F.when(fits, F.col("__upto"))), F.lit(0)).alias("__took"),
        )
        # a source that ended at a higher level has no documents here and keeps what it has
        step = edge.join(step.select("source", f"__d{level}", "__took"), "source", "left")
        edge = _held(step.select("source", *known, F.coalesce(F.col(f"__d{level}"), F.lit(1 << BITS)).alias(f"__d{level}"), (F.col("__left") - F.coalesce("__took", F.lit(0))).alias("__left")), few)
    names = [f"__d{k}" for k in range(LEVELS)]
    use = budgets.select("source", "passes", "rest").join(edge.select("source", *names), "source", "left")
    below, equal = F.lit(False), F.lit(True)
    for k in range(LEVELS):
        below = below | (equal & (_digit(k) < F.col(f"__d{k}")))
        equal = equal & (_digit(k) == F.col(f"__d{k}"))
    extra = F.when((F.col("rest") > 0) & F.coalesce(below, F.lit(False)), 1).otherwise(0)
    out = docs.join(sent(use), "source").withColumn("copies", F.col("passes") + extra)
    return out.where(F.col("copies") > 0).select("doc_id", "source", "size", "copies")


def reached_shares(mixed: DataFrame, weights: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``(source, target_share, documents, size_used, actual_share)`` for each source of ``weights``.

    With ``sizes`` also ``available``, the source's size, and ``limiting``: the mixture without a
    given total can be no larger because this source's size times its repeats is used up.
    """
    used = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("size") * F.col("copies")).alias("size_used"))
    all_used = used.agg(F.sum("size_used").alias("__all"))
    one = weights.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = one.join(used, "source", "left").crossJoin(F.broadcast(all_used))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = F.coalesce(F.col("size_used") / F.nullif(F.col("__all"), F.lit(0)), F.lit(0.0)).alias("actual_share")
    if sizes is None:
        return rows.select("source", "target_share", zero("documents"), zero("size_used"), share)
    have = sizes.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("size").alias("available"))
    reach = F.when((F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1), F.col("available") * F.col("max_repeats") / F.col("target_share"))
    least = one.join(have, "source").agg(F.min(reach).alias("__least"))
    rows = rows.join(have, "source", "left").crossJoin(F.broadcast(least))
    return rows.select("source", "target_share", zero("documents"), zero("size_used"), share, zero("available"), F.coalesce(reach == F.col("__least"), F.lit(False)).alias("limiting"))
