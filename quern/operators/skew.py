"""Joins and rankings that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: A key with at least one in this many of the rows is heavy. There can be no more such keys than this.
HEAVY_IN = 1000


def join_by_term(rows: DataFrame, stats: DataFrame, key: str, count: str, spread: str, kept: bool = False) -> DataFrame:
    """Left join ``rows`` to ``stats`` (unique by ``key``) without any task getting all rows of a heavy key.

    ``count`` is the column of ``stats`` with the key's number of rows in ``rows``. Keys with one in
    ``HEAVY_IN`` of the rows or more are broadcast: their number is at most ``HEAVY_IN`` by
    definition, so the broadcast's size does not grow with the data. All others go through an
    ordinary shuffle join in which the heavy rows are spread by ``spread`` under a salt that has no
    partner. Null keys match nothing. ``stats`` is read three times and therefore written first,
    unless the caller has ``kept`` it.
    """
    stats = stats if kept else written(stats, "stats")
    value = [c for c in stats.columns if c != key]
    total = stats.agg(F.sum(count).alias("__total"))
    heavy = (
        stats.crossJoin(F.broadcast(total))
        .where(F.col(count) * HEAVY_IN >= F.col("__total"))
        .select(F.col(key).alias("__hk"), F.struct(*value).alias("__h"))
    )
    marked = rows.join(F.broadcast(heavy), rows[key] == F.col("__hk"), "left").drop("__hk")
    salted = marked.withColumn("__s", F.when(F.col("__h").isNotNull() | F.col(key).isNull(), 1 + F.pmod(F.xxhash64(spread), F.lit(9973))).otherwise(F.lit(0)))
    light = stats.select(F.lit(0).cast("long").alias("__ls"), F.col(key).alias("__lk"), F.struct(*value).alias("__l"))
    joined = salted.join(light, (F.col("__s") == F.col("__ls")) & (F.col(key) == F.col("__lk")), "left")
    best = F.coalesce(F.col("__h"), F.col("__l"))
    return joined.select(*rows.columns, *[best[c].alias(c) for c in value])


def rank_descending(rows: DataFrame, group: list[str], value: str, row_id: str, cut: int = 200_000) -> DataFrame:
    """``rows`` plus ``rank_mid`` (1 for the largest value; ties share their middle rank) within each group.

    A group of more than ``cut`` rows is ranked in slices: a fixed-size sample of its values, chosen
    by a hash of ``row_id`` so that any retry picks the same, gives slice borders; each slice is
    ranked alone and shifted by the sizes of the slices above. No task sorts a whole hot group.
    Results do not depend on ``cut``. Values must not be null.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > cut)
    hot = rows.join(sizes, group, "left")
    unit = F.abs(F.xxhash64(row_id).cast("double")) / 2.0**63
    borders = hot.where(F.col("__n").isNotNull() & (unit < 512.0 / F.col("__n"))).groupBy(*group).agg(F.sort_array(F.collect_set(value)).alias("__b"))
    placed = hot.join(borders, group, "left")
    # binary search: the number of borders not above the value
    find = F.expr(
        f"""aggregate(sequence(1, 16), named_struct('lo', 0, 'hi', size(__b)),
        (a, i) -> if(a.lo < a.hi, if(__b[cast((a.lo + a.hi) div 2 as int)] <= {value},
            named_struct('lo', cast((a.lo + a.hi) div 2 as int) + 1, 'hi', a.hi),
            named_struct('lo', a.lo, 'hi', cast((a.lo + a.hi) div 2 as int))), a), a -> a.lo)"""
    )
    placed = placed.withColumn("__slice", F.when(F.col("__b").isNull(), F.lit(0)).otherwise(find)).drop("__b", "__n")
    per_value = placed.groupBy(*group, "__slice", value).agg(F.count(F.lit(1)).alias("__c"))
    per_slice = per_value.groupBy(*group, "__slice").agg(F.sum("__c").alias("__cs"))
    above = Window.partitionBy(*group).orderBy(F.col("__slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    shift = per_slice.select(*group, "__slice", F.coalesce(F.sum("__cs").over(above), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy(*group, "__slice").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_value.withColumn("__before", F.coalesce(F.sum("__c").over(inside), F.lit(0))).join(shift, [*group, "__slice"])
    ranks = ranks.select(*group, value, (F.col("__shift") + F.col("__before") + (F.col("__c") + 1) / 2).alias("rank_mid"))
    return rows.join(ranks, [*group, value])
