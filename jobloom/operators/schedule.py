"""Budgets and streaks as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobloom.session import staged

BLOCK = 4096


def within_budget(rows: DataFrame, bucket: str, canonical: str, order: str, budgets: dict[str, int | None]) -> DataFrame:
    """rows with decision: the first row of each canonical in a bucket takes a place while the bucket's budget lasts
    (selected, else not_scanned); its repeats are duplicates and take none. A null budget, or a bucket without one,
    has no end. order is a unique number.

    Ranks are counted in two steps, inside blocks of the order and over the blocks' totals, so that a bucket of a third
    of all rows is no single task.
    """
    first = rows.groupBy(bucket, canonical).agg(F.min(order).alias("_first"))
    heads = staged(first.withColumn("_block", F.floor(F.col("_first") / BLOCK)), "heads")
    sizes = heads.groupBy(bucket, "_block").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(bucket).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(W.partitionBy(bucket, "_block").orderBy("_first"))
    ranked = heads.withColumn("_own", own).join(before.drop("_n"), [bucket, "_block"]).select(bucket, canonical, "_first", (F.col("_before") + F.col("_own")).alias("rank"))
    limit = F.lit(None).cast("long")
    for name, n in budgets.items():
        limit = F.when(F.col(bucket) == name, F.lit(n)).otherwise(limit)
    x = rows.join(ranked, [bucket, canonical])
    fits = limit.isNull() | (F.col("rank") <= limit)
    decision = F.when(~fits, "not_scanned").when(F.col(order) == F.col("_first"), "selected").otherwise("duplicate")
    return x.withColumn("decision", decision).drop("_first")


def streaks(rows: DataFrame, key: str, order: str, hit: Column) -> DataFrame:
    """rows with streak: how many rows of the key up to this one, without a gap, satisfy hit (0 where it doesn't)."""
    w = W.partitionBy(key).orderBy(order)
    x = rows.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    x = x.withColumn("_island", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(w))
    run = F.sum(F.when(F.col("_hit"), 1).otherwise(0)).over(W.partitionBy(key, "_island").orderBy(order))
    return x.withColumn("streak", run.cast("long")).drop("_hit", "_island")
