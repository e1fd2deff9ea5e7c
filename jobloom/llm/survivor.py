"""Problem 4: the best representative of each group of duplicate records.

Rows are ranked inside their group by trust, recency and completeness with a window, ties by id. A group may hold a
third of all rows, so the window runs twice: first over (group, salt), which leaves at most one leader a salt together
with the best value of each criterion, then over the leaders of a group. No task ever sorts a whole hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_TRUST = 1_000_000
SALTS = 32


def _ranked(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    w = W.partitionBy(*by)
    best = [F.min("_trust").over(w).alias("_best_trust"), F.max("_seen").over(w).alias("_best_seen"), F.max("_filled").over(w).alias("_best_filled")]
    return rows.select("*", F.row_number().over(w.orderBy(*order)).alias("_rank"), *best)


def leaders(
    rows: DataFrame, group: list[str], id_column: str, trust: Column, seen: Column, filled: Column, salts: int = SALTS
) -> DataFrame:
    """One row a group: the group columns, group_id (its smallest id), group_rows (how many), the leader's id, its
    trust, seen (null for none) and filled, and dominant: whether the leader is at least as good as every other row in each of the
    three and equals no other row in all three.

    trust: smaller is better, null the worst; seen: later is better, null the worst; filled: more is better. Rows equal
    in every column count once. Rows whose group columns hold a null belong to no group.
    """
    never = F.lit("0001-01-01").cast("timestamp")
    x = rows.dropDuplicates().dropna(subset=group)
    x = x.select(
        *group,
        F.col(id_column).alias("_id"),
        F.coalesce(trust, F.lit(LEAST_TRUST)).alias("_trust"),
        F.coalesce(seen, never).alias("_seen"),
        F.coalesce(filled, F.lit(0)).alias("_filled"),
    )
    # equal rows first: the count of each combination, with partial sums before the shuffle
    x = x.groupBy(*group, "_trust", "_seen", "_filled").agg(F.min("_id").alias("_id"), F.count("*").alias("_n"), F.min("_id").alias("_least"))
    order = [F.col("_trust"), F.col("_seen").desc(), F.col("_filled").desc(), F.col("_id")]
    x = x.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)))
    w = W.partitionBy(*group, "_salt")
    x = _ranked(x, [*group, "_salt"], order).select("*", F.min("_least").over(w).alias("_l"), F.sum("_n").over(w).alias("_rows"))
    x = x.where("_rank = 1").drop("_rank", "_salt")
    w = W.partitionBy(*group)
    x = x.select(
        *group, "_id", "_trust", "_seen", "_filled", "_n",
        F.row_number().over(w.orderBy(*order)).alias("_rank"),
        F.min("_best_trust").over(w).alias("_best_trust"),
        F.max("_best_seen").over(w).alias("_best_seen"),
        F.max("_best_filled").over(w).alias("_best_filled"),
        F.min("_l").over(w).alias("group_id"),
        F.sum("_rows").over(w).alias("group_rows"),
    ).where("_rank = 1")
    same = (F.col("_trust") == F.col("_best_trust")) & (F.col("_seen") == F.col("_best_seen")) & (F.col("_filled") == F.col("_best_filled"))
    return x.select(
        *group, "group_id", "group_rows", F.col("_id").alias(id_column), F.nullif("_trust", F.lit(LEAST_TRUST)).alias("trust"),
        F.nullif("_seen", never).alias("seen"), F.col("_filled").alias("filled"), (same & (F.col("_n") == 1)).alias("dominant"),
    )


def merged(rows: DataFrame, group: list[str], id_column: str, trust: Column, seen: Column, fields: list[str], blank_is_null: bool = True) -> DataFrame:
    """One record a group, built field by field: each field is the value of the best row (trust, then seen, then id)
    that has one; an empty string is no value if blank_is_null. A partial max_by does it, so a hot group costs no more
    than the others. Rows whose group columns hold a null belong to no group."""
    never = F.lit("0001-01-01").cast("timestamp")
    x = rows.dropna(subset=group)
    key = F.struct(
        (-F.coalesce(trust, F.lit(LEAST_TRUST))).alias("t"),
        F.coalesce(seen, never).alias("s"),
        (-F.col(id_column)).alias("i"),
    )
    kinds = dict(x.dtypes)

    def has(f: str) -> Column:
        there = F.col(f).isNotNull()
        return there & (F.trim(F.col(f)) != "") if blank_is_null and kinds[f] == "string" else there

    return x.groupBy(*group).agg(
        F.min(id_column).alias("group_id"),
        F.countDistinct(id_column).alias("group_rows"),
        *[F.max_by(F.when(has(f), F.col(f)), F.when(has(f), key)).alias(f) for f in fields],
    )
