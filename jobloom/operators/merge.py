"""Keyed merges, mirrors and histories. A merge never lists rows on the driver; every group is an aggregate with
partial sums or a window over one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_by_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key (the largest by order, compared from left to right; null is smallest). Rows with a null
    key form one group, as for any other key. The key's largest struct wins by a partial max, so a hot key is no
    single task."""
    cols = [c for c in rows.columns if c != key]
    top = F.max_by(F.struct(*cols), F.struct(*order)).alias("_row")
    return rows.groupBy(key).agg(top).select(key, *[F.col(f"_row.`{c}`").alias(c) for c in cols])


def overlay(prior: DataFrame, current: DataFrame, key: str, keep_prior: list[str], take_current: list[str]) -> DataFrame:
    """Full outer merge by a unique key: keep_prior columns come from prior unless null there, take_current columns from
    current wherever a current row exists (a null there counts). origin is 'both', 'prior' or 'current'. Absence never
    deletes. Null keys match nothing and are kept."""
    p = prior.select(key, *[F.col(c).alias("_p_" + c) for c in keep_prior + take_current], F.lit(True).alias("_p"))
    c = current.select(key, *[F.col(x).alias("_c_" + x) for x in keep_prior + take_current], F.lit(True).alias("_c"))
    x = p.join(c, key, "full_outer")
    origin = F.when(F.col("_p") & F.col("_c"), "both").when(F.col("_p"), "prior").otherwise("current")
    return x.select(
        key, origin.alias("origin"),
        *[F.coalesce("_p_" + n, "_c_" + n).alias(n) for n in keep_prior],
        *[F.when(F.col("_c"), F.col("_c_" + n)).otherwise(F.col("_p_" + n)).alias(n) for n in take_current],
    )


def mirror_diff(wanted: DataFrame, present: DataFrame, key: str, content: list[str]) -> DataFrame:
    """What an exact mirror has to do: (key, action) with insert, update, delete or keep. Keys are unique; content
    compares nulls as equal."""
    w = wanted.select(key, F.xxhash64(*content).alias("_w"), F.lit(True).alias("_wp"))
    p = present.select(key, F.xxhash64(*content).alias("_h"), F.lit(True).alias("_pp"))
    x = w.join(p, key, "full_outer")
    action = F.when(F.col("_pp").isNull(), "insert").when(F.col("_wp").isNull(), "delete").when(F.col("_w") == F.col("_h"), "keep").otherwise("update")
    return x.select(key, action.alias("action"))


def changes(rows: DataFrame, key: str, order: list[Column], content: list[str]) -> DataFrame:
    """rows with changed: whether content differs from the key's row before it (the first row of a key is changed)."""
    w = W.partitionBy(key).orderBy(*order)
    h = F.sha2(F.to_json(F.struct(*content)), 256)
    x = rows.withColumn("_h", h)
    return x.withColumn("changed", ~F.col("_h").eqNullSafe(F.lag("_h").over(w)) | (F.row_number().over(w) == 1)).drop("_h")


def lineage(rows: DataFrame, group: list[str], rank: Column, fields: list[str]) -> DataFrame:
    """One record a group: each field from the highest rank that has it, rows, and the distinct providers in order."""
    return rows.groupBy(*group).agg(
        F.count("*").alias("rows"),
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields],
    )


def merged_sources(rows: DataFrame, key: str, url: str, order: str, fields: list[str], priority: str) -> DataFrame:
    """(key, sources): array<struct<url, fields..>> of the rows of each key, one entry an address: each field from the
    last row (by order) that has it; the highest priority first, then by address. Rows without an address are left out."""
    x = rows.where(F.trim(F.col(url)) != "").groupBy(key, F.trim(F.col(url)).alias("_url"))
    x = x.agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])
    entry = F.struct((-F.coalesce(F.col(priority), F.lit(0))).alias("_p"), F.col("_url").alias("url"), *fields)
    x = x.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("s"))  # addresses of one record
    return x.select(key, F.transform("s", lambda e: F.struct(e["url"].alias("url"), *[e[f].alias(f) for f in fields])).alias("sources"))


def kept_ids(rows: DataFrame, id_column: str, order: str, least: int = 0) -> DataFrame:
    """rows with every missing id filled: the largest there is (at least `least`) plus the row's rank by order (unique,
    not negative) among rows without one. Ranks are counted inside blocks of the order and over the blocks' totals."""
    top = rows.agg(F.greatest(F.coalesce(F.max(id_column), F.lit(least)), F.lit(least)).alias("_top"))
    x = rows.withColumn("_block", F.floor(F.col(order) / 4096))
    n = x.where(F.col(id_column).isNull()).groupBy("_block").agg(F.count("*").alias("_n"))
    before = n.select("_block", F.coalesce(F.sum("_n").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a block
    own = F.count_if(F.col(id_column).isNull()).over(W.partitionBy("_block").orderBy(order))
    x = x.withColumn("_own", own).join(before, "_block", "left").crossJoin(F.broadcast(top))  # one row
    return x.withColumn(id_column, F.coalesce(F.col(id_column), F.col("_top") + F.coalesce("_before", F.lit(0)) + F.col("_own"))).drop("_block", "_own", "_before", "_top")
