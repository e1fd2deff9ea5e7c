"""Problem 8: mixing sources to target weights.

Weights of sources are temperature-like: natural token share s and target share q give s * (q / s) ** exponent, from
the natural mixture (0) to the target (1). The exponent is bisected: the largest that keeps every source within its
repetition limit for the budget, or the one whose mixture has a wished entropy. The weights are realised by whole passes
over a source and one last pass in block permutation: blocks in hash order until the budget is met, documents of the
boundary block in hash order, and then, for what is left, unused documents by size, the largest that fits first, until
none fits. Gathered are totals of sources (a fixed list) and, of documents no longer than what is left of a source's
budget (less than one document), how many there are of each size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobloom.session import staged

PER_BLOCK = 4096  # documents of a block, about
MOST_BLOCKS = 1 << 16


def weights(natural: dict[str, float], target: dict[str, float], exponent: float) -> dict[str, float]:
    """Normalised s * (q / s) ** exponent; sources without tokens or target have none."""
    s = {k: v for k, v in natural.items() if v > 0 and target.get(k, 0) > 0}
    ns, nq = sum(s.values()), sum(target[k] for k in s)
    w = {k: (v / ns) * ((target[k] / nq) / (v / ns)) ** exponent for k, v in s.items()}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in w.values() if v > 0)


def _bisect(ok, steps: int = 60) -> float:
    """The largest x in [0, 1] with ok(x), for an ok that holds up to some point."""
    if ok(1.0):
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ok(mid) else (lo, mid)
    return lo


def exact_budget(natural: dict[str, float], target: dict[str, float], repeats: dict[str, int]) -> float:
    """The largest total for which every source can give its target share within its repetition limit."""
    w = weights(natural, target, 1.0)
    return min((repeats[k] * natural[k] / v for k, v in w.items()), default=0.0)


def temperature(natural: dict[str, float], target: dict[str, float], repeats: dict[str, int], budget: float, wished_entropy: float | None = None) -> tuple[float, float]:
    """(exponent, budget): the largest exponent within the limits (and, if wished, at most as uniform or as peaked as
    the wished entropy). A budget that even the natural mixture can't give is lowered to what it can."""
    if not weights(natural, target, 0.0):
        return 1.0, 0.0

    def within(x: float, b: float) -> bool:
        return all(v * b <= repeats[k] * natural[k] * (1 + 1e-9) for k, v in weights(natural, target, x).items())

    if not within(0.0, budget) and not within(1.0, budget):
        budget = max(exact_budget(natural, target, repeats), min(repeats[k] * natural[k] / v for k, v in weights(natural, target, 0.0).items()))
    x = _bisect(lambda e: within(e, budget)) if within(0.0, budget) else 1.0
    if wished_entropy is not None:
        start, end = entropy(weights(natural, target, 0.0)), entropy(weights(natural, target, 1.0))
        x = min(x, _bisect(lambda e: (entropy(weights(natural, target, e)) - wished_entropy) * (end - start) <= 0))
    return x, budget


def _up_to_edge(x: DataFrame, quota: DataFrame, id_column: str, seed: int) -> DataFrame:
    """Documents (id, source, n_tokens) in block order up to the source's quota (source, _rest): whole blocks, then the
    documents of the block in which it runs out, in hash order, as far as it reaches."""
    x = x.join(F.broadcast(quota), "source").where("n_tokens > 0")  # at most one row a target
    blocks = x.groupBy("source", "_block").agg(F.sum("n_tokens").alias("_n"), F.first("_rest").alias("_rest"))
    order = W.partitionBy("source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # at most MOST_BLOCKS rows a source
    blocks = staged(blocks.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))), "mix-blocks")
    edges = blocks.where("_before + _n > _rest").groupBy("source").agg(F.min("_block").alias("_edge"), F.min("_before").alias("_before"))
    x = x.join(F.broadcast(edges), "source", "left")  # at most one row a target
    whole = x.where("_edge IS NULL OR _block < _edge").select(id_column, "source", "n_tokens")
    run = W.partitionBy("source").orderBy(F.xxhash64(id_column, F.lit(seed + 1)), id_column)  # one block of each source
    inner = x.where("_block = _edge").withColumn("_sum", F.sum("n_tokens").over(run))
    return whole.union(inner.where("_before + _sum <= _rest").select(id_column, "source", "n_tokens"))


def picks(left: int, sizes: dict[int, int]) -> dict[int, int]:
    """How many of each size (size: how many there are) go into what is left, the largest that fits first."""
    out = {}
    for n in sorted(sizes, reverse=True):
        k = min(left // n, sizes[n])
        if k:
            out[n] = k
            left -= k * n
    return out


def _last_pass(x: DataFrame, rest: dict[str, int], id_column: str, seed: int) -> DataFrame:
    """Documents (id, source, n_tokens) that fill each source's rest, so that no unused document fits any more."""
    spark = x.sparkSession
    quota = spark.createDataFrame(list(rest.items()), "source string, _rest long")
    part = staged(_up_to_edge(x, quota, id_column, seed), "mix-pass")
    taken = {r.source: r.n for r in part.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # at most one row a target
    left = spark.createDataFrame([(k, n - taken.get(k, 0)) for k, n in rest.items()], "source string, _left long")
    small = x.join(F.broadcast(left), "source").where("n_tokens > 0 AND n_tokens <= _left").join(part.select(id_column), id_column, "left_anti")
    small = staged(small.select(id_column, "source", "n_tokens", "_left"), "mix-small")
    sizes: dict[tuple[str, int], dict[int, int]] = {}
    for r in small.groupBy("source", "_left", "n_tokens").agg(F.count("*").alias("n")).collect():  # sizes below one document's, by target
        sizes.setdefault((r.source, r["_left"]), {})[r.n_tokens] = r.n
    chosen = [(k, n, times) for (k, r), own in sizes.items() for n, times in picks(r, own).items()]
    few = small.join(F.broadcast(spark.createDataFrame(chosen, "source string, n_tokens long, _k long")), ["source", "n_tokens"])
    order = W.partitionBy("source", "n_tokens").orderBy(F.xxhash64(id_column, F.lit(seed + 2)), id_column)
    few = few.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max([1, *(c[2] for c in chosen)])).where("_r <= _k")
    return part.union(few.select(id_column, "source", "n_tokens"))


def natural_and_target(sized: DataFrame, targets: DataFrame) -> tuple[dict[str, float], dict[str, float], dict[str, int]]:
    """Tokens, target shares and limits of the sources that have a target; of a source's repeated targets the largest
    share and the smallest limit count."""
    t = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))
    rows = t.collect()  # the fixed list of targets
    repeats = {r.source: max(0, r.repeats) for r in rows}
    n = sized.join(F.broadcast(t.select("source")), "source").groupBy("source").agg(F.sum("n_tokens").alias("n"))
    natural = {r.source: float(r.n or 0) for r in n.collect()}  # at most one row a target
    return natural, {r.source: r.share for r in rows if repeats[r.source] > 0}, repeats


def mix(sized: DataFrame, targets: DataFrame, id_column: str, budget: float | None = None, wished_entropy: float | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(documents, shares) for sized (id, source, n_tokens) and targets (source, target_share, max_repeats).

    documents: every document with times, how often it is used (0 for sources without target). shares: every target
    with available and used tokens, reached share, passes and limit, the tokens its weight asks for (wanted) and what of
    them no unused document is short enough for (unfilled), the exponent and the largest total that would give every
    target exactly (exact_total), which is the budget if none is given. Null sources and sizes are used 0 times.
    """
    spark = sized.sparkSession
    natural, target, repeats = natural_and_target(sized, targets)
    exact = exact_budget(natural, target, repeats)
    exponent, budget = temperature(natural, target, repeats, exact if budget is None else budget, wished_entropy)
    w = weights(natural, target, exponent)
    passes = {k: min(int(v * budget / natural[k] + 1e-9), repeats[k]) for k, v in w.items()}
    rest = {k: max(0, int(v * budget - passes[k] * natural[k] + 1e-6)) if passes[k] < repeats[k] else 0 for k, v in w.items()}
    x = sized.select(id_column, "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    blocks = max(1, min(MOST_BLOCKS, x.count() // PER_BLOCK))
    blocked = x.withColumn("_block", F.pmod(F.xxhash64(id_column, F.lit(seed)), F.lit(blocks)).cast("int"))
    chosen = _last_pass(blocked, {k: r for k, r in rest.items() if r > 0}, id_column, seed)
    quota = F.broadcast(spark.createDataFrame(list(passes.items()), "source string, _passes int"))
    x = x.join(quota, "source", "left").join(chosen.select(id_column, F.lit(1).alias("_in")), id_column, "left")
    times = F.coalesce("_passes", F.lit(0)) + F.coalesce("_in", F.lit(0))
    docs = x.select(id_column, "source", "n_tokens", times.cast("int").alias("times"))
    used = docs.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.sum(F.col("n_tokens") * F.col("times")).alias("used"), F.max("times").alias("most_times"))
    rows = [(k, target[k], repeats[k], int(w[k] * budget + 1e-6) if k in w else 0) for k in target]
    t = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, wanted long")
    s = t.join(used, "source", "left").na.fill(0, ["available", "used", "most_times"])
    total = s.agg(F.sum("used").alias("_total"))
    s = s.crossJoin(F.broadcast(total))  # one row
    shares = s.select(
        "source", "target_share", "available", "used", F.try_divide(F.col("used"), F.col("_total")).alias("reached_share"),
        F.try_divide(F.col("used"), F.col("available")).alias("passes"), "most_times", "max_repeats", "wanted", (F.col("wanted") - F.col("used")).alias("unfilled"),
        F.lit(exponent).alias("exponent"), F.lit(exact).alias("exact_total"),
    )
    return docs, shares
