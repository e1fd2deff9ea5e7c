"""Set-similarity joins without a cross join, and greedy first-winner selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import jaccard
from jobloom.session import staged


def token_groups(rows: DataFrame, id_column: str, block: str, *tokens: str, tags: tuple[str, ...] = (), order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(members: id, block, the sorted token sets t0, t1, .. and tags; groups: block, sets, tags, rep, n, o): rows equal
    in their block, every set and every tag are one group of n rows; rep is its first row by order (by id if there is
    none) and o that row's order. Rows with a null block or an empty or null set are in none."""
    sets = [F.array_sort(F.array_distinct(c)).alias(f"t{i}") for i, c in enumerate(tokens)]
    full = " AND ".join(["block IS NOT NULL", *(f"size(t{i}) > 0" for i in range(len(tokens)))])
    o = (F.col(id_column) if order is None else order).alias("o")
    x = staged(rows.select(F.col(id_column).alias("id"), F.col(block).alias("block"), *sets, *tags, o).where(full), "token-sets")
    groups = x.groupBy("block", *(f"t{i}" for i in range(len(tokens))), *tags).agg(F.min_by("id", "o").alias("rep"), F.count("*").alias("n"), F.min("o").alias("o"))
    return x.drop("o"), groups


def with_group(members: DataFrame, groups: DataFrame, *tags: str) -> DataFrame:
    """(id, rep): members with the group that they are in. Sets of words take little in files and much in memory, so the
    size of a file must not decide on a broadcast."""
    keys = ["block", *(c for c in groups.columns if c[0] == "t" and c[1:].isdigit()), *tags]
    return members.join(groups.select(*keys, "rep").hint("merge"), keys).select("id", "rep")


def group_links(groups: DataFrame, *least: float) -> DataFrame:
    """(a, b, similarity, similarity1, ..), a < b: reps of one block whose every set ti is at least least[i] (> 0)
    similar, with the similarities of the sets.

    Prefix filter: tokens are ordered from rare to frequent; sets that are similar enough share one of their first
    n - ceil(least * n) + 1 tokens, so only groups that share one of each set are joined. What is joined are hashes of
    tokens and a signature of 64 bits a set: a token whose bit the other set lacks is not in it, which bounds what both
    share. Hashes that meet by chance add a pair to look at; the sets of all that remain are compared.
    """
    hashed = [f"transform(t{i}, w -> struct({i} AS i, xxhash64(block, {i}, w) AS h))" for i in range(len(least))]
    words = groups.select("rep", F.explode(F.expr(f"concat({', '.join(hashed)})")).alias("x")).select("rep", "x.i", "x.h")
    freq = words.groupBy("h").agg(F.count("*").alias("n"))
    ordered = words.join(freq.hint("merge"), "h").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("i", "n", "h"))).alias("o"))  # the tokens of one group
    own = ordered.select("rep", *(F.expr(f"transform(filter(o, x -> x.i = {i}), x -> x.h)").alias(f"o{i}") for i in range(len(least))))
    sizes = [F.expr(f"size(o{i})").alias(f"size{i}") for i in range(len(least))]
    signs = [F.expr(f"aggregate(o{i}, 0L, (s, h) -> s | shiftleft(1L, cast(h & 63 AS int)))").alias(f"sign{i}") for i in range(len(least))]
    heads = own.select("rep", *sizes, *signs, *(F.expr(f"slice(o{i}, 1, size(o{i}) - cast(ceil({part} * size(o{i}) - 1e-9) AS int) + 1)").alias(f"p{i}") for i, part in enumerate(least)))
    for i in range(len(least)):
        heads = heads.withColumn(f"p{i}", F.explode(f"p{i}"))
    sides = [c for i in range(len(least)) for c in (f"size{i}", f"sign{i}")]
    heads = heads.select(F.xxhash64(*(f"p{i}" for i in range(len(least)))).alias("key"), "rep", *sides)
    near = "a < b"
    for i, part in enumerate(least):
        both = f"least(size{i} - bit_count(sign{i} & ~sign{i}_b), size{i}_b - bit_count(sign{i}_b & ~sign{i}))"
        near += f" AND {both} >= {part} * (size{i} + size{i}_b - {both}) - 1e-9"
    b = heads.withColumnsRenamed({"rep": "b"} | {c: c + "_b" for c in sides})
    y = heads.withColumnRenamed("rep", "a").join(b.hint("merge"), "key").where(near).select("a", "b").distinct()
    for side in "ab":
        x = groups.select(F.col("rep").alias(side), F.col("block").alias("block_" + side), *(F.col(f"t{i}").alias(f"{side}{i}") for i in range(len(least))))
        y = y.join(x.hint("merge"), side)
    y = y.where("block_a = block_b")
    alike = [jaccard(F.col(f"a{i}"), F.col(f"b{i}")) for i in range(len(least))]
    for s, part in zip(alike, least, strict=True):
        y = y.where(s >= part - 1e-12)
    return y.select("a", "b", *(a.alias(f"similarity{i or ''}") for i, a in enumerate(alike)))


def jaccard_links(rows: DataFrame, id_column: str, block: str, tokens: str, least: float) -> DataFrame:
    """(a, b, similarity), a < b: rows of one block whose token sets are at least `least` (> 0) similar.

    Rows with equal block and tokens are one representative (the smallest id); copies are linked to it alone, so a
    further criterion needs its sets in the groups (`token_groups`). Null blocks and empty sets have no links.
    """
    x, groups = token_groups(rows, id_column, block, tokens)
    copies = with_group(x, groups).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return group_links(groups, least).select("a", "b", "similarity").union(copies)


def first_winners(rows: DataFrame, links: DataFrame, order: str) -> DataFrame:
    """(id, winner): going through rows (id, order unique) in order, a row that is linked to an earlier winner belongs to
    the first such winner; every other row is a winner (winner = id). links (a, b) point either way; order may be a
    struct.

    The loop over rows is replaced by rounds over the links: in each, rows whose earlier neighbours are all decided, or
    that have an earlier winner before any open one, are decided at once, so the number of rounds is the longest chain
    of undecided neighbours, not the number of rows. The first open row is always decided, so rounds go on until none is
    open. Only links of open rows are carried on.
    """
    ord_ = rows.select(F.col("id"), F.col(order).alias("o"))
    # orders may be structs, which take more memory than a file tells
    e = links.select("a", "b").join(ord_.select(F.col("id").alias("a"), F.col("o").alias("oa")).hint("merge"), "a").join(ord_.select(F.col("id").alias("b"), F.col("o").alias("ob")).hint("merge"), "b")
    first = F.col("oa") < F.col("ob")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    e = staged(e.where("oa <> ob").select(pick("b", "a").alias("id"), pick("a", "b").alias("by"), pick("oa", "ob").alias("by_o")).distinct(), "links")
    parts = [staged(ord_.join(e.select("id").distinct().hint("merge"), "id", "left_anti").select("id", F.col("id").alias("winner")), "decided")]
    e = e.withColumn("won", F.lit(None).cast("boolean"))
    while True:
        done = parts[-1].select(F.col("id").alias("by"), (F.col("winner") == F.col("id")).alias("now"))
        e = e.join(done.hint("merge"), "by", "left").select("id", "by", "by_o", F.coalesce("won", "now").alias("won"))
        e = staged(e.join(parts[-1].select("id").hint("merge"), "id", "left_anti"), "open-links")
        if e.isEmpty():
            break
        s = e.groupBy("id").agg(F.min(F.when(F.col("won"), F.struct("by_o", "by"))).alias("w"), F.min(F.when(F.col("won").isNull(), F.col("by_o"))).alias("open"))
        s = s.where("open IS NULL OR w.by_o < open")
        parts.append(staged(s.select("id", F.coalesce("w.by", "id").alias("winner")), "decided"))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out
