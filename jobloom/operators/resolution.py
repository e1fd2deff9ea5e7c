"""Linking a record to its official posting: evidence of each candidate, and a decision only where one stands out."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobloom.functions.text import norm_words, tokens

# Short words of titles, what a candidate's title must reach, from which score it may be taken, and from
# which a second one makes it doubtful.
TITLE_WORDS = ((r"\b(?:jr|junior)\b", "junior"), (r"\bdev\b", "desenvolvedor"), (r"\banl\b", "analista"))
LEAST_TITLE, TAKEN, DOUBTFUL, KEPT = 0.8, 85.0, 70.0, 5


def title_form(title: Column) -> Column:
    x = norm_words(title)
    for pattern, word in TITLE_WORDS:
        x = F.regexp_replace(x, pattern, word)
    return x


def with_ratio(rows: DataFrame, a: str, b: str, out: str = "ratio") -> DataFrame:
    """rows with the share of two texts that matching blocks cover (Ratcliff and Obershelp); each different pair is
    compared once. Null with a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            left, right = x.column(0).to_pylist(), x.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array([SequenceMatcher(None, p, q).ratio() for p, q in zip(left, right, strict=True)], pa.float64())], names=["_a", "_b", "_r"])

    pairs = rows.select(F.col(a).alias("_a"), F.col(b).alias("_b")).dropna().distinct().mapInArrow(run, "_a string, _b string, _r double")
    x = rows.drop(out).join(pairs, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left")
    return x.withColumn(out, F.col("_r")).drop("_a", "_b", "_r")


def coverage(items: Column, words: Column) -> Column:
    """Share of items of which three quarters of the words at least are among words; 0 without items."""
    own = F.filter(F.transform(items, tokens), lambda t: F.size(t) > 0)
    hit = F.size(F.filter(own, lambda t: F.size(F.array_intersect(t, words)) / F.size(t) >= 0.75))
    return F.coalesce(hit / F.greatest(F.size(own), F.lit(1)), F.lit(0.0))


def evidence(title_similarity: Column, item_coverage: Column, text_coverage: Column, known_city: Column, actual_city: Column) -> Column:
    """Score 0 to 100 of a candidate, null if its title or a known city says it is another posting. Where no city is
    known, the others count for all."""
    known = known_city.isNotNull() & (known_city != "")
    other = known & actual_city.isNotNull() & (actual_city != "") & (known_city != actual_city)
    place = F.when(known & (actual_city == known_city), 15.0).otherwise(0.0)
    score = 100 * (55 * title_similarity + 20 * item_coverage + 10 * text_coverage + place) / F.when(known, 100).otherwise(85)
    return F.when((title_similarity >= LEAST_TITLE) & ~F.coalesce(other, F.lit(False)), F.round(score.cast("decimal(20,10)"), 1).cast("double"))


def decide(candidates: DataFrame, record: str, candidate: str) -> DataFrame:
    """(record, candidate, score, state) of candidates (record, candidate, score or null, confirmed, failed): one row a
    record. 'fetch_failed' if any candidate couldn't be read, 'pending' if none scored, 'resolved' if the best is good
    enough, confirmed and stands alone, else 'review_required'; candidate is the best, null unless there is one."""
    # ties go to the smaller candidate
    best = F.min_by(F.struct(F.col(candidate).alias("c"), "score", "confirmed"), F.when(F.col("score").isNotNull(), F.struct(-F.col("score"), F.col(candidate))))
    g = candidates.groupBy(record).agg(best.alias("b"), F.coalesce(F.bool_or("failed"), F.lit(False)).alias("f"), F.count_if(F.col("score") >= DOUBTFUL).alias("near"))
    good = (F.col("b.score") >= TAKEN) & (F.col("near") == 1) & F.coalesce(F.col("b.confirmed"), F.lit(False))
    state = F.when(F.col("f"), "fetch_failed").when(F.col("b.score").isNull(), "pending").when(good, "resolved").otherwise("review_required")
    return g.select(record, F.col("b.c").alias(candidate), F.col("b.score").alias("score"), state.alias("state"))


def ranked(candidates: DataFrame, record: str, candidate: str, most: int = KEPT) -> DataFrame:
    """The best candidates of each record with place (from 1) and next (the score behind)."""
    w = W.partitionBy(record).orderBy(F.desc("score"), F.col(candidate))
    x = candidates.where("score IS NOT NULL").withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    return x.where(F.col("place") <= most)


def complete(pages: DataFrame, board: str) -> DataFrame:
    """(board, postings, state) of pages (board, address or null, advertised total or null, error or null): a board is
    complete only if no page failed, it has postings, and not fewer than any page advertised."""
    g = pages.groupBy(board).agg(F.countDistinct("address").alias("postings"), F.max("total").alias("_total"), F.count("error").alias("_errors"))
    ok = (F.col("_errors") == 0) & (F.col("postings") > 0) & (F.col("postings") >= F.coalesce("_total", F.lit(0)))
    return g.select(board, "postings", F.when(ok, "complete").otherwise("error").alias("state"))
