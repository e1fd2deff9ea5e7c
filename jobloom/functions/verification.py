"""Whether a posting is still open: from a fetched page, and over time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import norm_plain
from jobloom.functions.times import age_days

# Phrases of a closed advert, and for how many days a confirmation holds.
CLOSED = r"nao aceita mais candidaturas|no longer accepting applications|vaga (?:foi )?encerrada|job (?:is )?no longer available"
VALID_DAYS = 7
TITLE_LIKE, LEAST_TEXT = 0.65, 150


def fetched(http_status: Column, text: Column, valid_through: Column, title_similarity: Column, same_employer: Column, has_posting: Column, description: Column, as_of: str) -> Column:
    """struct<state, reason> of a fetched page: closed if it is gone, says so or has expired; confirmed if it holds the
    posting looked for (title, employer, a real description); else pending. Nulls count as not there."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = lambda state, reason: F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))
    like, own = yes(title_similarity >= TITLE_LIKE), yes(same_employer)
    return (
        F.when(http_status.isin(404, 410), out("closed", "gone")).when(F.coalesce(http_status, F.lit(0)) != 200, out("pending", "not reached"))
        .when(yes(norm_plain(text).rlike(CLOSED)), out("closed", "says so")).when(~yes(has_posting), out("pending", "no posting"))
        .when(yes(valid_through < F.to_timestamp(F.lit(as_of))), out("closed", "expired")).when(like & own & yes(F.length(description) > LEAST_TEXT), out("confirmed", "same posting"))
        .when(~own, out("pending", "other employer")).otherwise(out("pending", "not enough"))
    )


def public_state(review: Column, status: Column, state: Column, checked_at: Column, verified_at: Column, as_of: str) -> Column:
    """State of a record over time: review before closed before a newer attempt that failed before a confirmation of
    the last seven days; else pending."""
    newer = checked_at.isNotNull() & (verified_at.isNull() | (checked_at > verified_at))
    return (
        F.when(F.coalesce(review, F.lit(False)), "review").when(status == "Encerrada", "closed").when((state == "pending") & newer, "pending")
        .when((status == "Ativa") & (age_days(verified_at, as_of) <= VALID_DAYS), "confirmed").otherwise("pending")
    )


def after_check(prior_verified_at: Column, prior_status: Column, state: Column, at: Column) -> Column:
    """struct<status, verified_at, previously_verified_at> after a check: a pending one clears the confirmation, keeps
    when it was, and an active record stays active."""
    pending = state == "pending"
    return F.struct(
        F.when(pending & (prior_status == "Ativa"), "Ativa").when(pending, "Possivelmente encerrada").when(state == "closed", "Encerrada").otherwise("Ativa").alias("status"),
        F.when(~pending, at).alias("verified_at"), F.when(pending, prior_verified_at).alias("previously_verified_at"),
    )


def retry_delay(header: Column, failures: Column, as_of: str) -> Column:
    """Seconds to wait: what a Retry-After header says (a number or an HTTP date), else 30 * 2 ** failures, from 1 second
    to a day."""
    date = F.try_to_timestamp(F.regexp_replace(header, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    until = (F.unix_micros(date) - F.unix_micros(F.to_timestamp(F.lit(as_of)))) / 1_000_000
    backoff = F.lit(30.0) * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(6)).cast("double"))
    return F.greatest(F.lit(1.0), F.least(F.coalesce(header.try_cast("double"), until, backoff), F.lit(86400.0)))
