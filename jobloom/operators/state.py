"""State of keys that outlives a run: one row a key, advanced by each run's outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def advance(history: DataFrame, outcomes: DataFrame, key: str, passive: list[str], final: list[str]) -> DataFrame:
    """history (key, status, attempts, first_seen, last_seen) after a run's outcomes (key, status, at).

    A key has one outcome a run (see repeated_outcomes). Passive outcomes neither count as attempts nor replace a known
    status; a final status never changes; first_seen never changes; keys without an outcome stay. Null keys are left
    out of both.
    """
    h = history.where(F.col(key).isNotNull()).select(key, *[F.col(c).alias("_" + c) for c in ("status", "attempts", "first_seen", "last_seen")])
    o = outcomes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("status", F.struct("at", "status")).alias("_now"), F.max("at").alias("_at"))
    x = h.join(o, key, "full_outer")
    quiet = F.col("_now").isNull() | F.col("_now").isin(*passive)
    status = F.when(F.col("_status").isin(*final), F.col("_status")).when(quiet, F.coalesce("_status", "_now")).otherwise(F.col("_now"))
    return x.select(
        key, status.alias("status"), (F.coalesce("_attempts", F.lit(0)) + F.when(quiet, 0).otherwise(1)).alias("attempts"),
        F.coalesce("_first_seen", "_at").alias("first_seen"), F.greatest("_last_seen", "_at").alias("last_seen"),
    )


def repeated_outcomes(outcomes: DataFrame, key: str) -> DataFrame:
    """(key, outcomes): keys with more than one outcome in a run, which a run must not have."""
    return outcomes.groupBy(key).agg(F.count("*").alias("outcomes")).where("outcomes > 1")


def expired(history: DataFrame, as_of: str, days: int) -> DataFrame:
    """history without keys not seen for more than `days` before as_of; a null last_seen counts as never seen."""
    return history.where(F.col("last_seen") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS"))


# Outcomes that are no attempt, and reasons of outcomes that only put off what was known.
NO_ATTEMPT = ("already_known", "not_scanned")
PUT_OFF = ("recent_rejection", "retry_deferred")
HOLD = {"rejected": "1 day", "retry": "30 minutes"}


def marked(history: DataFrame, outcomes: DataFrame, key: str, at: str, policy: str) -> DataFrame:
    """history (key, status, reason, first_seen, last_seen, last_processed, retry_after, attempts, policy, transitions)
    after a run's outcomes (key, status, reason), one a key.

    What is put off keeps reason and retry_after, not_scanned also the status; rejected and retried keys wait (HOLD).
    Only real attempts count and move last_processed. transitions, array<struct<stage, reason>>, gets the discovery of a
    new key and every outcome. Keys without an outcome stay as they are; null keys are left out."""
    h = history.where(F.col(key).isNotNull())
    names = ["status", "reason", "first_seen", "last_seen", "last_processed", "retry_after", "attempts", "policy", "transitions"]
    h = h.select(key, *[F.col(n).alias("_" + n) for n in names])
    o = outcomes.where(F.col(key).isNotNull()).select(key, "status", "reason")
    x = h.join(o, key, "full_outer")
    now = F.to_timestamp(F.lit(at))
    none = F.col("status").isNull()
    unread, off = F.col("status") == "not_scanned", F.coalesce(F.col("reason").isin(*PUT_OFF), F.lit(False))
    tried = ~none & ~F.col("status").isin(*NO_ATTEMPT) & ~off
    attempts = F.coalesce("_attempts", F.lit(0)) + F.when(tried, 1).otherwise(0)
    until = F.lit(None).cast("timestamp")
    for status, wait in HOLD.items():
        until = F.when(F.col("status") == status, now + F.expr(f"INTERVAL {wait}")).otherwise(until)
    step = lambda stage, reason: F.struct(stage.alias("stage"), reason.alias("reason"))
    past = F.coalesce("_transitions", F.array(step(F.lit("discovered"), F.lit("source_discovery"))))
    return x.select(
        key, F.when(none, F.col("_status")).when(unread, F.coalesce("_status", "status")).otherwise(F.col("status")).alias("status"),
        F.when(none, F.col("_reason")).when(off | unread, F.coalesce("_reason", "reason")).otherwise(F.col("reason")).alias("reason"),
        F.coalesce("_first_seen", now).alias("first_seen"), F.when(none, F.col("_last_seen")).otherwise(now).alias("last_seen"),
        F.when(tried, now).otherwise(F.col("_last_processed")).alias("last_processed"),
        F.when(none | off | unread, F.col("_retry_after")).otherwise(until).alias("retry_after"), attempts.alias("attempts"),
        F.when(none, F.col("_policy")).otherwise(F.lit(policy)).alias("policy"),
        F.when(none, F.col("_transitions")).otherwise(F.concat(past, F.array(step(F.col("status"), F.col("reason"))))).alias("transitions"),
    )


def waiting(history: DataFrame, as_of: str, policy: str) -> DataFrame:
    """history with waits: 'recent_rejection' or 'retry_deferred' for keys of this policy whose time hasn't come, else
    null."""
    open_ = (F.col("policy") == policy) & (F.col("retry_after") > F.to_timestamp(F.lit(as_of)))
    return history.withColumn("waits", F.when(open_ & (F.col("status") == "rejected"), "recent_rejection").when(open_ & (F.col("status") == "retry"), "retry_deferred"))


def append_if_absent(history: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """history with those rows whose key it doesn't have yet; what is there is never replaced."""
    return history.unionByName(rows.join(history.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def reconciled(prior: DataFrame, current: DataFrame, key: str, automatic: str, excluded: str, reason: str) -> DataFrame:
    """prior with retired: only automatic rows that are neither excluded nor in current, and that have a reason to be
    invalid, are retired; absence alone retires nothing. A null flag counts as false."""
    seen = current.select(key).distinct().withColumn("_there", F.lit(True))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    x = prior.join(seen, key, "left")
    return x.withColumn("retired", flag(automatic) & ~flag(excluded) & F.col("_there").isNull() & F.col(reason).isNotNull()).drop("_there")


def transition_once(rows: DataFrame, column: str, stage: str, when: Column) -> DataFrame:
    """rows with stage appended to an array of stages where `when` holds and it isn't there yet."""
    own = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return rows.withColumn(column, F.when(F.coalesce(when, F.lit(False)) & ~F.array_contains(own, stage), F.array_append(own, F.lit(stage))).otherwise(own))


def set_once(existing: Column, new: Column) -> Column:
    """What was written first stays."""
    return F.coalesce(existing, new)
