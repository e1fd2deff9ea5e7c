"""What came of applications: flags of each, funnel, bands, cohorts, calibration. One pass of conditional counts each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stages that are an answer, stages that are an interview, days after which silence is an answer.
ANSWERS = ("Teste técnico", "Entrevista RH", "Entrevista técnica", "Rejeitado", "Oferta")
INTERVIEWS = ("Entrevista RH", "Entrevista técnica", "Oferta")
MATURE_DAYS = 21
BANDS = (("under50", "Abaixo de 50%", 0, 49), ("50to64", "50–64%", 50, 64), ("65to79", "65–79%", 65, 79), ("80plus", "80–100%", 80, 100))
THRESHOLD, LEAST_MATURE, LEAST_SIDE, PROMISING = 80, 10, 3, 10
NO_LABEL = "Não informada"


def outcomes(applications: DataFrame, as_of: str) -> DataFrame:
    """applications (applied_at, stages array<string>, and any others) that were sent, with response, interview, offer,
    rejected and mature (an interview, a rejection or 21 days). Null stages are none; a null applied_at was never sent."""
    s = F.coalesce("stages", F.array().cast("array<string>"))
    has = lambda names: F.arrays_overlap(s, F.array(*map(F.lit, names)))
    x = applications.where("applied_at IS NOT NULL").select("*", has(ANSWERS).alias("response"), has(INTERVIEWS).alias("interview"), has(["Oferta"]).alias("offer"), has(["Rejeitado"]).alias("rejected"))
    aged = F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(F.col("applied_at").cast("timestamp")) >= MATURE_DAYS * 86_400_000_000
    return x.withColumn("mature", F.coalesce(F.col("interview") | F.col("rejected") | aged, F.lit(False)))


def rate(part: Column, whole: Column) -> Column:
    """Whole percent, halves up; null of nothing."""
    return F.floor(F.try_divide(part * 100, whole) + 0.5).cast("long")


def _counts() -> list[Column]:
    c = lambda name: F.coalesce(F.count_if(name), F.lit(0))
    n = F.count("mature")
    return [
        n.alias("applications"), c("mature").alias("mature"), c("response").alias("responses"), c("interview").alias("interviews"), c("offer").alias("offers"),
        rate(c("response"), n).alias("response_rate"), rate(c("interview"), n).alias("interview_rate"),
    ]


def funnel(x: DataFrame) -> DataFrame:
    """One row over outcomes."""
    return x.agg(*_counts())


def _scored(x: DataFrame) -> DataFrame:
    return x.where("score IS NOT NULL AND NOT isnan(score)")


def bands(x: DataFrame) -> DataFrame:
    """One row a band of score (inclusive, whole numbers), empty bands too."""
    b = x.sparkSession.createDataFrame([(i, a, *r) for i, (a, *r) in enumerate(BANDS)], "place int, band string, label string, lo int, hi int")
    place = F.lit(None).cast("int")
    for i, (_, _, lo, hi) in enumerate(BANDS):
        place = F.when(F.col("score").between(lo, hi), F.lit(i)).otherwise(place)
    done = F.coalesce(F.count_if(F.col("mature") & F.col("interview")), F.lit(0))
    per = _scored(x).withColumn("place", place).where("place IS NOT NULL").groupBy("place").agg(*_counts(), done.alias("mature_interviews"), rate(done, F.count_if("mature")).alias("mature_interview_rate"))
    y = F.broadcast(b).join(per, "place", "left")  # four bands
    return y.na.fill(0, ["applications", "mature", "responses", "interviews", "offers", "mature_interviews"]).drop("place")


def cohorts(x: DataFrame, column: str) -> DataFrame:
    """One row a label of a column; null and empty labels are one."""
    label = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(NO_LABEL)).alias("label")
    return _scored(x).groupBy(label).agg(*_counts())


def calibration(x: DataFrame) -> DataFrame:
    """One row: whether high scores (from 80) lead to more interviews than lower ones, once there are enough."""
    m = _scored(x).where("mature").withColumn("high", F.col("score") >= THRESHOLD)
    c = lambda cond: F.coalesce(F.count_if(cond), F.lit(0))
    y = m.agg(c("high").alias("high_mature"), c(F.col("high") & F.col("interview")).alias("high_interviews"), c(~F.col("high")).alias("low_mature"), c(~F.col("high") & F.col("interview")).alias("low_interviews"))
    y = y.select("*", rate(F.col("high_interviews"), F.col("high_mature")).alias("high_rate"), rate(F.col("low_interviews"), F.col("low_mature")).alias("low_rate"))
    ready = (F.col("high_mature") + F.col("low_mature") >= LEAST_MATURE) & (F.col("high_mature") >= LEAST_SIDE) & (F.col("low_mature") >= LEAST_SIDE)
    y = y.select("*", ready.alias("ready"), (F.col("high_rate") - F.col("low_rate")).alias("difference"))
    return y.withColumn("status", F.when(~F.col("ready"), "insufficient").when(F.col("difference") >= PROMISING, "promising").otherwise("weak"))
