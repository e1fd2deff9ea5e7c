"""Outcome queries. Orders stand for applications: sent on their date, with stages by status and priority, a score out of
the price and the priority as cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.operators import feedback
from jobloom.plans.queries import query
from jobloom.session import table

AS_OF = "1998-08-05 00:00:00"


def _applications(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    more = F.when(F.col("o_orderstatus") == "F", F.lit("Entrevista RH")).when(F.col("o_orderstatus") == "P", F.lit("Rejeitado")).when(F.col("o_orderpriority") == "1-URGENT", F.lit("Oferta"))
    stages = F.filter(F.array(F.lit("Candidatado"), more), lambda s: s.isNotNull())
    score = F.pmod(F.floor("o_totalprice"), F.lit(103)).cast("double")  # 101 and 102 lie in no band
    return feedback.outcomes(o.select(F.col("o_orderdate").alias("applied_at"), stages.alias("stages"), score.alias("score"), F.col("o_orderpriority").alias("source")), AS_OF)


_APPLICATIONS = """WITH o AS (SELECT o_orderpriority AS source, floor(o_totalprice)::bigint % 103 AS score,
    o_orderstatus IN ('F', 'P') OR o_orderpriority = '1-URGENT' AS response, o_orderstatus = 'F' OR (o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT') AS interview,
    o_orderstatus NOT IN ('F', 'P') AND o_orderpriority = '1-URGENT' AS offer, o_orderstatus = 'P' AS rejected, o_orderdate FROM orders WHERE o_orderdate IS NOT NULL),
  x AS (SELECT *, interview OR rejected OR TIMESTAMP '1998-08-05' - o_orderdate >= INTERVAL 21 DAYS AS mature FROM o)"""
_COUNTS = """count(mature) AS applications, count(*) FILTER (mature) AS mature, count(*) FILTER (response) AS responses, count(*) FILTER (interview) AS interviews, count(*) FILTER (offer) AS offers,
  CASE WHEN count(mature) > 0 THEN floor(count(*) FILTER (response) * 100 / count(mature) + 0.5)::bigint END AS response_rate,
  CASE WHEN count(mature) > 0 THEN floor(count(*) FILTER (interview) * 100 / count(mature) + 0.5)::bigint END AS interview_rate"""


@query(f"{_APPLICATIONS} SELECT {_COUNTS} FROM x")
def feedback_funnel(spark: SparkSession, d: str) -> DataFrame:
    return feedback.funnel(_applications(spark, d))


@query(f"""{_APPLICATIONS}, b(band, label, lo, hi) AS (VALUES ('under50', 'Abaixo de 50%', 0, 49), ('50to64', '50–64%', 50, 64), ('65to79', '65–79%', 65, 79), ('80plus', '80–100%', 80, 100))
SELECT band, label, lo, hi, {_COUNTS}, count(*) FILTER (mature AND interview) AS mature_interviews,
  CASE WHEN count(*) FILTER (mature) > 0 THEN floor(count(*) FILTER (mature AND interview) * 100 / count(*) FILTER (mature) + 0.5)::bigint END AS mature_interview_rate
FROM b LEFT JOIN x ON score BETWEEN lo AND hi GROUP BY 1, 2, 3, 4""")
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    return feedback.bands(_applications(spark, d))


@query(f"{_APPLICATIONS} SELECT coalesce(nullif(source, ''), 'Não informada') AS label, {_COUNTS} FROM x GROUP BY 1")
def cohort_rates(spark: SparkSession, d: str) -> DataFrame:
    return feedback.cohorts(_applications(spark, d), "source")


@query(f"""{_APPLICATIONS}, m AS (SELECT count(*) FILTER (score >= 80) AS hm, count(*) FILTER (score >= 80 AND interview) AS hi, count(*) FILTER (score < 80) AS lm, count(*) FILTER (score < 80 AND interview) AS li FROM x WHERE mature),
  r AS (SELECT *, CASE WHEN hm > 0 THEN floor(hi * 100 / hm + 0.5)::bigint END AS hr, CASE WHEN lm > 0 THEN floor(li * 100 / lm + 0.5)::bigint END AS lr FROM m)
SELECT hm AS high_mature, hi AS high_interviews, lm AS low_mature, li AS low_interviews, hr AS high_rate, lr AS low_rate, hm + lm >= 10 AND hm >= 3 AND lm >= 3 AS ready, hr - lr AS difference,
  CASE WHEN NOT (hm + lm >= 10 AND hm >= 3 AND lm >= 3) THEN 'insufficient' WHEN hr - lr >= 10 THEN 'promising' ELSE 'weak' END AS status FROM r""")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    return feedback.calibration(_applications(spark, d))
