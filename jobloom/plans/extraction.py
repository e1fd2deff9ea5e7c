"""Queries that read text structure out of documents and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.plans.queries import query
from jobloom.session import table
from jobloom.sources import pages


@query()
def document_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of requirements, lines and links of every document, as if it were a page."""
    x = pages.parse_pages(table(spark, d, "documents").select("doc_id", "text"), "text")
    return x.select("doc_id", "n_lines", F.size("requirements").alias("requirements"), F.size("differentials").alias("differentials"), F.size("duties").alias("duties"), F.size("links").alias("links"))


@query("""
WITH x AS (SELECT id, json_extract_string(payload, '$.requirements[*]') AS r, json_extract_string(payload, '$.differentials[*]') AS d FROM jobs)
SELECT id, len(r) AS requirements, len(d) AS differentials, len(list_intersect(r, d)) AS both, list_aggregate(list_transform(r, lambda t: length(t)), 'sum')::bigint AS letters FROM x""")
def payload_lists(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the requirement lists in every payload."""
    s = F.from_json("payload", "requirements array<string>, differentials array<string>")
    x = table(spark, d, "jobs").select("id", s.alias("p")).select("id", "p.*")
    letters = F.aggregate("requirements", F.lit(0).cast("long"), lambda a, t: a + F.length(t))
    return x.select("id", F.size("requirements").cast("long").alias("requirements"), F.size("differentials").cast("long").alias("differentials"),
                    F.size(F.array_intersect("requirements", "differentials")).cast("long").alias("both"), F.when(F.size("requirements") > 0, letters).alias("letters"))


@query("""
SELECT (length(text) - length(replace(text, chr(10), ''))) AS breaks, count(*) AS documents, sum(length(text))::bigint AS letters FROM documents GROUP BY 1""")
def document_lines(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.length("text").alias("n"), F.length(F.replace("text", F.lit("\n"), F.lit(""))).alias("m"))
    return x.groupBy((F.col("n") - F.col("m")).cast("long").alias("breaks")).agg(F.count("*").alias("documents"), F.sum("n").alias("letters"))
