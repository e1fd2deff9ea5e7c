"""Queries that hold inbox rows against the catalog, and postings built out of catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import postings, text, verification
from jobloom.operators import resolution
from jobloom.plans.queries import AS_OF, query
from jobloom.session import table

_WORDS = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"


def _city(location: Column) -> Column:
    return text.norm_words(F.split(location, "[,/|]")[0])


@query()
def title_matches(spark: SparkSession, d: str) -> DataFrame:
    """For each posting of the inbox, the catalog job of the same firm whose title is most alike, and whether that
    settles it. Blocks of firm and city keep the comparisons to real candidates."""
    c = table(spark, d, "candidates").groupBy("candidate_key").agg(F.min_by(F.struct("title", "company", "location"), "inbox_id").alias("r")).select("candidate_key", "r.*")
    c = c.select("candidate_key", resolution.title_form(F.col("title")).alias("x"), F.nullif(text.compact(F.col("company")), F.lit("")).alias("firm"), _city(F.col("location")).alias("city"))
    j = table(spark, d, "jobs").select("id", resolution.title_form(F.col("role")).alias("y"), F.nullif(text.compact(F.col("company")), F.lit("")).alias("firm"), _city(F.col("location")).alias("place"))
    p = c.join(j, "firm").where(F.coalesce(F.col("city") == F.col("place"), F.lit(True)))
    p = resolution.with_ratio(p, "x", "y", "similarity")
    p = p.withColumn("score", resolution.evidence(F.col("similarity"), F.lit(1.0), F.lit(1.0), F.col("city"), F.col("place")))
    return resolution.decide(p.select("candidate_key", "id", "score", F.lit(True).alias("confirmed"), F.lit(False).alias("failed")), "candidate_key", "id")


@query(f"""
WITH n AS (SELECT id, list_distinct(list_filter(string_split({_WORDS.format("company")}, ' '), lambda w: w <> '' AND w NOT IN ('a', 'as', 'da', 'das', 'de', 'do', 'dos', 'e', 'for', 'para', 'the', 'sa', 'ltda', 'inc'))) AS e, company FROM jobs)
SELECT j.id, role AS title, trim(j.company) AS employer, nullif(array_to_string(list_filter([trim(split_part(location, ',', 1)), 'Brasil'], lambda x: x <> ''), ', '), '') AS place,
  CASE WHEN modality = 'Remoto' THEN 'Remoto' WHEN modality = 'Híbrido' THEN 'Híbrido' WHEN modality = 'Presencial' THEN 'Presencial' END AS modality,
  'firma' || j.id % 5 || '.example' AS domain, len(e) >= 2 AS legal_name, ['https://firma' || j.id % 5 || '.example/v/' || j.id, 'https://x.vagas.example/1'] AS links
FROM jobs j JOIN n USING (id)""")
def posting_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields read back out of postings that are built from catalog rows: organisation as an object, a list or a text,
    location as an object or a list."""
    j = table(spark, d, "jobs")
    site = F.concat(F.lit("https://www.firma"), (F.col("id") % 5).cast("string"), F.lit(".example/sobre"))
    org = F.struct(F.col("company").alias("name"), site.alias("sameAs"))
    place = F.struct(F.struct(F.trim(F.split("location", ",")[0]).alias("addressLocality"), F.lit("").alias("addressRegion"), F.lit("Brasil").alias("addressCountry")).alias("address"))
    remote = F.when(F.col("modality") == "Remoto", F.lit("TELECOMMUTE"))
    one = F.to_json(F.struct(F.col("role").alias("title"), org.alias("hiringOrganization"), place.alias("jobLocation"), remote.alias("jobLocationType")))
    many = F.to_json(F.struct(F.col("role").alias("title"), F.array(org).alias("hiringOrganization"), F.array(place).alias("jobLocation"), remote.alias("jobLocationType")))
    bare = F.to_json(F.struct(F.col("role").alias("title"), F.col("company").alias("hiringOrganization")))
    said = F.when(F.col("modality") != "Remoto", F.concat(F.lit("Modelo: "), "modality"))
    x = j.select("id", "company", one.alias("p"), F.when(F.col("id") % 3 == 0, one).when(F.col("id") % 3 == 1, many).otherwise(bare).alias("o"), F.when(F.col("id") % 2 == 0, one).otherwise(many).alias("l"), said.alias("said"))
    own = F.concat(F.lit("https://firma"), (F.col("id") % 5).cast("string"), F.lit(".example/v/"), F.col("id").cast("string"))
    links = postings.official_links(own, F.lit("http://firma0.example/no-https"), F.concat(F.lit("Veja <a href='https://x.vagas.example/1'>aqui</a>, https://outra.example/2, "), own, F.lit(".")), [f"firma{i}.example" for i in range(5)] + [".vagas.example"])
    return x.select("id", postings.title(F.col("p")).alias("title"), postings.employer(F.col("o")).alias("employer"), postings.places(F.col("l")).alias("place"), postings.modality(F.col("p"), F.col("said")).alias("modality"),
                    postings.domain(F.col("p")).alias("domain"), postings.same_employer(F.concat(F.lit("Grupo "), "company", F.lit(" S.A.")), F.col("company")).alias("legal_name"), links.alias("links"))


@query(f"""
WITH s AS (SELECT job_key, arg_max(http_status, coalesce(last_verified_at, TIMESTAMP '0001-01-01')) AS http, max(last_verified_at) AS seen FROM (SELECT DISTINCT * FROM job_sources) WHERE http_status IS NOT NULL GROUP BY 1),
  u AS (SELECT job_key, count(*) AS n FROM (SELECT job_key, coalesce(last_verified_at, TIMESTAMP '0001-01-01') AS t, count(DISTINCT http_status) AS k FROM job_sources WHERE http_status IS NOT NULL GROUP BY 1, 2) WHERE k > 1 GROUP BY 1),
  x AS (SELECT key, status, updated_at, seen, CASE WHEN http IN (404, 410) THEN 'closed' WHEN coalesce(http, 0) <> 200 THEN 'pending' ELSE 'confirmed' END AS state FROM jobs LEFT JOIN s ON s.job_key = key WHERE key NOT IN (SELECT job_key FROM u)),
  p AS (SELECT *, CASE WHEN status = 'Encerrada' THEN 'closed' WHEN state = 'pending' AND updated_at IS NOT NULL AND (seen IS NULL OR updated_at > seen) THEN 'pending'
      WHEN status = 'Ativa' AND seen IS NOT NULL AND greatest(0, floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(seen)) / 86400000000.0)) <= 7 THEN 'confirmed' ELSE 'pending' END AS public_state FROM x)
SELECT state, public_state, count(*) AS jobs FROM p GROUP BY 1, 2""")
def validation_states(spark: SparkSession, d: str) -> DataFrame:
    """States of catalog jobs by the newest answer of any of their pages; jobs whose newest answers differ are left to
    people."""
    s = table(spark, d, "job_sources").where("http_status IS NOT NULL").select("job_key", "http_status", F.coalesce("last_verified_at", F.to_timestamp(F.lit("0001-01-01"))).alias("t"), "last_verified_at").distinct()
    unsure = s.groupBy("job_key", "t").agg(F.countDistinct("http_status").alias("k")).where("k > 1").select(F.col("job_key").alias("key")).distinct()
    s = s.groupBy("job_key").agg(F.max_by("http_status", "t").alias("http"), F.max("last_verified_at").alias("at"))
    x = table(spark, d, "jobs").select("key", "status", "updated_at").join(unsure, "key", "left_anti").join(s.withColumnRenamed("job_key", "key"), "key", "left")
    none = F.lit(None)
    f = verification.fetched(F.col("http"), none.cast("string"), none.cast("timestamp"), F.lit(1.0), F.lit(True), F.lit(True), F.lit("x" * 200), AS_OF)
    x = x.withColumn("state", f["state"])
    x = x.withColumn("public_state", verification.public_state(F.lit(False), F.col("status"), F.col("state"), F.col("updated_at"), F.col("at"), AS_OF))
    return x.groupBy("state", "public_state").agg(F.count("*").alias("jobs"))


@query("""
WITH p AS (SELECT provider, batch_no, source_url AS address, CASE WHEN inbox_id % 50 = 0 THEN NULL ELSE batch_no * 3 END AS total, CASE WHEN inbox_id % 997 = 0 THEN 'timeout' END AS error FROM candidates),
  g AS (SELECT provider || ' ' || batch_no AS board, count(DISTINCT address) AS postings, max(total) AS total, count(error) AS errors FROM p GROUP BY 1)
SELECT board, postings, CASE WHEN errors = 0 AND postings > 0 AND postings >= coalesce(total, 0) THEN 'complete' ELSE 'error' END AS state FROM g""")
def board_states(spark: SparkSession, d: str) -> DataFrame:
    """Which loads of a provider are complete; each batch of a provider stands for a board, its rows for pages."""
    c = table(spark, d, "candidates")
    p = c.select(F.concat_ws(" ", "provider", "batch_no").alias("board"), F.col("source_url").alias("address"), F.when(F.col("inbox_id") % 50 != 0, F.col("batch_no") * 3).alias("total"), F.when(F.col("inbox_id") % 997 == 0, F.lit("timeout")).alias("error"))
    return resolution.complete(p, "board")


@query("""
WITH c AS (SELECT provider, source_url, min(inbox_id) AS inbox_id, min(batch_no) AS batch_no FROM candidates WHERE source_url IS NOT NULL GROUP BY 1, 2),
  h AS (SELECT inbox_id, CASE inbox_id % 4 WHEN 0 THEN '120' WHEN 1 THEN 'Sun, 01 Mar 2026 00:10:00 GMT' WHEN 2 THEN 'soon' END AS header, 1 + inbox_id % 10 AS failures FROM c)
SELECT inbox_id, greatest(1.0, least(86400.0, coalesce(try_cast(header AS double), epoch(try_strptime(header, '%a, %d %b %Y %H:%M:%S GMT')) - epoch(TIMESTAMP '2026-03-01'), 30.0 * 2 ** least(failures - 1, 6))))::double AS seconds FROM h""")
def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    """How long to wait before a page is asked for again."""
    c = table(spark, d, "candidates").where("source_url IS NOT NULL").groupBy("provider", "source_url").agg(F.min("inbox_id").alias("inbox_id"))
    r = F.col("inbox_id") % 4
    header = F.when(r == 0, F.lit("120")).when(r == 1, F.lit("Sun, 01 Mar 2026 00:10:00 GMT")).when(r == 2, F.lit("soon"))
    return c.select("inbox_id", verification.retry_delay(header, 1 + F.col("inbox_id") % 10, AS_OF).alias("seconds"))


@query(f"""
WITH t AS (SELECT key, location, {_WORDS.format("role")} AS x FROM jobs)
SELECT key, nullif({_WORDS.format("trim(regexp_split_to_array(location, '[,/|]')[1])")}, '') AS city, regexp_replace(regexp_replace(regexp_replace(x, '\\b(jr|junior)\\b', 'junior', 'g'), '\\bdev\\b', 'desenvolvedor', 'g'), '\\banl\\b', 'analista', 'g') AS title_form FROM t""")
def title_forms(spark: SparkSession, d: str) -> DataFrame:
    """Titles and cities as they are compared with official postings."""
    return table(spark, d, "jobs").select("key", F.nullif(_city(F.col("location")), F.lit("")).alias("city"), resolution.title_form(F.col("role")).alias("title_form"))
