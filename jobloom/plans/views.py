"""Views over catalog and inbox: text forms, sort modes, named samples, pay, redirects, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobloom.functions import markup, urls
from jobloom.functions.text import norm_blank, norm_plain
from jobloom.plans.queries import query
from jobloom.session import table


@query("""
SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')))) AS page,
  md5(trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS inbox,
  md5(regexp_replace(lower(strip_accents(regexp_replace(text, '<[^>]+>', '', 'g'))), '[^\\p{L}\\p{N}]+', '', 'g')) AS identity, md5(lower(strip_accents(text))) AS plain FROM documents""")
def norm_forms(spark: SparkSession, d: str) -> DataFrame:
    """The forms in which pages, inbox rows and names are compared, of every document."""
    t = F.col("text")
    x = table(spark, d, "documents").select("doc_id", markup.norm_page(t).alias("page"), markup.norm_inbox(t).alias("inbox"), markup.norm_identity(t).alias("identity"), norm_plain(t).alias("plain"))
    return x.select("doc_id", *[F.md5(c).alias(c) for c in ("page", "inbox", "identity", "plain")])


@query("""
WITH r AS (SELECT lower(regexp_extract(base_url, '//(?:www\\.)?([^/?#:]*)', 1)) AS host, min(priority) AS priority FROM source_registry GROUP BY 1),
  j AS (SELECT key, updated_at, coalesce(priority, 9) AS priority, len(json_extract_string(payload, '$.requirements[*]')) AS n FROM jobs LEFT JOIN r ON r.host = lower(regexp_extract(key, '//(?:www\\.)?([^/?#:]*)', 1)) WHERE status <> 'Encerrada'),
  m AS (SELECT 'date' AS mode, key, row_number() OVER (ORDER BY updated_at DESC, key) AS place FROM j UNION ALL SELECT 'priority', key, row_number() OVER (ORDER BY priority, updated_at DESC, key) FROM j
    UNION ALL SELECT 'requirements', key, row_number() OVER (ORDER BY n DESC, key) FROM j)
SELECT * FROM m WHERE place <= 25""")
def radar_modes(spark: SparkSession, d: str) -> DataFrame:
    """The first page of open jobs in each way of sorting."""
    r = table(spark, d, "source_registry").groupBy(urls.host(F.col("base_url")).alias("host")).agg(F.min("priority").alias("priority"))  # a fixed list
    j = table(spark, d, "jobs").where("status <> 'Encerrada'").withColumn("host", urls.host(F.col("key"))).join(F.broadcast(r), "host", "left")
    j = j.select("key", "updated_at", F.coalesce("priority", F.lit(9)).alias("priority"), F.size(F.from_json(F.get_json_object("payload", "$.requirements"), "array<string>")).alias("n"))
    modes = {"date": [F.desc("updated_at"), "key"], "priority": ["priority", F.desc("updated_at"), "key"], "requirements": [F.desc("n"), "key"]}
    out = None
    for mode, order in modes.items():
        x = j.orderBy(*order).limit(25)  # a page
        x = x.select(F.lit(mode).alias("mode"), "key", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))
        out = x if out is None else out.union(x)
    return out


@query("""
SELECT count(*) FILTER (status = 'Ativa') AS active, count(*) FILTER (status = 'Ativa' AND modality IS NOT NULL AND location IS NOT NULL) AS market_sample, count(*) FILTER (status = 'Possivelmente encerrada') AS pending,
  count(*) FILTER (status <> 'Encerrada' AND (location IS NULL OR modality IS NULL)) AS review FROM jobs""")
def named_samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").agg(
        F.count_if(F.col("status") == "Ativa").alias("active"), F.count_if((F.col("status") == "Ativa") & F.col("modality").isNotNull() & F.col("location").isNotNull()).alias("market_sample"),
        F.count_if(F.col("status") == "Possivelmente encerrada").alias("pending"), F.count_if((F.col("status") != "Encerrada") & (F.col("location").isNull() | F.col("modality").isNull())).alias("review"),
    )


@query("""
WITH a AS (SELECT source_url AS key, arg_max(json_extract_string(raw, '$.faixa'), inbox_id) FILTER (json_extract_string(raw, '$.faixa') IS NOT NULL) AS range FROM candidates WHERE source_url IS NOT NULL GROUP BY 1),
  p AS (SELECT key, try_cast(split_part(range, '-', 1) AS double) AS lo, try_cast(split_part(range, '-', 2) AS double) AS hi FROM a),
  e(level, lo, hi) AS (VALUES ('Júnior', 3000.0, 6000.0), ('Pleno', 6000.0, 10000.0), ('Sênior', 10000.0, 16000.0))
SELECT key, CASE WHEN p.lo >= 0 AND p.hi >= p.lo THEN 'advertised' WHEN e.lo IS NOT NULL THEN 'estimated' END AS kind, CASE WHEN p.lo >= 0 AND p.hi >= p.lo THEN p.lo ELSE e.lo END AS lo, CASE WHEN p.lo >= 0 AND p.hi >= p.lo THEN p.hi ELSE e.hi END AS hi
FROM jobs j LEFT JOIN p USING (key) LEFT JOIN e ON e.level = json_extract_string(payload, '$.level')""")
def job_pay(spark: SparkSession, d: str) -> DataFrame:
    """Pay of each job: as advertised, else as estimated for its level, else none."""
    said = F.get_json_object("raw", "$.faixa")
    a = table(spark, d, "candidates").where("source_url IS NOT NULL").groupBy(F.col("source_url").alias("key")).agg(F.max_by(said, F.when(said.isNotNull(), F.col("inbox_id"))).alias("r"))
    p = a.select("key", F.try_element_at(F.split("r", "-"), F.lit(1)).try_cast("double").alias("plo"), F.try_element_at(F.split("r", "-"), F.lit(2)).try_cast("double").alias("phi"))
    e = spark.createDataFrame([("Júnior", 3000.0, 6000.0), ("Pleno", 6000.0, 10000.0), ("Sênior", 10000.0, 16000.0)], "level string, elo double, ehi double")
    x = table(spark, d, "jobs").select("key", F.get_json_object("payload", "$.level").alias("level")).join(p, "key", "left").join(F.broadcast(e), "level", "left")
    ok = F.coalesce((F.col("plo") >= 0) & (F.col("phi") >= F.col("plo")), F.lit(False))
    kind = F.when(ok, "advertised").when(F.col("elo").isNotNull(), "estimated")
    return x.select("key", kind.alias("kind"), F.when(ok, F.col("plo")).otherwise(F.col("elo")).alias("lo"), F.when(ok, F.col("phi")).otherwise(F.col("ehi")).alias("hi"))


_PATH = "lower(regexp_extract(trim({0}), '//(?:[^/?#@]*@)?(?:[wW]{{3}}\\.)?([^/?#:]*)', 1)) || regexp_replace(regexp_extract(trim({0}), '//[^/?#]*([^?#]*)', 1), '/+$', '')"


@query(f"""
WITH s AS (SELECT {_PATH.format("url")} AS page, min(job_key) AS job_key FROM job_sources WHERE url IS NOT NULL AND job_key IS NOT NULL GROUP BY 1),
  c AS (SELECT inbox_id, provider, {_PATH.format("source_url")} AS page FROM candidates WHERE source_url IS NOT NULL)
SELECT provider, count(*) AS rows, count(s.job_key) AS redirected, count(DISTINCT s.job_key) AS jobs FROM c LEFT JOIN s USING (page) GROUP BY 1""")
def redirected_rows(spark: SparkSession, d: str) -> DataFrame:
    """Inbox rows whose page is one of a catalog job's sources, which leads them to the job's own key."""
    page = lambda c: F.concat(F.coalesce(urls.host(F.col(c)), F.lit("")), F.regexp_replace(F.regexp_extract(F.trim(c), r"//[^/?#]*([^?#]*)", 1), "/+$", ""))
    s = table(spark, d, "job_sources").where("url IS NOT NULL AND job_key IS NOT NULL").groupBy(page("url").alias("page")).agg(F.min("job_key").alias("job_key"))
    c = table(spark, d, "candidates").where("source_url IS NOT NULL").select("provider", page("source_url").alias("page"))
    return c.join(s, "page", "left").groupBy("provider").agg(F.count("*").alias("rows"), F.count("job_key").alias("redirected"), F.countDistinct("job_key").alias("jobs"))


@query("""
WITH p(skill, level, evidence) AS (VALUES ('Python', 2, 3), ('Java', 1, 1), ('SQL', 3, 2)), r AS (SELECT DISTINCT requirement_id, skill, required_level FROM job_requirements WHERE category = 'technical')
SELECT r.skill, coalesce(p.level, 0) AS level, coalesce(p.evidence, 0) AS evidence, count(*) AS requirements, count(*) FILTER (coalesce(required_level, 1) <= coalesce(p.level, 0)) AS reached FROM r LEFT JOIN p ON p.skill = r.skill GROUP BY 1, 2, 3""")
def profile_levels(spark: SparkSession, d: str) -> DataFrame:
    """Technical requirements by skill beside a profile; a skill that isn't in it has level and evidence 0."""
    p = spark.createDataFrame([("Python", 2, 3), ("Java", 1, 1), ("SQL", 3, 2)], "skill string, level int, evidence int")
    r = table(spark, d, "job_requirements").where("category = 'technical'").select("requirement_id", "skill", "required_level").distinct()
    x = r.join(F.broadcast(p), "skill", "left")  # one profile
    level, evidence = F.coalesce("level", F.lit(0)), F.coalesce("evidence", F.lit(0))
    return x.groupBy("skill", level.alias("level"), evidence.alias("evidence")).agg(F.count("*").alias("requirements"), F.count_if(F.coalesce("required_level", F.lit(1)) <= level).alias("reached"))


@query("""
WITH k AS (SELECT DISTINCT skill FROM skill_catalog), w AS (SELECT lower(strip_accents(skill)) AS x FROM k)
SELECT count(*) AS skills, count(*) FILTER (regexp_matches(x, '\\b(java|spring|python|sql|aws|azure|docker|kubernetes|kafka)\\b')) AS common FROM w""")
def catalog_technologies(spark: SparkSession, d: str) -> DataFrame:
    """Skills of the catalog, and how many name one of the commonest technologies."""
    k = table(spark, d, "skill_catalog").select("skill").distinct().select(norm_blank(F.col("skill")).alias("x"))
    return k.agg(F.count("*").alias("skills"), F.count_if(F.col("x").rlike(r"\b(java|spring|python|sql|aws|azure|docker|kubernetes|kafka)\b")).alias("common"))
