"""Queries over the catalog: rows out of payloads, identity, rankings inside companies, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobloom.functions import text, times, urls
from jobloom.plans.queries import query
from jobloom.session import staged, table


@query("""
WITH x AS (SELECT key, payload FROM jobs),
  m AS (SELECT key, true AS mandatory, generate_subscripts(r, 1) - 1 AS position, unnest(r) AS requirement FROM (SELECT key, json_extract_string(payload, '$.requirements[*]') AS r FROM x)),
  n AS (SELECT key, false AS mandatory, generate_subscripts(r, 1) - 1 AS position, unnest(r) AS requirement FROM (SELECT key, json_extract_string(payload, '$.differentials[*]') AS r FROM x))
SELECT key, mandatory, position::int AS position, requirement FROM m UNION ALL SELECT key, mandatory, position::int, requirement FROM n""")
def requirement_rows(spark: SparkSession, d: str) -> DataFrame:
    """The requirement lists of every payload as rows; position restarts in each list."""
    p = table(spark, d, "jobs").select("key", F.from_json("payload", "requirements array<string>, differentials array<string>").alias("p"))
    parts = [p.select("key", F.lit(m).alias("mandatory"), F.posexplode(F.col(f"p.{c}")).alias("position", "requirement")) for m, c in ((True, "requirements"), (False, "differentials"))]
    return parts[0].unionByName(parts[1])


@query("""
WITH s AS (SELECT source_id, job_key, url, row_number() OVER (PARTITION BY job_key, url ORDER BY source_id) AS r FROM (SELECT DISTINCT source_id, job_key, url FROM job_sources))
SELECT job_key, url, source_id, row_number() OVER (PARTITION BY job_key ORDER BY source_id) AS place FROM s WHERE r = 1""")
def ordered_sources(spark: SparkSession, d: str) -> DataFrame:
    """Distinct addresses of each job in order of first appearance."""
    s = table(spark, d, "job_sources").groupBy("job_key", "url").agg(F.min("source_id").alias("source_id"))
    return s.withColumn("place", F.row_number().over(W.partitionBy("job_key").orderBy("source_id")).cast("long"))


@query("""
WITH c AS (SELECT candidate_key, min(inbox_id) AS first FROM candidates GROUP BY 1), m AS (SELECT max(id) AS top FROM jobs)
SELECT candidate_key, top + row_number() OVER (ORDER BY first) AS id FROM c, m""")
def assigned_ids(spark: SparkSession, d: str) -> DataFrame:
    """New ids for postings of the inbox, after the catalog's largest, in order of arrival; ranks are counted inside
    blocks of the order and over the blocks' totals, not in one task."""
    c = table(spark, d, "candidates").groupBy("candidate_key").agg(F.min("inbox_id").alias("first")).withColumn("block", F.floor(F.col("first") / 4096))
    c = staged(c, "first-arrivals")
    n = c.groupBy("block").agg(F.count("*").alias("n"))
    before = n.select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a block
    top = table(spark, d, "jobs").agg(F.max("id").alias("top"))
    own = F.row_number().over(W.partitionBy("block").orderBy("first"))
    x = c.withColumn("own", own).join(before, "block").crossJoin(F.broadcast(top))  # one row
    return x.select("candidate_key", (F.col("top") + F.col("before") + F.col("own")).alias("id"))


@query(f"""
WITH k AS (SELECT DISTINCT h || p AS page FROM (SELECT regexp_extract(lower(key), '//(?:www\\.)?([^/?#:]*)', 1) AS h, regexp_extract(key, '//[^/?#]*([^?#]*)', 1) AS p FROM jobs)),
  c AS (SELECT provider, regexp_extract(lower(source_url), '//(?:www\\.)?([^/?#:]*)', 1) || regexp_extract(source_url, '//[^/?#]*([^?#]*)', 1) AS page FROM candidates)
SELECT provider, count(*) FILTER (page IN (SELECT page FROM k)) AS known, count(*) AS rows FROM c GROUP BY 1""")
def known_pages(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose page (host and path) is in the catalog, by provider."""
    page = lambda c: F.concat(urls.host(F.col(c)), F.regexp_extract(c, r"//[^/?#]*([^?#]*)", 1))
    k = table(spark, d, "jobs").select(page("key").alias("page")).distinct().withColumn("known", F.lit(1))
    c = table(spark, d, "candidates").select("provider", page("source_url").alias("page"))
    return c.join(k, "page", "left").groupBy("provider").agg(F.count("known").alias("known"), F.count("*").alias("rows"))


@query("""
SELECT company, count(*) AS jobs, count(*) FILTER (json_extract_string(payload, '$.level') IN ('Júnior', 'Junior', 'Estágio', 'Trainee', 'Assistente')) AS entry_level,
  count(DISTINCT location) AS places, max(updated_at)::timestamp AS updated_at FROM jobs GROUP BY 1""")
def company_stats(spark: SparkSession, d: str) -> DataFrame:
    entry = F.get_json_object("payload", "$.level").isin("Júnior", "Junior", "Estágio", "Trainee", "Assistente")
    return table(spark, d, "jobs").groupBy("company").agg(
        F.count("*").alias("jobs"), F.count_if(entry).alias("entry_level"), F.countDistinct("location").alias("places"), F.max("updated_at").cast("timestamp_ntz").alias("updated_at")
    )


@query("""
WITH n AS (SELECT company, skill, count(DISTINCT requirement_id) AS n FROM jobs j JOIN job_requirements r ON r.job_key = j.key WHERE skill IS NOT NULL GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY n DESC, skill) AS place, lead(n) OVER (PARTITION BY company ORDER BY n DESC, skill) AS next FROM n)
SELECT company, skill, n, place, next IS NULL OR next < n AS ahead FROM k WHERE place <= 6""")
def company_skills(spark: SparkSession, d: str) -> DataFrame:
    """The six skills each company asks for most, and whether each is ahead of the next."""
    r = table(spark, d, "job_requirements").where("skill IS NOT NULL").select(F.col("job_key").alias("key"), "skill", "requirement_id")
    n = r.join(table(spark, d, "jobs").select("key", "company"), "key").groupBy("company", "skill").agg(F.countDistinct("requirement_id").alias("n"))
    w = W.partitionBy("company").orderBy(F.desc("n"), "skill")
    k = n.select("company", "skill", "n", F.row_number().over(w).cast("long").alias("place"), F.lead("n").over(w).alias("next"))
    return k.where("place <= 6").select("company", "skill", "n", "place", (F.col("next").isNull() | (F.col("next") < F.col("n"))).alias("ahead"))


@query("""
SELECT skill, subskill, count(*) AS copies FROM (SELECT skill, subskill FROM job_requirements WHERE skill IS NOT NULL EXCEPT ALL SELECT skill, subskill FROM skill_catalog) GROUP BY 1, 2""")
def uncatalogued_skills(spark: SparkSession, d: str) -> DataFrame:
    """Typed (skill, subskill) left over when each catalog entry is taken away once."""
    r = table(spark, d, "job_requirements").where("skill IS NOT NULL").groupBy("skill", "subskill").agg(F.count("*").alias("n"))
    c = table(spark, d, "skill_catalog").groupBy("skill", "subskill").agg(F.count("*").alias("m"))
    x = r.join(F.broadcast(c), r["skill"].eqNullSafe(c["skill"]) & r["subskill"].eqNullSafe(c["subskill"]), "left")  # a fixed catalog of 70
    return x.select(r["skill"], r["subskill"], (F.col("n") - F.coalesce("m", F.lit(0))).alias("copies")).where("copies > 0")


@query("""
SELECT provider, date_trunc('week', discovered_at)::date AS week, count(*) AS rows, count(*) FILTER (discovered_at < b.ran) AS late
FROM candidates c JOIN (SELECT batch_no, arg_max(discovered_at, inbox_id) - INTERVAL 1 DAY AS ran FROM candidates GROUP BY 1) b USING (batch_no) GROUP BY 1, 2""")
def late_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Rows by provider and week, and how many were seen more than a day before their batch's last row."""
    c = table(spark, d, "candidates").select("provider", "batch_no", "inbox_id", "discovered_at")
    b = c.groupBy("batch_no").agg((F.max_by("discovered_at", "inbox_id") - F.expr("INTERVAL 1 DAY")).alias("ran"))
    x = c.join(b, "batch_no")
    return x.groupBy("provider", times.week(F.col("discovered_at")).alias("week")).agg(F.count("*").alias("rows"), F.count_if(F.col("discovered_at") < F.col("ran")).alias("late"))


@query("""
WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) > 3))) AS word FROM documents)
SELECT word, count(*) AS documents FROM w GROUP BY 1 HAVING count(*) >= 20""")
def frequent_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of four letters or more that at least twenty documents hold."""
    w = table(spark, d, "documents").select(F.explode(F.filter(text.tokens(F.col("text")), lambda t: F.length(t) > 3)).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("documents")).where("documents >= 20")


@query("""
WITH b AS (SELECT DISTINCT candidate_key, batch_no FROM candidates), g AS (SELECT *, batch_no - lag(batch_no) OVER (PARTITION BY candidate_key ORDER BY batch_no) AS gap FROM b)
SELECT candidate_key, min(batch_no) AS first_batch, max(batch_no) AS last_batch, count(*) AS batches, coalesce(max(gap), 0) AS longest_gap FROM g GROUP BY 1""")
def inbox_history(spark: SparkSession, d: str) -> DataFrame:
    """For each posting of the inbox, its first and last batch, in how many it came and the longest gap between two."""
    b = table(spark, d, "candidates").select("candidate_key", "batch_no").distinct()
    g = b.withColumn("gap", F.col("batch_no") - F.lag("batch_no").over(W.partitionBy("candidate_key").orderBy("batch_no")))
    return g.groupBy("candidate_key").agg(
        F.min("batch_no").alias("first_batch"), F.max("batch_no").alias("last_batch"), F.count("*").alias("batches"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap")
    )


@query("""
WITH o AS (SELECT source_url AS key, arg_max(CASE WHEN description IS NULL THEN 'textless' ELSE 'read' END, (discovered_at, CASE WHEN description IS NULL THEN 'textless' ELSE 'read' END)) AS now, max(discovered_at) AS at
    FROM candidates WHERE source_url IS NOT NULL GROUP BY 1)
SELECT coalesce(j.key, o.key) AS key, CASE WHEN j.status = 'Encerrada' THEN j.status WHEN o.now IS NULL OR o.now = 'textless' THEN coalesce(j.status, o.now) ELSE o.now END AS status,
  (CASE WHEN j.key IS NULL THEN 0 ELSE 1 END + CASE WHEN o.now IS NULL OR o.now = 'textless' THEN 0 ELSE 1 END)::int AS attempts,
  coalesce(j.first_seen_at, o.at)::timestamp AS first_seen, greatest(j.updated_at, o.at)::timestamp AS last_seen
FROM jobs j FULL JOIN o ON j.key = o.key""")
def page_states(spark: SparkSession, d: str) -> DataFrame:
    """The catalog's pages after a run over the whole inbox: rows without text are passive, closed jobs stay closed."""
    from jobloom.operators import state

    c = table(spark, d, "candidates")
    o = c.select(F.col("source_url").alias("key"), F.when(F.col("description").isNull(), "textless").otherwise("read").alias("status"), F.col("discovered_at").alias("at"))
    h = table(spark, d, "jobs").select("key", "status", F.lit(1).alias("attempts"), F.col("first_seen_at").alias("first_seen"), F.col("updated_at").alias("last_seen"))
    x = state.advance(h, o, "key", ["textless"], ["Encerrada"])
    return x.select("key", "status", "attempts", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


_BOARDS = """WITH u AS (SELECT inbox_id, trim(source_url) AS plain, 'https://www.linkedin.com/jobs/view/dev-' || (1000000 + inbox_id) || '?trk=x' AS numbered,
    'https://banco' || inbox_id % 7 || '.gupy.io/jobs/' || inbox_id || '?jobBoardSource=y' AS board FROM candidates WHERE source_url IS NOT NULL)"""


@query(_BOARDS + """
SELECT inbox_id, lower(regexp_extract(plain, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(plain, '//([^/?#]*)', 1)) || regexp_replace(regexp_extract(plain, '//[^/?#]*([^?#]*)', 1), '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(plain, '^[^?#]*\\?([^#]*)', 1), '&'),
      lambda p: regexp_matches(p, '=.') AND lower(split_part(p, '=', 1)) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'trk', 'trackingid', 'jobboardsource'))), '&'), ''), '') AS audit,
  lower(regexp_extract(lower(plain), '//(?:www\\.)?([^/?#]*)', 1) || regexp_replace(regexp_extract(plain, '//[^/?#]*([^?#]*)', 1), '/+$', '')) AS catalog,
  'linkedin:' || (1000000 + inbox_id) AS numbered, 'banco' || inbox_id % 7 || '.gupy.io:' || inbox_id AS board, 'https://www.linkedin.com/jobs/view/' || (1000000 + inbox_id) AS again,
  'linkedin' AS numbered_provider, 'gupy' AS board_provider, true AS is_posting FROM u""")
def canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of postings by their address: those of the inbox, and two numbered boards made out of their ids."""
    i = F.col("inbox_id").cast("string")
    u = table(spark, d, "candidates").where("source_url IS NOT NULL").select("inbox_id", F.col("source_url").alias("plain"),
        F.concat(F.lit("https://www.linkedin.com/jobs/view/dev-"), (F.col("inbox_id") + 1_000_000).cast("string"), F.lit("?trk=x")).alias("numbered"),
        F.concat(F.lit("https://banco"), (F.col("inbox_id") % 7).cast("string"), F.lit(".gupy.io/jobs/"), i, F.lit("?jobBoardSource=y")).alias("board"))
    n = urls.canonical_id(F.col("numbered"))
    return u.select("inbox_id", urls.canonical_id(F.col("plain")).alias("audit"), urls.catalog_id(F.col("plain")).alias("catalog"), n.alias("numbered"), urls.catalog_id(F.col("board")).alias("board"),
                    urls.retry_address(n).alias("again"), urls.provider(F.col("numbered")).alias("numbered_provider"), urls.provider(F.col("board")).alias("board_provider"),
                    (F.regexp_extract("board", "^https://([^/]*)", 1) == F.concat(F.lit("banco"), (F.col("inbox_id") % 7).cast("string"), F.lit(".gupy.io"))).alias("is_posting"))
