"""Queries of the core operators: name -> (session, folder) -> rows, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobloom.functions import requirements as req
from jobloom.functions import text, times, urls
from jobloom.operators import merge, schedule, similar
from jobloom.session import staged, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


AS_OF = "2026-03-01 00:00:00"


@query("""
SELECT skill, count(DISTINCT company) AS companies, count(DISTINCT job_key) AS jobs,
  count(DISTINCT CASE WHEN mandatory THEN company END) AS required_by
FROM job_requirements r JOIN jobs j ON j.key = r.job_key
WHERE skill IS NOT NULL AND status <> 'Encerrada' GROUP BY skill""")
def technology_demand(spark: SparkSession, d: str) -> DataFrame:
    """Demand for each skill: companies, jobs and how many companies require it."""
    r = table(spark, d, "job_requirements").where("skill IS NOT NULL").select("job_key", "skill", "mandatory").distinct()
    j = table(spark, d, "jobs").where("status <> 'Encerrada'").select(F.col("key").alias("job_key"), "company")
    return r.join(j, "job_key").groupBy("skill").agg(
        F.countDistinct("company").alias("companies"),
        F.countDistinct("job_key").alias("jobs"),
        F.countDistinct(F.when(F.col("mandatory"), F.col("company"))).alias("required_by"),
    )


@query("""
WITH t AS (SELECT DISTINCT id, unnest(json_extract_string(payload, '$.requirements[*]')) AS item FROM jobs)
SELECT item, count(*) AS jobs, count(*) * 100 // max(count(*)) OVER () AS pct FROM t GROUP BY item ORDER BY jobs DESC, item LIMIT 10""")
def item_demand_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent requirement sentences of the catalog, with their share of the first."""
    items = F.from_json(F.get_json_object("payload", "$.requirements"), "array<string>")
    x = table(spark, d, "jobs").select(F.explode(F.array_distinct(items)).alias("item"))
    top = x.groupBy("item").agg(F.count("*").alias("jobs")).orderBy(F.desc("jobs"), "item").limit(10)
    return top.withColumn("pct", F.floor(F.col("jobs") * 100 / F.max("jobs").over(W.partitionBy())).cast("long"))


@query("""
SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) AS words_md5,
  md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '', 'g')) AS compact_md5 FROM documents""")
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", text.norm_words(F.col("text")).alias("w"))
    return x.select("doc_id", F.md5("w").alias("words_md5"), F.md5(F.replace("w", F.lit(" "), F.lit(""))).alias("compact_md5"))


@query("""
WITH r AS (SELECT DISTINCT job_key, requirement_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(strip_accents(requirement)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> ''))) AS t FROM job_requirements WHERE requirement IS NOT NULL),
  p AS (SELECT a.job_key, a.requirement_id AS a, b.requirement_id AS b, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS similarity
    FROM r a JOIN r b ON a.job_key = b.job_key AND a.requirement_id < b.requirement_id WHERE len(a.t) > 0 AND len(b.t) > 0 AND a.t <> b.t)
SELECT a, b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.6""")
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Requirements of one job whose word sets differ and are at least 0.6 similar (Jaccard)."""
    r = table(spark, d, "job_requirements").select("requirement_id", "job_key", text.tokens(F.col("requirement")).alias("t")).distinct()
    w = F.array_sort("t")
    r = r.withColumn("t", w)
    links = similar.jaccard_links(r, "requirement_id", "job_key", "t", 0.6).where("similarity < 1")
    # representatives stand for equal sets; here every row is wanted, and a job holds few
    same = r.select("job_key", "t", F.col("requirement_id").alias("id"))
    a = same.withColumnsRenamed({"id": "a", "t": "ta"})
    b = same.withColumnsRenamed({"id": "b", "t": "tb"})
    rep = r.groupBy("job_key", "t").agg(F.min("requirement_id").alias("rep"))
    m = same.join(rep, ["job_key", "t"]).select("rep", "id")
    x = links.join(m.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a").join(m.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b")
    return x.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), F.round("similarity", 6).alias("similarity"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with the terms of title (t) and requirements (r)."""
    items = F.from_json(F.get_json_object("payload", "$.requirements"), "array<string>")
    return table(spark, d, "jobs").select("id", F.col("key").alias("job_key"), F.nullif(text.compact(F.col("company")), F.lit("")).alias("company"), text.title_tokens(F.col("role")).alias("t"), text.requirement_tokens(items).alias("r"), "first_seen_at", urls.host(F.col("key")).alias("host"))


def _postings(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with their terms, the trust in their source (rank, more is better), whether anybody verified them and when
    they were first seen."""
    p = table(spark, d, "source_registry").groupBy(urls.host(F.col("base_url")).alias("host")).agg((6 - F.min("priority")).alias("rank"))  # a fixed list
    v = table(spark, d, "job_sources").where("last_verified_at IS NOT NULL").select("job_key").distinct().withColumn("verified", F.lit(True))
    # jobs' keys grow with the data: never a broadcast, whatever their file's size
    x = _terms(spark, d).join(F.broadcast(p), "host", "left").join(v.hint("merge"), "job_key", "left")
    return x.select("id", "company", "t", "r", F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("verified", F.lit(False)).alias("verified"), "first_seen_at")


_TERMS = f"""WITH RECURSIVE w AS (SELECT id, key, first_seen_at, nullif(regexp_replace(lower(strip_accents(company)), '[^a-z0-9]+', '', 'g'), '') AS company,
    list_distinct(list_transform(list_filter(string_split(trim(regexp_replace(lower(strip_accents(role)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''),
      lambda x: CASE x WHEN 'jr' THEN 'junior' WHEN 'eng' THEN 'engineer' WHEN 'dev' THEN 'developer' ELSE x END)) AS t,
    list_distinct(list_transform(list_filter(string_split(trim(regexp_replace(lower(strip_accents(array_to_string(json_extract_string(payload, '$.requirements[*]'), ' '))), '[^a-z0-9+#.]+', ' ', 'g')), ' '),
        lambda x: length(x) > 2 AND x NOT IN ({", ".join(f"'{w}'" for w in text.STOP_WORDS)})),
      lambda x: CASE {" ".join(f"WHEN x = '{k}' THEN '{v}'" for k, v in text.TERMS.items())} ELSE x END)) AS r FROM jobs),
  pairs AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.r, b.r)) / len(list_distinct(list_concat(a.r, b.r))) AS similarity
    FROM w a JOIN w b ON a.company = b.company AND a.id <> b.id AND len(a.t) > 0 AND len(b.t) > 0 AND len(a.r) > 0 AND len(b.r) > 0
    WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.72 AND len(list_intersect(a.r, b.r)) / len(list_distinct(list_concat(a.r, b.r))) >= 0.45)"""


@query(f"""{_TERMS},
  reached(id, other) AS (SELECT a, b FROM pairs UNION SELECT reached.id, pairs.b FROM reached JOIN pairs ON pairs.a = reached.other)
SELECT id, links, class FROM (SELECT a AS id, count(*) AS links FROM pairs GROUP BY 1) JOIN (SELECT id, least(id, min(other)) AS class FROM reached GROUP BY 1) USING (id)""")
def same_posting_links(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of one company with similar titles and requirements: each job with its class and its number of links."""
    from jobloom.operators.components import connected_components

    members, groups = similar.token_groups(_terms(spark, d), "id", "company", "t", "r")
    groups = staged(groups, "posting-groups")
    links = staged(similar.group_links(groups, 0.72, 0.45).select("a", "b"), "posting-links")
    # copies are linked to each other and to all that their group is linked to
    size = groups.select("rep", "n")
    ends = links.union(links.select("b", "a")).join(size.select(F.col("rep").alias("b"), "n").hint("merge"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("near"))
    degree = size.join(ends.hint("merge"), "rep", "left").select("rep", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    copies = groups.where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    parts = connected_components(links.union(copies), "a", "b").withColumnsRenamed({"node": "rep", "component": "class"})
    x = similar.with_group(members, groups)
    return x.join(degree.hint("merge"), "rep").join(parts.hint("merge"), "rep").select("id", "links", "class")


@query(f"""{_TERMS},
  trust AS (SELECT lower(regexp_extract(base_url, '//(?:www\\.)?([^/?#:]*)', 1)) AS host, 6 - min(priority) AS rank FROM source_registry GROUP BY 1),
  ranked AS (SELECT w.id, coalesce(w.company, 'id ' || w.id) AS company, coalesce(rank, 0) AS rank,
      row_number() OVER (PARTITION BY coalesce(w.company, 'id ' || w.id) ORDER BY coalesce(rank, 0) DESC, (key IN (SELECT job_key FROM job_sources WHERE last_verified_at IS NOT NULL)) DESC, first_seen_at DESC, w.id) AS place
    FROM w LEFT JOIN trust ON trust.host = lower(regexp_extract(key, '//(?:www\\.)?([^/?#:]*)', 1))),
  near AS (SELECT p.a AS id, list(p.b) AS others FROM pairs p JOIN ranked x ON x.id = p.a JOIN ranked y ON y.id = p.b WHERE similarity >= 0.9 OR x.rank <> y.rank GROUP BY 1),
  step(company, place, id, winner, winners) AS (SELECT company, place, id, id, [id] FROM ranked WHERE place = 1
    UNION ALL SELECT r.company, r.place, r.id, coalesce(list_filter(s.winners, lambda x: list_contains(coalesce(n.others, []), x))[1], r.id),
      CASE WHEN len(list_filter(s.winners, lambda x: list_contains(coalesce(n.others, []), x))) > 0 THEN s.winners ELSE list_append(s.winners, r.id) END
    FROM step s JOIN ranked r ON r.company = s.company AND r.place = s.place + 1 LEFT JOIN near n ON n.id = r.id)
SELECT id, winner FROM step""")
def preferred_postings(spark: SparkSession, d: str) -> DataFrame:
    """Every job with the job it is a copy of (itself if none): going from the most trusted, verified and newest job
    down, the first of the same posting that is no copy itself, if its requirements are nearly equal or its source is
    trusted differently."""
    j = staged(_postings(spark, d), "postings")
    first = F.struct((-F.col("rank")).alias("rank"), (~F.col("verified")).alias("verified"), (-F.unix_micros("first_seen_at")).alias("seen"), F.col("id").alias("id"))
    # rows of equal company, words and trust stand together: they are linked to the same rows, so they have one winner
    members, groups = similar.token_groups(j, "id", "company", "t", "r", tags=("rank",), order=first)
    groups = staged(groups, "title-groups")
    links = similar.group_links(groups, 0.72, 0.45)
    rank = groups.select("rep", "rank")
    links = links.join(rank.withColumnsRenamed({"rep": "a", "rank": "ra"}).hint("merge"), "a").join(rank.withColumnsRenamed({"rep": "b", "rank": "rb"}).hint("merge"), "b").where("similarity1 >= 0.9 - 1e-12 OR ra <> rb")
    won = similar.first_winners(groups.select(F.col("rep").alias("id"), "o"), links, "o")
    x = similar.with_group(members, groups, "rank").join(won.withColumnRenamed("id", "rep"), "rep")
    return j.select("id").join(x, "id", "left").select("id", F.coalesce("winner", "id").alias("winner"))


@query(f"""{_TERMS}
SELECT a, b, CASE WHEN similarity >= 0.9 THEN 'duplicate' ELSE 'review' END AS band FROM pairs WHERE a < b AND similarity >= 0.75""")
def similarity_bands(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one posting that are duplicates or should be reviewed, by their requirements' similarity."""
    members, groups = similar.token_groups(_terms(spark, d), "id", "company", "t", "r")
    groups = staged(groups, "posting-groups")
    links = similar.group_links(groups, 0.72, 0.75).select("a", "b", text.similarity_band(F.col("similarity1")).alias("band"))
    x = staged(similar.with_group(members, groups), "posting-members")
    # a company stores an opening a few times, so the members of two groups are few
    far = links.join(x.select(F.col("rep").alias("a"), F.col("id").alias("ia")).hint("merge"), "a").join(x.select(F.col("rep").alias("b"), F.col("id").alias("ib")).hint("merge"), "b").select("ia", "ib", "band")
    own = x.select("rep", F.col("id").alias("ia")).join(x.select("rep", F.col("id").alias("ib")).hint("merge"), "rep").where("ia < ib").select("ia", "ib", F.lit("duplicate").alias("band"))
    return far.union(own).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "band")


_PAGE = """SELECT source_id, url, lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[^/]*//[^/?#]*', '') AS rest FROM (SELECT DISTINCT source_id, url FROM job_sources)"""


@query(f"""
WITH a AS ({_PAGE}), b AS (SELECT source_id, nullif(regexp_replace(h, '^www\\.', ''), '') AS host,
    regexp_replace(url_decode(replace(regexp_extract(rest, '^([^?]*)', 1), '+', '%2B')), '/+$', '') AS path,
    array_to_string(list_transform(list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'),
      lambda p: p <> '' AND lower(regexp_extract(p, '^([^=]*)', 1)) NOT IN ({", ".join(f"'{t}'" for t in urls.TRACKING)}))),
      lambda p: url_decode(replace(p, '+', '%2B'))), '&') AS tail FROM a)
SELECT source_id, host, host || path || CASE WHEN tail = '' THEN '' ELSE '?' || tail END AS page FROM b""")
def page_keys(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "job_sources").select("source_id", "url").distinct()
    return s.select("source_id", urls.host(F.col("url")).alias("host"), urls.page_key(F.col("url")).alias("page"))


@query("""
WITH a AS (SELECT key, lower(regexp_extract(key, '//(?:www\\.)?([^/?#:]*)', 1)) AS host FROM jobs),
  r AS (SELECT provider, priority, lower(regexp_extract(base_url, '//(?:www\\.)?([^/?#:]*)', 1)) AS host FROM source_registry)
SELECT coalesce(r.provider, 'unknown') AS provider, coalesce(priority, 0) AS priority, count(*) AS jobs FROM a LEFT JOIN r ON a.host = r.host GROUP BY 1, 2""")
def provider_class(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").select(urls.host(F.col("key")).alias("host"))
    r = table(spark, d, "source_registry").select("provider", "priority", urls.host(F.col("base_url")).alias("host"))
    x = j.join(F.broadcast(r), "host", "left")  # the registry is a fixed list
    return x.groupBy(F.coalesce("provider", F.lit("unknown")).alias("provider"), F.coalesce("priority", F.lit(0)).alias("priority")).agg(F.count("*").alias("jobs"))


@query("""
WITH a AS (SELECT name AS canonical, unnest(list_append(coalesce(aliases, []), name)) AS alias FROM target_companies),
  k AS (SELECT DISTINCT canonical, regexp_replace(lower(strip_accents(alias)), '[^a-z0-9]+', '', 'g') AS k FROM a)
SELECT canonical, count(*) AS rows, count(DISTINCT company) AS spellings FROM candidates c JOIN k ON regexp_replace(lower(strip_accents(c.company)), '[^a-z0-9]+', '', 'g') = k.k GROUP BY 1""")
def company_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of target companies, by exact alias key."""
    t = table(spark, d, "target_companies")
    alias = F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))
    k = t.select(F.col("name").alias("canonical"), F.explode(alias).alias("alias")).select("canonical", text.compact(F.col("alias")).alias("k")).distinct()
    per = table(spark, d, "candidates").where("company IS NOT NULL").groupBy("company").agg(F.count("*").alias("n"))
    x = per.withColumn("k", text.compact(F.col("company"))).join(F.broadcast(k), "k")  # a fixed list of 40 firms
    return x.groupBy("canonical").agg(F.sum("n").alias("rows"), F.count("*").alias("spellings"))


_REQ = "trim(regexp_replace(lower(strip_accents(requirement)), '\\s+', ' ', 'g'))"


@query(f"""
WITH r AS (SELECT DISTINCT requirement_id, requirement, {_REQ} AS x FROM job_requirements)
SELECT requirement_id, CASE WHEN regexp_matches(x, 'especialista|expert|arquitetura avancada') THEN 4 WHEN regexp_matches(x, 'avancad|advanced|domin(io|ar)|solido|proficien') THEN 3
    WHEN regexp_matches(x, 'intermedi') THEN 2 WHEN regexp_matches(x, 'basic|fundament|noc(ao|oes)|introdutor|familiaridade') THEN 1 END AS level,
  nullif(regexp_extract(replace(x, ',', '.'), '(\\d+(?:\\.\\d+)?)\\s*\\+?\\s*(?:anos?|years?)', 1), '')::double AS min_years FROM r""")
def requirement_levels(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "job_requirements").select("requirement_id", "requirement").distinct()
    return r.select("requirement_id", req.level(F.col("requirement")).alias("level"), req.min_years(F.col("requirement")).alias("min_years"))


@query("""
SELECT category, requirement_type, count(*) AS rows, count(*) FILTER (mandatory) AS mandatory, count(*) FILTER (skill IS NULL) AS unmapped,
  count(*) FILTER (transferable) AS transferable, count(required_level) AS levelled, count(min_years) AS with_years FROM (SELECT DISTINCT * FROM job_requirements) GROUP BY 1, 2""")
def requirement_summary(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "job_requirements").distinct()
    return r.groupBy("category", "requirement_type").agg(
        F.count("*").alias("rows"), F.count_if("mandatory").alias("mandatory"), F.count_if(F.col("skill").isNull()).alias("unmapped"),
        F.count_if("transferable").alias("transferable"), F.count("required_level").alias("levelled"), F.count("min_years").alias("with_years"),
    )


@query("""
WITH s AS (SELECT DISTINCT coalesce(subskill, skill) AS name, ' ' || trim(regexp_replace(lower(strip_accents(coalesce(subskill, skill))), '[^a-z0-9+#.]+', ' ', 'g')) || ' ' AS k FROM skill_catalog),
  r AS (SELECT DISTINCT job_key, requirement_id, ' ' || trim(regexp_replace(lower(strip_accents(requirement)), '[^a-z0-9+#.]+', ' ', 'g')) || ' ' AS x FROM job_requirements)
SELECT name, count(*) AS requirements, count(DISTINCT job_key) AS jobs FROM r JOIN s ON contains(r.x, s.k) GROUP BY 1""")
def technology_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Requirements that name a catalog skill as a word: runs of up to four words are joined with the names by equality."""
    s = table(spark, d, "skill_catalog").select(F.coalesce("subskill", "skill").alias("name")).distinct().withColumn("k", text.norm_tech(F.col("name")))
    r = table(spark, d, "job_requirements").select("job_key", "requirement_id", text.norm_tech(F.col("requirement")).alias("x")).distinct()
    r = r.where("x <> ''").withColumn("w", F.split("x", " "))
    runs = F.expr("flatten(transform(sequence(1, least(4, size(w))), n -> transform(sequence(1, size(w) - n + 1), p -> array_join(slice(w, p, n), ' '))))")
    x = r.select("job_key", "requirement_id", F.explode(F.array_distinct(runs)).alias("k")).join(F.broadcast(s), "k")  # a fixed catalog of 70
    return x.groupBy("name").agg(F.countDistinct("requirement_id").alias("requirements"), F.countDistinct("job_key").alias("jobs"))


@query("""
SELECT date_trunc('week', first_seen_at)::date AS week, status, count(*) AS jobs, count(DISTINCT company) AS companies FROM jobs GROUP BY 1, 2""")
def weekly_snapshot(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs")
    return j.groupBy(times.week(F.col("first_seen_at")).alias("week"), "status").agg(F.count("*").alias("jobs"), F.countDistinct("company").alias("companies"))


@query("""
WITH w AS (SELECT skill, date_trunc('week', collected_at)::date AS week, count(*) AS n FROM (SELECT DISTINCT * FROM job_requirements) WHERE skill IS NOT NULL GROUP BY 1, 2),
  e AS (SELECT min(week) AS lo, max(week) AS hi FROM w)
SELECT skill, sum(n) AS total, coalesce(sum(n) FILTER (week = hi), 0) - coalesce(sum(n) FILTER (week = lo), 0) AS delta FROM w, e GROUP BY skill""")
def trend_first_last(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of each skill: all, and the last week's less the first week's (missing counts as 0)."""
    r = table(spark, d, "job_requirements").distinct().where("skill IS NOT NULL")
    w = r.groupBy("skill", times.week(F.col("collected_at")).alias("week")).agg(F.count("*").alias("n"))
    ends = w.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    x = w.crossJoin(F.broadcast(ends))  # one row
    part = lambda end: F.coalesce(F.sum(F.when(F.col("week") == F.col(end), F.col("n"))), F.lit(0))
    return x.groupBy("skill").agg(F.sum("n").alias("total"), (part("hi") - part("lo")).alias("delta"))


@query("""
WITH b(band, lo, hi) AS (VALUES ('0-2', 0, 2), ('3-4', 3, 4), ('5-6', 5, 6), ('7+', 7, 1000000)),
  n AS (SELECT j.key, count(DISTINCT r.requirement_id) AS n FROM jobs j LEFT JOIN job_requirements r ON r.job_key = j.key GROUP BY 1)
SELECT band, count(key) AS jobs FROM b LEFT JOIN n ON n.n BETWEEN lo AND hi GROUP BY 1""")
def requirement_bands(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by number of requirements; every band is there, even empty."""
    bands = spark.createDataFrame([("0-2", 0), ("3-4", 3), ("5-6", 5), ("7+", 7)], "band string, lo long")
    n = table(spark, d, "job_requirements").groupBy(F.col("job_key").alias("key")).agg(F.countDistinct("requirement_id").alias("n"))
    n = table(spark, d, "jobs").select("key").join(n, "key", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    lo = F.when(F.col("n") >= 7, 7).when(F.col("n") >= 5, 5).when(F.col("n") >= 3, 3).otherwise(0).cast("long")
    per = n.groupBy(lo.alias("lo")).agg(F.count("*").alias("jobs"))
    return bands.join(per, "lo", "left").select("band", F.coalesce("jobs", F.lit(0)).alias("jobs"))


@query("""
SELECT provider, count(*) AS rows, count(*) FILTER (company IS NULL) AS no_company, count(*) FILTER (description IS NULL) AS no_text,
  count(DISTINCT candidate_key) AS postings, count(*) FILTER (apply_url IS NOT NULL) * 1000 // count(*) AS apply_permille FROM candidates GROUP BY 1""")
def funnel_by_source(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates")
    return c.groupBy("provider").agg(
        F.count("*").alias("rows"), F.count_if(F.col("company").isNull()).alias("no_company"), F.count_if(F.col("description").isNull()).alias("no_text"),
        F.countDistinct("candidate_key").alias("postings"), F.floor(F.count("apply_url") * 1000 / F.count("*")).cast("long").alias("apply_permille"),
    )


@query("""
SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1""")
def event_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.count("event_id")).na.fill(0)


@query("""
WITH f AS (SELECT provider, candidate_key, min(inbox_id) AS first FROM candidates GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY first) AS rank FROM f),
  x AS (SELECT c.provider, CASE WHEN c.provider IN ('garimpeu', 'muralume') AND rank > 40 OR c.provider IN ('tramelo', 'conectuba') AND rank > 180 THEN 'not_scanned'
      WHEN inbox_id = first THEN 'selected' ELSE 'duplicate' END AS decision FROM candidates c JOIN k USING (provider, candidate_key))
SELECT provider, decision, count(*) AS rows FROM x GROUP BY 1, 2""")
def schedule_budget(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").select("provider", "candidate_key", "inbox_id")
    x = schedule.within_budget(c, "provider", "candidate_key", "inbox_id", {"garimpeu": 40, "muralume": 40, "tramelo": 180, "conectuba": 180})
    return x.groupBy("provider", "decision").agg(F.count("*").alias("rows"))


@query("""
WITH b AS (SELECT provider, batch_no, count(*) AS n, count(*) FILTER (description IS NULL) AS hits FROM candidates GROUP BY 1, 2),
  i AS (SELECT *, sum(CASE WHEN hits > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY provider ORDER BY batch_no) AS island FROM b)
SELECT provider, batch_no, sum(CASE WHEN hits > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY provider, island ORDER BY batch_no) AS streak FROM i""")
def textless_streaks(spark: SparkSession, d: str) -> DataFrame:
    """For each provider and batch, for how many batches in a row it has delivered rows without text."""
    c = table(spark, d, "candidates").groupBy("provider", "batch_no").agg(F.count_if(F.col("description").isNull()).alias("hits"))
    return schedule.streaks(c, "provider", "batch_no", F.col("hits") > 0).select("provider", "batch_no", "streak")


@query("""
SELECT candidate_key, arg_max(inbox_id, inbox_id) AS inbox_id, arg_max(title, inbox_id) AS title, count(*) AS rows FROM candidates GROUP BY 1""")
def latest_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").select("candidate_key", "inbox_id", "title")
    last = merge.latest_by_key(c, "candidate_key", [F.col("inbox_id")])
    return last.join(c.groupBy("candidate_key").agg(F.count("*").alias("rows")), "candidate_key")


@query("""
WITH x AS (SELECT provider, candidate_key, md5(concat_ws('|', coalesce(title, '-'), coalesce(description, '-'), coalesce(location, '-'))) AS h,
    lag(md5(concat_ws('|', coalesce(title, '-'), coalesce(description, '-'), coalesce(location, '-')))) OVER (PARTITION BY candidate_key ORDER BY inbox_id) AS p FROM candidates)
SELECT provider, count(*) AS rows, count(*) FILTER (p IS NULL OR p <> h) AS changed FROM x GROUP BY 1""")
def changed_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").select("provider", "candidate_key", "inbox_id", "title", "description", "location")
    x = merge.changes(c, "candidate_key", [F.col("inbox_id")], ["title", "description", "location"])
    return x.groupBy("provider").agg(F.count("*").alias("rows"), F.count_if("changed").alias("changed"))


@query("""
WITH c AS (SELECT source_url AS key, arg_max(location, inbox_id) AS location, max(discovered_at)::timestamp AS seen, arg_max(title, inbox_id) AS title, max(inbox_id) AS i FROM candidates WHERE source_url IS NOT NULL GROUP BY 1),
  l AS (SELECT source_url AS key, location, discovered_at::timestamp AS seen, title FROM candidates WHERE inbox_id IN (SELECT i FROM c)),
  j AS (SELECT key, location, first_seen_at::timestamp AS seen, role AS title FROM jobs)
SELECT coalesce(j.key, l.key) AS key, CASE WHEN j.key IS NOT NULL AND l.key IS NOT NULL THEN 'both' WHEN j.key IS NOT NULL THEN 'prior' ELSE 'current' END AS origin,
  coalesce(j.seen, l.seen) AS seen, CASE WHEN l.key IS NOT NULL THEN l.title ELSE j.title END AS title, CASE WHEN l.key IS NOT NULL THEN l.location ELSE j.location END AS location
FROM j FULL JOIN l ON j.key = l.key""")
def catalog_merge(spark: SparkSession, d: str) -> DataFrame:
    """The catalog overlaid by the newest candidate of each address: title and location are the newest (a null counts),
    the first sighting stays."""
    c = table(spark, d, "candidates").where("source_url IS NOT NULL")
    c = merge.latest_by_key(c.select(F.col("source_url").alias("key"), "inbox_id", "location", F.col("discovered_at").alias("seen"), "title"), "key", [F.col("inbox_id")])
    j = table(spark, d, "jobs").select("key", "location", F.col("first_seen_at").alias("seen"), F.col("role").alias("title"))
    x = merge.overlay(j, c, "key", ["seen"], ["title", "location"])
    return x.withColumn("seen", F.col("seen").cast("timestamp_ntz"))


@query("""
WITH w AS (SELECT key, company, role FROM jobs), p AS (SELECT job_key AS key, arg_max(name, source_id) AS company, NULL::varchar AS role FROM job_sources GROUP BY 1)
SELECT action, count(*) AS rows FROM (SELECT CASE WHEN p.key IS NULL THEN 'insert' WHEN w.key IS NULL THEN 'delete' WHEN w.company IS NOT DISTINCT FROM p.company AND w.role IS NOT DISTINCT FROM p.role THEN 'keep' ELSE 'update' END AS action
  FROM w FULL JOIN p ON w.key = p.key) GROUP BY 1""")
def mirror_diff(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "job_sources").groupBy(F.col("job_key").alias("key")).agg(F.max_by("name", "source_id").alias("company"), F.lit(None).cast("string").alias("role"))
    return merge.mirror_diff(table(spark, d, "jobs").select("key", "company", "role"), s, "key", ["company", "role"]).groupBy("action").agg(F.count("*").alias("rows"))


@query("""
WITH s AS (SELECT DISTINCT * FROM job_sources)
SELECT job_key, count(*) AS rows, arg_max(http_status, source_id) FILTER (http_status IS NOT NULL) AS http_status, arg_max(name, source_id) FILTER (name IS NOT NULL) AS name,
  bool_or(official) AS official, string_agg(DISTINCT lower(trim(provider)), ',' ORDER BY lower(trim(provider))) AS providers FROM s GROUP BY 1""")
def lineage(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "job_sources").distinct()
    x = merge.lineage(s, ["job_key"], F.col("source_id"), ["http_status", "name"])
    p = s.groupBy("job_key").agg(F.bool_or("official").alias("official"), F.array_sort(F.collect_set(F.lower(F.trim("provider")))).alias("p"))  # nine providers
    return x.join(p, "job_key").select("job_key", "rows", "http_status", "name", "official", F.nullif(F.array_join("p", ","), F.lit("")).alias("providers"))


@query("""
SELECT event_type, count(*) AS events, sum(json_extract(props, '$.k')::bigint)::bigint AS k FROM events GROUP BY 1""")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("k").alias("k"))


@query("""
SELECT json_extract_string(raw, '$.contrato') AS contract, json_extract_string(raw, '$.modalidade') AS modality, count(*) AS rows FROM candidates GROUP BY 1, 2""")
def raw_facets(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").select(F.from_json("raw", "contrato string, modalidade string").alias("r"))
    return c.groupBy(F.col("r.contrato").alias("contract"), F.col("r.modalidade").alias("modality")).agg(F.count("*").alias("rows"))


def radar(jobs: DataFrame, facets: dict[str, list[str]], words: str = "", n: int = 50) -> DataFrame:
    """A filtered, sorted page of jobs: facet equality, words anywhere in company, role or location (accents and case
    don't count), newest first, key as tie-break."""
    x = jobs
    for column, values in facets.items():
        x = x.where(F.col(column).isin(*values))
    if words:
        x = x.where(F.contains(text.norm_plain(F.concat_ws(" ", "company", "role", "location")), text.norm_plain(F.lit(words))))
    return x.orderBy(F.desc("updated_at"), "key").limit(n)


@query("""
SELECT key, company, role, updated_at::timestamp AS updated_at FROM jobs WHERE status IN ('Ativa') AND modality IN ('Remoto', 'Híbrido')
  AND contains(lower(strip_accents(concat_ws(' ', company, role, location))), 'analista') ORDER BY jobs.updated_at DESC, key LIMIT 50""")
def radar_filter(spark: SparkSession, d: str) -> DataFrame:
    x = radar(table(spark, d, "jobs"), {"status": ["Ativa"], "modality": ["Remoto", "Híbrido"]}, "Analista")
    return x.select("key", "company", "role", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("""
SELECT facet, value, count(*) AS jobs FROM (SELECT 'status' AS facet, status AS value FROM jobs UNION ALL SELECT 'modality', modality FROM jobs UNION ALL SELECT 'level', json_extract_string(payload, '$.level') FROM jobs)
WHERE value <> '' GROUP BY 1, 2""")
def facet_values(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").select(F.map_from_arrays(F.array(F.lit("status"), F.lit("modality"), F.lit("level")), F.array("status", "modality", F.get_json_object("payload", "$.level"))).alias("m"))
    return j.select(F.explode("m").alias("facet", "value")).where("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("jobs"))


@query(f"""
SELECT CASE WHEN published_at IS NOT NULL THEN greatest(0, floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(published_at)) / 86400000000.0))::bigint // 30 END AS months, count(*) AS rows FROM candidates GROUP BY 1""")
def posting_age(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").select(F.floor(times.age_days(F.col("published_at"), AS_OF) / 30).cast("long").alias("months"))
    return c.groupBy("months").agg(F.count("*").alias("rows"))


@query("""
WITH k AS (SELECT sha256(concat_ws('|', coalesce(n1, ''), coalesce(n2, ''), coalesce(n3, ''))) AS k FROM (SELECT
    trim(regexp_replace(lower(strip_accents(company)), '\\s+', ' ', 'g')) AS n1, trim(regexp_replace(lower(strip_accents(title)), '\\s+', ' ', 'g')) AS n2, trim(regexp_replace(lower(strip_accents(location)), '\\s+', ' ', 'g')) AS n3
    FROM candidates))
SELECT n AS copies, count(*) AS groups FROM (SELECT k, count(*) AS n FROM k GROUP BY 1) GROUP BY 1""")
def dedupe_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of groups of candidates with equal company, title and location (case, accents and blanks don't count)."""
    c = table(spark, d, "candidates")
    parts = [F.coalesce(text.norm_blank(F.col(n)), F.lit("")) for n in ("company", "title", "location")]
    k = c.groupBy(F.sha2(F.concat_ws("|", *parts), 256).alias("k")).agg(F.count("*").alias("n"))
    return k.groupBy(F.col("n").alias("copies")).agg(F.count("*").alias("groups"))


@query("""
WITH c AS (SELECT t.name, t.search_tier, count(j.key) AS jobs FROM target_companies t LEFT JOIN jobs j ON j.company = t.name GROUP BY 1, 2)
SELECT search_tier, count(*) AS companies, count(*) FILTER (jobs = 0) AS without_jobs, sum(jobs)::bigint AS jobs FROM c GROUP BY 1""")
def company_coverage(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").groupBy(F.col("company").alias("name")).agg(F.count("*").alias("jobs"))
    t = table(spark, d, "target_companies").join(j, "name", "left").select("search_tier", F.coalesce("jobs", F.lit(0)).alias("jobs"))
    return t.groupBy("search_tier").agg(F.count("*").alias("companies"), F.count_if(F.col("jobs") == 0).alias("without_jobs"), F.sum("jobs").alias("jobs"))


@query("""
SELECT job_key, position, requirement_id FROM (SELECT DISTINCT job_key, position, requirement_id, mandatory,
  row_number() OVER (PARTITION BY job_key ORDER BY mandatory DESC, position, requirement_id) AS r FROM (SELECT DISTINCT * FROM job_requirements)) WHERE r <= 3""")
def first_requirements(spark: SparkSession, d: str) -> DataFrame:
    """The first three requirements of each job, mandatory ones first."""
    r = table(spark, d, "job_requirements").distinct()
    w = W.partitionBy("job_key").orderBy(F.desc("mandatory"), "position", "requirement_id")
    return r.withColumn("r", F.row_number().over(w)).where("r <= 3").select("job_key", "position", "requirement_id")


from jobloom.plans import catalog, extraction, feedback, history, requirements, resolution, streams, views  # noqa: E402, F401
