"""Queries over runs and weeks: snapshots, health of sources, audit of pages, lineage, states as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobloom.functions import times
from jobloom.operators import merge, schedule, state
from jobloom.plans.queries import AS_OF, query
from jobloom.session import staged, table

NO_VALUE = "Não informada"


@query(f"""
WITH a AS (SELECT id, nullif(company, '') AS company, coalesce(modality, '{NO_VALUE}') AS modality, coalesce(json_extract_string(payload, '$.level'), '{NO_VALUE}') AS level, list_distinct(json_extract_string(payload, '$.tags[*]')) AS tags FROM jobs WHERE status = 'Ativa'),
  t AS (SELECT id, company, unnest(tags) AS tag FROM a)
SELECT date_trunc('week', TIMESTAMP '{AS_OF}')::date AS week, kind, name, n FROM (SELECT 'total' AS kind, '' AS name, count(*) AS n FROM a UNION ALL SELECT 'technologies', tag, count(*) FROM t GROUP BY tag
  UNION ALL SELECT 'technology_companies', tag, count(DISTINCT company) FROM t GROUP BY tag UNION ALL SELECT 'companies', company, count(*) FROM a WHERE company IS NOT NULL GROUP BY company
  UNION ALL SELECT 'areas', modality, count(*) FROM a GROUP BY modality UNION ALL SELECT 'segments', level, count(*) FROM a GROUP BY level)""")
def market_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The week's counts of active jobs: total, by technology (jobs and firms), firm, modality and level."""
    j = table(spark, d, "jobs").where("status = 'Ativa'")
    text = lambda c: F.coalesce(c, F.lit(NO_VALUE))
    a = j.select("id", F.nullif("company", F.lit("")).alias("company"), text(F.col("modality")).alias("areas"), text(F.get_json_object("payload", "$.level")).alias("segments"), F.array_distinct(F.from_json(F.get_json_object("payload", "$.tags"), "array<string>")).alias("tags"))
    t = a.select("company", F.explode("tags").alias("name"))
    n, firms = F.count("*").alias("n"), F.countDistinct("company").alias("n")
    parts = [a.agg(n).select(F.lit("total").alias("kind"), F.lit("").alias("name"), "n")]
    parts += [t.groupBy("name").agg(c).select(F.lit(k).alias("kind"), "name", "n") for k, c in (("technologies", n), ("technology_companies", firms))]
    parts += [a.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("name")).agg(n).select(F.lit(k).alias("kind"), "name", "n") for k, c in (("companies", "company"), ("areas", "areas"), ("segments", "segments"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(times.week(F.to_timestamp(F.lit(AS_OF))).alias("week"), "kind", "name", "n")


@query("""
WITH w AS (SELECT date_trunc('week', first_seen_at)::date AS week, count(*) AS jobs FROM jobs GROUP BY 1), h AS (SELECT * FROM w WHERE week < DATE '2025-12-01'),
  n AS (SELECT week, jobs * 10 AS jobs FROM w WHERE week >= DATE '2025-11-01')
SELECT * FROM h UNION ALL SELECT * FROM n WHERE week NOT IN (SELECT week FROM h)""")
def snapshots_appended(spark: SparkSession, d: str) -> DataFrame:
    """Weeks are added to a history only where it doesn't have them."""
    w = table(spark, d, "jobs").groupBy(times.week(F.col("first_seen_at")).alias("week")).agg(F.count("*").alias("jobs"))
    return state.append_if_absent(w.where("week < '2025-12-01'"), w.where("week >= '2025-11-01'").withColumn("jobs", F.col("jobs") * 10), "week")


@query("""
WITH s AS (SELECT job_key, bool_or(official) AS official FROM job_sources GROUP BY 1)
SELECT count(*) AS jobs, count(*) FILTER (status <> 'Encerrada') AS included, count(*) FILTER (status = 'Encerrada') AS excluded, count(*) FILTER (status = 'Possivelmente encerrada') AS pending,
  count(*) FILTER (official AND status <> 'Encerrada') AS official, round(count(*) FILTER (official AND status <> 'Encerrada') * 100 / greatest(1, count(*) FILTER (status <> 'Encerrada')), 1) AS coverage_pct FROM jobs LEFT JOIN s ON job_key = key""")
def catalog_meta(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "job_sources").groupBy(F.col("job_key").alias("key")).agg(F.bool_or("official").alias("official"))
    x = table(spark, d, "jobs").select("key", "status").join(s, "key", "left")
    kept = F.count_if(F.col("status") != "Encerrada")
    own = F.count_if(F.col("official") & (F.col("status") != "Encerrada"))
    return x.agg(F.count("*").alias("jobs"), kept.alias("included"), F.count_if(F.col("status") == "Encerrada").alias("excluded"), F.count_if(F.col("status") == "Possivelmente encerrada").alias("pending"), own.alias("official"),
                 F.round((own * 100 / F.greatest(F.lit(1), kept)).cast("decimal(20,10)"), 1).cast("double").alias("coverage_pct"))


@query("""
WITH p AS (SELECT provider, batch_no, count(*) AS requests, count(description) AS discovered, count(*) FILTER (title IS NULL OR location IS NULL) AS errors FROM candidates GROUP BY 1, 2),
  q AS (SELECT *, requests > 0 AND discovered < 12 AND errors = 0 AS zero FROM p),
  r AS (SELECT *, sum(CASE WHEN zero THEN 0 ELSE 1 END) OVER (PARTITION BY provider ORDER BY batch_no) AS island FROM q),
  s AS (SELECT *, sum(CASE WHEN zero THEN 1 ELSE 0 END) OVER (PARTITION BY provider, island ORDER BY batch_no) AS streak,
      CASE WHEN errors > 0 AND discovered = 0 THEN 'failed' WHEN errors > 0 THEN 'partial' ELSE 'success' END AS status FROM r)
SELECT provider, batch_no, requests, discovered, errors, status, streak, CASE WHEN streak >= 3 OR status = 'partial' THEN 'degraded' WHEN status = 'failed' THEN 'unavailable' ELSE 'healthy' END AS health,
  max(CASE WHEN discovered > 0 THEN batch_no END) OVER (PARTITION BY provider ORDER BY batch_no) AS last_useful FROM s""")
def run_health(spark: SparkSession, d: str) -> DataFrame:
    """Status and health of every run of a source: streaks of runs that brought little, the last useful run."""
    c = table(spark, d, "candidates")
    p = c.groupBy("provider", "batch_no").agg(F.count("*").alias("requests"), F.count("description").alias("discovered"), F.count_if(F.col("title").isNull() | F.col("location").isNull()).alias("errors"))
    x = schedule.streaks(p, "provider", "batch_no", (F.col("requests") > 0) & (F.col("discovered") < 12) & (F.col("errors") == 0))
    x = x.withColumn("status", F.when((F.col("errors") > 0) & (F.col("discovered") == 0), "failed").when(F.col("errors") > 0, "partial").otherwise("success"))
    health = F.when((F.col("streak") >= 3) | (F.col("status") == "partial"), "degraded").when(F.col("status") == "failed", "unavailable").otherwise("healthy")
    useful = F.max(F.when(F.col("discovered") > 0, F.col("batch_no"))).over(W.partitionBy("provider").orderBy("batch_no"))  # runs of a source
    return x.select("provider", "batch_no", "requests", "discovered", "errors", "status", "streak", health.alias("health"), useful.alias("last_useful"))


_OUTCOME = """CASE WHEN min(inbox_id) % 7 = 0 THEN 'rejected' WHEN min(inbox_id) % 7 = 1 THEN 'retry' WHEN min(inbox_id) % 7 = 2 THEN 'not_scanned' WHEN min(inbox_id) % 7 = 3 THEN 'already_known' ELSE 'accepted' END"""


@query(f"""
WITH h AS (SELECT key, 'retry' AS status, 'timeout' AS reason, first_seen_at::timestamp AS first_seen, updated_at::timestamp AS last_seen, 1 AS attempts FROM jobs),
  o AS (SELECT source_url AS key, {_OUTCOME} AS status, CASE WHEN min(inbox_id) % 14 = 0 THEN 'recent_rejection' ELSE 'rule ' || min(inbox_id) % 7 END AS reason FROM candidates WHERE source_url IS NOT NULL GROUP BY 1),
  x AS (SELECT coalesce(h.key, o.key) AS key, h.status AS was, h.reason AS why, h.first_seen, h.last_seen, h.attempts, o.status AS now, o.reason AS said, coalesce(o.reason = 'recent_rejection', false) AS off FROM h FULL JOIN o ON h.key = o.key)
SELECT key, CASE WHEN now IS NULL THEN was WHEN now = 'not_scanned' THEN coalesce(was, now) ELSE now END AS status, CASE WHEN now IS NULL THEN why WHEN off OR now = 'not_scanned' THEN coalesce(why, said) ELSE said END AS reason,
  coalesce(first_seen, TIMESTAMP '{AS_OF}') AS first_seen, CASE WHEN now IS NULL THEN last_seen ELSE TIMESTAMP '{AS_OF}' END AS last_seen,
  (coalesce(attempts, 0) + CASE WHEN now IS NOT NULL AND now NOT IN ('not_scanned', 'already_known') AND NOT off THEN 1 ELSE 0 END)::int AS attempts,
  CASE WHEN now IS NULL OR off OR now = 'not_scanned' THEN NULL WHEN now = 'rejected' THEN 'recent_rejection' WHEN now = 'retry' THEN 'retry_deferred' END AS waits,
  CASE WHEN now IS NULL THEN 0 WHEN was IS NULL THEN 2 ELSE 1 END::int AS new_transitions FROM x""")
def audit_history(spark: SparkSession, d: str) -> DataFrame:
    """The memory of pages after a run: states, reasons, attempts, what has to wait, transitions."""
    none = F.lit(None).cast("timestamp")
    h = table(spark, d, "jobs").select("key", F.lit("retry").alias("status"), F.lit("timeout").alias("reason"), F.col("first_seen_at").alias("first_seen"), F.col("updated_at").alias("last_seen"), none.alias("last_processed"), none.alias("retry_after"),
                                       F.lit(1).alias("attempts"), F.lit("v1").alias("policy"), F.array().cast("array<struct<stage: string, reason: string>>").alias("transitions"))
    c = table(spark, d, "candidates").where("source_url IS NOT NULL").groupBy(F.col("source_url").alias("key")).agg(F.min("inbox_id").alias("i"))
    status = F.element_at(F.array(*map(F.lit, ("rejected", "retry", "not_scanned", "already_known", "accepted", "accepted", "accepted"))), (F.col("i") % 7 + 1).cast("int"))
    o = c.select("key", status.alias("status"), F.when(F.col("i") % 14 == 0, "recent_rejection").otherwise(F.concat(F.lit("rule "), (F.col("i") % 7).cast("string"))).alias("reason"))
    x = state.waiting(state.marked(h, o, "key", AS_OF, "v2"), AS_OF, "v2")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return x.select("key", "status", "reason", ntz("first_seen"), ntz("last_seen"), "attempts", "waits", F.size("transitions").alias("new_transitions"))


@query("""
WITH s AS (SELECT DISTINCT * FROM job_sources WHERE trim(url) <> ''), r AS (SELECT lower(trim(provider)) AS p, 6 - min(priority) AS rank FROM source_registry GROUP BY 1),
  u AS (SELECT job_key, trim(url) AS url, arg_max(name, source_id) FILTER (name IS NOT NULL) AS name, coalesce(arg_max(rank, source_id) FILTER (rank IS NOT NULL), 0) AS rank FROM s LEFT JOIN r ON lower(trim(s.provider)) = r.p GROUP BY 1, 2)
SELECT job_key, count(*)::int AS addresses, md5(string_agg(url || '|' || coalesce(name, ''), ',' ORDER BY rank DESC, url)) AS lineage FROM u WHERE job_key IS NOT NULL GROUP BY 1""")
def source_lineage(spark: SparkSession, d: str) -> DataFrame:
    """All addresses of a job, the most trusted first, with what is known of each."""
    r = table(spark, d, "source_registry").groupBy(F.lower(F.trim("provider")).alias("p")).agg((6 - F.min("priority")).alias("rank"))  # a fixed list
    s = table(spark, d, "job_sources").where("job_key IS NOT NULL").distinct()
    s = s.join(F.broadcast(r), F.lower(F.trim("provider")) == F.col("p"), "left")
    x = merge.merged_sources(s, "job_key", "url", "source_id", ["name", "rank"], "rank")
    line = F.array_join(F.transform("sources", lambda e: F.concat(e["url"], F.lit("|"), F.coalesce(e["name"], F.lit("")))), ",")
    return x.select("job_key", F.size("sources").alias("addresses"), F.md5(line).alias("lineage"))


@query("""
WITH k AS (SELECT id, key, CASE WHEN id % 3 = 0 THEN id END AS given FROM jobs), t AS (SELECT max(given) AS top FROM k)
SELECT key, coalesce(given, top + count(*) FILTER (given IS NULL) OVER (ORDER BY id)) AS id FROM k, t""")
def filled_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that are there stay; missing ones follow the largest, in order."""
    j = table(spark, d, "jobs").select("key", F.col("id").alias("place"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("id"))
    return merge.kept_ids(j, "id", "place").select("key", "id")


@query("""
WITH p AS (SELECT key, id % 4 > 0 AS auto, status = 'Encerrada' AS excluded, CASE WHEN location IS NULL OR modality IS NULL THEN 'incomplete' END AS reason FROM jobs)
SELECT coalesce(auto, false) AND NOT coalesce(excluded, false) AND key NOT IN (SELECT source_url FROM candidates WHERE source_url IS NOT NULL) AND reason IS NOT NULL AS retired, count(*) AS jobs FROM p GROUP BY 1""")
def reconciled_jobs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "jobs").select("key", (F.col("id") % 4 > 0).alias("auto"), (F.col("status") == "Encerrada").alias("excluded"), F.when(F.col("location").isNull() | F.col("modality").isNull(), "incomplete").alias("reason"))
    c = table(spark, d, "candidates").select(F.col("source_url").alias("key"))
    return state.reconciled(p, c, "key", "auto", "excluded", "reason").groupBy("retired").agg(F.count("*").alias("jobs"))


STAGES = ("Salva", "Candidatado", "Teste técnico", "Entrevista RH", "Entrevista técnica", "Oferta", "Rejeitado", "Desistência", "Arquivada")


@query("""
WITH s(place, stage) AS (VALUES (0, 'Salva'), (1, 'Candidatado'), (2, 'Teste técnico'), (3, 'Entrevista RH'), (4, 'Entrevista técnica'), (5, 'Oferta'), (6, 'Rejeitado'), (7, 'Desistência'), (8, 'Arquivada')),
  o AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'Oferta' WHEN 'O' THEN 'Candidatado' ELSE 'Rejeitado' END AS stage FROM orders)
SELECT place, s.stage, count(o.stage) AS applications FROM s LEFT JOIN o ON o.stage = s.stage GROUP BY 1, 2""")
def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Applications in each stage, stages without any too."""
    s = spark.createDataFrame(list(enumerate(STAGES)), "place int, stage string")
    o = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "Oferta").when(F.col("o_orderstatus") == "O", "Candidatado").otherwise("Rejeitado").alias("stage"))
    return F.broadcast(s).join(o.groupBy("stage").agg(F.count("*").alias("applications")), "stage", "left").select("place", "stage", F.coalesce("applications", F.lit(0)).alias("applications"))


@query("""
WITH u AS (SELECT user_id, event_type, event_id FROM events)
SELECT user_id, event_type AS answer_key, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS ordinality, event_id FROM u""")
def state_rows(spark: SparkSession, d: str) -> DataFrame:
    """States kept as one JSON text each (event type: list of ids), taken apart into rows; places count from 1."""
    e = table(spark, d, "events")
    s = e.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list("event_id")).alias("ids")).groupBy("user_id")  # what one user keeps
    s = staged(s.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "ids")))).alias("state")), "states")
    x = s.select("user_id", F.explode(F.from_json("state", "map<string, array<bigint>>")).alias("answer_key", "ids"))
    return x.select("user_id", "answer_key", F.posexplode("ids").alias("p", "event_id")).select("user_id", "answer_key", (F.col("p") + 1).cast("long").alias("ordinality"), "event_id")


@query("""
SELECT key, company, role, updated_at::timestamp AS updated_at FROM jobs WHERE status = 'Ativa' ORDER BY jobs.updated_at DESC, key LIMIT 20 OFFSET 20""")
def radar_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of twenty active jobs."""
    j = table(spark, d, "jobs").where("status = 'Ativa'").orderBy(F.desc("updated_at"), "key").offset(20).limit(20)
    return j.select("key", "company", "role", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("""
SELECT provider, min(inbox_id) AS first_run, arg_min(batch_no, inbox_id) AS batch_no FROM candidates WHERE discovered_at >= TIMESTAMP '2026-02-03' - INTERVAL 5 SECONDS GROUP BY 1""")
def first_run_since(spark: SparkSession, d: str) -> DataFrame:
    """The first run of each source since a moment, with five seconds' grace."""
    c = table(spark, d, "candidates").where(F.col("discovered_at") >= F.to_timestamp(F.lit("2026-02-03")) - F.expr("INTERVAL 5 SECONDS"))
    return c.groupBy("provider").agg(F.min("inbox_id").alias("first_run"), F.min_by("batch_no", "inbox_id").alias("batch_no"))
