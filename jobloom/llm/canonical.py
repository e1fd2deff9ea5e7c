"""Problem 5: mapping free-entered values to a canonical list. SQL only.

Partition-based pigeonhole join: every reference string is cut into k + 1 segments; a typed string within k edits holds
one of them unchanged near its place. Substrings are joined on equality, the rest is verified by levenshtein, and what
finds no partner is reported through an anti-join. Typed values are taken apart into runs of words, so that decorations
('basic', 'or similar', versions) and whole sentences need no rules of their own; runs are as long as the longest
reference allows, whatever that is. Steps that are used more than once are written, not computed again.

A field may differ from its reference in k edits. In a sentence a slip is rarer than the right spelling, so a run that
isn't spelt like a reference counts only if at most a quarter as many sentences hold it as hold the reference; both
numbers are taken over all sentences.

k by the reference's length: below 4 characters it must be equal, 4 may miss or add one, 5 to 7 may differ in one (or
two that swap letters), longer ones in two. Nulls and empty strings are no value; ties go to the longer match, then the
smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobloom.llm.lookalikes import fold_tables
from jobloom.session import staged

# Other names of skills (name in the catalog: other names); the default of an input table.
ALIASES = {
    "Python": "python3.x, python3", "Cypress": "cypress.io", "JavaScript": "js, ecmascript", "TypeScript": "ts", "C#": "csharp, c sharp, dotnet", "ASP.NET Core": "asp.net, aspnet, net core, .net core, asp net",
    "Go": "golang", "Node.js": "node, nodejs", "React": "reactjs, react.js", "Angular": "angularcli, angularjs, angular cli", "PostgreSQL": "postgres, postgre",
    "MongoDB": "mongo", "SQL Server": "mssql, ms sql, sql server", "PL/SQL": "plsql", "Apache Spark": "spark, pyspark", "Power BI": "pbi, powerbi", "RabbitMQ": "rabbit",
    "IBM MQ": "mq series, mqseries, websphere mq", "AWS": "amazon web services, amazon aws, amazon", "Google Cloud": "gcp, google cloud platform", "AWS Lambda": "lambda",
    "Kubernetes": "k8s, kube", "Argo CD": "argo", "REST": "restful, api rest, apis rest, rest api", "OAuth 2.0": "oauth, oauth2", "Machine Learning": "aprendizado de maquina, ml",
    "Modelos de linguagem": "llm, llms, language models, large language models, modelo de linguagem", "RPA": "robotic process automation", "PyTorch": "torch",
    "Spring Boot": "spring", "COBOL": "cobol ii", "Docker": "docker compose", "Airflow": "apache airflow", "Kafka": "apache kafka", "Cassandra": "apache cassandra",
    "Excel": "ms excel, microsoft excel", "Azure": "microsoft azure, ms azure", "Jenkins": "jenkins ci", "GitHub Actions": "gh actions", "Git": "git scm",
}


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def default_aliases(spark: SparkSession) -> DataFrame:
    """(name, alias): ALIASES as a table."""
    return spark.createDataFrame([(n, a.strip()) for n, aa in ALIASES.items() for a in aa.split(",")], "name string, alias string")


def _keep(spark: SparkSession, name: str, sql: str) -> None:
    """A step that is used more than once: written, and read under its name."""
    staged(spark.sql(sql), name.replace("_", "-")).createOrReplaceTempView(name)


def prepare(spark: SparkSession) -> None:
    """Registers the SQL functions of this module."""
    a, b = fold_tables()
    fold = f"lower(trim(regexp_replace(replace(replace(translate(x, {_quoted(a)}, {_quoted(b)}), 'ﬁ', 'fi'), 'ﬃ', 'ffi'), '\\\\s+', ' ')))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION jl_fold(x STRING) RETURNS STRING RETURN {fold}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION jl_words(x STRING) RETURNS ARRAY<STRING> RETURN filter(split(jl_fold(x), '[^\\\\p{L}\\\\p{N}#+.]+'), w -> w <> '' AND w <> '.')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION jl_key(x STRING) RETURNS STRING RETURN regexp_replace(jl_fold(x), '[^\\\\p{L}\\\\p{N}#+]', '')")
    # 128 bits name a text of a kind
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION jl_id(x STRING, kind STRING) RETURNS STRUCT<a: BIGINT, b: BIGINT> RETURN named_struct('a', xxhash64(x, kind), 'b', xxhash64(kind, '-', x))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION jl_most(n INT) RETURNS INT RETURN CASE WHEN n < 4 THEN 0 WHEN n = 4 THEN 1 ELSE 2 END")


def mapped(spark: SparkSession, requirements: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(requirement_id, skill_id) of requirements (requirement_id, category, skill, subskill, requirement) of category
    'technical' whose (skill, subskill) is no entry of catalog (skill_id, skill, subskill) as it stands; 0 if none fits.
    aliases (name, alias) are other names of entries."""
    prepare(spark)
    requirements.createOrReplaceTempView("jl_requirements")
    catalog.createOrReplaceTempView("jl_catalog")
    (default_aliases(spark) if aliases is None else aliases).createOrReplaceTempView("jl_aliases")
    _keep(spark, "jl_refs", """
      WITH named AS (SELECT skill_id, coalesce(subskill, skill) AS name, subskill IS NOT NULL AS deep FROM jl_catalog WHERE coalesce(subskill, skill) IS NOT NULL),
        spelt AS (SELECT skill_id, deep, jl_key(name) AS ref, true AS main FROM named
          UNION ALL SELECT skill_id, deep, jl_key(a.alias), false FROM named JOIN jl_aliases a USING (name))
      SELECT ref, min_by(skill_id, struct(NOT main, skill_id)) AS skill_id, max(deep) AS deep, length(ref) AS len, jl_most(length(ref)) AS k
      FROM spelt WHERE ref <> '' GROUP BY ref""")
    _keep(spark, "jl_todo", """
      SELECT DISTINCT requirement_id, nullif(trim(r.skill), '') AS skill, nullif(trim(r.subskill), '') AS subskill, r.requirement
      FROM jl_requirements r LEFT ANTI JOIN jl_catalog c ON r.skill <=> c.skill AND r.subskill <=> c.subskill
      WHERE category = 'technical'""")
    # every different text once; a sentence counts only where both fields are empty. A run longer than the longest
    # reference and its edits can't be within them of any
    parts = spark.conf.get("spark.sql.shuffle.partitions")  # short texts make many runs, so few bytes are much work
    spark.sql(f"""CREATE OR REPLACE TEMPORARY VIEW jl_texts AS
      SELECT jl_id(text, kind) AS text_id, kind, (SELECT coalesce(max(len), 0) + 2 FROM jl_refs) AS longest,
        filter(transform(jl_words(text), w -> regexp_replace(w, '[^\\\\p{{L}}\\\\p{{N}}#+]', '')), w -> w <> '') AS words FROM (SELECT /*+ REPARTITION({parts}) */ text, kind FROM (
        SELECT skill AS text, 'field' AS kind FROM jl_todo UNION SELECT subskill, 'field' FROM jl_todo
        UNION SELECT requirement, 'sentence' FROM jl_todo WHERE skill IS NULL AND subskill IS NULL) WHERE text IS NOT NULL)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY VIEW jl_starts AS
      SELECT text_id, kind, words, longest, place FROM jl_texts LATERAL VIEW explode(CASE WHEN size(words) > 0 THEN sequence(0, size(words) - 1) END) p AS place""")
    _keep(spark, "jl_grams", """
      SELECT text_id, kind, gram, place FROM jl_starts
        LATERAL VIEW explode(transform(sequence(1, least(size(words) - place, longest)), n -> array_join(slice(words, place + 1, n), ''))) g AS gram
      WHERE length(gram) <= longest""")
    spark.sql("""CREATE OR REPLACE TEMPORARY VIEW jl_segments AS
      SELECT ref, skill_id, deep, len, k, i, substring(ref, start + 1, n) AS seg FROM (
        SELECT *, i * (len div (k + 1)) + greatest(0, i - (k + 1 - len % (k + 1))) AS start, len div (k + 1) + if(i >= k + 1 - len % (k + 1), 1, 0) AS n
        FROM jl_refs LATERAL VIEW explode(sequence(0, k)) s AS i)""")
    # substrings of a run that can equal segment i of a reference of length m; lengths that no reference has are no use
    spark.sql("""CREATE OR REPLACE TEMPORARY VIEW jl_probes AS
      SELECT DISTINCT gram, m, i, substring(gram, at + 1, n) AS seg FROM (
        SELECT gram, m, k, i, i * (m div (k + 1)) + greatest(0, i - (k + 1 - m % (k + 1))) AS start, m div (k + 1) + if(i >= k + 1 - m % (k + 1), 1, 0) AS n
        FROM (SELECT gram, m, jl_most(m) AS k FROM (SELECT DISTINCT gram FROM jl_grams) LATERAL VIEW explode(sequence(greatest(1, length(gram) - 2), length(gram) + 2)) t AS m)
        LATERAL VIEW explode(sequence(0, k)) s AS i WHERE abs(length(gram) - m) <= k)
      LATERAL VIEW explode(sequence(greatest(0, start - k), greatest(0, start + k))) p AS at WHERE at + n <= length(gram)""")
    _keep(spark, "jl_close", """
      SELECT gram, ref, skill_id, deep, len, min(d) AS d FROM (
        SELECT gram, s.*, levenshtein(gram, ref, 2) AS d FROM jl_probes p JOIN jl_segments s ON p.m = s.len AND p.i = s.i AND p.seg = s.seg)
      WHERE d = 0 OR (d = 1 AND (len > 4 OR (len = 4 AND length(gram) <> 4)))
        OR (d = 2 AND (len > 7 OR (len > 4 AND array_sort(split(gram, '')) = array_sort(split(ref, '')))))
      GROUP BY gram, ref, skill_id, deep, len""")
    # sentences that hold a run or a reference; no other run is asked for
    _keep(spark, "jl_common", """
      SELECT g.gram, count(DISTINCT text_id) AS df FROM jl_grams g LEFT SEMI JOIN (SELECT gram FROM jl_close WHERE d > 0 UNION SELECT ref FROM jl_close WHERE d > 0) c ON g.gram = c.gram
      WHERE kind = 'sentence' GROUP BY g.gram""")
    spark.sql("""CREATE OR REPLACE TEMPORARY VIEW jl_best AS
      SELECT text_id, max_by(struct(skill_id, deep, len), struct(d = 0, len, -place, -skill_id)) AS best FROM (
        SELECT g.text_id, c.skill_id, c.deep, c.len, c.d, g.place
        FROM jl_grams g JOIN jl_close c ON g.gram = c.gram LEFT JOIN jl_common a ON g.gram = a.gram LEFT JOIN jl_common b ON c.ref = b.gram
        WHERE g.kind = 'field' OR c.d = 0 OR coalesce(a.df, 0) * 4 <= coalesce(b.df, 0)) GROUP BY text_id""")
    _keep(spark, "jl_hits", """
      SELECT requirement_id, max_by(best.skill_id, struct(best.deep, best.len, -best.skill_id)) AS skill_id FROM (
        SELECT requirement_id, explode(ids) AS text_id FROM (
          SELECT requirement_id, CASE WHEN skill IS NULL AND subskill IS NULL THEN array(jl_id(requirement, 'sentence'))
            ELSE array(jl_id(skill, 'field'), jl_id(subskill, 'field')) END AS ids FROM jl_todo)) t JOIN jl_best USING (text_id) GROUP BY requirement_id""")
    return spark.sql("""
      SELECT requirement_id, skill_id FROM jl_hits
      UNION ALL SELECT DISTINCT t.requirement_id, 0 FROM jl_todo t LEFT ANTI JOIN jl_hits h ON t.requirement_id = h.requirement_id""")


def plain_sql() -> str:
    """The same result in SQL for another engine, with every run of words held against every reference."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    a, b = fold_tables()

    def fold(x: str) -> str:
        return f"lower(trim(regexp_replace(replace(replace(translate({x}, {quoted(a)}, {quoted(b)}), 'ﬁ', 'fi'), 'ﬃ', 'ffi'), '\\s+', ' ', 'g')))"

    def key(x: str) -> str:
        return f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}#+]', '', 'g')"

    aliases = ", ".join(f"({quoted(n)}, {quoted(y.strip())})" for n, yy in ALIASES.items() for y in yy.split(","))
    return f"""WITH named AS (SELECT skill_id, coalesce(subskill, skill) AS name, subskill IS NOT NULL AS deep FROM skill_catalog WHERE coalesce(subskill, skill) IS NOT NULL),
  spelt AS (SELECT skill_id, deep, {key(fold("name"))} AS ref, true AS main FROM named
    UNION ALL SELECT skill_id, deep, {key(fold("a.alias"))}, false FROM named JOIN (VALUES {aliases}) a(name, alias) USING (name)),
  refs AS (SELECT ref, arg_min(skill_id, (CASE WHEN main THEN 0 ELSE 1 END, skill_id)) AS skill_id, bool_or(deep) AS deep, length(ref) AS len FROM spelt WHERE ref <> '' GROUP BY ref),
  todo AS (SELECT DISTINCT requirement_id, nullif(trim(skill), '') AS skill, nullif(trim(subskill), '') AS subskill, requirement FROM job_requirements r
    WHERE category = 'technical' AND NOT EXISTS (SELECT 1 FROM skill_catalog c WHERE r.skill IS NOT DISTINCT FROM c.skill AND r.subskill IS NOT DISTINCT FROM c.subskill)),
  own AS (SELECT requirement_id, skill AS text, 'field' AS kind FROM todo UNION ALL SELECT requirement_id, subskill, 'field' FROM todo
    UNION ALL SELECT requirement_id, requirement, 'sentence' FROM todo WHERE skill IS NULL AND subskill IS NULL),
  texts AS (SELECT text, kind, list_filter(list_transform(regexp_split_to_array({fold("text")}, '[^\\p{{L}}\\p{{N}}#+.]+'), lambda w: {key("w")}), lambda w: w <> '') AS words FROM (SELECT DISTINCT text, kind FROM own WHERE text IS NOT NULL)),
  starts AS (SELECT text, kind, words, unnest(range(0, len(words))) AS place FROM texts),
  runs AS (SELECT text, kind, words, place, unnest(range(1, len(words) - place + 1)) AS n FROM starts),
  grams AS (SELECT text, kind, place, array_to_string(words[place + 1 : place + n], '') AS gram FROM runs),
  kept AS (SELECT * FROM grams WHERE length(gram) <= (SELECT max(len) + 2 FROM refs)),
  close AS (SELECT * FROM (SELECT gram, refs.*, levenshtein(gram, ref) AS d FROM (SELECT DISTINCT gram FROM kept) JOIN refs ON abs(length(gram) - len) <= 2)
    WHERE d = 0 OR (d = 1 AND (len > 4 OR (len = 4 AND length(gram) <> 4)))
      OR (d = 2 AND (len > 7 OR (len > 4 AND list_sort(string_split(gram, '')) = list_sort(string_split(ref, '')))))),
  common AS (SELECT gram, count(DISTINCT text) AS df FROM kept WHERE kind = 'sentence' GROUP BY gram),
  best AS (SELECT g.text, g.kind, arg_max({{'id': c.skill_id, 'deep': c.deep, 'len': c.len}}, (CASE WHEN c.d = 0 THEN 1 ELSE 0 END, c.len, -g.place, -c.skill_id)) AS b
    FROM kept g JOIN close c ON g.gram = c.gram LEFT JOIN common x ON g.gram = x.gram LEFT JOIN common y ON c.ref = y.gram
    WHERE g.kind = 'field' OR c.d = 0 OR coalesce(x.df, 0) * 4 <= coalesce(y.df, 0) GROUP BY 1, 2),
  hits AS (SELECT requirement_id, arg_max(b.id, (CASE WHEN b.deep THEN 1 ELSE 0 END, b.len, -b.id)) AS skill_id FROM own JOIN best USING (text, kind) GROUP BY 1)
SELECT DISTINCT requirement_id, coalesce(skill_id, 0)::int AS skill_id FROM todo LEFT JOIN hits USING (requirement_id)"""
