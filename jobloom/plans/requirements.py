"""Queries over requirement sentences: what they are about, lists without leakage, contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import requirements as req
from jobloom.functions import sections
from jobloom.functions import vocabulary as v
from jobloom.plans.queries import query
from jobloom.session import staged, table


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _plain(x: str) -> str:
    return f"lower(strip_accents({x}))"


_TECHNOLOGIES = "technologies(place, pattern, skill, subskill, profile) AS (VALUES " + ", ".join(f"({i}, {', '.join(map(_quoted, t))})" for i, t in enumerate(v.TECHNOLOGIES)) + ")"


# letters of other scripts are letters of a word in Spark; the other engine only knows that of ASCII
_OTHER_LETTERS = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{2AF}\x{370}-\x{58F}\x{1D400}-\x{1D7FF}\x{FF10}-\x{FF5A}]"


def _records_sql(rows: str) -> str:
    """SQL of the records of rows (an SQL select of key, mandatory, text): CTEs up to `records`."""
    return f"""WITH {_TECHNOLOGIES}, given AS ({rows}),
  said AS (SELECT DISTINCT text, regexp_replace(trim(regexp_replace({_plain("text")}, '\\s+', ' ', 'g')), '{_OTHER_LETTERS}', '_', 'g') AS x FROM given),
  named AS (SELECT text, skill, subskill, profile, min(place) AS place FROM said JOIN technologies ON regexp_matches(x, pattern) GROUP BY ALL),
  listed AS (SELECT text, count(*) AS n, count(*) FILTER (profile IS NULL) AS unmapped, arg_min(skill, place) AS skill, arg_min({{'s': subskill}}, place).s AS subskill,
      string_agg(skill || '/' || coalesce(subskill, '') || '/' || coalesce(profile, ''), ',' ORDER BY place) AS skills,
      bool_or(profile IN ('sql', 'api', 'git', 'tests', 'design', 'docker', 'cicd', 'micro', 'msg', 'obs', 'linux', 'iac', 'sec', 'data', 'auto', 'prod', 'cloud')) AS carried FROM named GROUP BY text),
  told AS (SELECT said.text, x, coalesce(n, 0) AS n, coalesce(unmapped, 0) AS unmapped, skill, subskill, coalesce(skills, '') AS skills, coalesce(carried, false) AS carried,
      nullif(regexp_extract(replace(x, ',', '.'), '(\\d+(\\.\\d+)?)\\s*\\+?\\s*(anos?|years?)', 1), '')::double AS min_years,
      CASE WHEN x SIMILAR TO '.*(especialista|expert|expertise profunda|arquitetura avancada).*' THEN 4 WHEN x SIMILAR TO '.*(avancad|advanced|dominio|dominar|solido|proficien).*' THEN 3
        WHEN contains(x, 'intermedi') THEN 2 WHEN x SIMILAR TO '.*(basic|fundament|nocao|nocoes|introdutor|familiaridade).*' THEN 1 END AS level FROM said LEFT JOIN listed USING (text)),
  judged AS (SELECT *, CASE
      WHEN regexp_matches(x, '\\bpcd\\b|pessoas? com deficiencia|vaga afirmativa|elegibilidade') THEN 'eligibility'
      WHEN regexp_matches(x, '\\b(formacao|graduacao|ensino superior|bacharel|bacharelado|cursando|curso superior|degree|degrees)\\b') THEN 'education'
      WHEN regexp_matches(x, 'residir|residencia|localizacao|disponibilidade para (atuar|trabalhar|mudanca)|\\bpresencial\\b') THEN 'location'
      WHEN n = 0 AND regexp_matches(x, '\\b(ingles|english|espanhol|spanish|portugues|portuguese)\\b') THEN 'language'
      WHEN n > 0 OR regexp_matches(x, 'backend|desenvolvimento de software|infraestrutura|redes|servidores|documentacao tecnica|regras de negocio|finops') THEN 'technical'
      WHEN min_years IS NOT NULL OR contains(x, 'experiencia') OR contains(x, 'vivencia') THEN 'experience'
      WHEN regexp_matches(x, 'comunicacao|colabora|proativ|organizacao|autonomia|curiosidade|relacionamento|trabalho em equipe|senso de') THEN 'behavioral'
      WHEN regexp_matches(x, 'mercado financeiro|meios de pagamento|fintech|bancari|credito|risco|fraude|investimento|renda fixa|compliance|\\bfidc\\b|ambiente sicoob') THEN 'domain'
      ELSE 'other' END AS category FROM told),
  records AS (SELECT given.*, category, skill, subskill, skills, unmapped, level, min_years,
      CASE level WHEN 1 THEN 'básico' WHEN 2 THEN 'intermediário' WHEN 3 THEN 'avançado' WHEN 4 THEN 'especialista' END AS level_label,
      CASE WHEN n < 2 THEN 'single' WHEN regexp_matches(x, '\\b(ou|or)\\b') OR contains(text, '/') THEN 'any' ELSE 'all' END AS relation,
      category = 'behavioral' OR carried AS transferable,
      CASE WHEN NOT mandatory THEN 'differential' WHEN category IN ('education', 'location', 'eligibility') THEN 'eliminatory' ELSE 'mandatory' END AS requirement_type FROM given JOIN judged USING (text))"""


def _joined_skills() -> F.Column:
    return F.array_join(F.transform("skills", lambda s: F.concat(s["skill"], F.lit("/"), F.coalesce(s["subskill"], F.lit("")), F.lit("/"), F.coalesce(s["profile"], F.lit("")))), ",")


@query(
    _records_sql("SELECT DISTINCT requirement_id, coalesce(mandatory, false) AS mandatory, trim(regexp_replace(coalesce(requirement, ''), '\\s+', ' ', 'g')) AS text FROM job_requirements")
    + """
SELECT requirement_id, category, requirement_type, skill, subskill, skills, unmapped::int AS unmapped, relation, level::int AS level, level_label, min_years, transferable FROM records"""
)
def requirement_records(spark: SparkSession, d: str) -> DataFrame:
    """What every requirement sentence is about, read from its words alone."""
    r = table(spark, d, "job_requirements").select("requirement_id", "mandatory", "requirement").distinct()
    x = req.with_record(r, "requirement", "mandatory").withColumn("skills", _joined_skills())
    return x.select("requirement_id", "category", "requirement_type", "skill", "subskill", "skills", "unmapped", "relation", "level", "level_label", "min_years", "transferable")


def _ends(x: str) -> str:
    n = f"regexp_replace(trim(regexp_replace({_plain(x)}, '^[^a-z0-9]+', '')), '^[ :_!?]+|[ :_!?]+$', '', 'g')"
    return f"(regexp_matches({n}, {_quoted(v.STOP_HEADING)}) OR regexp_matches({n}, {_quoted(v.STOP_BEGINNINGS)}))"


def _clean(column: str) -> str:
    kept = f"list_filter({column}, lambda x, i: NOT list_bool_or(list_transform({column}[1:i], lambda y: {_ends('y')})) AND NOT regexp_matches({_plain('x')}, {_quoted(v.NOISE)}))"
    line = f"list_filter(list_transform({kept}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"
    once = f"list_filter(l, lambda x, i: NOT list_contains(l[1:i - 1], x))"  # noqa: F541
    return line, once


def _cleaned_sql() -> str:
    (a, once), (b, _) = _clean("r"), _clean("d")
    held = f"(length(x) > 180 AND len(list_filter(u, lambda o: o <> x AND length({_plain('o')}) >= 3 AND contains({_plain('x')}, {_plain('o')}))) >= 2)"
    return f"""p AS (SELECT id, role, coalesce(json_extract_string(payload, '$.requirements[*]'), []) AS r, coalesce(json_extract_string(payload, '$.differentials[*]'), []) AS d FROM jobs),
  l AS (SELECT id, role, r, 0 AS kind, {a} AS l FROM p UNION ALL SELECT id, role, d, 1, {b} FROM p),
  u AS (SELECT id, role, r, kind, {once} AS u FROM l),
  cleaned AS (SELECT id, role, r, kind, list_filter(u, lambda x: NOT {held}) AS items FROM u)"""


def _payload_lists(spark: SparkSession, d: str) -> DataFrame:
    """(id, role, requirements, differentials, kept, kept_differentials) of every payload."""
    s = F.from_json("payload", "requirements array<string>, differentials array<string>")
    x = table(spark, d, "jobs").select("id", "role", s.alias("p")).select("id", "role", "p.requirements", "p.differentials")
    none = F.array().cast("array<string>")
    x = x.select("id", "role", F.coalesce("requirements", none).alias("requirements"), F.coalesce("differentials", none).alias("differentials"))
    return x.select("*", sections.clean_items(F.col("requirements")).alias("kept"), sections.clean_items(F.col("differentials")).alias("kept_differentials"))


@query(f"""WITH {_cleaned_sql()},
  q AS (SELECT id, role, list_filter(r, lambda x: trim(x) <> '') AS f FROM cleaned WHERE kind = 0),
  c AS (SELECT id, len(f) = 0 OR (len(list_filter(f, lambda x: regexp_matches({_plain("x")}, {_quoted(v.NOISE)}))) >= 2 AND len(list_filter(f, lambda x: regexp_matches({_plain("x")}, {_quoted(v.NOISE)}))) * 4 >= len(f))
      OR (regexp_matches({_plain("role")}, {_quoted(v.TECHNICAL_TITLE)}) AND len(list_filter(f, lambda x: regexp_matches({_plain("x")}, {_quoted(v.HARD_SKILL)}))) = 0) AS conflict FROM q)
SELECT id, max(len(items)) FILTER (kind = 0)::int AS requirements, max(len(items)) FILTER (kind = 1)::int AS differentials, max(md5(array_to_string(items, '|'))) FILTER (kind = 0) AS kept_md5, any_value(conflict) AS conflict
FROM cleaned JOIN c USING (id) GROUP BY id""")
def cleaned_lists(spark: SparkSession, d: str) -> DataFrame:
    """The requirement lists of payloads without leakage, and whether a list can't be trusted."""
    x = _payload_lists(spark, d)
    return x.select("id", F.size("kept").alias("requirements"), F.size("kept_differentials").alias("differentials"), F.md5(F.array_join("kept", "|")).alias("kept_md5"),
                    sections.quality_conflict(F.col("role"), F.col("requirements")).alias("conflict"))


ELIGIBILITY_NOTE = "Elegibilidade para vaga afirmativa: confirmar no anúncio"


@query(
    f"WITH {_cleaned_sql()}, rows_ AS (SELECT id, role, kind = 0 AS mandatory, unnest(items) AS text, generate_subscripts(items, 1) - 1 AS position, 'description' AS source FROM cleaned), "
    + _records_sql("""SELECT id, mandatory, text, position, source FROM rows_
      UNION ALL SELECT id, true, 'Elegibilidade para vaga afirmativa: confirmar no anúncio', len(items), 'title' FROM cleaned
      WHERE kind = 0 AND regexp_matches(lower(strip_accents(role)), '\\bpcd\\b|pessoas? com deficiencia|vaga afirmativa|elegibilidade')
        AND NOT EXISTS (SELECT 1 FROM rows_ w WHERE w.id = cleaned.id AND regexp_matches(lower(strip_accents(w.text)), '\\bpcd\\b|pessoas? com deficiencia|vaga afirmativa|elegibilidade'))""").removeprefix("WITH ")
    + """
SELECT id, mandatory, position::int AS position, source, text, category, requirement_type, relation, level::int AS level, min_years, unmapped::int AS unmapped, skills FROM records"""
)
def normalized_requirements(spark: SparkSession, d: str) -> DataFrame:
    """One record for each requirement that remains of a payload; a title that asks for eligibility adds one if none of
    the others does."""
    x = staged(_payload_lists(spark, d).select("id", "role", "kept", "kept_differentials"), "payload-lists")
    parts = [x.select("id", F.lit(m).alias("mandatory"), F.posexplode(c).alias("position", "line"), F.lit("description").alias("source")) for m, c in ((True, "kept"), (False, "kept_differentials"))]
    asks = lambda c: req.norm_blank(c).rlike(v.ELIGIBILITY)
    told = F.exists(F.concat("kept", "kept_differentials"), asks)
    extra = x.where(asks(F.col("role")) & ~told).select("id", F.lit(True).alias("mandatory"), F.size("kept").alias("position"), F.lit(ELIGIBILITY_NOTE).alias("line"), F.lit("title").alias("source"))
    r = req.with_record(parts[0].unionByName(parts[1]).unionByName(extra), "line", "mandatory").withColumn("skills", _joined_skills())
    return r.select("id", "mandatory", "position", "source", "text", "category", "requirement_type", "relation", "level", "min_years", "unmapped", "skills")


@query("""
WITH r AS (SELECT DISTINCT * FROM job_requirements),
  b AS (SELECT unnest(list_filter([CASE WHEN coalesce(trim(requirement), '') = '' THEN 'no text' END,
      CASE WHEN requirement_type IS NULL OR requirement_type NOT IN ('mandatory', 'differential', 'eliminatory') THEN 'type' END,
      CASE WHEN category IS NULL OR category NOT IN ('technical', 'experience', 'education', 'language', 'location', 'modality', 'eligibility', 'behavioral', 'domain', 'other') THEN 'category' END,
      CASE WHEN relation IS NULL OR relation NOT IN ('single', 'any', 'all') THEN 'relation' END, CASE WHEN required_level NOT BETWEEN 1 AND 4 THEN 'level' END,
      CASE WHEN min_years < 0 THEN 'years' END, CASE WHEN mandatory IS DISTINCT FROM (requirement_type <> 'differential') THEN 'flag' END], lambda x: x IS NOT NULL)) AS violation FROM r)
SELECT violation, count(*) AS rows FROM b GROUP BY 1""")
def requirement_violations(spark: SparkSession, d: str) -> DataFrame:
    """How many stored requirements break each rule of their contract."""
    r = table(spark, d, "job_requirements").distinct().withColumnsRenamed({"requirement": "text", "required_level": "level"})
    return req.violations(r).groupBy("violation").agg(F.count("*").alias("rows"))


_NO_ACCENT_EDGE = "regexp_replace({}, '[\\x{{AA}}\\x{{B5}}\\x{{BA}}\\x{{C0}}-\\x{{2AF}}\\x{{370}}-\\x{{58F}}\\x{{1D400}}-\\x{{1D7FF}}\\x{{FF10}}-\\x{{FF5A}}]', '_', 'g')"


def _tags_sql() -> str:
    # word boundaries are looked for where other letters stand for themselves, the rest in the text as it is
    def hit(p: str) -> str:
        parts = p.split("|")
        edge, free = [x for x in parts if "\\b" in x], [x for x in parts if "\\b" not in x]
        tests = ([f"regexp_matches(y, {_quoted('|'.join(edge))})"] if edge else []) + ([f"regexp_matches(x, {_quoted('|'.join(free))})"] if free else [])
        return f"({' OR '.join(tests)})"

    return "list_filter([" + ", ".join(f"CASE WHEN {hit(p)} THEN {_quoted(t)} END" for t, p in v.TAGS.items()) + "], lambda t: t IS NOT NULL)"


def _cases(column: str, pairs: list[tuple[str, list[str]]]) -> str:
    return " ".join(f"WHEN {' OR '.join(f'contains({column}, {_quoted(w)})' for w in words)} THEN {_quoted(name)}" for name, words in pairs)


@query(f"""
WITH j AS (SELECT id, role, lower(concat_ws(' ', role, json_extract_string(payload, '$.description'), array_to_string(json_extract_string(payload, '$.requirements[*]'), ' '))) AS x FROM jobs),
  k AS (SELECT *, {_NO_ACCENT_EDGE.format("x")} AS y, lower(trim(regexp_replace(role, '\\s+', ' ', 'g'))) AS t, lower(trim(regexp_replace(concat_ws(' ', role, x), '\\s+', ' ', 'g'))) AS a FROM j),
  l AS (SELECT *, {_tags_sql()} AS tags FROM k)
SELECT id, array_to_string(tags, ',') AS tags, CASE {_cases("a", v.AREAS)} ELSE '{v.OTHER_AREA}' END AS area,
  CASE {" ".join(f"WHEN list_contains(tags, {_quoted(tag)}) AND ({' OR '.join(f'contains(t, {_quoted(w)})' for w in words)}) THEN {_quoted(name)}" for name, tag, words in v.STACKS)}
    {" ".join(f"WHEN list_contains(tags, {_quoted(tag)}) THEN {_quoted(name)}" for name, tag in v.TAG_STACKS)} ELSE '{v.OTHER_STACK}' END AS stack FROM l""")
def job_labels(spark: SparkSession, d: str) -> DataFrame:
    """Tags, area and stack of every catalog job by its title, description and requirements."""
    from jobloom.functions import classify

    items = F.array_join(F.from_json(F.get_json_object("payload", "$.requirements"), "array<string>"), " ")
    x = table(spark, d, "jobs").select("id", "role", F.concat_ws(" ", "role", F.get_json_object("payload", "$.description"), items).alias("x"))
    x = x.withColumn("t", classify.tags(F.col("x")))
    return x.select("id", F.array_join("t", ",").alias("tags"), classify.area(F.col("role"), F.col("x")).alias("area"), classify.stack(F.col("t"), F.col("role")).alias("stack"))
