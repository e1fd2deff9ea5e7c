"""Requirement sentences as columns: technologies, level, years, category, type, relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import vocabulary as v
from jobloom.functions.text import norm_blank


def level(text: Column) -> Column:
    """1 to 4, the highest level whose words occur; null for none."""
    x = norm_blank(text)
    c = F.lit(None).cast("int")
    for n in sorted(v.LEVELS):
        c = F.when(x.rlike(v.LEVELS[n]), F.lit(n)).otherwise(c)
    return c


def min_years(text: Column) -> Column:
    """The first number before a word for years; a decimal comma counts. Null for none."""
    x = F.regexp_extract(F.replace(norm_blank(text), F.lit(","), F.lit(".")), r"(\d+(?:\.\d+)?)\s*\+?\s*(?:anos?|years?)", 1)
    return F.nullif(x, F.lit("")).cast("double")


def technologies(normal: Column) -> Column:
    """array<struct<skill, subskill, profile>> of the technologies in a text already normalised by norm_blank, in order
    of precedence, each once."""
    none = F.lit(None).cast("string")
    one = lambda x: none if x is None else F.lit(x)
    hits = [F.when(normal.rlike(p), F.struct(F.lit(a).alias("skill"), one(b).alias("subskill"), one(c).alias("profile"))) for p, a, b, c in v.TECHNOLOGIES]
    return F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))


def _category(x: Column, skills: Column, years: Column) -> Column:
    return (
        F.when(x.rlike(v.ELIGIBILITY), "eligibility").when(x.rlike(v.EDUCATION), "education").when(x.rlike(v.LOCATION), "location")
        .when(x.rlike(v.LANGUAGE) & (F.size(skills) == 0), "language").when((F.size(skills) > 0) | x.rlike(v.TECHNICAL), "technical")
        .when(years.isNotNull() | x.contains("experiencia") | x.contains("vivencia"), "experience").when(x.rlike(v.BEHAVIORAL), "behavioral")
        .when(x.rlike(v.DOMAIN), "domain").otherwise("other")
    )


RECORD = ["text", "category", "requirement_type", "skill", "subskill", "skills", "profile_ids", "unmapped", "relation", "level", "level_label", "min_years", "transferable"]


def with_record(rows: DataFrame, text: str, mandatory: str) -> DataFrame:
    """rows with the columns of RECORD for a sentence: what it is about, whether it rules out (eliminatory), which
    technologies it names and how they relate, level and years. Existing columns of these names are replaced, the text
    column too if it is called 'text'. A null text gives category 'other' with nothing in it; a null mandatory counts as
    false. Each different sentence is read once: a sentence that a third of all rows share costs one reading."""
    own = [c for c in rows.columns if c not in RECORD]
    x = rows.select(*own, F.coalesce(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")), F.lit("")).alias("text"), F.coalesce(F.col(mandatory).cast("boolean"), F.lit(False)).alias("_must"))
    t = x.select("text").distinct().select("text", norm_blank(F.col("text")).alias("_x"))
    t = t.select("text", "_x", technologies(F.col("_x")).alias("skills"), min_years(F.col("text")).alias("min_years"), level(F.col("text")).alias("level"))
    ids = F.array_distinct(F.filter(F.transform("skills", lambda s: s["profile"]), lambda p: p.isNotNull()))
    many = F.when(F.col("_x").rlike(r"\b(?:ou|or)\b") | F.contains(F.col("text"), F.lit("/")), "any").otherwise("all")
    t = t.select("*", _category(F.col("_x"), F.col("skills"), F.col("min_years")).alias("category"), ids.alias("profile_ids"), F.when(F.size("skills") > 1, many).otherwise("single").alias("relation"))
    labels = F.create_map(*[F.lit(y) for kv in v.LEVEL_LABELS.items() for y in kv])
    t = t.select(
        "text", "category", F.try_element_at("skills", F.lit(1))["skill"].alias("skill"), F.try_element_at("skills", F.lit(1))["subskill"].alias("subskill"), "skills", "profile_ids",
        F.size(F.filter("skills", lambda s: s["profile"].isNull())).alias("unmapped"), "relation", "level", F.try_element_at(labels, F.col("level")).alias("level_label"), "min_years",
        ((F.col("category") == "behavioral") | F.arrays_overlap("profile_ids", F.array(*map(F.lit, v.TRANSFERABLE)))).alias("transferable"),
    )
    kind = F.when(F.col("_must") & F.col("category").isin("education", "location", "eligibility"), "eliminatory").when(F.col("_must"), "mandatory").otherwise("differential")
    return x.join(t, "text").select(*own, *[kind.alias(c) if c == "requirement_type" else F.col(c) for c in RECORD])


RULES = {
    "no text": "coalesce(trim(text), '') = ''",
    "type": f"requirement_type IS NULL OR requirement_type NOT IN ({', '.join(map(repr, v.TYPES))})",
    "category": f"category IS NULL OR category NOT IN ({', '.join(map(repr, v.CATEGORIES))})",
    "relation": f"relation IS NULL OR relation NOT IN ({', '.join(map(repr, v.RELATIONS))})",
    "level": "level NOT BETWEEN 1 AND 4",
    "years": "min_years < 0",
    "flag": "mandatory IS DISTINCT FROM (requirement_type <> 'differential')",
}


def violations(records: DataFrame) -> DataFrame:
    """records (text, requirement_type, category, relation, level, min_years, mandatory, and any others) with violation,
    one row for each rule that a record breaks."""
    broken = F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in RULES.items()])
    return records.withColumn("violation", F.explode(F.filter(broken, lambda b: b.isNotNull())))
