"""What opening a posting is about: role, level and team out of a title, city out of a location. All in the JVM, in
steps of one projection each, so that no text is folded twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.lookalikes import fold

# Words of titles that are shortened, to one form, and the levels of a post.
SHORT = {"analista": "anl", "analyst": "anl", "engenheiro": "eng", "engenheira": "eng", "engineer": "eng", "desenvolvedor": "dev", "desenvolvedora": "dev",
         "developer": "dev", "administrador": "adm", "administradora": "adm", "administrator": "adm", "arquiteto": "arq", "arquiteta": "arq", "architect": "arq",
         "jr": "junior", "pl": "pleno", "sr": "senior", "est": "estagio", "estagiario": "estagio", "estagiaria": "estagio", "assist": "assistente"}
LONG = {"analista": "anl", "engenheiro": "eng", "desenvolvedor": "dev", "developer": "dev", "administrador": "adm", "arquiteto": "arq"}
LEVELS = ("junior", "pleno", "senior", "estagio", "assistente", "trainee", "intern", "associate", "graduate", "midlevel")
STATES = "ac al ap am ba ce df es go ma mt ms mg pa pb pr pe pi rj rn rs ro rr sc sp se to uy pt ar".split()

# what an advertiser adds: forms for both sexes, codes, classes and shifts
ADDED = r"\([a-z]{1,2}(?:/[a-z])?\)|/a\b|\(? ?\bco[dd]\w*\.? ?\d+ ?\)?|# ?\d+|[-|(]? ?\bvaga \d+\)?|[-|]? ?\b\d+[ao] (?:turma|turno)\b|\btm academy\b|\bacademy\b"
DASH = r"^(.+?) *(?:\||-(?= )| -|–)(.+)$"


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"[^a-z0-9]+"), lambda w: w != "")


def _known(w: Column) -> Column:
    """A word in its short form; long ones with up to two slips too."""
    c = F.when(F.length(w) < 7, w)
    for full, s in LONG.items():
        c = c.when(F.levenshtein(w, F.lit(full), 2) >= 0, F.lit(s))
    short = F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])
    return F.coalesce(F.try_element_at(short, w), c.otherwise(w))


def with_opening(rows: DataFrame, title: str, location: str) -> DataFrame:
    """rows without title and location, with role, level, team and city.

    The forms 'role level - team', 'role level | team', 'role (team) level' and 'team: role level' give the same parts.
    Without a level, level is ''; a null title gives null parts; a null location, or one that is nothing but state,
    country and way of working, gives the city ''. Existing columns of these names are replaced.
    """
    own = [c for c in rows.columns if c not in (title, location, "role", "level", "team", "city")]
    states = "|".join(STATES)
    levels, full = F.array(*map(F.lit, LEVELS)), F.array(*map(F.lit, [*LEVELS, "estagiario", "estagiaria"]))
    x = rows.select(*own, fold(F.col(title)).alias("_t"), fold(F.col(location)).alias("_l"))
    x = x.select(*own, F.regexp_replace(F.regexp_replace("_t", r"\bmid ?-? ?level\b", "midlevel"), ADDED, " ").alias("_t"),
                 F.trim(F.regexp_replace("_l", r"\b(?:remoto|hibrido|presencial|remote|hybrid|brasil|brazil|br)\b|[^\p{L}]+", " ")).alias("_l"))
    x = x.select(*own, "_t", F.regexp_replace("_l", r" {2,}", " ").alias("_l"), F.instr("_t", ":").alias("_colon"), F.regexp_extract("_t", r"\(([^()]+)\)", 1).alias("_paren"),
                 F.regexp_extract("_t", DASH, 1).alias("_left"), F.regexp_extract("_t", DASH, 2).alias("_right"))
    colon = F.col("_colon") > 1
    head = F.when(colon, F.expr("substring(_t, _colon + 1)")).when(F.col("_paren") != "", F.regexp_replace("_t", r"\([^()]+\)", " ")).otherwise(F.when(F.col("_left") != "", F.col("_left")).otherwise(F.col("_t")))
    team = F.when(colon, F.expr("substring(_t, 1, _colon - 1)")).when(F.col("_paren") != "", F.col("_paren")).otherwise(F.col("_right"))
    x = x.select(*own, _words(head).alias("_h"), _words(team).alias("_team"), F.regexp_replace("_l", rf"(?<=\p{{L}}) (?:{states})$", "").alias("_city"), "_l")
    x = x.select(*own, F.transform("_h", _known).alias("_h"), "_team", F.when(F.col("_city") == F.col("_l"), F.regexp_replace("_l", rf"^(?:{states}) (?=\p{{L}})", "")).otherwise(F.col("_city")).alias("_city"))
    x = x.select(*own, "_h", "_team", "_city", F.array_intersect("_h", levels).alias("_exact"), F.element_at(F.concat(F.array(F.lit("")), "_h"), -1).alias("_last"))
    near = F.when((F.size("_exact") == 0) & (F.length("_last") >= 5), F.filter(full, lambda v: F.levenshtein(F.col("_last"), v, 2) >= 0))
    x = x.select(*own, "_h", "_team", "_city", "_exact", F.coalesce(near, F.array().cast("array<string>")).alias("_near"))
    level = F.when(F.size("_exact") > 0, F.element_at("_exact", -1)).when(F.size("_near") > 0, F.regexp_replace(F.element_at("_near", 1), "^estagi.*", "estagio")).otherwise(F.lit(""))
    role = F.when(F.size("_exact") > 0, F.array_except("_h", "_exact")).when(F.size("_near") > 0, F.slice("_h", 1, F.greatest(F.size("_h") - 1, F.lit(0)))).otherwise(F.col("_h"))
    return x.select(*own, F.array_join(role, " ").alias("role"), F.when(F.col("_h").isNotNull(), level).alias("level"), F.array_join("_team", " ").alias("team"), F.coalesce("_city", F.lit("")).alias("city"))


def interleaved(a: Column, b: Column) -> Column:
    """Words of a and b in turn, so that every stretch of the result holds some of both."""
    pairs = F.zip_with(F.split(a, " "), F.split(b, " "), lambda p, q: F.concat_ws(" ", p, q))
    return F.trim(F.array_join(pairs, " "))
