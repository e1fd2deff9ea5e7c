"""Text columns: folding, tokens, set similarity. All of it stays in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def accent_tables() -> tuple[str, str]:
    """Letters with marks to their base letters (canonical decomposition, marks of category Mn dropped)."""
    to = {}
    for cp in [*range(0xC0, 0xAC00), *range(0xF900, 0x10000)]:
        d = unicodedata.normalize("NFD", chr(cp))
        base = "".join(c for c in d if unicodedata.category(c) != "Mn")
        if base != chr(cp) and len(base) == 1:
            to[chr(cp)] = base
    return "".join(to), "".join(to.values())


def strip_accents(c: Column) -> Column:
    """Letters without their marks; everything else is kept. Null stays null."""
    return F.regexp_replace(F.translate(c, *accent_tables()), r"\p{Mn}", "")


def norm_plain(c: Column) -> Column:
    """Accents dropped, lower case; blanks kept."""
    return F.lower(strip_accents(c))


def norm_blank(c: Column) -> Column:
    """norm_plain, runs of blanks as one, trimmed."""
    return F.trim(F.regexp_replace(norm_plain(c), r"\s+", " "))


def norm_words(c: Column) -> Column:
    """norm_plain with everything but a-z and 0-9 as one blank, trimmed."""
    return F.trim(F.regexp_replace(norm_plain(c), r"[^a-z0-9]+", " "))


def norm_tech(c: Column) -> Column:
    """norm_words that keeps + # and . (c++, c#, node.js)."""
    return F.trim(F.regexp_replace(norm_plain(c), r"[^a-z0-9+#.]+", " "))


def compact(c: Column) -> Column:
    """norm_plain without anything but a-z and 0-9."""
    return F.regexp_replace(norm_plain(c), r"[^a-z0-9]+", "")


def tokens(c: Column) -> Column:
    """Distinct words of norm_words in order of first appearance; an empty text has none."""
    return F.array_distinct(F.filter(F.split(norm_words(c), " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """|A ∩ B| / |A ∪ B| of two arrays; 0 if either is empty or null."""
    i, u = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), i / u).otherwise(F.lit(0.0))


# Words that say nothing in a requirement, other spellings of its terms, and short words of titles.
STOP_WORDS = ("conhecimento", "experiencia", "vivencia", "basico", "intermediario", "avancado", "para", "com", "uma", "das", "dos", "que", "atuar", "desenvolver")
TERMS = {"restful": "rest", "restapi": "api", "restapis": "api", "postgres": "postgresql", "nodejs": "node", "amazonwebservices": "aws", "googlecloud": "gcp",
         "microsoftazure": "azure", "microservices": "microservice", "microsservicos": "microservice"}
TITLE_WORDS = {"jr": "junior", "eng": "engineer", "dev": "developer"}


def _mapped(words: Column, table: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(m, w), w)))


def requirement_tokens(items: Column) -> Column:
    """The terms of a list of requirements: words of three signs or more (letters, digits, + # .), without words that say
    nothing, in one spelling. A null list has none."""
    words = F.filter(F.split(norm_tech(F.array_join(items, " ")), " "), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.coalesce(_mapped(words, TERMS), F.array().cast("array<string>"))


def title_tokens(title: Column) -> Column:
    return _mapped(tokens(title), TITLE_WORDS)


def similarity_band(similarity: Column) -> Column:
    """'duplicate' from 0.9, 'review' from 0.75, else null."""
    return F.when(similarity >= 0.9, "duplicate").when(similarity >= 0.75, "review")
