"""Tags, area and stack of an advert as columns. Nulls count as empty texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions import vocabulary as v


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def tags(text: Column) -> Column:
    x = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.when(x.rlike(p), F.lit(t)) for t, p in v.TAGS.items()]), lambda t: t.isNotNull())


def _holds(x: Column, words: list[str]) -> Column:
    c = F.lit(False)
    for w in words:
        c = c | x.contains(w)
    return c


def area(title: Column, text: Column) -> Column:
    """By title and text, the whole of it."""
    x = _plain(F.concat_ws(" ", title, text))
    c = F.when(F.lit(False), F.lit(""))
    for name, words in v.AREAS:
        c = c.when(_holds(x, words), name)
    return c.otherwise(v.OTHER_AREA)


def stack(tags_: Column, title: Column) -> Column:
    x = _plain(title)
    c = F.when(F.lit(False), F.lit(""))
    for name, tag, words in v.STACKS:
        c = c.when(F.array_contains(tags_, tag) & _holds(x, words), name)
    for name, tag in v.TAG_STACKS:
        c = c.when(F.array_contains(tags_, tag), name)
    return c.otherwise(v.OTHER_STACK)
