"""Text of markup as columns."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import strip_accents


def unescaped(c: Column) -> Column:
    """Every named and numbered entity resolved once. Texts without one need no Python."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(html.unescape, na_action="ignore")

    return F.when(c.rlike("&[#a-zA-Z0-9]+;?"), run(c)).otherwise(c)


def without_tags(c: Column, by: str = " ") -> Column:
    return F.regexp_replace(c, "<[^>]+>", by)


def norm_page(c: Column) -> Column:
    """Unescaped, without tags, single blanks, lower case; accents kept."""
    return F.lower(F.trim(F.regexp_replace(without_tags(unescaped(c)), r"\s+", " ")))


def norm_inbox(c: Column) -> Column:
    """Without accents and tags, single blanks, lower case."""
    return F.trim(F.regexp_replace(without_tags(F.lower(strip_accents(c))), r"\s+", " "))


def norm_identity(c: Column) -> Column:
    """Letters and digits alone, without tags, entities and accents, in lower case."""
    return F.regexp_replace(F.lower(strip_accents(unescaped(without_tags(c, "")))), r"[^\p{L}\p{N}]+", "")
