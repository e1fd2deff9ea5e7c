"""Lists of requirement lines as columns: what is no requirement, where a list ends, what only repeats other lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions import vocabulary as v
from jobloom.functions.text import norm_plain


def is_noise(line: Column) -> Column:
    """Benefits, steps of the process and the like."""
    return norm_plain(line).rlike(v.NOISE)


def heading(line: Column) -> Column:
    """The comparison form of a heading: nothing before its first letter."""
    return F.trim(F.regexp_replace(norm_plain(line), r"^[^a-z0-9]+", ""))


def ends_section(line: Column) -> Column:
    n = F.regexp_replace(heading(line), r"^[ :_!?]+|[ :_!?]+$", "")
    return n.rlike(v.STOP_HEADING) | n.rlike(v.STOP_BEGINNINGS)


def without_containers(items: Column) -> Column:
    """Lines with single blanks, each once in order, without long ones (over 180 characters) that hold two others or
    more. Nulls and blank lines are dropped; a null array stays null."""
    t = F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x.isNotNull() & (x != "")))
    both = F.transform(t, lambda x: F.struct(x.alias("t"), norm_plain(x).alias("n")))
    held = lambda x: F.size(F.filter(both, lambda o: (o["t"] != x["t"]) & (F.length(o["n"]) >= 3) & F.contains(x["n"], o["n"])))
    return F.transform(F.filter(both, lambda x: ~((F.length(x["t"]) > 180) & (held(x) >= 2))), lambda x: x["t"])


def clean_items(items: Column) -> Column:
    """Lines up to the first that ends the section, without noise, repeats and containers."""
    stops = F.array_position(F.transform(items, lambda x: F.coalesce(ends_section(x), F.lit(False))), True)
    kept = F.when(stops > 0, F.slice(items, 1, (stops - 1).cast("int"))).otherwise(items)
    return without_containers(F.filter(kept, lambda x: ~F.coalesce(is_noise(x), F.lit(False))))


def quality_conflict(title: Column, items: Column) -> Column:
    """Whether a list of requirements can't be trusted: empty, a quarter noise (two lines at least), or without any hard
    skill under a technical title."""
    full = F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    bad = F.size(F.filter(full, is_noise))
    bare = norm_plain(F.coalesce(title, F.lit(""))).rlike(v.TECHNICAL_TITLE) & ~F.exists(full, lambda x: norm_plain(x).rlike(v.HARD_SKILL))
    return (F.size(full) == 0) | ((bad >= 2) & (bad * 4 >= F.size(full))) | bare


def best_list(title: Column, section: Column, structured: Column, bullets: Column) -> Column:
    """struct<items, method> from a section's lines, a structured list and loose bullets: the section ('section') unless
    it has fewer than three lines; then the structured list ('json_ld') or the bullets ('technical_bullets'), if three
    or more, the bullets also without conflict; else what the section has. Nulls count as empty."""
    none = F.array().cast("array<string>")
    s, b = clean_items(F.coalesce(section, none)), clean_items(F.coalesce(bullets, none))
    j = F.filter(F.transform(F.coalesce(structured, none), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    pick = lambda items, method: F.struct(items.alias("items"), F.lit(method).alias("method"))
    few = F.size(s) < 3
    return (
        F.when(few & (F.size(j) >= 3), pick(clean_items(j), "json_ld")).when(few & (F.size(b) >= 3) & ~quality_conflict(title, b), pick(b, "technical_bullets")).otherwise(pick(s, "section"))
    )
