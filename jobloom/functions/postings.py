"""Fields of a schema.org posting (a JSON text) as columns, and who the employer is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import norm_blank, norm_plain, norm_words
from jobloom.functions.urls import host

# Words of a firm's name that don't tell it from others, and boards whose addresses are no employer's.
NAME_WORDS = ("a", "as", "da", "das", "de", "do", "dos", "e", "for", "para", "the", "sa", "ltda", "inc")
BOARDS = r"linkedin\.com|gupy\.io"
PLACE = "array<struct<address: struct<addressLocality: string, addressRegion: string, addressCountry: string>>>"


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def title(posting: Column) -> Column:
    return _filled(F.get_json_object(posting, "$.title"))


def employer(posting: Column) -> Column:
    """Name of hiringOrganization, which may be an object, a list of them or a text; '' without one."""
    raw = F.get_json_object(posting, "$.hiringOrganization")
    first = F.get_json_object(posting, "$.hiringOrganization[0]")
    name = F.coalesce(_filled(F.get_json_object(posting, "$.hiringOrganization.name")), _filled(F.get_json_object(posting, "$.hiringOrganization[0].name")))
    text = F.when(~raw.rlike(r"^[\[{]"), _filled(raw)).when(raw.rlike(r"^\[") & ~first.rlike(r"^[\[{]"), _filled(first))
    return F.coalesce(name, text, F.lit(""))


def places(posting: Column) -> Column:
    """Locality, region and country of every jobLocation, joined by ', ', places by ' / '; null without any."""
    raw = F.get_json_object(posting, "$.jobLocation")
    many = F.from_json(F.when(raw.rlike(r"^\["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]"))), PLACE)
    part = lambda s: F.when(s != "", s)
    one = F.transform(many, lambda p: F.concat_ws(", ", part(p["address"]["addressLocality"]), part(p["address"]["addressRegion"]), part(p["address"]["addressCountry"])))
    return F.nullif(F.array_join(F.filter(one, lambda x: x != ""), " / "), F.lit(""))


def modality(posting: Column, text: Column) -> Column:
    """Remoto, Híbrido or Presencial: what the posting says of telecommuting first, then the text; null for none."""
    n = norm_plain(F.coalesce(text, F.lit("")))
    return (
        F.when(F.get_json_object(posting, "$.jobLocationType") == "TELECOMMUTE", "Remoto").when(n.rlike(r"\bhibrid[oa]\b"), "Híbrido").when(n.rlike(r"\bpresencial\b"), "Presencial")
        .when(n.rlike(r"(?:trabalho|modelo|work)\s+(?:100%\s+)?(?:remoto|remote)"), "Remoto")
    )


def domain(posting: Column) -> Column:
    """Host of the employer's own address, if that isn't a board's."""
    url = F.coalesce(_filled(F.get_json_object(posting, "$.hiringOrganization.sameAs")), _filled(F.get_json_object(posting, "$.hiringOrganization.url")))
    h = F.when(F.startswith(url, F.lit("http")), host(url))
    return F.when(~h.rlike(BOARDS), h)


def name_words(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm_words(name), " "), lambda w: (w != "") & ~w.isin(*NAME_WORDS)))


def same_employer(actual: Column, expected: Column) -> Column:
    """Whether a name is the expected one, or a longer (legal) name with all its words, two at least."""
    a, e = name_words(actual), name_words(expected)
    same = F.regexp_replace(norm_blank(actual), "[^a-z0-9]", "") == F.nullif(F.regexp_replace(norm_blank(expected), "[^a-z0-9]", ""), F.lit(""))
    return F.coalesce(same, F.lit(False)) | F.coalesce((F.size(e) >= 2) & (F.size(F.array_except(e, a)) == 0), F.lit(False))


def official_links(apply_url: Column, source_url: Column, description: Column, hosts: list[str], most: int = 4) -> Column:
    """Distinct https addresses on hosts of employers, the address to apply first, then the source, then links in the
    description, at most `most`. A host '.x' stands for all below x."""
    found = F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(r"(https://[^\s\"'<>)]+)"), 1)
    urls = F.transform(F.concat(F.array(apply_url, source_url), found), lambda u: F.regexp_replace(F.coalesce(u, F.lit("")), r"[.,;\]]+$", ""))
    exact, below = [h for h in hosts if not h.startswith(".")], [h for h in hosts if h.startswith(".")]
    name = lambda u: F.lower(F.regexp_extract(u, r"^https://(?:[^/?#@]*@)?([^/?#:]*)", 1))

    def trusted(u: Column) -> Column:
        ok = name(u).isin(*(exact or [""]))
        for b in below:
            ok = ok | F.endswith(name(u), F.lit(b))
        return ok & (name(u) != "")

    return F.slice(F.array_distinct(F.filter(urls, trusted)), 1, most)
