"""Addresses: one key for each page, host, provider."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that follow a visitor and don't choose the page.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "msclkid",
            "ref", "src", "origem", "sessao", "trk", "trackingid", "refid", "jobboardsource")


def host(url: Column) -> Column:
    """Host in lower case without user, port and www; null without a host."""
    h = F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(h, r"^www\.", ""), F.lit(""))


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def page_key(url: Column) -> Column:
    """host/path?parameters of the page an address leads to: scheme, www, port, fragment, last slash, escapes and
    tracking parameters don't count, nor does the order of the others. Null or no host gives null."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[^/]*//[^/?#]*", "")
    path = F.regexp_replace(_decoded(F.regexp_extract(rest, r"^([^?]*)", 1)), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, r"^([^=]*)", 1)).isin(*TRACKING))
    )
    tail = F.array_join(F.transform(kept, _decoded), "&")
    return F.concat(host(url), path, F.when(tail == "", F.lit("")).otherwise(F.concat(F.lit("?"), tail)))


# Hosts of applicant-tracking systems and boards, by provider, and parameters that don't choose the page.
HOSTS = {
    "linkedin": r"(.+\.)?linkedin\.com", "greenhouse": r"(boards|job-boards)(\..+)?\.greenhouse\.io", "lever": r"(api|api\.eu|jobs|jobs\.eu)\.lever\.co",
    "ashby": r"(api|jobs)\.ashbyhq\.com", "gupy": r"(.+\.)?gupy\.io", "aggregator": r"remotar\.com\.br|querovagastech\.com\.br",
}
GOOGLE_JOBS = "/about/careers/applications/jobs/results/"
AUDIT_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "trk", "trackingid", "jobboardsource")


def _authority(url: Column) -> Column:
    """Host in lower case, www kept."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def provider(url: Column, company_hosts: list[str] | None = None) -> Column:
    """Provider of an address by its host; 'company' for the hosts given, 'unknown' for any other."""
    h = F.coalesce(host(url), F.lit(""))
    c = F.when(h.isin(*(company_hosts or [""])) & (h != ""), "company").when((h == "google.com") & F.startswith(_path(url), F.lit(GOOGLE_JOBS)), "company")
    for name, pattern in HOSTS.items():
        c = c.when(h.rlike(f"^(?:{pattern})$"), name)
    return c.otherwise("unknown")


def canonical_id(url: Column) -> Column:
    """The id of a posting: 'linkedin:id' or 'host:id' of boards that number their postings, else scheme://host/path with
    sorted parameters that choose the page. What is no address stays as it is, trimmed."""
    url = F.trim(url)
    h, path = _authority(url), _path(url)
    ids = F.regexp_extract_all(path, F.lit(r"(\d{7,})"), 1)
    job = F.regexp_extract(path, r"/jobs?/(\d+)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: p.contains("=") & ~p.endswith("=") & ~F.lower(F.regexp_extract(p, r"^([^=]*)", 1)).isin(*AUDIT_TRACKING)))
    tail = F.array_join(kept, "&")
    bare = F.regexp_replace(path, "/+$", "")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*?(:\d+)(?:[/?#]|$)", 1)
    plain = F.concat(scheme, F.lit("://"), h, port, bare, F.when(tail == "", F.lit("")).otherwise(F.concat(F.lit("?"), tail)))
    return (
        F.when(h == "", url).when(h.rlike(r"^(.+\.)?linkedin\.com$") & path.contains("/jobs/view/") & (F.size(ids) > 0), F.concat(F.lit("linkedin:"), F.element_at(ids, -1)))
        .when(h.endswith(".gupy.io") & (job != ""), F.concat(h, F.lit(":"), job))
        .when(h.isin("www.google.com", "google.com") & F.startswith(path, F.lit(GOOGLE_JOBS)), F.concat(F.lit("https://www.google.com"), bare)).otherwise(plain)
    )


def catalog_id(url: Column) -> Column:
    """As canonical_id for numbered boards, else host (no www), port and path in lower case."""
    url = F.trim(url)
    h, path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), _path(url)
    ids = F.regexp_extract_all(url, F.lit(r"(\d{7,})"), 1)
    job = F.regexp_extract(url, r"/jobs?/(\d+)", 1)
    return (
        F.when(url.contains("linkedin.com/jobs/view") & (F.size(ids) > 0), F.concat(F.lit("linkedin:"), F.element_at(ids, -1)))
        .when(url.contains(".gupy.io/") & (job != ""), F.concat(h, F.lit(":"), job)).otherwise(F.lower(F.concat(F.replace(h, F.lit("www."), F.lit("")), F.regexp_replace(path, "/+$", ""))))
    )


def retry_address(canonical: Column) -> Column:
    """The address behind a canonical id; null if there is none."""
    numbered = F.regexp_extract(canonical, r"^linkedin:(\d{7,})$", 1)
    board, job = F.regexp_extract(canonical, r"^([a-z0-9-]+\.gupy\.io):(\d+)$", 1), F.regexp_extract(canonical, r"^([a-z0-9-]+\.gupy\.io):(\d+)$", 2)
    return (
        F.when(numbered != "", F.concat(F.lit("https://www.linkedin.com/jobs/view/"), numbered)).when(board != "", F.concat(F.lit("https://"), board, F.lit("/jobs/"), job))
        .when(F.startswith(canonical, F.lit("https://")), canonical)
    )


def is_posting_page(url: Column, board_host: str, path: str = r"/jobs?/\d+/?") -> Column:
    """Whether an address is a posting of a board: https, exactly its host, a path of the form."""
    return F.startswith(url, F.lit("https://")) & (_authority(url) == board_host) & _path(url).rlike(f"^{path}$")
