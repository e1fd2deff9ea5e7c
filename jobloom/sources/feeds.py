"""Landed feeds of applicant-tracking systems, search results and script literals, as one posting schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.markup import unescaped

POSTING = "url string, title string, company string, description string, location string, posted_on string, valid_through string, remote boolean"

GREENHOUSE = "jobs array<struct<absolute_url: string, title: string, content: string, location: struct<name: string>, first_published: string, updated_at: string, application_deadline: string>>"
LEVER = "array<struct<hostedUrl: string, text: string, description: string, descriptionPlain: string, additional: string, workplaceType: string, categories: struct<location: string>, lists: array<struct<text: string, content: string>>>>"
ASHBY = "jobs array<struct<jobUrl: string, title: string, descriptionHtml: string, descriptionPlain: string, location: string, isRemote: boolean, publishedAt: string>>"


def greenhouse(feeds: DataFrame, company: str = "company", body: str = "body") -> DataFrame:
    """feeds (company, body: one JSON text each) as postings; entries without an address are dropped, unreadable
    bodies give none."""
    x = feeds.select(F.col(company).alias("company"), F.explode(F.from_json(body, GREENHOUSE)["jobs"]).alias("j"))
    return x.select(
        F.col("j.absolute_url").alias("url"), "j.title", "company", unescaped(F.col("j.content")).alias("description"), F.col("j.location.name").alias("location"),
        F.coalesce("j.first_published", "j.updated_at").alias("posted_on"), F.col("j.application_deadline").alias("valid_through"), F.lit(None).cast("boolean").alias("remote"),
    ).where("url <> ''")


def _escaped(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def lever(feeds: DataFrame, company: str = "company", body: str = "body") -> DataFrame:
    x = feeds.select(F.col(company).alias("company"), F.explode(F.from_json(body, LEVER)).alias("j"))
    lists = F.transform("j.lists", lambda s: F.concat(F.lit("<h2>"), _escaped(F.coalesce(s["text"], F.lit(""))), F.lit("</h2>"), F.coalesce(s["content"], F.lit(""))))
    text = F.concat_ws("", F.coalesce(first_filled("j.description"), F.col("j.descriptionPlain")), F.array_join(lists, ""), "j.additional")
    none = F.lit(None).cast("string")
    return x.select(
        F.col("j.hostedUrl").alias("url"), F.col("j.text").alias("title"), "company", text.alias("description"), F.col("j.categories.location").alias("location"),
        none.alias("posted_on"), none.alias("valid_through"), (F.lower("j.workplaceType") == "remote").alias("remote"),
    ).where("url <> ''")


def ashby(feeds: DataFrame, company: str = "company", body: str = "body") -> DataFrame:
    x = feeds.select(F.col(company).alias("company"), F.explode(F.from_json(body, ASHBY)["jobs"]).alias("j"))
    return x.select(
        F.col("j.jobUrl").alias("url"), "j.title", "company", first_filled("j.descriptionHtml", "j.descriptionPlain").alias("description"), "j.location",
        F.col("j.publishedAt").alias("posted_on"), F.lit(None).cast("string").alias("valid_through"), F.col("j.isRemote").alias("remote"),
    ).where("url <> ''")


ADAPTERS = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby}


def postings(feeds: DataFrame) -> DataFrame:
    """feeds (provider, company, body) of all known providers as one table; one bad body doesn't stop the others."""
    parts = [f(feeds.where(F.col("provider") == p)).withColumn("provider", F.lit(p)) for p, f in ADAPTERS.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def feed_report(feeds: DataFrame) -> DataFrame:
    """(provider, company, state, postings) of feeds (provider, company, body): a body that can't be read is an error of
    its board alone ('unreadable'), one without postings is 'empty', a provider nobody reads is 'unknown'."""
    kinds = {"greenhouse": GREENHOUSE, "lever": LEVER, "ashby": ASHBY}
    n = F.lit(None).cast("int")
    for p, kind in kinds.items():
        rows = F.from_json("body", kind) if kind.startswith("array") else F.from_json("body", kind)["jobs"]
        n = F.when(F.col("provider") == p, F.when(rows.isNotNull(), F.size(rows))).otherwise(n)
    state = F.when(~F.col("provider").isin(*kinds), "unknown").when(n.isNull(), "unreadable").when(n == 0, "empty").otherwise("read")
    return feeds.select("provider", "company", state.alias("state"), F.coalesce(n, F.lit(0)).alias("postings"))


CANDIDATE = ["provider", "external_id", "source_url", "apply_url", "title", "company", "location", "description", "published_at", "source_updated_at", "raw"]
# Where aggregators keep what: field: the places it may be in, the first that is filled counts.
AGGREGATORS = {
    "api_br": {"list": ("$", "$.data", "$.results", "$.items", "$.issues"), "external_id": ("id", "number", "issueId", "node_id", "html_url", "url", "issueUrl", "sourceUrl"), "source_url": ("html_url", "url", "issueUrl", "sourceUrl"),
               "apply_url": ("applyUrl", "apply_url"), "title": ("title", "name"), "company": ("company.name", "company.display_name", "company"), "location": ("location", "local"), "description": ("body", "description"),
               "published_at": ("created_at", "createdAt", "published_at"), "source_updated_at": ("updated_at", "updatedAt")},
    "adzuna": {"list": ("$.results",), "external_id": ("id", "redirect_url"), "source_url": ("redirect_url", "url"), "apply_url": (), "title": ("title",), "company": ("company.name", "company.display_name", "company"),
               "location": ("location.name", "location.display_name", "location"), "description": ("description",), "published_at": ("created",), "source_updated_at": ()},
    "jooble": {"list": ("$.jobs",), "external_id": ("id", "link"), "source_url": ("link", "url"), "apply_url": (), "title": ("title",), "company": ("company",), "location": ("location",),
               "description": ("snippet", "description"), "published_at": ("updated",), "source_updated_at": ()},
}


def aggregator(pages: DataFrame, provider: str) -> DataFrame:
    """Landed pages (body) of an aggregator as candidates (CANDIDATE), each (provider, external id) once; entries without
    title and address are dropped, an unreadable page gives none."""
    a = AGGREGATORS[provider]
    lists = [F.when(F.startswith(F.ltrim("body"), F.lit("[")), F.col("body")) if p == "$" else F.get_json_object("body", p) for p in a["list"]]
    x = pages.select(F.explode(F.from_json(F.coalesce(*lists), "array<string>")).alias("raw"))

    def field(name: str) -> Column:
        got = [F.get_json_object("raw", f"$.{p}") for p in a[name]]
        # an object is no value of its own; its name is
        got = [F.nullif(F.nullif(F.trim(F.when(~g.rlike(r"^[\[{]"), g)), F.lit("")), F.lit("null")) for g in got]
        return F.coalesce(*got) if got else F.lit(None).cast("string")

    x = x.select(F.lit(provider).alias("provider"), *[field(n).alias(n) for n in CANDIDATE[1:-1]], "raw").where("source_url IS NOT NULL OR title IS NOT NULL")
    return x.groupBy("provider", "external_id").agg(F.min_by(F.struct(*CANDIDATE[2:]), "raw").alias("r")).select("provider", "external_id", "r.*")


def paged_search(pages: DataFrame, base: str) -> DataFrame:
    """(query, urls, complete) of landed pages (query, body) of a paged search {total, jobPostings: [{externalPath}]}:
    distinct addresses of postings, and whether all the total promised was read."""
    p = F.from_json("body", "total int, jobPostings array<struct<externalPath: string>>")
    x = pages.select("query", p.alias("p")).select("query", F.col("p.total").alias("total"), F.coalesce("p.jobPostings", F.array().cast("array<struct<externalPath: string>>")).alias("rows"))
    paths = F.array_distinct(F.flatten(F.collect_list(F.transform("rows", lambda r: r["externalPath"]))))  # pages of one search
    g = x.groupBy("query").agg(paths.alias("paths"), F.sum(F.size("rows")).alias("seen"), F.max("total").alias("total"))
    urls = F.transform(F.filter("paths", lambda u: u.rlike(r"^/job/[^?#]+$")), lambda u: F.concat(F.lit(base), u))
    return g.select("query", F.array_sort(urls).alias("urls"), F.coalesce(F.col("seen") >= F.col("total"), F.lit(False)).alias("complete"))


def domain_map(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(key, value) of an object literal in JSON assigned to a name in script files (`name = {...};`)."""
    x = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", rf"(?s)\b{re.escape(name)}\s*=\s*(\{{.*?\}})\s*;", 1)
    return x.select(F.explode(F.from_json(F.nullif(body, F.lit("")), "map<string,string>")))


def write_script(rows: DataFrame, path: str, name: str = "jobs") -> None:
    """Rows as one script file that script_literals reads back, by id. For catalogs of a size a page can load."""
    line = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j"), "id").agg(F.array_sort(F.collect_list(F.struct("id", "j"))).alias("a"))
    text = F.concat(F.lit(f"{name}.push(...["), F.array_join(F.transform("a", lambda x: x["j"]), ",\n"), F.lit("]);"))
    line.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_catalog(jobs: DataFrame, meta: DataFrame, path: str) -> None:
    """A catalog as JSON lines of jobs beside one line of meta."""
    jobs.write.mode("overwrite").json(f"{path}/jobs", ignoreNullFields=False)
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta", ignoreNullFields=False)


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Jobs of a catalog: one written by write_catalog, or one JSON file {meta, jobs: [...]}."""
    if path.endswith(".json"):
        return spark.read.schema(f"jobs array<struct<{schema}>>").option("multiLine", True).json(path).select(F.inline("jobs"))
    return spark.read.schema(schema).json(f"{path}/jobs")


def by_key(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(key, and the fields of kind) of a JSON file that is one object of records by key."""
    x = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, struct<{kind}>>")).alias("key", "r"))
    return x.select("key", "r.*")


def script_literals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of script files that push an array literal in JSON (`name.push(...[...]);`); other files give none."""
    x = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", r"(?s)\.push\(\.\.\.(\[.*\])\);", 1)
    return x.select(F.inline(F.from_json(F.nullif(body, F.lit("")), f"array<struct<{schema}>>")))


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(url, last_modified) of sitemap files."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path).select(F.trim("loc").alias("url"), F.col("lastmod").alias("last_modified"))


def nested_sitemap(spark: SparkSession, path: str, most: int = 60, children: int = 4) -> DataFrame:
    """(url, place) of landed sitemap files: of an index (<sitemap>) only the last `children` entries are followed, by
    file name beside it; of each file the last `most` addresses of jobs (/job/ or /vaga(s)/), in order."""
    x = spark.read.text(f"{path}/*.xml", wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"), F.transform(F.regexp_extract_all("value", F.lit(r"<(?:\w+:)?loc>\s*([^<]*?)\s*</"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))).alias("locs"), F.contains("value", F.lit("<sitemapindex")).alias("index"))
    last = F.slice(F.col("locs"), F.greatest(F.lit(1), F.size("locs") - children + 1), children)
    followed = x.where("index").select(F.explode(F.transform(last, lambda u: F.regexp_extract(u, "([^/]+)$", 1))).alias("file")).distinct()
    leaves = x.where("NOT index")
    known = followed.join(x.select("file"), "file", "left_semi")
    leaves = leaves.join(known, "file", "left_semi") if not known.isEmpty() else leaves
    jobs = F.filter("locs", lambda u: F.lower(u).rlike("/(?:job|vagas?)/"))
    return leaves.select("file", jobs.alias("j")).select("file", F.posexplode(F.slice("j", F.greatest(F.lit(1), F.size("j") - most + 1), most)).alias("place", "url")).select("url", "place", "file")


def first_filled(*columns: str) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.col(c)) for c in columns])
