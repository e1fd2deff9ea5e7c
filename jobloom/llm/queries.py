"""Queries of the training-data operators: name -> (session, folder) -> rows, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.urls import TRACKING, page_key
from jobloom.llm import canonical, mixing, names, openings, order_minhash, packing, plain_form, segment_index, subjects, survivor, tokens
from jobloom.session import stage_root, staged, table


# Word-level share of an opening's text that its edited copies keep; texts of different openings keep less than half.
SAME_OPENING = 0.65
JOBS_BEFORE = 1 << 40


def _firms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Spellings with their firm, and the target names among them."""
    target = table(spark, d, "target_companies").select("name", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    stored = table(spark, d, "companies").select("name").union(target.select("alias"))
    nick = target.where("name <> alias").select(F.col("name").alias("name_a"), F.col("alias").alias("name_b"))
    known = names.firms(stored, table(spark, d, "candidates").select(F.col("company").alias("name")), nick)
    return known, target.select(F.col("alias").alias("name")).distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    known, target = _firms(spark, d)
    pairs = names.same_firm_pairs(known)
    for n in ("name_1", "name_2"):
        pairs = pairs.join(F.broadcast(target.select(F.col("name").alias(n), F.lit(True).alias("t" + n))), n, "left")  # a fixed list of 40 firms
    return pairs.where("tname_1 IS NULL OR tname_2 IS NULL").select("name_1", "name_2")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a spelling that belongs to a firm: the firm's smallest spelling, whether it is stored and how many other
    spellings the firm has."""
    known, _ = _firms(spark, d)
    x = staged(known.select("name", "stored", "firm").distinct(), "firm-names")
    n = x.groupBy("firm").agg(F.min("name").alias("class_name"), (F.count("*") - 1).alias("links"))
    return x.join(n, "firm").select("name", "stored", "class_name", "links")


def _company_firms(spark: SparkSession, d: str, companies: DataFrame) -> DataFrame:
    """(company, firm) of companies (company); no name or a placeholder is no firm, a name that is no known firm's is
    its own firm."""
    other = names.read_names(companies, "company").select(F.col("name").alias("company"), F.xxhash64("own", "biz").alias("other"))
    known, _ = _firms(spark, d)
    firm = other.join(known.select(F.col("name").alias("company"), "firm").distinct(), "company", "left")
    return staged(firm.select("company", F.coalesce("firm", "other").alias("firm")), "company-firms")


def _postings(spark: SparkSession, d: str) -> DataFrame:
    """Jobs and candidates in order of arrival (jobs first, ord below 0): ord, key, batch (0 for
    the catalog), described (has a description), firm, role, level, team, city.

    Each step is written before the next, so that no plan holds them all."""
    j = table(spark, d, "jobs")
    at = F.coalesce("location", F.get_json_object("payload", "$.location"))
    said = F.coalesce(F.trim(F.get_json_object("payload", "$.description")), F.lit("")) != ""
    j = j.select((F.col("id") - JOBS_BEFORE).alias("ord"), "key", "company", F.col("role").alias("title"), at.alias("location"), F.lit(0).alias("batch"), said.alias("described"))
    c = table(spark, d, "candidates").select(F.col("inbox_id").alias("ord"), F.col("candidate_key").alias("key"), "company", "title", "location", F.coalesce("batch_no", F.lit(0)).alias("batch"), (~_bare()).alias("described"))
    x = staged(j.union(c), "postings-raw")
    firm = _company_firms(spark, d, x.select("company"))
    parsed = staged(openings.with_opening(x, "title", "location"), "postings-parsed")
    return parsed.join(firm, "company", "left").drop("company")


def _arrivals(spark: SparkSession, d: str, at_once: int) -> tuple[DataFrame, DataFrame]:
    """(rows for the segment index: ord, key, text, block, scopes, described, with prior_key; descriptions: id, text),
    both with load: 0 for the catalog, then one for each `at_once` batches."""

    def load(batch: str) -> Column:
        return F.when(F.col(batch) > 0, F.floor((F.col(batch) - 1) / at_once) + 1).otherwise(0).cast("int").alias("load")

    x = _postings(spark, d)
    text = openings.interleaved(F.col("role"), F.col("team"))
    whole = F.col("firm").isNotNull() & (F.col("city") != "")
    scopes = F.array(F.when(F.col("city") != "", F.xxhash64(F.lit("city"), "city", "level")), F.when(F.col("firm").isNotNull(), F.xxhash64(F.lit("firm"), "firm", "level")))
    key = F.when(F.col("ord") > 0, F.col("key"))  # keys of the catalog are addresses
    x = x.select("ord", key.alias("key"), F.col("key").alias("prior_key"), text.alias("text"), F.when(whole, F.xxhash64("firm", "level", "city")).alias("block"), scopes.alias("scopes"), "described", load("batch"))
    j = table(spark, d, "jobs").select((F.col("id") - JOBS_BEFORE).alias("id"), F.get_json_object("payload", "$.description").alias("text"))
    c = table(spark, d, "candidates").select(F.col("inbox_id").alias("id"), F.col("description").alias("text"), load("batch_no"))
    return staged(x, "arrivals"), j.withColumn("load", F.lit(0)).union(c).where("text IS NOT NULL")


def _first_postings(spark: SparkSession, d: str, at_once: int) -> DataFrame:
    """(inbox_id, prior_key): candidates that repeat an opening, going through the catalog and then `at_once` batches at
    a time by a new index in the shared folder. How many batches go at once doesn't change the rows."""
    x, texts = _arrivals(spark, d, at_once)
    index = segment_index.SegmentIndex(spark, f"{stage_root(spark)}/segment-index-{uuid.uuid4().hex}", least=SAME_OPENING)
    for r in x.select("load").distinct().orderBy("load").collect():  # one number a load
        index.add(x.where(F.col("load") == r.load), texts.where(F.col("load") == r.load))
    found = index.result().where("label < ord AND ord > 0")
    prior = x.select(F.col("ord").alias("label"), "prior_key")
    return found.join(prior, "label").select(F.col("ord").alias("inbox_id"), "prior_key")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _first_postings(spark, d, 24)


def p2_in_loads(spark: SparkSession, d: str) -> DataFrame:
    """p2_found with six batches a load; the same rows."""
    return _first_postings(spark, d, 6)


KINDS = {"job": 0, "candidate": 1, "requirement": 2}
HEADS = 3
# (least similarity, band) of jobs, candidates, requirements and titles of candidates without a description
RULES = [(SAME_OPENING, 32), (SAME_OPENING, 32), (0.8, 16), (0.9, 8)]


def _coded(id_column: str, kind: int) -> Column:
    """Ids of several kinds in one column, so that all kinds share each step."""
    return (F.col(id_column) * len(RULES) + kind).alias("id")


def _bare() -> Column:
    """Whether a candidate has no description."""
    return (F.coalesce(F.trim("description"), F.lit("")) == "").alias("bare")


def _heads(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by what is known without their description: id, bare (no description), text (role and team) and scope
    (firm, level and city); those without firm or city are left out. Titles are read before any join, so only what is
    needed of them moves."""
    c = table(spark, d, "candidates")
    head = openings.with_opening(c.where("company IS NOT NULL").select("inbox_id", "company", _bare(), "title", "location"), "title", "location")
    # no filter on what is read out of a title: it would be read twice
    place = F.when((F.col("city") != "") & F.col("role").isNotNull(), F.xxhash64("level", "city"))
    head = head.select(_coded("inbox_id", HEADS), "company", "bare", F.concat_ws(" ", "role", "team").alias("text"), place.alias("place"))
    head = head.join(_company_firms(spark, d, c.select("company")), "company")
    scope = F.when(F.col("place").isNotNull() & F.col("firm").isNotNull(), F.xxhash64("firm", "place"))
    return staged(head.select("id", "bare", "text", scope.alias("scope")), "candidate-heads").where("scope IS NOT NULL")


def _classes(spark: SparkSession, d: str) -> DataFrame:
    """(record_kind, id, class) of records that say the same, by their descriptions or sentences; a candidate without a
    description is known by its title, level, city and firm, or by its candidate_key."""
    j = table(spark, d, "jobs").select(_coded("id", 0), F.get_json_object("payload", "$.description").alias("text"), F.lit(0).cast("long").alias("scope"))
    c = table(spark, d, "candidates").select(_coded("inbox_id", 1), F.col("description").alias("text"), F.lit(1).cast("long").alias("scope"))
    r = table(spark, d, "job_requirements").select(_coded("requirement_id", 2), F.col("requirement").alias("text"), F.xxhash64("job_key").alias("scope"))
    head = _heads(spark, d).where("text IS NOT NULL")
    # equal titles of a scope are one node, and only scopes with a candidate to be found by its title are looked at
    head = head.join(head.where("bare").select("scope").distinct(), "scope", "left_semi").select("id", "bare", "text", "scope").repartition("scope", "text")
    same = head.groupBy("scope", "text").agg(F.min("id").alias("first"), F.bool_or("bare").alias("bare"))
    head = staged(head.select("id", "scope", "text", F.col("bare").alias("own")).join(same, ["scope", "text"]), "candidate-titles")
    copies = head.where("bare AND id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    near = head.where("id = first").select("id", "text", "scope")
    om = order_minhash
    in_jobs, r = om.linked_in_scopes(r, "letters", RULES)
    sketches = om.sketched(j.union(c), "words", 5, 3, 32).union(om.sketched(r, "letters", 4, 2, 12)).union(om.sketched(near, "letters", 5, 2, 12))
    links = staged(om.linked(staged(sketches, "sketches"), "records", RULES).union(in_jobs), "record-links")
    # titles must be alike by edits too
    is_head = F.col("a") % len(RULES) == HEADS
    t = near.select("id", "text")
    heads = links.where(is_head).join(t.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(t.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    heads = heads.where(segment_index.alike(F.col("x"), F.col("y"), 3)).select("a", "b").union(copies).select((F.col("a") - HEADS + 1).alias("a"), (F.col("b") - HEADS + 1).alias("b"))
    # keys by 128 bits of them; the lowest bit of code says that a description is there. Shuffled once
    k = table(spark, d, "candidates").where("candidate_key IS NOT NULL").select(_coded("inbox_id", 1), F.xxhash64("candidate_key").alias("k1"), F.xxhash64(F.lit("-"), "candidate_key").alias("k2"), _bare())
    k = k.select("k1", "k2", (F.shiftleft("id", 1) + F.when(F.col("bare"), 0).otherwise(1)).alias("code")).where("code IS NOT NULL").repartition("k1", "k2")
    first = k.groupBy("k1", "k2").agg(F.shiftright(F.min("code"), 1).alias("a"), F.bool_or(F.col("code") % 2 == 0).alias("bare")).where("bare").select("k1", "k2", "a")
    keys = k.join(first, ["k1", "k2"]).select("a", F.shiftright("code", 1).alias("b")).where("a < b")
    x = om.classes(links.where(~is_head).union(heads).union(keys))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("id") % len(RULES)).cast("int") + 1)
    return x.select(kind.alias("record_kind"), F.expr(f"id div {len(RULES)}").alias("id"), F.expr(f"class div {len(RULES)}").alias("class"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    x = _classes(spark, d)
    a, b = x.withColumnRenamed("id", "id_1"), x.withColumnRenamed("id", "id_2")
    return a.join(b, ["record_kind", "class"]).where("id_1 < id_2").select("record_kind", "id_1", "id_2")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a record that says the same as another: its class (smallest id) and how many others the class holds."""
    x = staged(_classes(spark, d), "record-classes")
    n = x.groupBy("record_kind", "class").agg((F.count("*") - 1).alias("links"))
    return x.join(n, ["record_kind", "class"]).select("record_kind", "id", F.col("class").alias("class_id"), "links")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "job_requirements").select("requirement_id", "category", "skill", "subskill", "requirement")
    return canonical.mapped(spark, r, table(spark, d, "skill_catalog"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    c = plain_form.changed_values(table(spark, d, "candidates"), "inbox_id", ["title", "location"])
    r = plain_form.changed_values(table(spark, d, "job_requirements"), "requirement_id", ["requirement"]).distinct()
    return c.unionByName(r)


def p6_plain_titles(spark: SparkSession, d: str) -> DataFrame:
    x = plain_form.plain_columns(table(spark, d, "candidates").select("inbox_id", "title", "location"), ["title", "location"])
    return x.select("inbox_id", "title_plain", "title_changed", "location_plain", "location_changed")


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "job_sources").withColumn("page", page_key(F.col("url")))
    # at most one row a provider: the registry is a list of providers
    r = table(spark, d, "source_registry").groupBy(F.lower(F.trim("provider")).alias("_p")).agg(F.min("priority").alias("_priority"))
    s = s.join(r, F.lower(F.trim(F.col("provider"))) == F.col("_p"), "left").drop("_p")
    filled = sum(
        (F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), 1).otherwise(0) for c in ("name", "official", "posted_on", "http_status")),
        F.lit(0),
    )
    return s, s.withColumn("_filled", filled)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    _, s = _sources(spark, d)
    x = survivor.leaders(s, ["job_key", "page"], "source_id", F.col("_priority"), F.col("last_verified_at"), F.col("_filled"))
    return x.where("dominant AND group_rows > 1").select("group_id", "source_id")


def p4_survivor(spark: SparkSession, d: str) -> DataFrame:
    _, s = _sources(spark, d)
    x = survivor.leaders(s, ["job_key", "page"], "source_id", F.col("_priority"), F.col("last_verified_at"), F.col("_filled"))
    return x.select("job_key", "page", "group_id", F.col("group_rows").cast("long").alias("group_rows"), "source_id", "dominant")


def p4_merged(spark: SparkSession, d: str) -> DataFrame:
    s, _ = _sources(spark, d)
    fields = ["url", "provider", "name", "official", "posted_on", "http_status", "last_verified_at"]
    return survivor.merged(s, ["job_key", "page"], "source_id", F.col("_priority"), F.col("last_verified_at"), fields)


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return staged(tokens.with_tokens(table(spark, d, "documents").select("doc_id", "source", "text"), "text"), "sized")


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, _sized(spark, d))


def _packed(spark: SparkSession, d: str, sized: DataFrame) -> DataFrame:
    parts = []
    for r in table(spark, d, "pack_sizes").orderBy("capacity_tokens").collect():  # a fixed list of three
        x = packing.packed(sized, "doc_id", "n_tokens", r.capacity_tokens)
        parts.append(x.select(F.lit(r.size_name).alias("size_name"), "container_id", "place", "doc_id", "piece", "start", "length"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "pack_sizes").withColumnRenamed("capacity_tokens", "capacity")
    x = p7_pack(spark, d).groupBy("size_name").agg((F.max("container_id") + 1).alias("containers"), F.count("*").alias("pieces"), F.sum("length").alias("tokens"))
    x = x.join(F.broadcast(sizes), "size_name")
    return x.select("size_name", "capacity", "containers", "pieces", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("used"))


def _budget(sized: DataFrame, targets: DataFrame) -> float:
    """Half of the tokens that sources with a target hold: more than exact shares can give, so repetition limits keep
    the exponent below 1."""
    return sized.join(F.broadcast(targets.select("source").distinct()), "source").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0] / 2


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized, targets = _sized(spark, d), table(spark, d, "mix_targets")
    return mixing.mix(sized, targets, "doc_id", budget=_budget(sized, targets))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_shares_exact(spark: SparkSession, d: str) -> DataFrame:
    """The largest mix that gives every target exactly."""
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"), "doc_id")[1]


def p8_shares_entropy(spark: SparkSession, d: str) -> DataFrame:
    """The mix whose entropy is half way between that of the natural mixture and that of the targets."""
    sized, targets = _sized(spark, d), table(spark, d, "mix_targets")
    natural, target, _ = mixing.natural_and_target(sized, targets)
    wished = sum(mixing.entropy(mixing.weights(natural, target, x)) for x in (0.0, 1.0)) / 2
    return mixing.mix(sized, targets, "doc_id", wished_entropy=wished)[1]


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What every mix must keep, by target: its documents, and whether limits and weights are kept and nothing is left
    that an unused document would fit into."""
    docs, shares = _mixed(spark, d)
    docs, shares = staged(docs, "mix"), staged(shares, "shares")
    x = docs.join(F.broadcast(shares.select("source", "max_repeats", "unfilled")), "source")  # the fixed list of targets
    few = x.groupBy("source").agg(F.min("times").alias("few"))
    fits = (F.col("times") == F.col("few")) & (F.col("few") < F.col("max_repeats")) & (F.col("n_tokens") > 0) & (F.col("n_tokens") <= F.col("unfilled"))
    x = x.join(F.broadcast(few), "source").groupBy("source").agg(F.count("*").alias("documents"), (F.max("times") <= F.max("max_repeats")).alias("limit_kept"), (~F.bool_or(fits)).alias("filled"))
    w = shares.select("source", (F.col("used") <= F.col("wanted")).alias("weight_kept"), ((F.col("exponent") > 0) & (F.col("exponent") < 1)).alias("bisected"))
    x = w.join(x, "source", "left")
    return x.select("source", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("limit_kept", F.lit(True)).alias("limit_kept"), "weight_kept", F.coalesce("filled", F.lit(True)).alias("filled"), "bisected")


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What every packing must keep, by capacity: how many documents have a place, and how many containers are too full
    or have holes, and documents cut although they'd fit or not wholly there."""
    sized = _sized(spark, d)
    x = staged(_packed(spark, d, sized), "packed").join(F.broadcast(table(spark, d, "pack_sizes")), "size_name")  # a fixed list of three
    c = x.groupBy("size_name", "container_id").agg(F.sum("length").alias("n"), F.first("capacity_tokens").alias("room"), F.count("*").alias("k"), F.max("place").alias("last"), F.countDistinct("place").alias("places"))
    c = c.groupBy("size_name").agg(F.count_if(F.expr("n > room")).alias("overfull"), F.count_if(F.expr("places <> k OR last <> k - 1")).alias("holes"))
    p = x.groupBy("size_name", "doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.first("capacity_tokens").alias("room"), F.sum(F.col("start") + F.col("length")).alias("ends"), F.sum("start").alias("starts"))
    p = p.join(sized.select("doc_id", "n_tokens"), "doc_id")
    wrong = (F.col("n") != F.col("n_tokens")) | (F.col("ends") - F.col("starts") != F.col("n_tokens")) | (F.col("k") != F.ceil(F.col("n_tokens") / F.col("room")))
    p = p.groupBy("size_name").agg(F.count("*").alias("documents"), F.count_if(wrong).alias("wrongly_cut"))
    return p.join(c, "size_name").select("size_name", "documents", "overfull", "holes", "wrongly_cut")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "doc_labels").select("doc_id", "subject_id")
    found, _ = subjects.subjects(table(spark, d, "documents").select("doc_id", "text"), labels)
    return found.join(labels.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "subject_id")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and mean share of text by subject, over the whole corpus."""
    found, figures = subjects.subjects(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "doc_labels").select("doc_id", "subject_id"))
    x = found.groupBy("subject_id").agg(F.count("*").alias("documents"), F.avg("share").alias("mean_share"))
    names = table(spark, d, "subjects").select("subject_id", "subject")
    x = F.broadcast(names).join(x, "subject_id", "left")
    return x.select("subject_id", "subject", F.coalesce("documents", F.lit(0)).alias("documents"), "mean_share", F.lit(figures["f1"]).alias("held_out_f1"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_in_loads": p2_in_loads,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p4_found": p4_found,
    "p4_survivor": p4_survivor,
    "p4_merged": p4_merged,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_plain_titles": p6_plain_titles,
    "p7_pack": p7_pack,
    "p7_fill": p7_fill,
    "p7_checks": p7_checks,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_shares_exact": p8_shares_exact,
    "p8_shares_entropy": p8_shares_entropy,
    "p8_checks": p8_checks,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}

_PAGE = f"""
  lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h0,
  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[^/]*//[^/?#]*', '') AS rest"""

_SOURCES_SQL = f"""
  a AS (SELECT DISTINCT * FROM job_sources),
  b AS (SELECT *, {_PAGE} FROM a),
  c AS (SELECT *, nullif(regexp_replace(h0, '^www\\.', ''), '')
      || regexp_replace(url_decode(replace(regexp_extract(rest, '^([^?]*)', 1), '+', '%2B')), '/+$', '') AS hp,
      array_to_string(list_transform(list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'),
        lambda p: p <> '' AND lower(regexp_extract(p, '^([^=]*)', 1)) NOT IN ({", ".join(f"'{t}'" for t in TRACKING)}))),
        lambda p: url_decode(replace(p, '+', '%2B'))), '&') AS tail FROM b),
  s AS (SELECT c.*, hp || CASE WHEN tail = '' THEN '' ELSE '?' || tail END AS page,
      coalesce(r.priority, 1000000) AS trust, coalesce(last_verified_at::timestamp, TIMESTAMP '0001-01-01') AS seen,
      (nullif(trim(c.name), '') IS NOT NULL)::int + (official IS NOT NULL)::int + (posted_on IS NOT NULL)::int
        + (http_status IS NOT NULL)::int AS filled
    FROM c LEFT JOIN (SELECT lower(trim(provider)) AS p, min(priority) AS priority FROM source_registry GROUP BY 1) r
      ON lower(trim(c.provider)) = r.p)"""

SQL: dict[str, str] = {
    "p4_found": f"""WITH {_SOURCES_SQL},
  g AS (SELECT job_key, page, min(source_id) AS group_id, count(*) AS n, min(trust) AS bt, max(seen) AS bs, max(filled) AS bf
    FROM s WHERE job_key IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
SELECT group_id, min(source_id) AS source_id FROM g JOIN s USING (job_key, page)
WHERE trust = bt AND seen = bs AND filled = bf GROUP BY group_id HAVING count(*) = 1""",
    "p4_survivor": f"""WITH {_SOURCES_SQL},
  q AS (SELECT job_key, page, min(source_id) OVER w AS group_id, count(*) OVER w AS group_rows, source_id,
      trust, seen, filled, min(trust) OVER w AS bt, max(seen) OVER w AS bs, max(filled) OVER w AS bf,
      count(*) OVER (PARTITION BY job_key, page, trust, seen, filled) AS same,
      row_number() OVER (PARTITION BY job_key, page ORDER BY trust, seen DESC, filled DESC, source_id) AS r
    FROM s WHERE job_key IS NOT NULL AND page IS NOT NULL WINDOW w AS (PARTITION BY job_key, page))
SELECT job_key, page, group_id, group_rows, source_id, trust = bt AND seen = bs AND filled = bf AND same = 1 AS dominant
FROM q WHERE r = 1""",
    "p4_merged": f"""WITH {_SOURCES_SQL},
  r AS (SELECT *, {{'t': -trust, 's': seen, 'i': -source_id}} AS k FROM s WHERE job_key IS NOT NULL AND page IS NOT NULL)
SELECT job_key, page, min(source_id) AS group_id, count(DISTINCT source_id) AS group_rows,
  {", ".join(f"arg_max({c}, k) FILTER ({c} IS NOT NULL{filled}) AS {c}" for c, filled in (("url", " AND trim(url) <> ''"), ("provider", " AND trim(provider) <> ''"), ("name", " AND trim(name) <> ''"), ("official", ""), ("posted_on", ""), ("http_status", "")))},
  arg_max(last_verified_at, k) FILTER (last_verified_at IS NOT NULL) AS last_verified_at
FROM r GROUP BY 1, 2""",
    "p5_found": canonical.plain_sql(),
    "p7_checks": """SELECT size_name, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0::bigint AS overfull, 0::bigint AS holes, 0::bigint AS wrongly_cut FROM pack_sizes""",
    "p8_checks": """SELECT t.source, count(d.doc_id) AS documents, true AS limit_kept, true AS weight_kept, true AS filled, true AS bisected
FROM mix_targets t LEFT JOIN documents d ON d.source = t.source WHERE target_share > 0 GROUP BY 1""",
}
