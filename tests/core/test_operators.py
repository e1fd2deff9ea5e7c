import json
import random
import re
from datetime import datetime

from pyspark.sql import functions as F

from jobloom.functions import requirements, sections, text, times, urls
from jobloom.operators import merge, schedule, similar
from jobloom.plans.queries import QUERIES, _postings
from jobloom.session import staged


def test_text(spark):
    r = spark.createDataFrame([("Olá,  Ｍundo! C# é", "a-B_ç"), (None, None), ("", "")], "x string, y string").select(
        text.norm_words(F.col("x")).alias("w"), text.compact(F.col("y")).alias("c"), text.tokens(F.col("x")).alias("t"), text.norm_tech(F.col("x")).alias("k")
    ).collect()
    assert r[0].w == "ola undo c e" and r[0].c == "abc" and r[0].t == ["ola", "undo", "c", "e"] and r[0].k == "ola undo c# e"
    assert r[1].w is None and r[2].t == []


def test_page_keys(spark):
    same = ["https://a.example/x/y?v=1&k=2", " http://WWW.A.example:80/x/y/?k=2&v=1&utm_source=z#top", "https://a.example:443/x%2Fy?v=1&gclid=&k=2"]
    df = spark.createDataFrame([(u,) for u in [*same, "https://a.example/x", "nothing", None, ""]], "u string").select(urls.page_key(F.col("u")).alias("p"))
    got = [r.p for r in df.collect()]
    assert got[:3] == ["a.example/x/y?k=2&v=1"] * 3 and got[3] == "a.example/x" and got[4:] == [None] * 3


def test_requirements(spark):
    df = spark.createDataFrame([("Inglês avançado",), ("Experiência de 2,5 anos",), ("Noções de X",), (None,), ("3+ years of Go or Java",)], "x string")
    got = [tuple(r) for r in df.select(requirements.level(F.col("x")), requirements.min_years(F.col("x"))).collect()]
    assert got == [(3, None), (None, 2.5), (1, None), (None, None), (None, 3.0)]


def test_records(spark):
    rows = [("Python básico ou Java", True), ("Spring Boot e  SQL avançado", True), ("Ensino superior cursando", True), ("Inglês", False), ("Vaga afirmativa para PcD", True), ("2 anos de experiência", True),
            ("Boa comunicação", False), ("Mercado financeiro", True), ("C# e .NET", True), (None, None), ("Transformação digital e informação", True)]
    df = spark.createDataFrame([(i, *r, "old") for i, r in enumerate(rows)], "id int, sentence string, must boolean, level string")
    got = {r.id: r for r in requirements.with_record(df, "sentence", "must").collect()}
    assert [got[i].category for i in range(11)] == ["technical", "technical", "education", "language", "eligibility", "experience", "behavioral", "domain", "technical", "other", "other"]
    assert [got[i].requirement_type for i in range(11)] == ["mandatory", "mandatory", "eliminatory", "differential", "eliminatory", "mandatory", "differential", "mandatory", "mandatory", "differential", "mandatory"]
    assert (got[0].relation, got[0].profile_ids, got[0].level, got[0].level_label) == ("any", ["python", "java"], 1, "básico")
    assert (got[1].relation, got[1].skill, got[1].subskill, got[1].text) == ("all", "Java", "Spring Boot", "Spring Boot e SQL avançado") and got[1].transferable and not got[0].transferable
    assert got[8].unmapped == 0 and got[6].transferable and got[9].text == "" and got[5].min_years == 2.0
    assert requirements.with_record(df.limit(0), "sentence", "must").count() == 0
    bad = requirements.violations(spark.createDataFrame([("", "odd", "other", "single", 9, -1.0, True), ("x", "mandatory", "technical", "all", 2, None, True)], "text string, requirement_type string, category string, relation string, level int, min_years double, mandatory boolean"))
    assert sorted(r.violation for r in bad.collect()) == ["level", "no text", "type", "years"]


def test_sections(spark):
    long = "Conhecimento em bancos de dados relacionais e não relacionais; Python para automação de rotinas; boa comunicação com as áreas de negócio; organização e autonomia para conduzir entregas sem supervisão próxima, sempre"
    items = ["Python  para automação de rotinas", "Vale-refeição", long, "boa comunicação", None, "", "Python para automação de rotinas", "Benefícios:", "Java"]
    df = spark.createDataFrame([(items,), ([],), (None,), (["Nossos benefícios", "SQL"],)], "x array<string>")
    got = [r[0] for r in df.select(sections.clean_items(F.col("x"))).collect()]
    assert got == [["Python para automação de rotinas", "boa comunicação"], [], None, []] and len(long) > 180
    q = spark.createDataFrame([("Dev Backend", ["Boa vontade"]), ("Dev Backend", ["SQL"]), ("Recepção", ["Boa vontade"]), ("x", []), ("x", None), ("x", ["Vale transporte", "Gympass", "a b c"])], "t string, x array<string>")
    assert [r[0] for r in q.select(sections.quality_conflict(F.col("t"), F.col("x"))).collect()] == [True, False, False, True, True, True]
    b = spark.createDataFrame([(["a1", "b1", "c1"], ["d1"], ["e1"]), (["a1"], ["d1", "e1", "f1 "], None), (["a1"], ["d1"], ["Conhecimento em SQL", "Experiência em Java", "Formação"]), (None, None, None)], "s array<string>, j array<string>, b array<string>")
    got = [tuple(r[0]) for r in b.select(sections.best_list(F.lit("Dev"), F.col("s"), F.col("j"), F.col("b"))).collect()]
    assert got == [(["a1", "b1", "c1"], "section"), (["d1", "e1", "f1"], "json_ld"), (["Conhecimento em SQL", "Experiência em Java", "Formação"], "technical_bullets"), ([], "section")]


def test_times(spark):
    r = spark.createDataFrame([("2026-02-26 10:00:00",), ("2027-01-01 00:00:00",), (None,)], "t string").select(times.age_days(F.to_timestamp("t"), "2026-03-01 00:00:00").alias("a"), times.week(F.to_timestamp("t")).alias("w")).collect()
    assert [x.a for x in r] == [2, 0, None] and str(r[0].w) == "2026-02-23"


def brute(rows, least):
    out = {}
    for i, (a, ba, ta) in enumerate(rows):
        for b, bb, tb in rows[i + 1 :]:
            if ba == bb and ba is not None and ta and tb:
                s = len(set(ta) & set(tb)) / len(set(ta) | set(tb))
                if s >= least:
                    out[min(a, b), max(a, b)] = s
    return out


def make_rows(n):
    rnd = random.Random(9)
    out = []
    for i in range(n):
        t = [rnd.choice("abcdefghij") for _ in range(rnd.randrange(0, 7))] if not out or rnd.random() < 0.5 else list(rnd.choice(out)[2])
        if t and rnd.random() < 0.5:
            t[rnd.randrange(len(t))] = rnd.choice("abcdefghijk")
        out.append((i, rnd.choice(["x", "y", None]), t))
    return out


def test_jaccard_links(spark):
    rows = make_rows(120)
    for least in (0.5, 0.72):
        want = brute(rows, least)
        got = {(r.a, r.b): r.similarity for r in similar.jaccard_links(spark.createDataFrame(rows, "id long, block string, t array<string>"), "id", "block", "t", least).collect()}
        assert all(abs(want[k] - v) < 1e-9 for k, v in got.items())
        # copies hang on their representative; between representatives nothing is missing
        key = {i: (b, tuple(sorted(set(t)))) for i, b, t in rows}
        rep = {}
        for i, k in key.items():
            rep.setdefault(k, i)
        assert {(rep[key[a]], rep[key[b]]) for a, b in want if key[a] != key[b]} == {(a, b) for a, b in got if key[a] != key[b]} | {(b, a) for a, b in got if key[a] != key[b]} & {(rep[key[a]], rep[key[b]]) for a, b in want}
        assert {(a, b) for a, b in got if key[a] == key[b]} == {(rep[k], i) for i, k in key.items() if rep[k] != i and k[0] is not None and k[1]}


def test_first_winners(spark):
    rnd = random.Random(2)
    links = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(70)}
    winner = {}
    for i in range(60):
        before = [j for j in range(i) if (j, i) in links and winner[j] == j]
        winner[i] = before[0] if before else i
    rows = spark.createDataFrame([(i, i) for i in range(60)], "id long, o long")
    got = {r.id: r.winner for r in similar.first_winners(rows, spark.createDataFrame([(b, a) for a, b in links], "a long, b long"), "o").collect()}
    assert got == winner


def write_jobs(spark, folder, n=140):
    """Jobs of few companies with few titles and requirement lists, so that copies differ in their requirements."""
    rnd = random.Random(4)
    titles = ["dev java senior time pagamentos", "dev java senior time cartoes pagamentos", "Dev Java senior time pagamentos!", "analista dados", "", None]
    words = [f"word{i}" for i in range(9)]
    rows = []
    for i in range(n):
        items = rnd.choice([None, []]) if rnd.random() < 0.1 else [" ".join(rnd.sample(words, rnd.randrange(2, 6))) for _ in range(2)]
        if rows and rnd.random() < 0.3:
            items = json.loads(rnd.choice(rows)[3])["requirements"]
        host = rnd.choice(["best", "good", "other"])
        rows.append((i + 1, rnd.choice(["x", "y", None]), rnd.choice(titles), json.dumps({"requirements": items}), f"https://{host}.example/{i}", datetime(2026, 1, rnd.randrange(1, 9))))
    rnd.shuffle(rows)
    spark.createDataFrame(rows, "id long, company string, role string, payload string, key string, first_seen_at timestamp").write.parquet(f"{folder}/jobs.parquet")
    spark.createDataFrame([("https://best.example", 1), ("https://www.good.example/", 3)], "base_url string, priority int").write.parquet(f"{folder}/source_registry.parquet")
    checked = [(r[4], datetime(2026, 2, 1) if rnd.random() < 0.5 else None) for r in rows]
    spark.createDataFrame(checked, "job_key string, last_verified_at timestamp").write.parquet(f"{folder}/job_sources.parquet")
    verified = {k for k, t in checked if t}
    split = lambda s: set(re.findall("[a-z0-9]+", (s or "").lower()))
    trust = lambda k: 5 if "best" in k else 3 if "good" in k else 0
    rows.sort(key=lambda r: (-trust(r[4]), r[4] not in verified, -r[5].timestamp(), r[0]))
    return [(i, c, split(r), split(" ".join(json.loads(p)["requirements"] or [])), trust(k)) for i, c, r, p, k, _ in rows]


def share(x, y):
    return len(x & y) / len(x | y) if x and y else 0


def test_same_posting_links(spark, tmp_path):
    rows = write_jobs(spark, tmp_path)
    near = {i: set() for i, *_ in rows}
    for i, c, t, r, _ in rows:
        for i2, c2, t2, r2, _ in rows:
            if i != i2 and c == c2 and c is not None and share(t, t2) >= 0.72 and share(r, r2) >= 0.45:
                near[i].add(i2)
    want = {}
    for i in near:
        part, todo = set(), [i]
        while todo:
            if (k := todo.pop()) not in part:
                part.add(k)
                todo += near[k]
        if near[i]:
            want[i] = (len(near[i]), min(part))
    got = [tuple(r) for r in QUERIES["same_posting_links"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and {i: (n, c) for i, n, c in got} == want


def test_preferred_postings(spark, tmp_path):
    winner, seen = {}, []
    for i, c, t, r, k in write_jobs(spark, tmp_path):
        first = [i2 for i2, c2, t2, r2, k2 in seen if c == c2 and c is not None and share(t, t2) >= 0.72 and share(r, r2) >= 0.45 and (share(r, r2) >= 0.9 or k != k2) and winner[i2] == i2]
        winner[i] = first[0] if first else i
        seen.append((i, c, t, r, k))
    assert sum(i != w for i, w in winner.items()) > 5
    got = [tuple(r) for r in QUERIES["preferred_postings"](spark, str(tmp_path)).collect()]
    assert len(got) == len(winner) and dict(got) == winner


def test_merge(spark):
    p = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (None, "n", "n")], "k int, s string, t string")
    c = spark.createDataFrame([(1, "b", None), (3, "c", "z")], "k int, s string, t string")
    got = {tuple(r) for r in merge.overlay(p, c, "k", ["s"], ["t"]).collect()}
    assert got == {(1, "both", "a", None), (2, "prior", None, "y"), (3, "current", "c", "z"), (None, "prior", "n", "n")}
    d = {r.k: r.action for r in merge.mirror_diff(p.where("k IS NOT NULL"), c, "k", ["s", "t"]).collect()}
    assert d == {1: "update", 2: "insert", 3: "delete"}
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("b", 1, None)], "k string, o int, v string")
    assert [r.changed for r in merge.changes(rows, "k", [F.col("o")], ["v"]).orderBy("k", "o").collect()] == [True, False, True, True]
    assert {(r.k, r.o, r.v) for r in merge.latest_by_key(rows, "k", [F.col("o")]).collect()} == {("a", 3, None), ("b", 1, None)}


def test_schedule(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("pq"), rnd.randrange(40), i) for i in range(300)]
    df = spark.createDataFrame(rows, "bucket string, c int, o long")
    got = {r.o: r.decision for r in schedule.within_budget(df, "bucket", "c", "o", {"p": 7}).collect()}
    taken, want = {"p": [], "q": []}, {}
    for b, c, o in rows:
        if c in taken[b]:
            want[o] = "duplicate"
        elif b == "p" and len(taken[b]) >= 7:
            want[o] = "not_scanned"
        else:
            taken[b].append(c)
            want[o] = "selected"
    assert got == want
    s = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, None), ("a", 4, True)], "k string, o int, h boolean")
    assert [r.streak for r in schedule.streaks(s, "k", "o", F.col("h")).orderBy("o").collect()] == [1, 2, 0, 1]


def test_copies_of_a_copy(spark):
    """Three rows of which two are equal: all belong to the first."""
    rows = spark.createDataFrame([(1, "x", ["a", "b", "c", "d"]), (2, "x", ["a", "b", "c", "d", "e"]), (3, "x", ["a", "b", "c", "d", "e"]), (4, "x", []), (5, None, ["a"])], "id long, block string, t array<string>")
    members, groups = similar.token_groups(rows, "id", "block", "t")
    won = similar.first_winners(groups.select(F.col("rep").alias("id"), "o"), similar.group_links(groups, 0.72), "o").withColumnRenamed("id", "rep")
    got = {r.id: r.winner for r in members.join(groups, ["block", "t0"]).select("id", "rep").join(won, "rep").collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_links_of_two_sets(spark):
    """Pairs must be alike in both sets; a firm with many rows is compared in full."""
    rnd = random.Random(5)
    draw = lambda signs, most: sorted({rnd.choice(signs) for _ in range(rnd.randrange(1, most))})
    rows = [(i, "x" if i % 5 else "y", draw("abcde", 5), draw("klmnopqrst", 9)) for i in range(150)]
    _, groups = similar.token_groups(spark.createDataFrame(rows, "id long, block string, t array<string>, r array<string>"), "id", "block", "t", "r")
    reps = {r.rep for r in groups.select("rep").collect()}
    share = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and {a[0], b[0]} <= reps and a[1] == b[1] and share(a[2], b[2]) >= 0.72 and share(a[3], b[3]) >= 0.45}
    got = [(r.a, r.b) for r in similar.group_links(groups, 0.72, 0.45).select("a", "b").collect()]
    assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want


def test_no_broadcast_of_sets(spark):
    """Sets of words are small in files and large in memory: no join of them goes through the driver."""
    rows = spark.createDataFrame([(i, "x", ["a", "b", str(i % 7)]) for i in range(50)], "id long, block string, t array<string>")
    members, groups = similar.token_groups(rows, "id", "block", "t")
    groups = staged(groups, "groups")
    links = similar.group_links(groups, 0.5)
    for x in (links, similar.with_group(members, groups)):
        assert "Broadcast" not in x._jdf.queryExecution().executedPlan().toString()
    x = _postings(spark, "/root/testdata/sf0.001")
    assert x._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 1  # the fixed list of sources


def test_members_without_broadcast(spark):
    """Jobs grow, so none of the joins of members goes through the driver or whole to every executor."""
    for name in ("similarity_bands", "same_posting_links"):
        x = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "Broadcast" not in x._jdf.queryExecution().executedPlan().toString(), name


def test_long_chain_of_winners(spark):
    """A path settles row by row; no row is left out however long it is."""
    n = 30
    rows = spark.createDataFrame([(i, n - i) for i in range(n)], "id long, place long")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    got = {r.id: r.winner for r in similar.first_winners(rows, links, "place").collect()}
    want = {}
    for i in reversed(range(n)):
        want[i] = i + 1 if i + 1 in want and want[i + 1] == i + 1 else i
    assert got == want


def test_addresses(spark):
    cases = {
        "https://www.linkedin.com/jobs/view/dev-python-at-x-4012345678?trk=a": ("linkedin:4012345678", "linkedin:4012345678", "linkedin"),
        "https://itau.gupy.io/job/99?jobBoardSource=x": ("itau.gupy.io:99", "itau.gupy.io:99", "gupy"),
        "https://jobs.lever.co/x/1/?b=2&a=1&utm_source=z#top": ("https://jobs.lever.co/x/1?a=1&b=2", "jobs.lever.co/x/1", "lever"),
        "https://www.google.com/about/careers/applications/jobs/results/1-dev/?q=x": ("https://www.google.com/about/careers/applications/jobs/results/1-dev", "google.com/about/careers/applications/jobs/results/1-dev", "company"),
        "https://fakelinkedin.com/jobs/view/4012345678": ("https://fakelinkedin.com/jobs/view/4012345678", "linkedin:4012345678", "unknown"),
        " nothing ": ("nothing", "", "unknown"),
    }
    df = spark.createDataFrame([(u,) for u in [*cases, None]], "u string").select(urls.canonical_id(F.col("u")), urls.catalog_id(F.col("u")), urls.provider(F.col("u")))
    got = [tuple(r) for r in df.collect()]
    assert got[:-1] == list(cases.values()) and got[-1][:2] == (None, None)
    back = spark.createDataFrame([("linkedin:4012345678",), ("itau.gupy.io:99",), ("https://a.example/",), ("x:1",)], "c string").select(urls.retry_address(F.col("c")))
    assert [r[0] for r in back.collect()] == ["https://www.linkedin.com/jobs/view/4012345678", "https://itau.gupy.io/jobs/99", "https://a.example/", None]
