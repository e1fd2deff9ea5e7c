import json

from jobloom.sources import feeds, pages


def test_postings(spark):
    g = json.dumps({"jobs": [{"absolute_url": "u1", "title": "T", "content": "&lt;p&gt;fun&amp;ccedil;&atilde;o&lt;/p&gt;", "location": {"name": "Recife"}, "updated_at": "2026-01-02"}, {"title": "no address"}]})
    v = json.dumps([{"hostedUrl": "u2", "text": "L", "description": "d", "workplaceType": "remote", "categories": {"location": "SP"}, "lists": [{"text": "R & D", "content": "<li>a</li>"}]}])
    a = json.dumps({"jobs": [{"jobUrl": "u3", "title": "A", "descriptionPlain": "p", "isRemote": True}]})
    rows = [("greenhouse", "c1", g), ("lever", "c2", v), ("ashby", "c3", a), ("ashby", "c4", "not json"), ("other", "c5", "{}"), ("lever", "c6", None)]
    got = {r.url: r for r in feeds.postings(spark.createDataFrame(rows, "provider string, company string, body string")).collect()}
    assert set(got) == {"u1", "u2", "u3"}
    assert got["u1"].description == "<p>fun&ccedil;ão</p>" and got["u1"].posted_on == "2026-01-02"
    assert got["u2"].description == "d<h2>R &amp; D</h2><li>a</li>" and got["u2"].remote and got["u3"].remote


def test_files(spark, tmp_path):
    (tmp_path / "a.js").write_text('window.jobs.push(...[{"id": 1, "company": "x"},\n {"id": 2, "company": null}]);')
    (tmp_path / "b.js").write_text("nothing here")
    assert {tuple(r) for r in feeds.script_literals(spark, str(tmp_path / "*.js"), "id: int, company: string").collect()} == {(1, "x"), (2, None)}
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://a.example/1 </loc><lastmod>2026-01-01</lastmod></url><url><loc>https://a.example/2</loc></url></urlset>")
    assert {tuple(r) for r in feeds.sitemap(spark, str(tmp_path / "s.xml")).collect()} == {("https://a.example/1", "2026-01-01"), ("https://a.example/2", None)}


PAGE = """<h2>Requisitos</h2><ul><li>Python</li><li>SQL &amp; dados</li></ul><h3>Diferenciais</h3><p>Scala</p><h3>Benefícios</h3><li>VR</li>
<a href="/x">a</a><a href="/x">b</a><script type="application/ld+json">{&quot;@graph&quot;: [{&quot;@type&quot;: &quot;JobPosting&quot;, &quot;title&quot;: &quot;Dev&quot;}]}</script>"""


def test_pages(spark):
    r = {x.id: x for x in pages.parse_pages(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, html string"), "html").collect()}
    assert r[1].requirements == ["Python", "SQL & dados"] and r[1].differentials == ["Scala"] and r[1].links == ["/x"] and json.loads(r[1].posting)["title"] == "Dev"
    assert r[2].requirements == [] and r[2].posting is None and r[3].n_lines == 0


def test_sections_of_lines():
    lines = [("p", "Somos um banco"), ("head", "Requisitos"), ("li", "Conhecimento em Python"), ("li", "Vale-refeição"), ("p", "SQL"), ("li", "SQL"), ("head", "Responsabilidades"), ("li", "Manter serviços"), ("p", "Diferenciais:"), ("li", "Scala"), ("head", "Benefícios"), ("li", "Salário bom")]
    assert pages.sections(lines) == {"requirements": ["Conhecimento em Python", "SQL"], "differentials": ["Scala"], "duties": ["Manter serviços"]}
    assert pages.loose_bullets(lines) == []
    free = [("li", "Experiência com Java"), ("li", "Gostar de gente"), ("head", "Atividades"), ("li", "Experiência com testes")]
    assert pages.loose_bullets(free) == ["Experiência com Java"] and pages.sections(free)["requirements"] == []
    assert [len(x) for x in pages.sections([("head", "Requisitos")] + [("li", f"item {i}") for i in range(50)]).values()] == [30, 0, 0]
    p = pages.read_page("<p>Conhecimento em <strong>Python</strong> e SQL</p><ul><li><b>Java</b></li></ul>")
    assert p.lines == [("p", "Conhecimento em Python e SQL"), ("head", "Java")] or p.lines[0] == ("p", "Conhecimento em Python e SQL")


def test_links_and_boards():
    raw = '<a href="/v/1">a</a><a href="/x">n</a> text https://a.example/v/2&amp;k=1 <a href="/v/1">again</a>'
    assert pages.links(pages.read_page(raw), raw, "https://a.example/", [r"/v/"]) == ["https://a.example/v/1", "https://a.example/v/2&k=1"]
    data = {"props": {"totalJobs": 3, "jobs": [{"id": 7, "name": "Dev"}, {"id": 8, "title": "QA"}], "deep": [{"id": 9, "name": "SRE", "jobUrl": "/job/9"}, {"id": 10, "name": "no address"}]}}
    html_ = f'<a href="/jobs/1">Um</a><a href="/?page=2">Próxima</a><a href="https://b.example/jobs/2">fora</a><script id="__NEXT_DATA__">{json.dumps(data)}</script>'
    b = pages.board(html_, "x.example")
    assert b["postings"] == {"https://x.example/jobs/1": "Um", "https://x.example/jobs/7": "Dev", "https://x.example/jobs/8": "QA", "https://x.example/job/9": "SRE"}
    assert b["pages"] == ["https://x.example/?page=2"] and b["total"] == 3 and not b["complete"]
    assert pages.board('<a href="/jobs/1">Um</a>', "x.example")["complete"] and not pages.board("", "x.example")["complete"]


def test_more_feeds(spark, tmp_path):
    f = spark.createDataFrame([("lever", "a", "[]"), ("ashby", "b", "oops"), ("x", "c", "{}"), ("greenhouse", "d", '{"jobs": [{"absolute_url": "u"}]}'), ("ashby", "e", None)], "provider string, company string, body string")
    assert {r.company: (r.state, r.postings) for r in feeds.feed_report(f).collect()} == {"a": ("empty", 0), "b": ("unreadable", 0), "c": ("unknown", 0), "d": ("read", 1), "e": ("unreadable", 0)}
    page = json.dumps([{"id": 1, "html_url": "u1", "title": "T", "company": {"name": "C"}, "body": "B"}, {"id": 1, "html_url": "u1", "title": "T", "company": {"name": "C"}, "body": "B"}, {"number": 2, "url": "u2", "name": "N", "company": "D", "local": ""}, {"x": 1}])
    got = {r.external_id: r for r in feeds.aggregator(spark.createDataFrame([(page,), ("oops",), (None,)], "body string"), "api_br").collect()}
    assert set(got) == {"1", "2"} and got["1"].company == "C" and got["2"].company == "D" and got["2"].source_url == "u2" and got["2"].location is None
    z = feeds.aggregator(spark.createDataFrame([(json.dumps({"results": [{"redirect_url": "r", "title": "T", "company": {"display_name": "C"}, "location": {"display_name": "L"}}]}),)], "body string"), "adzuna").first()
    assert (z.external_id, z.company, z.location, z.apply_url) == ("r", "C", "L", None)
    w = [("q", json.dumps({"total": 3, "jobPostings": [{"externalPath": "/job/a"}, {"externalPath": "/job/b"}]})), ("q", json.dumps({"total": 3, "jobPostings": [{"externalPath": "/job/a"}]})), ("r", json.dumps({"total": 9, "jobPostings": [{"externalPath": "/x"}]})), ("s", "oops")]
    got = {r.query: (r.urls, r.complete) for r in feeds.paged_search(spark.createDataFrame(w, "query string, body string"), "https://w").collect()}
    assert got == {"q": (["https://w/job/a", "https://w/job/b"], True), "r": ([], False), "s": ([], False)}


def test_catalog_files(spark, tmp_path):
    jobs = spark.createDataFrame([(2, "b", None), (1, "a", "x")], "id int, company string, role string")
    feeds.write_script(jobs, str(tmp_path / "s"))
    assert [tuple(r) for r in feeds.script_literals(spark, str(tmp_path / "s" / "*.txt"), "id: int, company: string, role: string").orderBy("id").collect()] == [(1, "a", "x"), (2, "b", None)]
    feeds.write_catalog(jobs, jobs.limit(1), str(tmp_path / "c"))
    assert {tuple(r) for r in feeds.read_catalog(spark, str(tmp_path / "c"), "id int, company string, role string").collect()} == {(1, "a", "x"), (2, "b", None)}
    (tmp_path / "one.json").write_text('{"meta": {}, "jobs": [\n{"id": 5, "company": "z"}]}')
    assert [tuple(r) for r in feeds.read_catalog(spark, str(tmp_path / "one.json"), "id: int, company: string").collect()] == [(5, "z")]
    (tmp_path / "m.js").write_text('const domains = {"a.example": "A", "b.example": "B"};')
    assert {tuple(r) for r in feeds.domain_map(spark, str(tmp_path / "m.js"), "domains").collect()} == {("a.example", "A"), ("b.example", "B")}
    (tmp_path / "pay.json").write_text('{"k1": {"min": 1.0, "max": 2.0}, "k2": {"min": null}}')
    assert {tuple(r) for r in feeds.by_key(spark, str(tmp_path / "pay.json"), "min: double, max: double").collect()} == {("k1", 1.0, 2.0), ("k2", None, None)}


def test_nested_sitemaps(spark, tmp_path):
    (tmp_path / "index.xml").write_text("<sitemapindex>" + "".join(f"<sitemap><loc>https://a.example/s{i}.xml</loc></sitemap>" for i in range(6)) + "</sitemapindex>")
    for i in range(6):
        (tmp_path / f"s{i}.xml").write_text("<urlset>" + "".join(f"<url><loc>https://a.example/vaga/{i}-{k}?a=1&amp;b=2</loc></url>" for k in range(5)) + "<url><loc>https://a.example/about</loc></url></urlset>")
    got = {r.url for r in feeds.nested_sitemap(spark, str(tmp_path), most=2).collect()}
    assert got == {f"https://a.example/vaga/{i}-{k}?a=1&b=2" for i in range(2, 6) for k in (3, 4)}
