import json
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from jobloom.functions import postings, verification
from jobloom.operators import feedback, resolution


def test_posting_fields(spark):
    cases = [
        ({"title": " Dev ", "hiringOrganization": {"name": "Banco X", "sameAs": "https://www.bancox.example/a"}, "jobLocation": {"address": {"addressLocality": "Natal", "addressRegion": "RN", "addressCountry": "BR"}}, "jobLocationType": "TELECOMMUTE"}, ("Dev", "Banco X", "Natal, RN, BR", "Remoto", "bancox.example")),
        ({"hiringOrganization": [{"name": "Banco X"}], "jobLocation": [{"address": {"addressLocality": "Natal"}}, {"address": {"addressLocality": "Recife", "addressCountry": "BR"}}]}, (None, "Banco X", "Natal / Recife, BR", "Híbrido", None)),
        ({"hiringOrganization": "Banco X", "jobLocation": []}, (None, "Banco X", None, "Híbrido", None)),
        ({"hiringOrganization": {"name": "Banco X", "url": "https://banco.gupy.io/"}}, (None, "Banco X", None, "Híbrido", None)),
        ({}, (None, "", None, "Híbrido", None)),
    ]
    df = spark.createDataFrame([(json.dumps(p), "modelo híbrido") for p, _ in cases] + [(None, None)], "p string, t string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(postings.title(p), postings.employer(p), postings.places(p), postings.modality(p, F.col("t")), postings.domain(p)).collect()]
    assert got == [w for _, w in cases] + [(None, "", None, None, None)]


def test_same_employer(spark):
    cases = [("Banco Alfa S.A.", "Banco Alfa", True), ("Alfa Holding", "Alfa", False), ("BANCO  ALFA", "banco alfa", True), ("", "", False), (None, "x", False), ("Grupo Beta Pagamentos Ltda", "Beta Pagamentos", True), ("Beta", "Beta Pagamentos", False)]
    df = spark.createDataFrame([c[:2] for c in cases], "a string, e string").select(postings.same_employer(F.col("a"), F.col("e")))
    assert [r[0] for r in df.collect()] == [c[2] for c in cases]


def test_states(spark):
    s = verification.fetched(F.col("h"), F.col("t"), F.to_timestamp("v"), F.col("r"), F.col("e"), F.col("p"), F.col("d"), "2026-03-01")
    rows = [(404, None, None, None, None, None, None), (500, "", None, 1.0, True, True, "x" * 200), (200, "Vaga encerrada", None, 1.0, True, True, "x" * 200), (200, "", "2026-02-01", 1.0, True, True, "x" * 200), (200, "", None, 0.7, True, True, "x" * 200), (200, "", None, 0.7, False, True, "x" * 200), (200, "", None, 0.1, True, True, "x" * 200), (200, "", None, None, None, False, None), (None, None, None, None, None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "h int, t string, v string, r double, e boolean, p boolean, d string").select(s["state"]).collect()]
    assert got == ["closed", "pending", "closed", "closed", "confirmed", "pending", "pending", "pending", "pending"]
    u = spark.createDataFrame([(True, "Ativa", "confirmed", None, "2026-02-28"), (False, "Encerrada", None, None, None), (None, "Ativa", "pending", "2026-02-28", "2026-02-27"), (None, "Ativa", "pending", "2026-02-26", "2026-02-27"), (None, "Ativa", None, None, "2026-02-01"), (None, None, None, None, None)], "r boolean, s string, v string, c string, l string")
    x = u.select(verification.public_state(F.col("r"), F.col("s"), F.col("v"), F.to_timestamp("c"), F.to_timestamp("l"), "2026-03-01"))
    assert [r[0] for r in x.collect()] == ["review", "closed", "pending", "confirmed", "pending", "pending"]


def test_ratio_and_decision(spark):
    pairs = [("analista de dados", "analista dados junior"), ("abc", "abc"), ("", "x"), (None, "x")]
    got = resolution.with_ratio(spark.createDataFrame([(*p, 9) for p in pairs], "x string, y string, ratio int"), "x", "y").collect()
    assert {(r.x, r.y): r.ratio for r in got} == {p: SequenceMatcher(None, *p).ratio() if p[0] is not None else None for p in pairs}
    rows = [(1, 10, 90.0, True, False), (1, 11, 60.0, True, False), (2, 10, 90.0, True, False), (2, 11, 75.0, True, False), (3, 10, 80.0, True, False), (4, 10, None, None, False), (5, 10, 95.0, True, False), (5, 11, None, None, True), (6, 10, 95.0, False, False), (7, 12, 88.0, True, False), (7, 11, 88.0, True, False)]
    x = spark.createDataFrame(rows, "job int, c int, score double, confirmed boolean, failed boolean")
    got = {r.job: (r.c, r.state) for r in resolution.decide(x, "job", "c").collect()}
    assert got == {1: (10, "resolved"), 2: (10, "review_required"), 3: (10, "review_required"), 4: (None, "pending"), 5: (10, "fetch_failed"), 6: (10, "review_required"), 7: (11, "review_required")}
    assert {(r.job, r.c, r.place) for r in resolution.ranked(x, "job", "c", 1).collect()} == {(1, 10, 1), (2, 10, 1), (3, 10, 1), (5, 10, 1), (6, 10, 1), (7, 11, 1)}


def test_feedback(spark):
    rows = [("2026-01-01", ["Candidatado"], 90.0, "a"), ("2026-02-27", ["Candidatado"], 90.0, "a"), ("2026-02-27", ["Candidatado", "Rejeitado"], 49.0, ""), ("2026-02-27", ["Oferta"], 101.0, None), ("2026-02-27", None, None, "a"), (None, ["Oferta"], 90.0, "a")]
    x = feedback.outcomes(spark.createDataFrame(rows, "applied_at string, stages array<string>, score double, source string").withColumn("applied_at", F.to_timestamp("applied_at")), "2026-03-01")
    f = feedback.funnel(x).first()
    assert (f.applications, f.mature, f.responses, f.interviews, f.offers, f.response_rate, f.interview_rate) == (5, 3, 2, 1, 1, 40, 20)
    assert {r.band: (r.applications, r.mature, r.response_rate) for r in feedback.bands(x).collect()} == {"under50": (1, 1, 100), "50to64": (0, 0, None), "65to79": (0, 0, None), "80plus": (2, 1, 0)}
    assert {r.label: r.applications for r in feedback.cohorts(x, "source").collect()} == {"a": 2, "Não informada": 2}
    assert feedback.calibration(x).first().status == "insufficient" and feedback.funnel(x.limit(0)).first().response_rate is None
