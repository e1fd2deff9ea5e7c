from pyspark.sql import functions as F

from jobloom.functions import classify
from jobloom.operators import merge, state


def test_advance(spark):
    h = spark.createDataFrame([("a", "rejected", 2, 1, 5), ("b", "published", 1, 2, 3), ("c", "rejected", 1, 1, 1), (None, "x", 0, 0, 0)], "k string, status string, attempts int, first_seen long, last_seen long")
    o = spark.createDataFrame([("a", "accepted", 9), ("b", "rejected", 8), ("d", "not_scanned", 7), ("a", "older", 8), (None, "y", 1)], "k string, status string, at long")
    got = {r.k: tuple(r)[1:] for r in state.advance(h, o, "k", ["not_scanned"], ["published"]).collect()}
    assert got == {"a": ("accepted", 3, 1, 9), "b": ("published", 2, 2, 8), "c": ("rejected", 1, 1, 1), "d": ("not_scanned", 0, 7, 7)}
    assert {tuple(r) for r in state.repeated_outcomes(o, "k").collect()} == {("a", 2)}


def test_expired(spark):
    h = spark.sql("SELECT * FROM VALUES ('a', timestamp'2026-01-01'), ('b', timestamp'2025-01-01'), ('c', NULL) AS t(k, last_seen)")
    assert [r.k for r in state.expired(h, "2026-03-01 00:00:00", 180).collect()] == ["a"]


def test_marks(spark):
    at = "2026-03-01 00:00:00"
    none = F.lit(None).cast("timestamp")
    h = spark.createDataFrame([("a", "accepted", "ok", 3), ("b", "retry", "timeout", 1), ("c", "rejected", "old", 2), (None, "x", "x", 1)], "k string, status string, reason string, attempts int")
    h = h.select("k", "status", "reason", F.to_timestamp(F.lit("2026-01-01")).alias("first_seen"), none.alias("last_seen"), none.alias("last_processed"), F.to_timestamp(F.lit("2026-03-09")).alias("retry_after"), "attempts", F.lit("v1").alias("policy"), F.array().cast("array<struct<stage: string, reason: string>>").alias("transitions"))
    o = spark.createDataFrame([("b", "not_scanned", "budget"), ("c", "rejected", "recent_rejection"), ("d", "rejected", "title"), ("e", "retry", "timeout"), ("f", "already_known", "known"), (None, "x", "y")], "k string, status string, reason string")
    x = state.marked(h, o, "k", at, "v2")
    got = {r.k: (r.status, r.reason, r.attempts, r.policy, [tuple(t) for t in r.transitions]) for r in x.collect()}
    new = ("discovered", "source_discovery")
    assert got == {
        "a": ("accepted", "ok", 3, "v1", []), "b": ("retry", "timeout", 1, "v2", [("not_scanned", "budget")]), "c": ("rejected", "old", 2, "v2", [("rejected", "recent_rejection")]),
        "d": ("rejected", "title", 1, "v2", [new, ("rejected", "title")]), "e": ("retry", "timeout", 1, "v2", [new, ("retry", "timeout")]), "f": ("already_known", "known", 0, "v2", [new, ("already_known", "known")]),
    }
    later = lambda t: {r.k: r.waits for r in state.waiting(x, t, "v2").collect()}
    assert later("2026-03-01 00:10:00") == {"a": None, "b": "retry_deferred", "c": "recent_rejection", "d": "recent_rejection", "e": "retry_deferred", "f": None}
    assert later("2026-03-02 00:10:00") == {"a": None, "b": "retry_deferred", "c": "recent_rejection", "d": None, "e": None, "f": None}


def test_histories(spark):
    h, r = spark.createDataFrame([("w1", 1)], "week string, n int"), spark.createDataFrame([("w1", 9), ("w2", 2)], "week string, n int")
    assert {tuple(x) for x in state.append_if_absent(h, r, "week").collect()} == {("w1", 1), ("w2", 2)}
    p = spark.createDataFrame([("a", True, False, "bad"), ("b", True, False, None), ("c", True, True, "bad"), ("d", None, None, "bad"), ("e", True, None, "bad")], "k string, auto boolean, out boolean, why string")
    c = spark.createDataFrame([("e",)], "k string")
    assert {x.k: x.retired for x in state.reconciled(p, c, "k", "auto", "out", "why").collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False}
    t = spark.createDataFrame([(["a"], True), (["a", "z"], True), (None, True), (["a"], None)], "s array<string>, w boolean")
    assert [x.s for x in state.transition_once(t, "s", "z", F.col("w")).collect()] == [["a", "z"], ["a", "z"], ["z"], ["a"]]
    assert [x[0] for x in spark.createDataFrame([("a", "b"), (None, "b")], "x string, y string").select(state.set_once(F.col("x"), F.col("y"))).collect()] == ["a", "b"]


def test_ids_and_sources(spark):
    rows = [(5000 + i, None if i % 2 else 100 + i) for i in range(10)] + [(20, None), (9000, None)]
    got = {r.o: r.i for r in merge.kept_ids(spark.createDataFrame(rows, "o long, i long"), "i", "o").collect()}
    want, top = {}, 108
    for o, i in sorted(rows):
        if i is None:
            top += 1
        want[o] = i if i is not None else top
    assert got == want
    s = spark.createDataFrame([("k", "u1", 1, "old", 2), ("k", "u1", 2, None, 3), ("k", "u2", 3, "two", 9), ("k", " ", 4, "x", 1), ("k", None, 5, "x", 1), ("m", "u3", 6, None, None)], "k string, url string, o int, name string, p int")
    got = {r.k: [tuple(x) for x in r.sources] for r in merge.merged_sources(s, "k", "url", "o", ["name", "p"], "p").collect()}
    assert got == {"k": [("u2", "two", 9), ("u1", "old", 3)], "m": [("u3", None, None)]}


def test_labels(spark):
    x = spark.createDataFrame([("Desenvolvedor Python", "APIs REST com Docker"), ("Analista de segurança", "LGPD"), ("QA", "testes em Java"), (None, None)], "t string, x string")
    x = x.withColumn("g", classify.tags(F.concat_ws(" ", "t", "x")))
    got = [tuple(r) for r in x.select("g", classify.area(F.col("t"), F.col("x")), classify.stack(F.col("g"), F.col("t"))).collect()]
    assert got == [(["Python", "REST/APIs", "Docker"], "Engenharia de Software", "Python"), (["Segurança"], "Segurança", "Multistack"), (["Java", "Testes"], "Engenharia de Software", "Java"), ([], "Engenharia de Software", "Multistack")]
