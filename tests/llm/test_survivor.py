import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from jobloom.llm import survivor

SCHEMA = "id long, g string, trust int, seen timestamp, filled int, name string, extra string"


def make(n, hot):
    rnd = random.Random(8)
    t0 = datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        g = "hot" if i < hot else rnd.choice([f"g{i % 40}", None])
        rows.append((i, g, rnd.choice([1, 2, 3, None]), rnd.choice([None, *[t0 + timedelta(days=k) for k in range(3)]]), rnd.randrange(3), rnd.choice(["x", "", None, " y "]), "e"))
    return rows + rows[:10]  # repeated rows


def better(r):
    return (r[2] if r[2] is not None else survivor.LEAST_TRUST, -(r[3].timestamp() if r[3] else -1e15), -r[4])


def test_leaders(spark):
    rows = make(300, 100)
    out = survivor.leaders(spark.createDataFrame(rows, SCHEMA), ["g"], "id", F.col("trust"), F.col("seen"), F.col("filled")).collect()
    groups = {}
    for r in set(rows):
        if r[1] is not None:
            groups.setdefault(r[1], []).append(r)
    assert {r.g for r in out} == set(groups)
    for r in out:
        own = groups[r.g]
        best = min(own, key=lambda x: (*better(x), x[0]))
        keys = [better(x) for x in own]
        top = better(best)
        dominant = all(a <= b for k in keys for a, b in zip(top, k, strict=True)) and keys.count(top) == 1
        assert (r.id, r.group_id, r.group_rows, r.dominant) == (best[0], min(x[0] for x in own), len(own), dominant)


def test_merged(spark):
    rows = make(200, 60)
    out = survivor.merged(spark.createDataFrame(rows, SCHEMA), ["g"], "id", F.col("trust"), F.col("seen"), ["name", "trust"]).collect()
    groups = {}
    for r in set(rows):
        if r[1] is not None:
            groups.setdefault(r[1], []).append(r)
    assert {r.g for r in out} == set(groups)
    for r in out:
        own = [x for x in groups[r.g] if x[5] is not None and x[5].strip()]
        want = min(own, key=lambda x: (*better(x)[:2], x[0]))[5] if own else None
        assert r.name == want and r.group_rows == len(groups[r.g])


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert survivor.leaders(df, ["g"], "id", F.col("trust"), F.col("seen"), F.col("filled")).count() == 0
    assert survivor.merged(df, ["g"], "id", F.col("trust"), F.col("seen"), ["name"]).count() == 0
