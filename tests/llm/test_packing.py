import random

import numpy as np
from pyspark.sql import functions as F

from jobloom.llm import packing


def test_plan_uses_everything_and_fills():
    rnd = random.Random(4)
    for cap, n, top in ((20, 50, 20), (256, 3000, 256), (256, 5000, 60), (1024, 4000, 700), (64, 3, 64)):
        counts = np.zeros(cap + 1, np.int64)
        for _ in range(n):
            counts[rnd.randrange(1, top + 1)] += 1
        made = packing.plan(counts, cap)
        back = np.zeros(cap + 1, np.int64)
        for sizes, k in made:
            assert sum(sizes) <= cap and k > 0
            for s in sizes:
                back[s] += k
        assert (back == counts).all()
        tokens, containers = int((counts * np.arange(cap + 1)).sum()), sum(k for _, k in made)
        if n > 1000 and top < cap:
            assert containers <= -(-tokens // cap) * 1.01 + 1
    assert packing.plan(np.zeros(11, np.int64), 10) == []


def test_packed(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_SALT", 50)  # the frequent size is ranked in several tasks
    rnd = random.Random(7)
    rows = [(i, rnd.choice([7, 7, 7, rnd.randrange(1, 90)])) for i in range(400)] + [(1000, 0), (1001, None), (1002, 333)]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, n long"), "doc_id", "n", 64).cache()
    got = out.collect()
    by, docs = {}, {}
    for r in got:
        by.setdefault(r.container_id, []).append(r)
        docs.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for rs in by.values():
        assert sum(r.length for r in rs) <= 64 and sorted(r.place for r in rs) == list(range(len(rs)))
    assert sorted(by) == list(range(len(by)))
    for i, n in rows:
        if not n:
            assert i not in docs
            continue
        ps = sorted(docs[i])
        assert [p for p, *_ in ps] == list(range(-(-n // 64))) and [s for _, s, _ in ps] == [64 * k for k in range(len(ps))] and sum(k for *_, k in ps) == n
    f = packing.fill(out, 64).first()
    assert f.used > 0.97 and f.containers == len(by)
    assert packing.packed(spark.createDataFrame([], "doc_id long, n long"), "doc_id", "n", 64).count() == 0
