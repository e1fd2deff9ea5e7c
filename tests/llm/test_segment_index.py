import random

import pytest
from pyspark.sql import functions as F

from jobloom.llm import segment_index
from jobloom.llm.segment_index import SegmentIndex, as_entries, link_entries


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def like(a, b):
    n = min(len(a), len(b))
    if lev(a, b) > (3 if n >= 16 else 1 if n >= 4 else 0) or "".join(c if c.isdigit() else " " for c in a).split() != "".join(c if c.isdigit() else " " for c in b).split():
        return False
    x, y = a.split(" "), b.split(" ")
    return len(x) != len(y) or all(p == q or (min(len(p), len(q)) >= 4 and lev(p, q) <= 2) for p, q in zip(x, y, strict=True))


def texts(n):
    rnd = random.Random(3)
    words = "analista desenvolvedor plataforma dados cobranca antifraude celula granito horizonte credito squad frente".split()
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.6:
            t = list(rnd.choice(out))
            for _ in range(rnd.randrange(4)):
                i = rnd.randrange(len(t))
                t[i : i + rnd.randrange(2)] = rnd.choice("abcdefgh") if rnd.random() < 0.6 else ""
            out.append("".join(t))
        else:
            out.append(" ".join(rnd.choice(words) for _ in range(5)))
    return out


SHORT = ["dev", "devs", "dev bi", "dev bj", "anl de bi", "anl de bii", "anl dd bi", "anl de dados xy", "anl de dados xyz", "gerente", "gerentes", "gerantes", "a", "b"]


def test_links_are_brute_force(spark):
    """Short texts too, which may differ in fewer edits."""
    rows = [(i % 2, t, i) for i, t in enumerate(texts(150))] + [(0, t, 200 + i) for i, t in enumerate(SHORT)]
    e = as_entries(spark.createDataFrame(rows, "block long, text string, ord long")).cache()
    own = {r.entry: (r.block, r.text) for r in e.collect()}
    got = {(r.a, r.b) for r in link_entries(e, 3).collect()}
    ids = sorted(own)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if own[a][0] == own[b][0] and like(own[a][1], own[b][1])}
    assert got == want and {(209, 210), (210, 211)} <= want and (209, 211) not in want


WORDS = "para definir rotinas de conciliacao com a equipe do banco e revisar os alertas de fraude no fim de cada mes sob demanda".split()
INPUT = "ord long, key string, text string, block long, scopes array<long>, body string"


def arrivals():
    """Rows with blocks and without, keys that repeat, short and null texts."""
    rnd = random.Random(7)
    rows = []
    for i, t in enumerate(texts(70)):
        whole = rnd.random() < 0.7
        body = " ".join(rnd.sample(WORDS, len(WORDS)) if rnd.random() < 0.3 else WORDS) if rnd.random() < 0.8 else None
        rows.append((i, f"k{rnd.randrange(60)}" if rnd.random() < 0.5 else None, t, 5 if whole else None, [8, 9 if whole or rnd.random() < 0.5 else None], body))
    rows += [(80 + i, None, t, 6, [None, 11], None) for i, t in enumerate(SHORT)]
    return rows + [(100, "k1", None, 5, [8, 9], "x"), (101, None, "", 5, [8, 9], None), (102, None, None, None, None, None)]


def brute(rows):
    """First arrival of each row, over all links."""
    label = {r[0]: r[0] for r in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, ka, ta, ba, sa, da) in enumerate(rows):
        for b, kb, tb, bb, sb, db in rows[i + 1 :]:
            same = ka is not None and ka == kb
            if ta and tb and ba is not None and bb is not None:
                same |= ba == bb and (ta == tb or like(ta, tb))
            elif ta and tb:
                same |= bool({x for x in sa if x} & {x for x in sb if x}) and like(ta, tb) and bool(da) and bool(db) and sorted(da) == sorted(db) and da == db
            if same:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {r[0]: root(r[0]) for r in rows}


def given(spark, rows):
    x = spark.createDataFrame(rows, INPUT)
    return x.withColumn("described", F.coalesce("body", F.lit("")) != "").drop("body"), x.select(F.col("ord").alias("id"), F.col("body").alias("text")).where("text IS NOT NULL")


@pytest.mark.parametrize("cuts", [(0, 200), (0, 30, 31, 60, 200)])
def test_batches_give_what_all_at_once_gives(spark, tmp_path, cuts):
    rows = arrivals()
    path = str(tmp_path / "ix")
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        index = SegmentIndex(spark, path, least=0.999)  # opened anew each time: history is what lies under the path
        index.add(*given(spark, [r for r in rows if lo <= r[0] < hi]))
    got = {r.ord: r.label for r in SegmentIndex(spark, path).result().collect()}
    # a block's equal texts hold one description, that of the first row that has any
    assert got == brute(rows)


def test_unfinished_loads_do_not_count(spark, tmp_path):
    index = SegmentIndex(spark, str(tmp_path / "ix"))
    rows, own = given(spark, [(1, "k", "analista de dados senior", 5, [8], None)])
    index.add(rows.limit(0), own)
    index._append("rows", spark.createDataFrame([(1, "k", 1)], "ord long, key string, label long"), "broken off")
    assert index.result().count() == 0
    index.add(rows, own)
    assert [tuple(r) for r in index.result().collect()] == [(1, "k", 1)]


def test_open_rows_of_a_scope_are_not_written_as_pairs(spark, tmp_path, monkeypatch):
    """Rows without block, all of one text and scope: neither strangers nor copies make pairs that grow with the square."""
    written = {}

    def counted(df, name):
        x = segment_index_staged(df, name)
        written[name] = written.get(name, 0) + (x.count() if name == "batch-pairs" else 0)
        return x

    segment_index_staged = segment_index.staged
    monkeypatch.setattr(segment_index, "staged", counted)
    rnd = random.Random(11)
    strangers = [(i, None, "analista de dados", None, [4], " ".join(f"w{rnd.randrange(9999)}" for _ in range(40))) for i in range(100)]
    copies = [(100 + i, None, "analista de dados", None, [4], "Olá MUNDO de hoje" if i % 2 else "ola mundo de hoje") for i in range(100)]
    late = [(300, None, "analista de dadas", None, [4], "ola mundo de hoje"), (301, None, "analista de dados", 7, [4], "ola mundo de hoje"), (302, None, "analista de dados", 7, [4], None)]
    for rows in (strangers + copies, late):
        SegmentIndex(spark, str(tmp_path / "ix"), least=0.65).add(*given(spark, rows))
    got = {r.ord: r.label for r in SegmentIndex(spark, str(tmp_path / "ix")).result().collect()}
    assert got == {i: i for i in range(100)} | dict.fromkeys([*range(100, 200), 300, 301, 302], 100)
    assert written["batch-pairs"] < 10
