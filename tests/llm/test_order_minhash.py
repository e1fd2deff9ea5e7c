import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from jobloom.llm import order_minhash as om


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], max(row[j], row[j - 1], prev + 1 if x == y else 0)
    return row[-1]


def test_alignment_is_brute_force():
    rnd = np.random.default_rng(2)
    a = [rnd.integers(0, 6, rnd.integers(0, 30)).astype(np.int32) for _ in range(700)]
    b = [rnd.integers(0, 6, rnd.integers(0, 30)).astype(np.int32) for _ in range(700)]
    want = [2 * lcs(x.tolist(), y.tolist()) / (len(x) + len(y)) if len(x) + len(y) else 1 for x, y in zip(a, b, strict=True)]
    assert np.allclose(om.banded_similarity(a, b, 40), want)
    half = om.banded_similarity(a, b, 40, 0.5)
    assert all(abs(h - w) < 1e-9 if w >= 0.5 else h == 0 or abs(h - w) < 1e-9 for h, w in zip(half, want, strict=True))
    c = [np.concatenate((x, y[: len(y) // 3], x)) for x, y in zip(a, b, strict=True)]
    e = [np.concatenate((x, y, x)) for x, y in zip(a, b, strict=True)]
    want_c = [2 * lcs(x.tolist(), y.tolist()) / (len(x) + len(y)) if len(x) + len(y) else 1 for x, y in zip(c, e, strict=True)]
    assert np.allclose(om.banded_similarity(c, e, 99), want_c)
    assert (om.banded_similarity(a, b, 3) <= np.array(want) + 1e-9).all()


def reference_keys(text, k, ell, m):
    """The sketch of one text, step by step, with the same hash functions."""
    u = lambda x: int(om.mix(np.array([x % (1 << 64)], np.uint64))[0])
    s = [u(x + 1) for x in text] + [0x9E3779B97F4A7C15] * max(0, k - len(text))
    seen, h = {}, []
    for i in range(len(s) - k + 1):
        x = u(sum(s[i + j] * pow(0x100000001B3, j + 1, 1 << 64) for j in range(k)))
        seen[x] = seen.get(x, -1) + 1
        h.append((x + seen[x] * 0x9E3779B97F4A7C15) % (1 << 64))
    out = []
    for t in range(m):
        seed = (1000003 + t) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        at = sorted(sorted(range(len(h)), key=lambda i: ((h[i] ^ seed) * ((seed >> 7) * 2 + 1) % (1 << 64) >> 20, i))[:ell])
        key = t + 1
        for i in at:
            key = u(key * 0x100000001B3 + h[i])
        out.append(key - (1 << 64) if key >= 1 << 63 else key)
    return out


def test_sketch_is_reference():
    rnd = random.Random(5)
    docs = [[rnd.randrange(9) for _ in range(rnd.randrange(6, 40))] for _ in range(40)]
    off = np.concatenate(([0], np.cumsum([len(x) for x in docs])))
    got = om.order_minhash(np.array(sum(docs, []), np.int64), off, 3, 2, 4)
    assert [list(map(int, g)) for g in got] == [reference_keys(x, 3, 2, 4) for x in docs]


def test_symbols():
    texts = ["Olá,  mundo! olá", "", "a", "ＯＬÁ mun​do", "--", "c# c++"]
    w, off = om.words(pa.array(texts))
    rows = [w[off[i] : off[i + 1]].tolist() for i in range(len(texts))]
    assert rows[0][0] == rows[0][2] and rows[3] == rows[0][:2] and [len(r) for r in rows] == [3, 0, 1, 2, 0, 2]
    c, off = om.letters(pa.array(texts))
    assert ["".join(map(chr, c[off[i] : off[i + 1]])) for i in range(len(texts))] == ["ola mundo ola", "", "a", "ola mundo", "", "c# c++"]


def test_near_duplicates(spark):
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    rows, want = [], {}
    for g in range(40):
        base = [rnd.choice(vocab) for _ in range(60)]
        for c in range(rnd.randrange(1, 5)):
            t = list(base)
            for _ in range(c):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(t), 0))
            want[len(rows) - 1] = g
    rows += [(900, None, 0), (901, "", 0), (902, "Só uma", 0), (903, "so UMA", 0), (904, "so uma", 1)]
    df = spark.createDataFrame(rows, "id long, t string, scope long").withColumnRenamed("t", "text")
    got = {r.id: r["class"] for r in om.classes(om.near_duplicates(df, "t")).collect()}
    groups = {}
    for i, g in want.items():
        groups.setdefault(g, []).append(i)
    expect = {i: min(v) for v in groups.values() if len(v) > 1 for i in v} | {902: 902, 903: 902}
    assert got == expect
    pairs = {tuple(r) for r in om.pairs_of(spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, class long")).collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3)}
    assert om.near_duplicates(df.limit(0), "e").count() == 0


def test_all_of_a_bucket_are_compared(spark):
    """The smallest id of every bucket is a stranger; the others are two openings of like texts."""
    rnd = np.random.default_rng(3)
    base = [rnd.integers(0, 60000, 50) for _ in range(3)]
    forms = [base[0], base[1], base[1], base[2], base[2], base[1]]
    forms = [f.copy() for f in forms]
    for i, f in enumerate(forms):
        f[i] = 60000 + i
    rows = [(i, [7, 8], f.astype("<u2").tobytes()) for i, f in enumerate(forms)] + [(9, [5], base[1].astype("<u2").tobytes())]
    s = spark.createDataFrame(rows, "id long, keys array<long>, form binary")
    rules, shared = [(0.8, 32)], om.stars(s)
    first = om.verified(shared, s, rules)
    assert first.count() == 0
    for block in (4096, 3, 2, 1):  # a bucket cut into blocks gives the same
        got = {tuple(r) for r in om.remaining(s, shared, first, rules, block).collect()}
        assert got == {(1, 2), (1, 5), (2, 5), (3, 4)}
    linked = spark.createDataFrame([(1, 2), (2, 5)], "a long, b long")
    assert {tuple(r) for r in om.remaining(s, shared, linked, rules).collect()} == {(3, 4)}
    # ids of two kinds: odd ones must be more alike than these are
    twice = s.select((s.id * 2).alias("id"), "keys", "form").union(s.select((s.id * 2 + 1).alias("id"), F.transform("keys", lambda k: k + 100), "form"))
    two = om.stars(twice)
    assert {tuple(r) for r in om.remaining(twice, two, first, [(0.8, 32), (0.999, 32)]).collect()} == {(2, 4), (2, 10), (4, 10), (6, 8)}
    # the same through near_duplicates: a word that all share is the only key
    for c in range(5000):
        texts = [f"c{c} " + " ".join(f"w{x}" for x in f) for f in forms]
        w, off = om.words(pa.array(texts))
        if len(set(om.order_minhash(w, off, 1, 1, 1).ravel().tolist())) == 1:
            break
    else:
        raise AssertionError("no common key")
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "id long, text string, scope long")
    links = om.near_duplicates(df, "b", k=1, ell=1, m=1)
    assert {(r.id, r["class"]) for r in om.classes(links).collect()} == {(1, 1), (2, 1), (5, 1), (3, 3), (4, 3)}


def test_buckets_are_brute_force():
    """The alike pairs of a bucket, over batches cut anywhere."""
    rnd = np.random.default_rng(5)
    forms = [rnd.integers(0, 8, rnd.integers(1, 30)).astype("<u2") for _ in range(90)]
    key = np.sort(rnd.integers(0, 6, 90))
    b = pa.record_batch([pa.array(key), pa.array([-1] * 90), pa.array(range(90)), pa.array(range(90)), pa.array([f.tobytes() for f in forms])], names=["group", "side", "id", "part", "form"])
    i, j = np.triu_indices(90, 1)
    i, j = i[key[i] == key[j]], j[key[i] == key[j]]
    sim = om.banded_similarity([forms[x].astype(np.int32) for x in i], [forms[x].astype(np.int32) for x in j], 40)
    want = {(int(x), int(y)) for x, y, z in zip(i, j, sim, strict=True) if z >= 0.7}
    for size in (1, 7, 90):
        got = [p for r in om._compared(iter([b.slice(x, size) for x in range(0, 90, size)]), [(0.7, 40)]) for p in zip(*map(pa.Array.to_pylist, r.columns), strict=True)]
        assert len(got) == len(set(got)) and want and want == set(got)


def test_buckets_of_two_are_settled(spark):
    """The only pair of a bucket of two rows is its star; a bucket of three is looked at again, so its rest is linked."""
    rows = [(1, [10, 20], b"\1\0\2\0"), (2, [10], b"\7\0\x08\0"), (3, [20], b"\3\0\4\0"), (4, [20], b"\3\0\4\0")]
    sketches = spark.createDataFrame(rows, "id long, keys array<long>, form binary")
    met = om.stars(sketches)
    assert {(r.a, r.b): r["keys"] for r in met.collect()} == {(1, 2): [], (1, 3): [20], (1, 4): [20]}
    assert {(r.a, r.b) for r in om.linked(sketches, "two", [(0.8, 8)]).collect()} == {(3, 4)}


def test_profiles_rule_out_no_alike_pair(spark):
    """Equal hashes are equal words; bits deny only pairs that aren't alike."""
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(60)}" for _ in range(40)]
    texts = ["", "--", "Olá mundo", "ola  MUNDO"] + [" ".join(rnd.choice(base) if rnd.random() < 0.4 else w for w in base[: rnd.randrange(1, 41)]) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    p = om.profiles(rows)
    own = {r.id: r for r in p.collect()}
    assert set(own) == set(range(2, 64)) and (own[2].h1, own[2].h2) == (own[3].h1, own[3].h2) and len({r.h1 for r in own.values()}) == len({tuple(texts[i].lower().replace("á", "a").split()) for i in own})
    a, b = (p.select(F.col("id").alias(s), F.col("size").alias(f"size_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab")
    x = a.crossJoin(b).where("a < b")
    alike = {tuple(r) for r in om.verified(x.select("a", "b"), om.forms(rows), [(0.65, 40)]).collect()}
    may = {(r.a, r.b) for r in x.where(om.may_be_alike("a", "b", 0.65)).collect()}
    assert alike and alike <= may and len(may) < x.count()


def test_counts_rule_out_strangers_only(spark):
    """What is ruled out before a text is moved is never a pair that is alike; most strangers are."""
    rnd = np.random.default_rng(11)
    base = rnd.integers(0, 65536, (6, 120))
    forms = [np.where(rnd.random(120) < rnd.random() * 0.5, rnd.integers(0, 65536, 120), base[i % 6])[: rnd.integers(1, 121)].astype("<u2") for i in range(60)] + [np.full(9, 7, "<u2"), np.full(8, 7, "<u2"), np.full(3, 7, "<u2")]
    s = spark.createDataFrame([(i, f.tobytes()) for i, f in enumerate(forms)], "id long, form binary")
    x = s.select(F.col("id").alias("a")).crossJoin(s.select(F.col("id").alias("b"))).where("a < b")
    rules = [(0.65, 32), (0.9, 32)]  # odd ids must be more alike
    alike = {tuple(r) for r in om.verified(x, s, rules).collect()}
    may = {tuple(r) for r in om.possible(x, s, rules).collect()}
    assert (60, 61) in alike and (60, 62) not in may and len(alike) > 30
    assert alike <= may and len(may - alike) < 0.2 * (x.count() - len(alike))
    assert om.possible(x.limit(0), s, rules).count() == 0


def test_all_of_a_scope_are_compared(spark):
    """No sketch is asked in a small scope: these two share no key. Larger scopes are left to the sketches."""
    texts = ["Inglês avançado, com entrevista nesse idioma", "Ingles avançado, em geral com entrevista nesse idioma"]
    rows = [(4, texts[0], 1), (8, texts[1], 1), (8, texts[1], 1), (12, "Outra coisa", 1), (16, texts[0], 2), (20, None, 1), (24, "--", 1), (28, texts[0], None)]
    rows += [(100 + i, texts[0], 3) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, text string, scope long")
    assert om.linked(om.sketched(df.where("scope = 1"), "letters", 4, 2, 12), "s", [(0.8, 16)]).count() == 0
    links, rest = om.linked_in_scopes(df, "letters", [(0.8, 16)], most=5)
    assert {tuple(r) for r in rest.collect()} == {(4, texts[0], 1), (8, texts[1], 1), (12, "Outra coisa", 1), (24, "--", 1)}
    assert {tuple(r) for r in links.collect()} == {(100 + i, 100 + j) for i in range(5) for j in range(i + 1, 5)}
    links, rest = om.linked_in_scopes(df, "letters", [(0.8, 16)], most=6)
    assert rest.count() == 0 and {(4, 8)} == {tuple(r) for r in links.where("a < 100").collect()} and links.count() == 11


def test_smallest_ids_are_not_compared_again(spark):
    """A bucket's smallest id has met all others as a star, so only the others are looked at, and only if their classes differ."""
    f = b"\1\0\2\0"
    s = spark.createDataFrame([(i, [5], f) for i in (1, 2, 3)] + [(i, [6], f) for i in (4, 5, 6)], "id long, keys array<long>, form binary")
    met = om.stars(s)
    links = spark.createDataFrame([(5, 6)], "a long, b long")
    assert {tuple(r) for r in om.remaining(s, met, links, [(0.8, 8)]).collect()} == {(2, 3)}
