import random

import numpy as np
import pyarrow as pa

from jobloom.llm import subjects as S

WORDS = {1: ["codigo limpo", "testes unitarios", "arquitetura hexagonal"], 2: ["taxa selic", "bolsa valores", "renda fixa"], 3: ["contrato trabalho", "aviso previo", "ferias vencidas"]}


def make(n, seed):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        own = rnd.sample([1, 2, 3], rnd.choice([1, 1, 1, 2]))
        s = [f"O texto fala de {rnd.choice(WORDS[c])} e depois de {rnd.choice(WORDS[c])} outra vez." for c in own for _ in range(4)]
        s += ["Nada mais a declarar hoje.", "Envie seu currículo até amanhã."]
        rnd.shuffle(s)
        docs.append((i, " ".join(s)))
        labels += [(i, c) for c in own]
    return docs, labels


def test_sentences():
    texts = ["<p>Olá mundo. Ｃódigo limpo 2025!</p>\n- Fim", None, "", "x" * 3, "ab. a", "limpo codigo de limpo codigo"]
    s = S.read(pa.array(texts))
    assert s.owner.tolist() == [0, 0, 0, 3, 5] and s.size.tolist() == [9, 12, 3, 3, 28]
    assert np.bincount(s.of).tolist() == [3, 3, 1, 1, 4]  # words, and neighbours; each once
    words = {w: set(S.read(pa.array([w])).item.tolist()) for w in ("ola", "codigo", "limpo", "fim", "xxx")}
    assert words["codigo"] | words["limpo"] < set(s.item[s.of == 1].tolist()) and set(s.item[s.of == 2].tolist()) == words["fim"]
    assert len(S.read(pa.array([None, ""], pa.string())).owner) == 0


def test_pairs_are_brute_force():
    rnd = np.random.default_rng(1)
    of = np.sort(rnd.integers(0, 9, 60))
    item = np.concatenate([np.sort(rnd.choice(40, (of == k).sum(), replace=False)) for k in range(9)]).astype(np.uint64)
    known = np.arange(0, 40, 2).astype(np.uint64)
    got = [(int(a), int(b)) for i, j in S.paired(item, of, known, 7) for a, b in zip(i, j, strict=True)]
    want = [(a, b) for a in range(60) for b in range(a + 1, 60) if of[a] == of[b] and item[a] % 2 == item[b] % 2 == 0]
    assert got == want


def test_held_out(spark):
    docs, labels = make(160, 1)
    d = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string")
    known = spark.createDataFrame([(i, c, "r") for i, c in labels if i < 100] + [(99, None, "r"), (3, labels[3][1], "s")], "doc_id long, subject_id int, labeler string")
    found, figures = S.subjects(d, known)
    got = {(r.doc_id, r.subject_id) for r in found.collect() if r.doc_id >= 100}
    want = {(i, c) for i, c in labels if i >= 100}
    assert len(got & want) * 2 / (len(got) + len(want)) > 0.95 and figures["f1"] > 0.9 and figures["rules"] > 5


def test_rules_are_brute_force(spark):
    """Rules of one and two items, mined step by step over sentences."""
    docs, labels = make(60, 2)
    rnd = random.Random(4)
    docs = [(i, t + " " + " ".join(f"{rnd.choice(['banco', 'risco', 'prazo'])} {rnd.choice(['alto', 'baixo'])} {rnd.choice(['caixa', 'meta'])}." for _ in range(12))) for i, t in docs]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = S.mine(S.labelled(d, spark.createDataFrame(labels, "doc_id long, subject_id int"), 1000))["all"]
    of = {}
    for i, c in labels:
        of.setdefault(i, []).append(c)
    rows, holds = [], {}
    for i, t in docs:
        if len(of[i]) == 1:
            s = S.read(pa.array([t]))
            sentences = {int(p): frozenset(s.item[s.of == k].tolist()) for k, p in enumerate(s.print)}
            rows += [(x, of[i][0]) for x in sentences.values()]
            for x in set().union(*sentences.values()):
                holds.setdefault(x, {}).setdefault(of[i][0], set()).add(i)
    size = {c: sum(v == [c] for v in of.values()) for c in (1, 2, 3)}
    told = set()
    for x, by in holds.items():
        n = sum(map(len, by.values()))
        if n >= 3 and max(len(v) / size[c] for c, v in by.items()) * sum(size.values()) / n >= 2:
            told.add(x)

    def sure(body, least=3):
        n = [c for x, c in rows if body <= x]
        c = max(set(n), key=lambda k: (n.count(k), k)) if n else 0
        return (c, n.count(c) / (len(n) + 1)) if n and n.count(c) >= least and n.count(c) / (len(n) + 1) >= 0.55 else None

    single = {x: r for x in told if (r := sure({x}))}
    assert dict(zip(got.item.tolist(), got.item_subject.tolist(), strict=True)) == {x: c for x, (c, _) in single.items()}
    pairs = {frozenset((a, b)) for x, _ in rows for a in x & told for b in x & told if a < b}
    want = {}
    for p in pairs:
        r = sure(p, S.PAIR_LEAST)
        if r and not any(single.get(x, (0, 0))[0] == r[0] and single[x][1] >= r[1] for x in p):
            a, b = (np.array([x], np.uint64) for x in p)
            want[int(S._pair_hash(a, b)[0])] = r[0]
    assert dict(zip(got.pair.tolist(), got.pair_subject.tolist(), strict=True)) == want


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "texto qualquer")], "doc_id long, text string")
    found, figures = S.subjects(d, spark.createDataFrame([], "doc_id long, subject_id int"))
    assert found.count() == 0 and figures["rules"] == 0
