import random

from jobloom.llm import mixing


def test_exponent():
    nat, tgt = {"a": 900.0, "b": 100.0}, {"a": 0.5, "b": 0.5}
    assert mixing.temperature(nat, tgt, {"a": 4, "b": 4}, 800)[0] == 1.0
    x, b = mixing.temperature(nat, tgt, {"a": 4, "b": 2}, 1000)
    w = mixing.weights(nat, tgt, x)
    assert 0 < x < 1 and abs(w["b"] * b - 200) < 1e-3
    x, _ = mixing.temperature(nat, tgt, {"a": 9, "b": 9}, 100, wished_entropy=0.5)
    assert abs(mixing.entropy(mixing.weights(nat, tgt, x)) - 0.5) < 1e-6
    assert abs(mixing.exact_budget(nat, tgt, {"a": 1, "b": 4}) - 800) < 1e-9


def test_picks():
    assert mixing.picks(10, {7: 2, 3: 5, 2: 1}) == {7: 1, 3: 1} and mixing.picks(1, {2: 9}) == {} and mixing.picks(9, {2: 3, 1: 9}) == {2: 3, 1: 3}


def test_rests_are_filled(spark):
    """Documents too long for what is left must not end the filling: one long document, many short ones."""
    rows = [(i, "a", 1000 if i % 2 else 1 + i % 7) for i in range(400)] + [(i, "b", 50) for i in range(400, 800)]
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 3)], "source string, target_share double, max_repeats int")
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    for budget in (90_001, 150_003, 20_007.0):
        docs, shares = mixing.mix(sized, targets, "doc_id", budget=budget)
        got, s = docs.collect(), {r.source: r for r in shares.collect()}
        for k in "ab":
            assert s[k].used == sum(r.times * r.n_tokens for r in got if r.source == k) <= s[k].wanted
            few = min(r.times for r in got if r.source == k)
            assert not any(r.n_tokens <= s[k].unfilled for r in got if r.source == k and r.times == few < s[k].max_repeats)


def test_mix(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("aaaabc"), rnd.randrange(1, 40)) for i in range(3000)] + [(9000, "z", 5), (9001, None, 5), (9002, "a", None), (9003, "b", 0)]
    targets = [("a", 0.4, 1), ("b", 0.4, 3), ("c", 0.1, 1), ("ghost", 0.1, 2)]
    docs, shares = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, n_tokens long"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), "doc_id")
    d = {r.doc_id: r for r in docs.collect()}
    assert len(d) == len(rows) and d[9000].times == 0 and d[9001].times == 0
    limit = {"a": 1, "b": 3, "c": 1}
    assert all(r.times <= limit.get(r.source, 0) for r in d.values())
    s = {r.source: r for r in shares.collect()}
    for k, q in (("a", 4 / 9), ("b", 4 / 9), ("c", 1 / 9)):
        assert abs(s[k].reached_share - q) < 0.01, (k, s[k])
    assert s["ghost"].used == 0
    # of what is left, no unused document is short enough
    for k in "abc":
        own = [r for r in d.values() if r.source == k and r.n_tokens > 0 and r.times < limit[k]]
        few = min((r.times for r in own), default=0)
        assert 0 <= s[k].unfilled and not any(r.n_tokens <= s[k].unfilled for r in own if r.times == few)
    empty, _ = mixing.mix(spark.createDataFrame([], "doc_id long, source string, n_tokens long"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), "doc_id")
    assert empty.count() == 0
