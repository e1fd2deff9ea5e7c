"""Problem 1: variant spellings of company names.

A spelling is read into its line of business (from a nickname table of full and shortened words, typos allowed) and its
own words, sorted. Own words are blocked by phonetic codes, compared by Jaro-Winkler, and accepted pairs of spellings
become the edges of a graph whose connected components are the firms. Spellings typed by people (many) are compared
with stored names (few) first; only those that none explains are compared with each other.

Null, blank and placeholder names belong to no firm. A spelling without a line of business belongs to a firm only if
all its stored look-alikes are compatible; equal spellings are one node.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.lookalikes import fold
from jobloom.operators.components import connected_components
from jobloom.session import staged

# Words for a line of business and how they are shortened.
BUSINESS = {
    "analytics": "", "asset": "", "banco": "bco b bank", "bolsa": "", "camara": "", "cambio": "camb", "capital": "cap",
    "cartoes": "cart cartao", "consorcio": "consorc csc cons.", "consultoria": "consult cons", "cooperativa": "coop cooperat",
    "corretora": "corret corr", "credito": "cred", "ctvm": "", "dados": "dds", "digitais": "dig digital", "financeira": "fin financ financeiros financeiro",
    "fomento": "", "gestora": "gest", "grupo": "gpo gr", "investimentos": "inv invest", "leasing": "", "liquidacao": "",
    "mercantil": "", "microcredito": "", "pagamentos": "pag pagtos pgtos pagto pgto pagamento pay", "previdencia": "prev previd", "promotora": "",
    "recebiveis": "", "recursos": "", "securitizadora": "sec", "seguradora": "", "seguros": "seg", "servicos": "serv svcs svc servs",
    "sistemas": "sist sis", "solucoes": "sol soluc", "tecnologia": "tec tech tecn tecnol",
}
# Words that say nothing about who a firm is, and entries that name no firm.
LEGAL = frozenset("ltda sa epp me eireli matriz filial oficial brasil br inc llc s a o as os e de da do das dos the".split())
PLACEHOLDERS = frozenset(("", "na", "nd", "nao informado", "nao informada", "confidencial", "empresa confidencial", "sigiloso", "empresa sigilosa",
                          "a definir", "a confirmar", "undisclosed", "confidential", "empresa", "null", "none", "teste", "x", "xxx"))

SHORT = {s.rstrip("."): full for full, ss in BUSINESS.items() for s in [full, *ss.split()]} | {"cons": "consultoria"}
LONG = sorted((w for w in SHORT if len(w) >= 5), key=lambda w: (-len(w), w))
FULL = sorted((w for w in BUSINESS if len(w) >= 5), key=lambda w: (-len(w), w))
LONG_LEGAL = tuple(w for w in sorted(LEGAL) if len(w) >= 6)


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits incl. swaps of neighbours between a and b; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, prev = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, prev = prev, row
    return prev[-1]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    got = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                got.append(x)
                break
    if not got:
        return 0.0
    other = [y for y, t in zip(b, taken, strict=True) if t]
    m, swaps = len(got), sum(x != y for x, y in zip(got, other, strict=True)) / 2
    j = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return j + p * 0.1 * (1 - j)


@lru_cache(maxsize=100_000)
def business_word(w: str) -> str | None:
    """The line of business a word means, typos allowed in long words; '' for a word that says nothing."""
    if w in LEGAL:
        return ""
    if w in SHORT:
        return SHORT[w]
    if len(w) >= 5:
        for f in LONG_LEGAL:
            if edit_distance(w, f, 1) <= 1:
                return ""
        near = [(edit_distance(w, f, 1 if len(f) < 7 else 2), f) for f in LONG if abs(len(f) - len(w)) <= 2]
        near = [(d, f) for d, f in near if d <= (1 if len(f) < 7 else 2) and len(w) >= d * 3]
        if near:
            return SHORT[min(near)[1]]
    return None


def _apart(w: str) -> list[str]:
    """Words typed as one, taken apart at full business and legal words."""
    if len(w) >= 9 and business_word(w) is None:
        for f in FULL:
            if len(w) - len(f) >= 4:
                if w.startswith(f):
                    return [f, *_apart(w[len(f) :])]
                if w.endswith(f):
                    return [*_apart(w[: -len(f)]), f]
        if w.endswith("ltda"):
            return [*_apart(w[:-4]), "ltda"]
    return [w]


def read_name(folded: str) -> tuple[str, str]:
    """(own words, line of business) of a folded spelling, each sorted and joined by blanks."""
    x = re.sub(r"\bs\s*[./]\s*a\b\.?", " ", folded)
    own, business = [], set()
    for w in (y for w in re.split(r"[^a-z0-9]+", x) if w for y in _apart(w)):
        f = business_word(w)
        if f is None:
            own.append(w)
        elif f:
            business.add(f)
    if business > {"grupo"}:
        business.discard("grupo")
    return " ".join(sorted(own)), " ".join(sorted(business))


def phonetic(w: str) -> str:
    """Consonant classes of a word; vowels and h are silent, doubled sounds count once."""
    w = re.sub(r"ph", "f", re.sub(r"(lh|nh)", lambda m: m[0][0], w))
    w = re.sub(r"c(?=[eiy])", "s", w)
    w = re.sub(r"g(?=[eiy])", "j", w)
    w = w.translate(str.maketrans("ckqzxwy", "kkkssvi"))
    w = re.sub(r"[aeiouhy ]", "", w)
    return re.sub(r"(.)\1+", r"\1", w)


def block_keys(own: str) -> list[str]:
    """Phonetic keys of sorted own words: the code of all and of each long word, each also without any one symbol, long
    codes without any two (a slip changes one). Short names have only themselves."""
    keys = {"=" + own}
    for w in {own, *own.split()}:
        if len(w) < 5:
            continue
        code = phonetic(w)
        n = len(code)
        keys |= {"c" + code, *("c" + code[:i] + code[i + 1 :] for i in range(n))}
        if n >= 6:
            keys |= {"c" + code[:i] + code[i + 1 : j] + code[j + 1 :] for i in range(n) for j in range(i + 1, n)}
        keys |= {"b" + w[:5], "e" + w[-5:]}
    return sorted(keys)


def similar(a: str, b: str, least: float) -> float:
    """Jaro-Winkler similarity of own words, in their best order, if they may be one name, else 0."""
    if a == b:
        return 1.0
    n = min(len(a), len(b))
    if n < 5 or re.sub(r"\D", "", a) != re.sub(r"\D", "", b):
        return 0.0
    most = 1 if n < 7 else 2
    words = a.split()
    best = 0.0
    for p in permutations(words) if 1 < len(words) <= 4 else [words]:
        x = " ".join(p)
        s = jaro_winkler(x, b)
        if s > best and s >= least and edit_distance(x, b, most) <= most:
            best = s
    return best


def _pair_up(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(4)]
        keep, score = [], []
        for i, (oa, ba, ob, bb) in enumerate(zip(*cols, strict=True)):
            x, y = set(ba.split()), set(bb.split())
            if (x <= y or y <= x) and (s := similar(oa, ob, least)):
                keep.append(i)
                score.append(s + (0.5 if x == y else 0.25 if x and y else 0))
        yield pa.RecordBatch.from_arrays([*b.take(pa.array(keep, pa.int64())).columns, pa.array(score, pa.float64())], names=["own_a", "biz_a", "own_b", "biz_b", "score"])


def read_names(names: DataFrame, column: str) -> DataFrame:
    """Distinct spellings of a column with own and biz; placeholders and null are left out."""

    def run(batches):
        for b in batches:
            read = [read_name(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in read], pa.string()), pa.array([r[1] for r in read], pa.string())], names=["name", "own", "biz"])

    x = names.select(F.col(column).alias("name")).dropna().distinct()
    glued = F.when(~F.trim("name").contains(" "), F.regexp_replace("name", r"(\p{Ll})(\p{Lu})", "$1 $2")).otherwise(F.col("name"))
    x = x.withColumn("f", fold(glued))
    x = x.where(~F.trim(F.regexp_replace("f", "[^a-z0-9]+", " ")).isin(*PLACEHOLDERS) & ~F.regexp_replace("f", "[^a-z0-9]+", "").isin(*PLACEHOLDERS))
    return x.mapInArrow(run, "name string, own string, biz string").where("own <> ''")


def firms(stored: DataFrame, typed: DataFrame, nicknames: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """(name, stored, own, biz, firm): the spellings of stored (name) and typed (name) that belong to a firm with a
    stored name, or to a firm that at least two typed spellings (of one line of business) name. nicknames (name_a, name_b) are stored names known to mean one firm."""
    s = read_names(stored, "name").withColumn("stored", F.lit(True))
    t = read_names(typed, "name").withColumn("stored", F.lit(False))
    names = staged(s.union(t).groupBy("name").agg(F.first("own").alias("own"), F.first("biz").alias("biz"), F.max("stored").alias("stored")), "names")
    forms = names.groupBy("own", "biz").agg(F.max("stored").alias("stored")).withColumn("form", F.xxhash64("own", "biz"))
    keyed = forms.mapInArrow(_keys, "own string, biz string, stored boolean, form long, key long")
    keyed = staged(keyed, "name-keys")
    a = keyed.where("stored").select("key", F.col("own").alias("own_a"), F.col("biz").alias("biz_a"))
    b = keyed.select("key", F.col("own").alias("own_b"), F.col("biz").alias("biz_b"))
    cand = a.join(b, "key").where("own_a <> own_b OR biz_a <> biz_b").select("own_a", "biz_a", "own_b", "biz_b").distinct()
    schema = "own_a string, biz_a string, own_b string, biz_b string, score double"
    pairs = cand.mapInArrow(lambda it: _pair_up(it, least), schema)
    pairs = pairs.withColumns({"a": F.xxhash64("own_a", "biz_a"), "b": F.xxhash64("own_b", "biz_b")})
    pairs = staged(pairs.join(forms.where("stored").select(F.col("form").alias("b"), F.lit(True).alias("b_stored")), "b", "left"), "name-pairs")
    # a form whose line of business is missing or cut short means one firm only if its fuller look-alikes agree
    fuller = pairs.where("length(biz_a) > length(biz_b)").groupBy("b").agg(F.countDistinct("biz_a").alias("ways"), F.max("score").alias("best"))
    vague = fuller.where("ways > 1").select("b")
    clear = pairs.join(vague, "b", "left_anti")
    vague_a = vague.select(F.col("b").alias("a"))
    edges = clear.where("b_stored").join(vague_a, "a", "left_anti").select("a", "b")
    if nicknames is not None:
        own = names.where("stored").select("name", F.xxhash64("own", "biz").alias("form"))
        n = nicknames.join(own.select(F.col("name").alias("name_a"), F.col("form").alias("a")), "name_a")
        n = n.join(own.select(F.col("name").alias("name_b"), F.col("form").alias("b")), "name_b").select("a", "b")
        edges = edges.union(n)
    lone = forms.where("stored").select(F.col("form").alias("a"), F.col("form").alias("b"))
    parts = staged(connected_components(edges.union(lone), "a", "b"), "firms").withColumnsRenamed({"node": "form", "component": "firm"})
    # each typed form goes to the firm of its best stored look-alike; two firms as good as each other are no answer
    near = pairs.where("b_stored IS NULL").join(parts.withColumnRenamed("form", "a"), "a").groupBy("b", "firm").agg(F.max("score").alias("score"))
    near = near.groupBy("b").agg(F.max_by("firm", "score").alias("firm"), F.max("score").alias("top"), F.collect_list("score").alias("all"))
    near = near.where("size(filter(all, x -> x > top - 0.01)) = 1").select(F.col("b").alias("form"), "firm")
    known = staged(parts.union(near), "known-forms")
    # spellings that no stored name explains are held against each other, so that a firm known from typed names alone is
    # one firm too
    rest = forms.join(known.select("form"), "form", "left_anti").select("own", "biz", "stored", "form")
    rest = staged(rest.mapInArrow(_keys, "own string, biz string, stored boolean, form long, key long"), "unknown-forms")
    a = rest.select("key", F.col("own").alias("own_a"), F.col("biz").alias("biz_a"), F.col("form").alias("a"))
    b = rest.select("key", F.col("own").alias("own_b"), F.col("biz").alias("biz_b"), F.col("form").alias("b"))
    cand = a.join(b, "key").where("a < b").select("own_a", "biz_a", "own_b", "biz_b").distinct()
    same = cand.mapInArrow(lambda it: _pair_up(it, least), schema).where("biz_a = biz_b").select(F.xxhash64("own_a", "biz_a").alias("a"), F.xxhash64("own_b", "biz_b").alias("b"))
    same = staged(same, "unknown-pairs")
    if not same.isEmpty():
        known = known.union(connected_components(same, "a", "b").select(F.col("node").alias("form"), F.col("component").alias("firm")))
    return names.withColumn("form", F.xxhash64("own", "biz")).join(known, "form").select("name", "stored", "own", "biz", "firm")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        keys = [block_keys(x) for x in b.column(0).to_pylist()]
        at = pa.array([i for i, k in enumerate(keys) for _ in k], pa.int64())
        ids = pa.array([xxhash.xxh64_intdigest(k) - (1 << 63) for ks in keys for k in ks], pa.int64())
        yield pa.RecordBatch.from_arrays([*b.take(at).columns, ids], names=["own", "biz", "stored", "form", "key"])


def same_firm_pairs(known: DataFrame) -> DataFrame:
    """(name_1, name_2): pairs of different spellings of a firm of which one at least is stored."""
    a = known.where("stored").select("firm", F.col("name").alias("x"))
    b = known.select("firm", F.col("name").alias("y"))
    p = a.join(b, "firm").where("x <> y")
    return p.select(F.least("x", "y").alias("name_1"), F.greatest("x", "y").alias("name_2")).distinct()
