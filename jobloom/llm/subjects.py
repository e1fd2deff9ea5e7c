"""Problem 9: the subjects of a document, by class-association rules.

Transactions are the sentences of labelled documents of one subject: their words, pairs of neighbouring words and the
subject. Parallel frequent-pattern growth mines bodies of one and two items: every transaction is sent, for each of its
items, as that item's conditional transaction (the items before it), and the conditional counts are grown where they
are frequent. A rule goes if a part of its body is as sure of the same subject. Every sentence of every document is
scored by the evidence (log odds) of the rules it matches; the share of text whose sentences speak for a subject is the
document's evidence for it. The evidence from which a sentence speaks for a subject, and the share from which a subject
counts, are calibrated on labelled documents that the rules haven't seen.

An item that means one subject wherever it occurs is grown no further: a longer body can't be surer, so its rules would
all go as redundant. No other item is left out of a sentence.

Items are 64-bit hashes; all work on sentences is array operations over whole Arrow batches. Labelled documents: at most
`sample` of them, the smallest by a hash of their id (a documented bound); everything else reads all documents and whole
texts. Null and empty texts have no subject.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.order_minhash import bounded, fold_table, mix
from jobloom.llm.plain_form import code_points
from jobloom.session import staged

SAMPLE = 12_000
HELD_OUT = 4  # one labelled document of so many calibrates, the others are mined
LEAST, SURE, LIFT = 3, 0.55, 2.0
PAIR_LEAST = 8  # of the many pairs of items, some keep to one subject by chance in a few sentences
FLOORS = (1.5, 2.0, 1.0, 2.5)
TOP_RULES = 4
P = np.uint64(0x100000001B3)


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """Code point to its comparison form: letters, 32 between words, 10 between sentences, 0 for nothing."""
    t = fold_table().copy()
    t[(t >= 48) & (t <= 57)] = 32
    for c in ".!?;:\n\r•|":
        t[ord(c)] = 10
    for c in "+#":
        t[ord(c)] = 32
    return t


@dataclass
class Sentences:
    """Sentences of more than two characters of a batch: owner (place of the document) and size (characters, single
    blanks between words), and their items: item, of (the sentence), each once a sentence and sorted by sentence."""

    owner: np.ndarray
    size: np.ndarray
    print: np.ndarray
    item: np.ndarray
    of: np.ndarray


def read(texts: pa.Array) -> Sentences:
    """The sentences of texts, markup and digits left out. Items are words of three letters or more and pairs of
    neighbours among them."""
    texts = pc.replace_substring_regex(texts.cast(pa.large_string()), pattern="<[^<>]*>", replacement="\n")
    cps, bounds = code_points(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    c = _table()[cps]
    c, doc = c[c > 0], doc[c > 0]
    if not len(c):
        none = np.zeros(0, np.int64)
        return Sentences(none, none, none.view(np.uint64), none.view(np.uint64), none)
    fresh = np.concatenate(([True], doc[1:] != doc[:-1]))
    part = np.cumsum(fresh | (c == 10))  # a sentence by its place among the batch's
    letter = (c != 32) & (c != 10)
    starts = letter.copy()
    starts[1:] &= ~(letter[:-1] & ~fresh[1:])
    c, doc, part, starts = c[letter], doc[letter], part[letter], starts[letter]
    at = np.flatnonzero(starts)
    if not len(at):
        return read(pa.array([], pa.string()))
    length = np.diff(np.concatenate((at, [len(c)])))
    place = np.arange(len(c)) - np.repeat(at, length)
    power = np.cumprod(np.full(place.max() + 1, P, np.uint64))
    word = mix(np.add.reduceat(mix(c.astype(np.uint64)) * power[place], at))
    doc, part = doc[at], part[at]
    # sentences, numbered as they come
    new = np.concatenate(([True], part[1:] != part[:-1]))
    s = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    words = np.diff(np.concatenate((first, [len(s)])))
    size = np.add.reduceat(length, first) + words - 1
    order = np.arange(len(word)) - np.repeat(first, words)
    print_ = np.add.reduceat(mix(word + order.astype(np.uint64) * P), first)
    keep = size > 2
    number = np.cumsum(keep) - 1
    own = keep[s] & (length > 2)
    w, of = word[own], number[s[own]]
    near = np.flatnonzero(of[1:] == of[:-1])
    item = np.concatenate((w, mix(w[near] * P + w[near + 1])))
    of = np.concatenate((of, of[near]))
    o = np.lexsort((item, of))
    item, of = item[o], of[o]
    one = np.concatenate(([True], (item[1:] != item[:-1]) | (of[1:] != of[:-1])))[: len(item)]
    return Sentences(doc[first][keep], size[keep], print_[keep], item[one], of[one])


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, subjects, fold): labelled documents, at most `sample`; no subject at all gives an empty array."""
    own = labels.groupBy("doc_id").agg(F.array_sort(F.collect_set("subject_id")).alias("subjects"))  # few labels a document
    keep = own.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(sample)
    x = docs.join(keep, "doc_id").select("doc_id", "text", "subjects", F.pmod("_h", F.lit(HELD_OUT)).cast("int").alias("fold"))
    return staged(x, "labelled")


def _once(s: Sentences, subject: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item, of, subject, train) of the items of sentences, a sentence that its document repeats only once."""
    _, one = np.unique(np.stack((s.owner.astype(np.uint64), s.print)), axis=1, return_index=True) if len(s.owner) else (None, np.zeros(0, np.int64))
    keep = np.zeros(len(s.owner), bool)
    keep[one] = True
    ok = keep[s.of]
    item, of = s.item[ok], s.of[ok]
    return item, of, subject[s.owner[of]], train[s.owner[of]]


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    o = np.lexsort(keys[::-1])
    keys = [k[o] for k in keys]
    new = np.zeros(len(o), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[o], at) if len(at) else v[:0] for v in values]


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names)


COUNTS = ["all", "train", "all_docs", "train_docs"]


def item_counts(one: DataFrame) -> DataFrame:
    """(item, subject, all, train, all_docs, train_docs): sentences and documents of rows (text, subject, train) that
    hold an item; train counts those of rows with train = 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 0):
            s = read(b.column(0))
            subject, train = (np.asarray(b.column(i)).astype(np.int64) for i in (1, 2))
            item, of, c, t = _once(s, subject, train)
            doc = s.owner[of]
            (item_d, _, c_d, t_d), _ = _summed([item, doc.astype(np.int64), c, t], [t])
            keys = [np.concatenate((item, item_d)), np.concatenate((c, c_d))]
            none, none_d, ones, ones_d = np.zeros_like(t), np.zeros_like(t_d), np.ones_like(t), np.ones_like(t_d)
            values = [np.concatenate(x) for x in ((ones, none_d), (t, none_d), (none, ones_d), (none, t_d))]
            keys, values = _summed(keys, values)
            yield _batch(["item", "subject", *COUNTS], [*keys, *values])

    x = one.select("text", "subject", "train").mapInArrow(run, "item long, subject long, all long, train long, all_docs long, train_docs long")
    return x.groupBy("item", "subject").agg(*(F.sum(c).alias(c) for c in COUNTS))


def grown(one: DataFrame, items: np.ndarray) -> DataFrame:
    """(i, j, subject, all, train): how many sentences hold two of the items (sorted), by subject."""
    shared = one.sparkSession.sparkContext.broadcast(items)  # bounded by the sample of labelled documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in bounded(batches, 0):
            s = read(b.column(0))
            subject, train = (np.asarray(b.column(i)).astype(np.int64) for i in (1, 2))
            item, of, c, t = _once(s, subject, train)
            for i, j in paired(item, of, known):
                keys, values = _summed([item[i], item[j], c[i]], [np.ones(len(i), np.int64), t[i]])
                yield _batch(["i", "j", "subject", "all", "train"], [*keys, *values])

    x = one.select("text", "subject", "train").mapInArrow(run, "i long, j long, subject long, all long, train long")
    return x.groupBy("i", "j", "subject").agg(F.sum("all").alias("all"), F.sum("train").alias("train"))


def paired(item: np.ndarray, of: np.ndarray, known: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i before j, of two known items of one sentence; items are sorted by sentence, then hash."""
    at = np.flatnonzero(_find(known, item) >= 0)
    own = of[at]
    end = np.searchsorted(own, own, "right")
    done = np.concatenate(([0], np.cumsum(end - 1 - np.arange(len(at)))))
    for lo in range(0, int(done[-1]), most):
        p = np.arange(lo, min(lo + most, int(done[-1])))
        i = np.searchsorted(done, p, "right") - 1
        yield at[i], at[i + 1 + p - done[i]]


def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in a sorted table, -1 for none."""
    if not len(table):
        return np.full(len(x), -1)
    i = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[i] == x, i, -1)


@dataclass
class Rules:
    """Rules of one item (item, subject, weight), sorted by item, and of two (pair: a hash of both, sorted)."""

    item: np.ndarray
    item_subject: np.ndarray
    item_weight: np.ndarray
    members: np.ndarray
    pair: np.ndarray
    pair_subject: np.ndarray
    pair_weight: np.ndarray
    floor: float = 1.0  # evidence from which a sentence speaks for a subject

    def __len__(self) -> int:
        return len(self.item) + len(self.pair)


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(np.minimum(a, b) * P + mix(np.maximum(a, b)))


def _weight(conf: np.ndarray, freq: np.ndarray) -> np.ndarray:
    p = np.minimum(np.minimum(conf, freq / (freq + 1.0)), 0.995)
    return np.log(p / (1 - p)) + 0.2


def mine(known: DataFrame, sets: tuple[str, ...] = ("all", "train")) -> dict[str, Rules]:
    """Rules from labelled rows (text, subjects, fold): of documents of one subject, all or those of fold 1 and up."""
    one = known.where("size(subjects) = 1").select("text", F.col("subjects")[0].cast("long").alias("subject"), (F.col("fold") > 0).cast("int").alias("train"))
    docs = {(r.subject, r.train): r.n for r in one.groupBy("subject", "train").agg(F.count("*").alias("n")).collect()}  # one row a subject
    counted = staged(item_counts(one), "item-counts")
    told = {}
    for s in sets:
        size = {c: sum(n for (d, t), n in docs.items() if d == c and (s == "all" or t)) for c in {d for d, _ in docs}}
        total = sum(size.values())
        of = F.create_map(*[F.lit(x) for c, n in size.items() for x in (c, max(n, 1))]) if size else F.create_map(F.lit(0), F.lit(1))
        x = counted.groupBy("item").agg(
            F.sum(s).alias("n"), F.sum(s + "_docs").alias("docs"), F.max(F.col(s + "_docs") / F.try_element_at(of, F.col("subject").cast("int" if not size else "long"))).alias("best"),
            F.max(F.struct(s, "subject")).alias("top"))
        x = x.where((F.col("docs") >= LEAST) & (F.col("best") * total / F.col("docs") >= LIFT))
        rows = x.select("item", "n", F.col("top.subject").alias("subject"), F.col(f"top.{s}").alias("freq")).collect()  # bounded by the sample of labelled documents
        a = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 4)
        told[s] = (a[:, 0].view(np.uint64).copy() if len(a) else np.zeros(0, np.uint64), a[:, 1], a[:, 2], a[:, 3])
    # an item that only one subject uses can't gain by another
    mixed = np.unique(np.concatenate([i[n > f] for i, n, _, f in told.values()]))
    pairs = staged(grown(one, mixed), "item-pairs") if len(mixed) else None
    out = {}
    for s in sets:
        item, n, subject, freq = told[s]
        o = np.argsort(item)
        item, n, subject, freq = item[o], n[o], subject[o], freq[o]
        conf = freq / (n + 1.0)
        sure = (conf >= SURE) & (freq >= LEAST)
        single = np.where(sure, conf, 0.0)
        i = j = c = f = conf2 = np.zeros(0, np.int64)
        if pairs is not None:
            x = pairs.groupBy("i", "j").agg(F.sum(s).alias("n"), F.max(F.struct(s, "subject")).alias("top"))
            x = x.where((F.col(f"top.{s}") >= PAIR_LEAST) & (F.col(f"top.{s}") / (F.col("n") + 1) >= SURE))
            rows = x.select("i", "j", "n", F.col("top.subject").alias("subject"), F.col(f"top.{s}").alias("freq")).collect()  # bounded by the sample of labelled documents
            a = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 5)
            i, j, c, f, conf2 = a[:, 0].view(np.uint64), a[:, 1].view(np.uint64), a[:, 3], a[:, 4], a[:, 4] / (a[:, 2] + 1.0)
            ok = np.ones(len(a), bool)
            for side in (i, j):
                at = _find(item, side)
                # redundant: a part of the body is as sure of the same subject
                ok &= (at >= 0) & ~((single[at] >= conf2) & (subject[at] == c))
            i, j, c, f, conf2 = i[ok], j[ok], c[ok], f[ok], conf2[ok]
        w, w2 = _weight(conf, freq), _weight(conf2, f)
        sure, sure2 = sure & (w > 0), w2 > 0
        pair = _pair_hash(i[sure2], j[sure2]) if len(i) else np.zeros(0, np.uint64)
        o = np.argsort(pair)
        members = np.unique(np.concatenate((i[sure2], j[sure2]))).astype(np.uint64)
        out[s] = Rules(item[sure], subject[sure], w[sure], members, pair[o], c[sure2][o], w2[sure2][o])
    return out


def speaks_for(s: Sentences, rules: Rules) -> np.ndarray:
    """The subject each sentence speaks for, 0 for none: the evidence for a subject is the sum of its surest rules."""
    hit = _find(rules.item, s.item)
    of, subject, weight = [s.of[hit >= 0]], [rules.item_subject[hit[hit >= 0]]], [rules.item_weight[hit[hit >= 0]]]
    for i, j in paired(s.item, s.of, rules.members):
        at = _find(rules.pair, _pair_hash(s.item[i], s.item[j]))
        ok = at >= 0
        of.append(s.of[i[ok]])
        subject.append(rules.pair_subject[at[ok]])
        weight.append(rules.pair_weight[at[ok]])
    of, subject, weight = np.concatenate(of), np.concatenate(subject), np.concatenate(weight)
    out = np.zeros(len(s.owner), np.int64)
    if not len(of):
        return out
    o = np.lexsort((-weight, subject, of))
    of, subject, weight = of[o], subject[o], weight[o]
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (subject[1:] != subject[:-1])))
    at = np.flatnonzero(new)
    rank = np.arange(len(of)) - np.repeat(at, np.diff(np.concatenate((at, [len(of)]))))
    score = np.add.reduceat(np.where(rank < TOP_RULES, weight, 0.0), at)
    of, subject = of[at], subject[at]
    o = np.lexsort((-subject, -score, of))
    of, subject, score = of[o], subject[o], score[o]
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    last = np.concatenate((first[1:], [len(of)]))
    second = np.where(last - first > 1, score[np.minimum(first + 1, len(score) - 1)], -np.inf)
    ok = (score[first] > rules.floor) & (score[first] > second + 0.5)
    out[of[first[ok]]] = subject[first[ok]]
    return out


def score(rows: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, subject_id, share) of documents (doc_id, text) for every subject with evidence: the share of text whose
    sentences speak for it."""
    shared = rows.sparkSession.sparkContext.broadcast(rules)  # bounded by the sample of labelled documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1):
            s = read(b.column(1))
            subject = speaks_for(s, shared.value)
            size = np.bincount(s.owner, weights=s.size, minlength=len(b))
            own = subject > 0
            (doc, c), (n,) = _summed([s.owner[own], subject[own]], [s.size[own]])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(c, pa.int32()), pa.array(n / size[doc], pa.float64())], names=["doc_id", "subject_id", "share"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, subject_id int, share double")


def calibrate(scored: DataFrame, truth: DataFrame) -> tuple[float, float]:
    """(share, F1): the share from which a subject counts that is best by F1 on held-out documents (doc_id,
    subjects)."""
    t = truth.select("doc_id", F.explode("subjects").alias("subject_id")).withColumn("yes", F.lit(1))
    x = scored.join(t, ["doc_id", "subject_id"], "full_outer").select(F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("yes", F.lit(0)).alias("yes"))
    got = np.array([(r.share, r.yes) for r in x.collect()], float).reshape(-1, 2)  # bounded by the sample of labelled documents
    best = (0.2, 0.0)
    for cut in np.arange(0.08, 0.42, 0.01):
        hit = got[:, 0] >= cut
        tp = (hit & (got[:, 1] > 0)).sum()
        f1 = 2 * tp / max(1, hit.sum() + (got[:, 1] > 0).sum())
        if f1 > best[1] + 1e-9:
            best = (float(cut), float(f1))
    return best


def subjects(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict]:
    """((doc_id, subject_id, share) of all documents (doc_id, text), figures): figures hold the held-out F1, the share
    from which a subject counts and the number of rules."""
    known = labelled(docs, labels, sample)
    test = known.where("fold = 0")
    rules = mine(known)
    tried = [(*calibrate(score(test, replace(rules["train"], floor=floor)), test), floor) for floor in FLOORS]
    cut, f1, floor = max(tried, key=lambda x: x[1])
    found = score(docs.select("doc_id", "text"), replace(rules["all"], floor=floor)).where(F.col("share") >= cut)
    return found, {"f1": f1, "share": cut, "floor": floor, "rules": len(rules["all"])}
