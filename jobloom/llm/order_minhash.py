"""Problem 3: near-duplicate records with small edits, by Order MinHash and banded alignment.

A text is a row of symbols (word hashes or code points). Its k-mers are labelled by occurrence; each of m hash
functions picks the `ell` smallest and keeps them in text order, which makes a bucket key. Texts that share a bucket
are linked to the bucket's smallest id (a star), each link is verified by an alignment inside a band of diagonals, and
verified links close to classes through connected components. Texts of a bucket that are still in different classes are
then all compared, so a smallest id that belongs elsewhere costs no link. Large buckets are compared in blocks.

`ell` decides how many strangers meet: of texts made of common sentences, two share one k-mer often and three in the
same order seldom, so three k-mers and more keys find the same links as two at a fraction of the comparisons.

Sketches are computed by array operations over whole Arrow batches; alignment loops over the symbols of the longest
text of 128 pairs. Symbols are compared by 16 bits of their hash: two different words of a pair pass for equal once in
65,536, which moves a similarity by less than a word. Null and empty texts have no sketch and no class; texts shorter
than k have one k-mer; equal texts share every bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.lookalikes import fold_tables
from jobloom.llm.plain_form import code_points
from jobloom.operators.components import connected_components
from jobloom.session import staged

TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
LOW = np.uint64((1 << 20) - 1)  # places in a text of up to a million k-mers; longer ones take more bits


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of uint64 over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(symbols: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(labelled k-mer hashes of all texts, bounds): in text order, labelled by occurrence inside their text."""
    lens = np.diff(off)
    padded = np.maximum(lens, k)
    start = np.concatenate(([0], np.cumsum(padded)))
    s = np.full(start[-1], 0x9E3779B97F4A7C15, np.uint64)  # a text shorter than k is filled up
    doc = np.repeat(np.arange(len(lens)), lens)
    s[np.arange(len(symbols)) - off[:-1][doc] + start[:-1][doc]] = mix(symbols.astype(np.uint64) + np.uint64(1))
    h = np.zeros(len(s), np.uint64)
    for j in range(k):
        h[: len(s) - j] += s[j:] * np.uint64(pow(0x100000001B3, j + 1, 1 << 64))
    count = padded - k + 1
    bounds = np.concatenate(([0], np.cumsum(count)))
    owner = np.repeat(np.arange(len(lens)), count)
    h = mix(h[np.arange(bounds[-1]) - bounds[:-1][owner] + start[:-1][owner]])
    tied = h ^ mix(owner.astype(np.uint64) + np.uint64(7))
    order = np.sort(tied)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if len(twice):
        # few k-mers occur twice in a text: those that may, by their top bits, are looked at
        may = np.zeros(1 << 16, bool)
        may[twice >> np.uint64(48)] = True
        at = np.flatnonzero(may[tied >> np.uint64(48)])
        own = tied[at]
        by = np.argsort(own, kind="stable")
        same = np.concatenate(([False], own[by][1:] == own[by][:-1]))
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
        h[at[by]] += run.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h, bounds


def order_minhash(symbols: np.ndarray, off: np.ndarray, k: int, ell: int, m: int, seed: int = 1) -> np.ndarray:
    """Bucket keys [texts, m] (int64)."""
    h, bounds = kmers(symbols, off, k)
    n, starts = len(off) - 1, bounds[:-1]
    keys = np.empty((n, m), np.uint64)
    if not n:
        return keys.view(np.int64)
    count = np.diff(bounds)
    # the low bits of an order hold the place in the text, so the minimum says where it is
    bits = np.maximum(LOW, np.uint64((1 << int(count.max()).bit_length()) - 1))
    place = (np.arange(len(h)) - np.repeat(starts, count)).astype(np.uint64)
    at = np.empty((n, ell), np.int64)
    for t in range(m):
        c = (seed * 1000003 + t) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        v = (h ^ np.uint64(c)) * np.uint64((c >> 7) * 2 + 1 & 0xFFFFFFFFFFFFFFFF)  # h is mixed, so this orders well enough
        v = v & ~bits | place
        for r in range(ell):
            first = (np.minimum.reduceat(v, starts) & bits).astype(np.int64)
            at[:, r] = starts + np.where(first < count, first, 0)  # a text of fewer k-mers repeats its first
            v[at[:, r]] = TOP
        at.sort(axis=1)
        key = np.full(n, t + 1, np.uint64)
        for r in range(ell):
            key = mix(key * np.uint64(0x100000001B3) + h[at[:, r]])
        keys[:, t] = key
    return keys.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How many symbols (below 2 ** 16) two rows share, counted with repetition: no alignment can match more. a and b
    hold the rows one after another."""
    n = len(na)
    ka, ca = np.unique(np.repeat(np.arange(n), na) << 16 | a, return_counts=True)
    kb, cb = np.unique(np.repeat(np.arange(n), nb) << 16 | b, return_counts=True)
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    return np.bincount(ka[i] >> 16, weights=np.minimum(ca[i], cb[j]), minlength=n)


def banded_similarity(a: list[np.ndarray], b: list[np.ndarray], band: int, least: float = 0.0) -> np.ndarray:
    """2 * LCS / (|a| + |b|) of pairs of symbol rows; the alignment stays within `band` of the diagonals from 0 to the
    difference of lengths. Two empty rows are alike. Pairs that share too few symbols for `least` get 0; common ends
    are counted without alignment."""
    na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.zeros(len(a))
    order = np.lexsort((nb, na))
    for lo in range(0, len(a), 512):
        own = order[lo : lo + 512]
        total = na[own] + nb[own]
        fa, fb = np.concatenate([a[i] for i in own]).astype(np.int64), np.concatenate([b[i] for i in own]).astype(np.int64)
        hope = np.where(total > 0, 2 * overlap(fa, fb, na[own], nb[own]) / np.maximum(total, 1), 1.0)
        out[own[total == 0]] = 1.0
        own = own[(hope >= least) & (total > 0)]
        if not len(own):
            continue
        ma, mb = na[own], nb[own]
        x = np.full((len(own), max(1, ma.max())), -1, np.int32)
        y = np.full((len(own), max(1, mb.max())), -2, np.int32)
        for m, arrays, sizes in ((x, a, ma), (y, b, mb)):
            m[np.arange(m.shape[1]) < sizes[:, None]] = np.concatenate([arrays[i] for i in own])
        # common ends
        k = min(x.shape[1], y.shape[1])
        same = np.concatenate((x[:, :k] == y[:, :k], np.zeros((len(own), 1), bool)), axis=1)
        front = same.argmin(axis=1)
        back_x, back_y = (np.take_along_axis(m, np.maximum(sizes[:, None] - 1 - np.arange(k), 0), 1) for m, sizes in ((x, ma), (y, mb)))
        room = np.minimum(ma, mb) - front
        same = np.concatenate(((back_x == back_y) & (np.arange(k) < room[:, None]), np.zeros((len(own), 1), bool)), axis=1)
        back = same.argmin(axis=1)
        ra, rb = ma - front - back, mb - front - back
        match = (front + back).astype(np.float64)
        rest = np.flatnonzero((ra > 0) & (rb > 0))
        rest = rest[np.argsort(ra[rest], kind="stable")]
        for part in np.array_split(rest, max(1, len(rest) // 128)):
            if len(part):
                match[part] += _aligned(x, y, front, ra, rb, part, band)
        out[own] = 2 * match / (ma + mb)
    return out


def _aligned(x: np.ndarray, y: np.ndarray, front: np.ndarray, ra: np.ndarray, rb: np.ndarray, own: np.ndarray, band: int) -> np.ndarray:
    """Longest common subsequences, inside the band, of what lies between the common ends of some rows of x and y."""
    n, m = int(ra[own].max()), int(rb[own].max())
    u, v = np.arange(n), np.arange(m)
    a = np.where(u < ra[own][:, None], np.take_along_axis(x[own], np.minimum(front[own][:, None] + u, x.shape[1] - 1), 1), -1)
    b = np.where(v < rb[own][:, None], np.take_along_axis(y[own], np.minimum(front[own][:, None] + v, y.shape[1] - 1), 1), -2)
    diff = rb[own] - ra[own]
    below, above = band - min(0, int(diff.min())), band + max(0, int(diff.max()))
    d = np.zeros((len(own), m + 1), np.int32 if m > 30000 else np.int16)
    for i in range(n):
        left, right = max(0, i - below), min(m, i + above + 1)
        if left >= right:
            break
        eq = b[:, left:right] == a[:, i : i + 1]
        d[:, left + 1 : right + 1] = np.maximum(d[:, left + 1 : right + 1], d[:, left:right] + eq)
        np.maximum.accumulate(d[:, left : right + 1], axis=1, out=d[:, left : right + 1])
    return np.where(np.arange(m + 1) <= rb[own][:, None], d, 0).max(axis=1)


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point to its comparison form: plain lower-case letters and digits, 32 for what parts words, 0 for nothing."""
    t = np.full(0x110000, 32, np.uint32)
    for cp in range(0x20000):
        c = chr(cp)
        if c.isalnum():
            low = c.lower()
            t[cp] = ord(low) if len(low) == 1 else cp
    t[0x20000:0x30000] = np.arange(0x20000, 0x30000)
    matching, to = fold_tables()
    for i, c in enumerate(matching):
        d = to[i].lower() if i < len(to) else ""
        t[ord(c)] = 0 if not d else ord(d) if d.isalnum() else 32
    for c in "+#":
        t[ord(c)] = ord(c)
    return t


def _folded(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, their text, whether each starts a word) of the words of all texts, nothing between them."""
    cps, bounds = code_points(a)
    row = np.repeat(np.arange(len(a)), np.diff(bounds))
    c = fold_table()[cps]
    c, row = c[c > 0], row[c > 0]
    own = c != 32
    starts = own.copy()
    starts[1:] &= ~(own[:-1] & (row[1:] == row[:-1]))
    return c[own], row[own], starts[own]


def words(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the folded words of all texts, bounds)."""
    c, row, starts = _folded(a)
    at = np.flatnonzero(starts)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(row[at], minlength=len(a)))))
    if not len(at):
        return np.zeros(0, np.uint64), bounds
    place = np.arange(len(c)) - np.repeat(at, np.diff(np.concatenate((at, [len(c)]))))
    power = np.cumprod(np.full(place.max() + 1, 0x100000001B3, np.uint64))
    return mix(np.add.reduceat(mix(c.astype(np.uint64)) * power[place], at)), bounds


def letters(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the folded texts with single blanks between words, bounds)."""
    c, row, starts = _folded(a)
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    gap = (starts & ~first).astype(np.int64)
    at = np.arange(len(c)) + np.cumsum(gap)
    out = np.full(len(c) + gap.sum(), 32, np.uint64)
    out[at] = c
    return out, np.concatenate(([0], np.cumsum(np.bincount(row, weights=1 + gap, minlength=len(a)).astype(np.int64))))


SYMBOLS = {"words": words, "letters": letters}


def bounded(batches: Iterator[pa.RecordBatch], column: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none holds more than about `most` bytes of text in a column."""
    for b in batches:
        text = b.column(column).cast(pa.large_string())
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset :][: len(b) + 1]
        lo = 0
        while lo < len(b):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def _sketches(batches: Iterator[pa.RecordBatch], symbols_of: str, k: int, ell: int, m: int) -> Iterator[pa.RecordBatch]:
    for b in bounded(batches, 1):
        symbols, off = SYMBOLS[symbols_of](b.column(1))
        full = np.flatnonzero(np.diff(off))  # wordless texts have no sketch
        off = np.concatenate(([0], off[1:][full]))
        scope = np.asarray(b.column(2), dtype=np.int64)[full]
        # 48 bits: keys are what is shuffled most, and two buckets that fall together cost comparisons, not links
        keys = (order_minhash(symbols, off, k, ell, m).view(np.uint64) ^ mix(scope.view(np.uint64))[:, None]) >> np.uint64(16)
        own = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * m), pa.array(keys.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(full)), own, _small(symbols, off)], names=["id", "keys", "form"])


def _small(symbols: np.ndarray, off: np.ndarray) -> pa.Array:
    """The form of texts: 16 bits a symbol."""
    small = (mix(symbols) >> np.uint64(48)).astype("<u2")
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * 2).astype(np.int32)), pa.py_buffer(small)])


def forms(rows: DataFrame, symbols_of: str = "words") -> DataFrame:
    """rows (id long, text) as id and form, for comparing without a search; texts without a word are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1):
            symbols, off = SYMBOLS[symbols_of](b.column(1))
            full = np.flatnonzero(np.diff(off))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(full)), _small(symbols, np.concatenate(([0], off[1:][full])))], names=["id", "form"])

    return rows.select("id", "text").where("text IS NOT NULL").mapInArrow(run, "id long, form binary")


SLOTS = 256


def profiles(rows: DataFrame) -> DataFrame:
    """rows (id long, text) as id, size (words), bits and h1, h2 (128 bits of the row of words); texts without a word are
    left out. bits says for each of SLOTS classes of symbols whether a text has one, and whether it has two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, 1):
            symbols, off = words(b.column(1))
            full = np.flatnonzero(np.diff(off))
            off = np.concatenate(([0], off[1:][full]))
            n, size = len(full), np.diff(off)
            row = np.repeat(np.arange(n), size)
            small = (mix(symbols) >> np.uint64(48)).astype(np.int64)
            count = np.bincount(row * SLOTS + small % SLOTS, minlength=n * SLOTS).reshape(n, SLOTS)
            bits = np.packbits(np.concatenate((count >= 1, count >= 2), axis=1), axis=1).view(np.int64)
            hashes = []
            for base in (0x100000001B3, 0x9E3779B97F4A7C15):
                power = np.cumprod(np.full(size.max() if n else 1, base, np.uint64))
                place = np.arange(len(row)) - np.repeat(off[:-1], size)
                hashes.append(mix(np.add.reduceat(mix(symbols) * power[place], off[:-1])) if n else np.zeros(0, np.uint64))
            own = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (SLOTS // 32)), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(full)), pa.array(size.astype(np.int32)), own, *(pa.array(h.view(np.int64)) for h in hashes)], names=["id", "size", "bits", "h1", "h2"])

    return rows.select("id", "text").where("text IS NOT NULL").mapInArrow(run, "id long, size int, bits array<long>, h1 long, h2 long")


def may_be_alike(a: str, b: str, least: float) -> Column:
    """Whether two profiles, in columns size_a, bits_a, size_b and bits_b, leave it open that their texts are `least`
    alike. What one profile has and the other lacks can't be aligned, so this never says no to a pair that is."""
    only = lambda x, y: sum((F.bit_count(F.col(f"bits_{x}")[i].bitwiseAND(F.bitwise_not(F.col(f"bits_{y}")[i]))) for i in range(SLOTS // 32)), F.lit(0))
    size = {x: F.col(f"size_{x}") for x in (a, b)}
    return F.least(size[a] - only(a, b), size[b] - only(b, a)) >= least / 2 * (size[a] + size[b]) - 1e-9


def sketched(rows: DataFrame, symbols_of: str, k: int, ell: int, m: int) -> DataFrame:
    """rows (id long, text, scope long) as id, keys (m bucket keys) and form (16 bits a symbol). Texts of different
    scope never share a bucket. Rows whose text or scope is null, or whose text has no word, are left out."""
    x = rows.select("id", "text", "scope").where("text IS NOT NULL AND scope IS NOT NULL")
    return x.mapInArrow(lambda it: _sketches(it, symbols_of, k, ell, m), "id long, keys array<long>, form binary")


Rules = list[tuple[float, int]]  # (least similarity, band) by kind; the kind of an id is its rest by their number


def _similar(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not len(b):
            continue
        ids = np.asarray(b.column(0))
        rows = [[np.frombuffer(x, "<u2").astype(np.int32) for x in b.column(i).to_pylist()] for i in (2, 3)]
        ok = np.zeros(len(b), bool)
        for kind, (least, band) in enumerate(rules):
            own = np.flatnonzero(ids % len(rules) == kind)
            if len(own):
                ok[own] = banded_similarity([rows[0][i] for i in own], [rows[1][i] for i in own], band, least) >= least
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["a", "b"])


def stars(sketches: DataFrame) -> DataFrame:
    """(a, b, keys): every text of a shared bucket with the bucket's smallest id, each pair once, with the buckets of
    three rows and more in which they meet: a bucket of two has no other pair to compare. Keys are shuffled once, for the
    smallest ids and for the join with them; most buckets hold one row and end there."""
    # the filter is what the join would add to one side alone, and then the shuffle would be made twice
    x = sketches.select(F.explode("keys").alias("key"), "id").where("key IS NOT NULL AND id IS NOT NULL").repartition("key")
    low = x.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a", "n")
    return x.join(low, "key").where("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.collect_list(F.when(F.col("n") > 2, F.col("key"))).alias("keys"))  # at most m keys


def verified(pairs: DataFrame, sketches: DataFrame, rules: Rules) -> DataFrame:
    """Pairs (a, b) whose aligned similarity is high enough."""
    f = sketches.select("id", "form")
    x = pairs.select("a", "b").join(f.select(F.col("id").alias("b"), F.col("form").alias("form_b")), "b")
    x = x.join(f.select(F.col("id").alias("a"), F.col("form").alias("form_a")), "a").select("a", "b", "form_a", "form_b")
    return x.mapInArrow(lambda it: _similar(it, rules), "a long, b long")


CLASSES = 192
SHIFTS = np.arange(0, 8, 2, dtype=np.uint8)  # four counts of 0 to 3 a byte


def class_counts(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, how many symbols of each of CLASSES classes) of forms."""
    size = np.array([len(x) // 2 for x in raw], np.int64)
    at = np.repeat(np.arange(len(raw)), size) * CLASSES + np.frombuffer(b"".join(raw), "<u2") % CLASSES
    return size, np.bincount(at, minlength=len(raw) * CLASSES).reshape(len(raw), CLASSES)


def possible(pairs: DataFrame, sketches: DataFrame, rules: Rules) -> DataFrame:
    """Pairs (a, b) but for those that a few bytes show not to be alike, without a loss: of a only counts of symbols by
    class, up to three each, are brought to the text of b. So most strangers are told apart before a text is moved."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, count = class_counts(b.column(2).to_pylist())
            packed = np.bitwise_or.reduce(np.minimum(count, 3).astype(np.uint8).reshape(len(b), CLASSES // 4, 4) << SHIFTS, axis=2)
            own = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer((np.arange(len(b) + 1) * (CLASSES // 4)).astype(np.int32)), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size.astype(np.int32)), own], names=["a", "b", "size", "counts"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.array([r[0] for r in rules])
        for b in batches:
            if not len(b):
                continue
            packed = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(len(b), CLASSES // 4, 1)
            one = (packed >> SHIFTS & 3).reshape(len(b), CLASSES).astype(np.int64)
            other_size, other = class_counts(b.column(4).to_pylist())
            size = np.asarray(b.column(2)).astype(np.int64)
            # what one text has and the other lacks can't be aligned; a count of three may be any higher one
            most = np.minimum(size - np.maximum(one - other, 0).sum(axis=1), other_size - np.where(one < 3, np.maximum(other - one, 0), 0).sum(axis=1))
            ok = pa.array(most >= least[np.asarray(b.column(0)) % len(least)] / 2 * (size + other_size) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    f = sketches.select("id", "form")
    x = pairs.select("a", "b").join(f.select(F.col("id").alias("a"), F.col("form").alias("form_a")), "a").select("a", "b", "form_a")
    x = x.mapInArrow(short, "a long, b long, size int, counts binary")
    x = x.join(f.select(F.col("id").alias("b"), F.col("form").alias("form_b")), "b").select("a", "b", "size", "counts", "form_b")
    return x.mapInArrow(held, "a long, b long")


BITS = 1024


BLOCK = 4096  # rows of a bucket that are compared in one task


def signatures(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, signatures) of forms: one bit for each different symbol."""
    size = np.array([len(x) // 2 for x in raw], np.int64)
    bits = np.zeros((len(raw), BITS), bool)
    bits[np.repeat(np.arange(len(raw)), size), np.frombuffer(b"".join(raw), "<u2") % BITS] = True
    return size, np.packbits(bits, axis=1).view(np.uint64)


def _possible(group: np.ndarray, side: np.ndarray, id_: np.ndarray, part: np.ndarray, size: np.ndarray, sign: np.ndarray, least: np.ndarray, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group, different parts and different sides (or no sides, below 0) that may be `least` (by
    kind) alike; rows are sorted by group. A symbol whose bit the other text lacks is not in it, so the bits of one text alone bound
    what both share."""
    n = len(group)
    end = np.searchsorted(group, group, "right")
    count = end - 1 - np.arange(n)
    done = np.concatenate(([0], np.cumsum(count)))
    for lo in range(0, int(done[-1]), most):
        p = np.arange(lo, min(lo + most, int(done[-1])))
        i = np.searchsorted(done, p, "right") - 1
        j = i + 1 + p - done[i]
        need = least[id_[i] % len(least)] / 2 * (size[i] + size[j]) - 1e-9
        ok = (part[i] != part[j]) & ((side[i] < 0) | (side[i] != side[j])) & (np.minimum(size[i], size[j]) >= need)
        i, j, need = i[ok], j[ok], need[ok]
        x, y = sign[i], sign[j]
        only_x, only_y = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
        ok = np.minimum(size[i] - only_x, size[j] - only_y) >= need
        yield i[ok], j[ok]


def _compared(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    """The alike pairs (a, b), a < b, of rows (group, side, id, part, form) sorted by group; a group may span batches and
    is bounded by two blocks."""
    held: list[tuple[np.ndarray, ...]] = []
    least = np.array([r[0] for r in rules])

    def pairs(cols: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        ids, form = cols[2], cols[4]
        for i, j in _possible(*cols[:4], *cols[5:], least):
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            # a pair that shares several buckets of a batch is aligned once
            o = np.lexsort((b, a))
            one = o[np.concatenate(([True], (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])))[: len(o)]]
            cand = pa.RecordBatch.from_arrays([pa.array(a[one]), pa.array(b[one]), pa.array(form[i[one]], pa.binary()), pa.array(form[j[one]], pa.binary())], names=["a", "b", "x", "y"])
            yield from _similar(iter([cand]), rules)

    for batch in batches:
        if not len(batch):
            continue
        raw = batch.column(4).to_pylist()
        form = np.empty(len(raw), object)
        form[:] = raw
        cols = (*(np.asarray(batch.column(i)).astype(np.int64) for i in range(4)), form, *signatures(raw))
        # what the last group has so far waits for the next batch
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if cut:
            yield from pairs(tuple(np.concatenate(c) for c in zip(*held, tuple(c[:cut] for c in cols), strict=True)))
            held = []
        elif held and held[0][0][0] != cols[0][0]:
            yield from pairs(tuple(np.concatenate(c) for c in zip(*held, strict=True)))
            held = []
        held.append(tuple(c[cut:] for c in cols))
    if held:
        yield from pairs(tuple(np.concatenate(c) for c in zip(*held, strict=True)))


def remaining(sketches: DataFrame, met: DataFrame, links: DataFrame, rules: Rules, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: alike texts of one bucket that links leave in different classes; met are the stars, which have
    been verified, so a bucket's smallest id isn't looked at again. Only buckets whose other texts are of several classes
    are. A bucket of more than `block` rows is cut, and every two of its cuts meet in a task of their own. Texts
    are compared where their bucket lies, so no pair is written that isn't a link."""
    parts = staged(classes(links), "star-classes")
    x = met.select("keys", F.col("b").alias("id")).join(parts, "id", "left").select(F.explode("keys").alias("key"), "id", F.coalesce("class", "id").alias("part"))
    # keys are shuffled once, as in stars
    x = x.where("key IS NOT NULL AND id IS NOT NULL").repartition("key")
    mixed = x.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("id").alias("n")).where("low <> high")
    x = x.join(mixed.select("key", F.ceil(F.col("n") / block).cast("int").alias("cuts")), "key").join(sketches.select("id", "form"), "id")
    x = x.withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    group = F.when(F.col("cuts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("cut", "other"), F.greatest("cut", "other")))
    side = F.when(F.col("cut") == F.col("other"), -1).when(F.col("cut") < F.col("other"), 0).otherwise(1)
    x = x.select(group.alias("group"), side.alias("side"), "id", "part", "form").repartition("group").sortWithinPartitions("group")
    return x.mapInArrow(lambda it: _compared(it, rules), "a long, b long").distinct()


def linked(sketches: DataFrame, name: str, rules: Rules) -> DataFrame:
    """(a, b): verified links between the texts of sketches (id, keys, form). Any two that share a bucket and are alike
    are linked, directly or through others."""
    met = staged(stars(sketches), name + "-stars")
    links = staged(verified(possible(met, sketches, rules), sketches, rules), name + "-links")
    return links.union(remaining(sketches, met, links, rules))


def near_duplicates(rows: DataFrame, name: str, symbols_of: str = "words", k: int = 5, ell: int = 3, m: int = 32, least: float = 0.8, band: int = 32) -> DataFrame:
    """(a, b): verified links between near-duplicate rows (id, text, scope), compared by their words or letters."""
    return linked(staged(sketched(rows, symbols_of, k, ell, m), name), name, [(least, band)])


def linked_in_scopes(rows: DataFrame, symbols_of: str, rules: Rules, most: int = 256) -> tuple[DataFrame, DataFrame]:
    """(links, rest): all alike pairs (a, b), a < b, of rows (id long, text, scope long) of one scope of up to `most` rows,
    compared without keys; and the rows of larger scopes, for sketched(). Equal rows count once. Rows whose text or scope
    is null, or whose text has no word, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shaped() -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in bounded(iter([whole]), 1):
                    symbols, off = SYMBOLS[symbols_of](b.column(1))
                    full = np.flatnonzero(np.diff(off))
                    own = b.take(pa.array(full))
                    alone = pa.array(np.full(len(full), -1))
                    form = _small(symbols, np.concatenate(([0], off[1:][full])))
                    yield pa.RecordBatch.from_arrays([own.column(2), alone, own.column(0), own.column(0), form], names=["group", "side", "id", "part", "form"])

        yield from _compared(shaped(), rules)

    x = rows.select("id", "text", "scope").where("id IS NOT NULL AND text IS NOT NULL AND scope IS NOT NULL")
    large = staged(x.groupBy("scope").agg(F.count("*").alias("n")).where(F.col("n") > most).select("scope"), "large-scopes")
    # a scope lies in one task, where its equal rows are found too
    small = x.join(large, "scope", "left_anti").select("id", "text", "scope").repartition("scope").distinct()
    rest = x.join(large, "scope", "left_semi").select("id", "text", "scope").distinct()
    return small.sortWithinPartitions("scope").mapInArrow(run, "a long, b long"), rest


def classes(links: DataFrame) -> DataFrame:
    """(id, class): rows with at least one link and the smallest id they are connected to."""
    return connected_components(links, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("class"))


def pairs_of(members: DataFrame) -> DataFrame:
    """(id_1, id_2), id_1 < id_2: all pairs inside the classes of members (id, class)."""
    a, b = members.select("class", F.col("id").alias("id_1")), members.select("class", F.col("id").alias("id_2"))
    return a.join(b, "class").where("id_1 < id_2").select("id_1", "id_2")
