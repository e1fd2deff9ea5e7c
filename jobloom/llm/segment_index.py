"""Problem 2: each new batch against all history, by a segment index for edit distance.

A text of length L is cut into k + 1 segments of fixed place and length; two texts within k edits share at least one
segment near its place. The index stores one row a segment; a batch probes it with the few substrings that can match,
joins on equality alone, checks the edit distance and is then appended itself.

k is `most` from 16 characters on, 1 from 4 on and 0 below, by the shorter text; so short texts are indexed like long
ones, with fewer segments. Texts are compared inside a block (an exact key); equal texts of a block are one entry, named
by its first arrival. Null texts are no entries. Nothing is capped: every substring that can match is probed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import order_minhash
from jobloom.llm.order_minhash import mix
from jobloom.llm.plain_form import code_points
from jobloom.operators.components import connected_components
from jobloom.session import staged


P = np.uint64(0x100000001B3)
LONG = 16  # characters from which a text may differ in `most` edits


class _Texts:
    """Code points of a batch of texts with rolling hashes, so that any substring's hash costs a few array operations."""

    def __init__(self, batch: pa.RecordBatch):
        names = batch.schema.names
        c, self.bounds = code_points(batch.column(names.index("text")))
        self.block = np.asarray(batch.column(names.index("block")), dtype=np.int64).view(np.uint64)
        self.entry = np.asarray(batch.column(names.index("entry")), dtype=np.int64)
        self.length = np.diff(self.bounds)
        self.power = np.cumprod(np.concatenate(([1], np.full(len(c), P, np.uint64))).astype(np.uint64))
        # prefix sums of c[i] * P ** i; a substring's sum is brought to a common place by multiplying up
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(c.astype(np.uint64)) * self.power[: len(c)])))
        self.n = len(c)

    def keys(self, rows: np.ndarray, start: np.ndarray, size: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
        """Keys of the substrings (start, size) of rows as segment i of a text of some length."""
        at = self.bounds[rows] + start
        own = (self.prefix[at + size] - self.prefix[at]) * self.power[self.n - at] * self.lift
        return mix(own ^ mix(self.block[rows] + mix((length * 64 + i).astype(np.uint64)))).view(np.int64)

    lift = np.uint64(1)


def _rolling(batch: pa.RecordBatch) -> _Texts:
    """Hashes must not depend on the batch: what stands at place p of a batch carries P ** p, and multiplying by
    P ** (n - p) leaves P ** n, which its inverse takes away."""
    t = _Texts(batch)
    t.lift = np.uint64(pow(pow(int(P), -1, 1 << 64), t.n, 1 << 64))
    return t


def _cut(length: np.ndarray, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (from 0) and size of segment i of texts of some lengths, cut into k + 1."""
    n, rest = length // (k + 1), length % (k + 1)
    return i * n + np.maximum(0, i - (k + 1 - rest)), n + (i >= k + 1 - rest)


def _edits(length: np.ndarray, most: int) -> np.ndarray:
    """Edits that may part a text of some length from a text that isn't shorter."""
    return np.where(length >= LONG, most, np.where(length >= 4, min(1, most), 0))


def _emit(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    entries = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(entries)], names=["key", "entry"])


def segments(entries: DataFrame, most: int) -> DataFrame:
    """The index rows of entries (block long, text, entry): key, entry. Keys hash block, length, place and segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = _rolling(b)
            parts = []
            for k in {0, min(1, most), most}:
                rows = np.flatnonzero((_edits(t.length, most) == k) & (t.length > 0))
                length = t.length[rows]
                parts += [(t.keys(rows, *_cut(length, i, k), length, i), t.entry[rows]) for i in range(k + 1)]
            yield _emit(parts)

    return entries.select("block", "text", "entry").mapInArrow(run, "key long, entry long")


def probes(entries: DataFrame, most: int, both_ways: bool) -> DataFrame:
    """The substrings of entries that can equal a segment of a text within `most` edits: key, entry.

    both_ways: against texts of any length; else only against texts that aren't longer (enough for joining a set with
    itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = _rolling(b)
            parts = []
            for delta in range(-most if both_ways else 0, most + 1):  # own length less the other's
                other = t.length - delta
                for k in {0, min(1, most), most}:
                    if abs(delta) > k:
                        continue
                    full = np.flatnonzero((_edits(other, most) == k) & (other > 0))
                    for i in range(k + 1):
                        start, size = _cut(other[full], i, k)
                        lo = np.maximum(0, np.maximum(start - i, start + delta - (k - i)))
                        hi = np.minimum(t.length[full] - size, np.minimum(start + i, start + delta + (k - i)))
                        for step in range(2 * k + 1):
                            ok = lo + step <= hi
                            if not ok.any():
                                break
                            rows = full[ok]
                            parts.append((t.keys(rows, (lo + step)[ok], size[ok], other[rows], i), t.entry[rows]))
            yield _emit(parts)

    return entries.select("block", "text", "entry").mapInArrow(run, "key long, entry long")


def alike(a: Column, b: Column, most: int) -> Column:
    """Within `most` edits, with the same digits, and, where both have as many words, no short word changed and no
    long one by more than two."""
    # the bound first: it settles most pairs, and cheaply
    least = F.least(F.length(a), F.length(b))
    d = F.levenshtein(a, b, most)
    # one comparison, so that the distance is computed once: beyond the bound it is -1, of which the low bits are 255
    near = (F.abs(F.length(a) - F.length(b)) <= most) & (d.bitwiseAND(255) <= F.when(least >= LONG, most).when(least >= 4, min(1, most)).otherwise(0))
    same_digits = F.regexp_replace(a, r"[^0-9]+", " ") == F.regexp_replace(b, r"[^0-9]+", " ")
    x, y = F.split(a, " "), F.split(b, " ")
    close = F.zip_with(x, y, lambda p, q: (p == q) | ((F.least(F.length(p), F.length(q)) >= 4) & (F.levenshtein(p, q, 2) >= 0)))
    return near & same_digits & ((F.size(x) != F.size(y)) | F.forall(close, lambda c: c))


def with_letters(rows: DataFrame) -> DataFrame:
    """rows (entry, open, text, body, scopes) with letters: for each of 32 classes of characters whether the text has one,
    and whether it has two. An edit takes away one of these bits at most and adds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, bounds = code_points(b.column(2))
            row = np.repeat(np.arange(len(b)), np.diff(bounds))
            count = np.bincount(row * 32 + c.astype(np.int64) % 32, minlength=len(b) * 32).reshape(len(b), 32)
            bits = np.packbits(np.concatenate((count >= 1, count >= 2), axis=1), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bits.ravel())], names=[*b.schema.names, "letters"])

    return rows.mapInArrow(run, "entry long, open boolean, text string, body long, scopes array<long>, letters long")


def as_entries(rows: DataFrame) -> DataFrame:
    """rows (block, text, ord) as entries: block, text and entry, the first arrival."""
    return rows.where("block IS NOT NULL AND text IS NOT NULL").groupBy("block", "text").agg(F.min("ord").alias("entry"))


def link_entries(entries: DataFrame, most: int) -> DataFrame:
    """(a, b): all alike entries of a set, each pair once."""
    x = probes(entries, most, False).withColumnRenamed("entry", "a").join(segments(entries, most).withColumnRenamed("entry", "b"), "key")
    x = x.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in "ab":
        x = x.join(entries.select(F.col("entry").alias(side), F.col("text").alias("text_" + side)), side)
    return x.where(alike(F.col("text_a"), F.col("text_b"), most)).select("a", "b")


TABLES = {
    "segments": ("key", "key BIGINT, entry BIGINT"),
    "scopes": ("block", "block BIGINT, entry BIGINT, open BOOLEAN, text STRING, letters BIGINT, size INT, bits ARRAY<BIGINT>"),
    "entries": ("entry", "entry BIGINT, text STRING, body BIGINT, open BOOLEAN, label BIGINT"),
    "texts": ("id", "id BIGINT, text STRING"),
    "keys": ("key", "key STRING, label BIGINT"),
    "rows": ("ord", "ord BIGINT, key STRING, label BIGINT"),
    "merges": ("a", "a BIGINT, b BIGINT"),
    "loads": ("done", "done STRING, buckets INT"),
}


class SegmentIndex:
    """An index kept as tables under a shared path; another session may open it again and go on.

    add(rows, texts) links a batch with itself and all history and appends it. Rows are
      ord (unique, rises with arrival), key (of the posting, or null), text, block (null: not known well enough),
      scopes (what is known, as further blocks), described (whether texts has a description of it),
    and texts (id, text) holds the descriptions by ord; only those that decide about an open row are ever read closely.
    Rows alike in their block are one opening, so are rows of one key. A row without block is open: it is held against
    all rows of its scopes, and those of alike text are the same opening if their descriptions are. That search grows with
    the open rows times the rows of their scope; a pair costs a few comparisons of numbers, and is written only if neither
    the letters of the texts nor the words of the descriptions rule it out. An opening's label
    is its first arrival. When a batch shows two openings to be one, that is noted (merges) and holds from then on, so
    what result() says doesn't depend on how the rows were cut into batches.

    Tables are bucketed by the key they are joined by: a batch shuffles its own probes, never history. Of texts, labels
    and descriptions of history it takes those that share a segment, or a scope and all that was compared of it. A batch that fails midway leaves rows of a load
    that was never finished, which no reader takes; adding it again is safe.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 3, least: float = 0.8, band: int = 32):
        self.spark, self.path, self.most, self.rules = spark, path, most, [(least, band)]
        self._name = "segment_index_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self._define("loads")
        first = self._table("loads").agg(F.max("buckets")).first()[0]  # one number
        self.buckets = first or self.buckets
        for t in TABLES:
            self._define(t)

    def _define(self, name: str) -> None:
        by, columns = TABLES[name]
        buckets = 1 if name == "loads" else self.buckets
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name}_{name} ({columns}, load STRING) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")

    def _table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self._name}_{name}")

    def _done(self) -> list[str]:
        return [r.done for r in self._table("loads").select("done").collect()]  # one name a batch

    def _stored(self, name: str) -> DataFrame:
        """A table's rows of finished loads."""
        done = self._done()
        return self._table(name).where(F.col("load").isin(done) if done else F.lit(False)).drop("load")

    def _append(self, name: str, rows: DataFrame, load: str) -> None:
        by, columns = TABLES[name]
        x = rows.select(*(c.split()[0] for c in columns.split(", ")), F.lit(load).alias("load"))
        x = x.repartition(1 if name == "loads" else self.buckets, by)
        x.write.insertInto(f"{self._name}_{name}")

    def _entries(self, rows: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(entries: entry, block, text, scopes, open, body; members: ord, key, entry) of a batch. Open rows of the same
        text, scopes and words of the description are one entry, as they are alike by all that is compared."""
        whole = "block IS NOT NULL AND text IS NOT NULL"
        form = F.when(F.col("described"), F.col("ord"))
        e = rows.where(whole).groupBy("block", "text").agg(F.min("ord").alias("entry"), F.min(form).alias("body"), F.first("scopes").alias("scopes"))
        e = staged(e, "entries")
        lone = rows.where(f"NOT ({whole})")
        members = rows.where(whole).select("ord", "key", "block", "text").join(e.select("block", "text", "entry"), ["block", "text"]).select("ord", "key", "entry")
        read = lone.where("described AND text <> ''").join(profiles.select(F.col("id").alias("ord"), "h1", "h2"), "ord").select("ord", "text", "scopes", "h1", "h2")
        alike_ = read.groupBy("text", "scopes", "h1", "h2").agg(F.min("ord").alias("entry"))
        of = read.join(alike_, ["text", "scopes", "h1", "h2"]).where("ord <> entry").select("ord", "entry")
        lone = staged(lone.join(of, "ord", "left").withColumn("entry", F.coalesce("entry", "ord")), "lone-rows")
        members = members.union(lone.select("ord", "key", "entry"))
        e = e.select("entry", "block", "text", "scopes", F.lit(False).alias("open"), "body")
        return e.union(lone.where("ord = entry").select("entry", F.lit(None).cast("long"), "text", "scopes", F.lit(True), form)), members

    def _in_scopes(self, load: str) -> DataFrame:
        """(a, b, stored): entries of this load with those of their scopes, of this load or stored, of which one is open,
        within `most` edits in their text, and not told apart by what their descriptions' profiles say. Pairs are compared where
        their scope lies, by a few numbers first, and only what passes is written."""
        done, t = self._done(), self._table("scopes")
        own, old = t.where(F.col("load") == load), t.where(F.col("load").isin(done) if done else F.lit(False))
        side = lambda x, s: x.select(*(F.col(c).alias(f"{c}_{s}") for c in ("block", "entry", "text", "letters", "size", "bits")))
        only = lambda x, y: F.bit_count(F.col(f"letters_{x}").bitwiseAND(F.bitwise_not(F.col(f"letters_{y}"))))
        near = (F.col("block_a") == F.col("block_b")) & (F.col("entry_a") != F.col("entry_b"))
        near &= (only("a", "b") <= self.most) & (only("b", "a") <= self.most) & order_minhash.may_be_alike("a", "b", self.rules[0][0])
        near &= F.levenshtein("text_a", "text_b", self.most) >= 0  # not all of alike(), which would keep the join from being compiled
        new = side(own, "a").join(side(own.where("open"), "b"), near).select(F.least("entry_a", "entry_b").alias("a"), F.greatest("entry_a", "entry_b").alias("b"), F.lit(False).alias("stored")).distinct()
        x = side(own, "a").join(side(old.where("open"), "b"), near).select(F.col("entry_a").alias("a"), F.col("entry_b").alias("b"))
        y = side(old, "a").join(side(own.where("open"), "b"), near).select(F.col("entry_b").alias("a"), F.col("entry_a").alias("b"))
        return new.union(x.union(y).distinct().withColumn("stored", F.lit(True)))

    def _described(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Of pairs (a, b, body_a, body_b), those whose descriptions are alike."""
        x = pairs.where("body_a IS NOT NULL AND body_b IS NOT NULL AND body_a <> body_b")
        ids = staged(x.select(F.explode(F.array("body_a", "body_b")).alias("id")).distinct(), "open-ids")
        near = texts.join(ids, "id", "left_semi").union(self._stored("texts").join(ids, "id", "left_semi"))
        own = x.select(F.col("body_a").alias("a"), F.col("body_b").alias("b")).distinct()
        alike_ = order_minhash.verified(own, staged(order_minhash.forms(near), "open-forms"), self.rules).withColumnsRenamed({"a": "body_a", "b": "body_b"})
        return x.join(alike_, ["body_a", "body_b"]).select("a", "b", "label_a", "label_b")

    def add(self, rows: DataFrame, texts: DataFrame) -> DataFrame:
        """(ord, label) of the batch's rows, after appending it. rows and texts are read more than once, so what is
        costly to compute should be written before."""
        load = uuid.uuid4().hex
        texts = texts.select("id", "text")
        profiles = staged(order_minhash.profiles(texts), "batch-profiles")
        e, members = self._entries(rows, profiles)
        e, members = staged(e, "batch-entries"), staged(members, "batch-members")
        blocks = e.where("block IS NOT NULL").select("block", "text", "entry")
        # what a batch adds is stored first and read from there, by its buckets; nobody else reads it before the load is done
        self._append("segments", segments(blocks, self.most), load)
        done = [*self._done(), load]
        seg = self._table("segments").where(F.col("load").isin(done)).select("key", F.col("entry").alias("b"), (F.col("load") != load).alias("stored"))
        probe = probes(blocks, self.most, True).withColumnRenamed("entry", "a").repartition(self.buckets, "key")
        near = probe.join(seg, "key").where("a <> b")
        near = near.select(F.when(F.col("stored"), F.col("a")).otherwise(F.least("a", "b")).alias("a"), F.when(F.col("stored"), F.col("b")).otherwise(F.greatest("a", "b")).alias("b"), "stored").distinct()
        # texts without a description or a word in it can't be told from others by it
        scopes = with_letters(e.where("text <> '' AND body IS NOT NULL").select("entry", "open", "text", "body", "scopes"))
        scopes = scopes.join(profiles.select(F.col("id").alias("body"), "size", "bits"), "body")
        self._append("scopes", scopes.withColumn("block", F.explode("scopes")).where("block IS NOT NULL"), load)
        pairs = staged(near.union(self._in_scopes(load)), "batch-pairs")
        own = e.select("entry", "text", "body", "open", F.col("entry").alias("label"))
        side = lambda t, s: t.select(F.col("entry").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("text", "body", "open", "label")))
        pairs = pairs.join(side(own, "a"), "a")
        found = pairs.where("NOT stored").join(side(own, "b"), "b").unionByName(pairs.where("stored").join(side(self._stored("entries"), "b"), "b"))
        found = staged(found.where(alike(F.col("text_a"), F.col("text_b"), self.most)).drop("text_a", "text_b"), "batch-alike")
        vague = F.col("open_a") | F.col("open_b")
        links = found.where(~vague).select("label_a", "label_b").union(self._described(found.where(vague), texts).select("label_a", "label_b"))
        # the same key is the same posting
        keyed = members.where("key IS NOT NULL").select("key", "entry")
        least = keyed.groupBy("key").agg(F.min("entry").alias("least"))
        keys = staged(least.join(self._stored("keys"), "key", "left").select("key", "least", "label"), "batch-keys")
        links = links.union(keys.where("label IS NOT NULL").select("least", "label"))
        links = links.union(keyed.join(least, "key").where("entry <> least").select("least", "entry"))
        merges = self._stored("merges")
        parts = staged(connected_components(links.union(merges), "label_a", "label_b"), "batch-parts").withColumnRenamed("component", "label")
        labels = e.select("entry").join(parts.withColumnRenamed("node", "entry"), "entry", "left").select("entry", F.coalesce("label", "entry").alias("label"))
        labels = staged(labels, "batch-labels")
        self._append("entries", e.join(labels, "entry"), load)
        self._append("texts", texts, load)
        self._append("keys", least.join(labels, least["least"] == labels["entry"]), load)
        out = staged(members.join(labels, "entry").select("ord", "key", "label"), "batch-rows")
        self._append("rows", out, load)
        moved = parts.where("node <> label").join(labels, parts["node"] == labels["entry"], "left_anti")
        self._append("merges", moved.join(merges.select(F.col("a").alias("node"), F.col("b").alias("label")), ["node", "label"], "left_anti").select(F.col("node").alias("a"), F.col("label").alias("b")), load)
        self._append("loads", self.spark.createDataFrame([(load, self.buckets)], "done string, buckets int"), load)
        return out.select("ord", "label")

    def result(self) -> DataFrame:
        """(ord, key, label): all rows with the first arrival of their opening, by all that is known now."""
        now = staged(connected_components(self._stored("merges"), "a", "b"), "merged").select(F.col("node").alias("label"), "component")
        return self._stored("rows").join(now, "label", "left").select("ord", "key", F.coalesce("component", "label").alias("label"))
