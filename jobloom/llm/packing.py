"""Problem 7: filling fixed-capacity containers by exact-complement hashing.

Only sizes matter for a plan, and sizes lie between 1 and the capacity, so the plan is made from the histogram of sizes
(at most `capacity` numbers, whatever the data). For the largest open size the index of single, pair and triple sums of
available sizes gives a combination that fills the gap exactly, or else the fullest one (best fit), and the whole
combination is consumed as often as availability counts allow. Documents then find their place by (size, rank within
size); ranks are counted with salted sizes, so a size that a third of all documents share is no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobloom.session import staged

PER_SALT = 50_000  # pieces of one size that are ranked in one task


class SumIndex:
    """Sums of one, two and three available sizes as bit sets. They may hold sums that are no longer available; find()
    notices and refreshes."""

    def __init__(self, avail: np.ndarray):
        self.avail = avail
        self.refresh()

    def refresh(self) -> None:
        sizes = np.flatnonzero(self.avail)
        mask = (1 << len(self.avail)) - 1
        self.one = sum(1 << int(s) for s in sizes)
        self.two = self.three = 0
        for s in sizes.tolist():
            self.two |= self.one << s & mask
        for s in sizes.tolist():
            self.three |= self.two << s & mask

    def _single(self, s: int) -> tuple[int, ...] | None:
        return (s,) if s < len(self.avail) and self.avail[s] else None

    def _pair(self, s: int) -> tuple[int, ...] | None:
        a = np.arange(max(1, s - len(self.avail) + 1), s // 2 + 1)
        ok = (self.avail[a] > 0) & (self.avail[s - a] > (a == s - a))
        i = int(ok.argmax()) if len(a) else 0
        return (s - int(a[i]), int(a[i])) if len(a) and ok[i] else None

    def _triple(self, s: int) -> tuple[int, ...] | None:
        for a in np.flatnonzero(self.avail[: s - 1])[::-1].tolist():
            if self.two >> (s - a) & 1:
                self.avail[a] -= 1
                p = self._pair(s - a)
                self.avail[a] += 1
                if p:
                    return (a, *p)
        return None

    def find(self, gap: int) -> tuple[int, ...] | None:
        """Available sizes, at most three, with the largest sum up to gap; fewer and larger ones first."""
        fresh = False
        while gap > 0:
            low = (1 << gap + 1) - 2
            for bits, get in ((self.one, self._single), (self.two, self._pair), (self.three, self._triple)):
                if bits >> gap & 1 and (found := get(gap)):
                    return found
            if (self.one | self.two | self.three) >> gap & 1 and not fresh:
                self.refresh()  # the sum was there once
                fresh = True
                continue
            rest = (self.one | self.two | self.three) & low & ~(1 << gap)
            gap = rest.bit_length() - 1
            fresh = False
        return None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(sizes of one container in falling order, how many such containers) that use up counts (index: size)."""
    avail = np.zeros(capacity + 1, np.int64)
    avail[: len(counts)] = counts[: capacity + 1]
    avail[0] = 0
    out = []
    if avail[capacity]:
        out.append(((capacity,), int(avail[capacity])))
        avail[capacity] = 0
    index = SumIndex(avail)
    for size in range(capacity - 1, 0, -1):
        while avail[size]:
            taken, gap = [size], capacity - size
            avail[size] -= 1
            while gap > 0 and (more := index.find(gap)):
                for s in more:
                    avail[s] -= 1
                taken += more
                gap -= sum(more)
            sizes, times = np.unique(taken, return_counts=True)
            n = 1 + int((avail[sizes] // times).min())
            avail[sizes] -= times * (n - 1)
            out.append((tuple(sorted(taken, reverse=True)), n))
    return out


def places(made: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (size, first rank, containers' start, copies a container, place) sorted by size and rank: documents of a
    size with ranks from first rank on go `copies` at a time into the containers from start on."""
    used: dict[int, int] = {}
    rows, start = [], 0
    for sizes, n in made:
        place = 0
        for s in sorted(set(sizes), reverse=True):
            c = sizes.count(s)
            rows.append((s, used.get(s, 0), start, c, place))
            used[s] = used.get(s, 0) + c * n
            place += c
        start += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(sizes: DataFrame, id_column: str, size: str, capacity: int) -> DataFrame:
    """sizes with one row a piece: piece (from 0), start and length. Only what exceeds the capacity is cut, into full
    pieces and a rest. Rows of size 0, null or below have no piece."""
    last = F.expr(f"int((`{size}` - 1) div {capacity})")
    x = sizes.where(F.col(size) > 0).select(id_column, F.col(size).alias("_n"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return x.select(id_column, "piece", start.alias("start"), F.least(F.col("_n") - start, F.lit(capacity).cast("long")).alias("length"))


def packed(sizes: DataFrame, id_column: str, size: str, capacity: int) -> DataFrame:
    """Every piece with its container_id (from 0) and place (from 0): id, piece, start, length, container_id, place.
    Ids must be unique; equal sizes are ranked by id, so the result is the same in every run."""
    x = staged(pieces(sizes, id_column, size, capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in x.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most one row a size up to the capacity
        counts[r.length] = r.n
    where = places(plan(counts, capacity))
    # a size of many pieces is ranked in as many tasks as it needs
    many = {int(n): int(-(-counts[n] // PER_SALT)) for n in np.flatnonzero(counts > PER_SALT)}
    salts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in many.items() for v in kv]), F.col("length").cast("int")), F.lit(1)) if many else F.lit(1)
    x = x.withColumn("_salt", F.pmod(F.xxhash64(id_column, "piece"), salts).cast("int"))
    groups = staged(x.groupBy("length", "_salt").agg(F.count("*").alias("n")), "piece-counts")
    w = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    before = groups.select("length", "_salt", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_before"))
    x = x.join(before, ["length", "_salt"])
    own = F.row_number().over(W.partitionBy("length", "_salt").orderBy(id_column, "piece")) - 1
    x = x.select(id_column, "piece", "start", "length", (F.col("_before") + own).alias("_rank"))
    kind = dict(x.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = where[:, 0] << 44 | where[:, 1]
        for b in batches:
            n, rank = (np.asarray(b.column(i), dtype=np.int64) for i in (3, 4))
            i = np.searchsorted(key, n << 44 | rank, "right") - 1
            k = rank - where[i, 1]
            c, p = where[i, 2] + k // where[i, 3], where[i, 4] + k % where[i, 3]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(c), pa.array(p)], names=[*b.schema.names[:4], "container_id", "place"])

    return x.mapInArrow(run, f"`{id_column}` {kind}, piece int, start long, length long, container_id long, place long")


def fill(pieces_: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the fewest containers that could hold them and the share of room used."""
    x = pieces_.agg((F.max("container_id") + 1).alias("containers"), F.sum("length").alias("tokens"), F.count("*").alias("pieces"))
    return x.select("containers", "pieces", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), (F.col("tokens") / (F.col("containers") * capacity)).alias("used"))
