"""Problem 6: visually identical text with different characters.

Text arrives as Arrow buffers. One decode per batch gives a numpy array of code points; every later step is a gather
from a lookup table, a repeat with expansion offsets or a search in a sorted pair table, over all values of the batch
at once. No Python string call is made per row.

Steps: invisible characters go (joiners stay inside emoji and between letters of joining scripts), compatibility forms
become their plain form (ligatures expand), look-alike letters become Latin unless their word also holds a letter of
that script that has no Latin twin, and marks compose with their letters in canonical order.

Null gives null, an empty text gives an empty text; ties and repeated rows don't matter, each value is handled alone.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobloom.llm.lookalikes import INVISIBLE, LETTERS, compatible

LAST = 0x110000
WORD, LATIN, LIKE, OTHER, EMOJI, JOINING, MARK, CJK = (1 << i for i in range(8))


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points, from Unicode data and the look-alike table."""
    flags = np.zeros(LAST, np.uint16)
    ccc = np.zeros(LAST, np.uint8)
    for cp in range(0x80, 0x20000):
        c = chr(cp)
        if k := unicodedata.combining(c):
            ccc[cp] = k
            flags[cp] |= MARK
        if c.isalpha():
            flags[cp] |= WORD
    for cp in [*range(65, 91), *range(97, 123)]:
        flags[cp] |= WORD | LATIN
    latin = [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), 0xAA, 0xBA]
    flags[latin] |= np.where(flags[latin] & WORD, LATIN, 0).astype(np.uint16)
    flags[0x300:0x370] |= MARK
    for c in LETTERS:
        flags[ord(c)] |= LIKE
        flags[ord(c)] &= ~np.uint16(LATIN)
    word = (flags & WORD) > 0
    flags[word & ((flags & (LATIN | LIKE)) == 0)] |= OTHER
    for a, b in ((0x1F000, 0x1FB00), (0x2600, 0x27C0), (0x2190, 0x2200), (0x2300, 0x2400), (0x2B00, 0x2C00)):
        flags[a:b] |= EMOJI
    flags[[0xFE0F, 0xA9, 0xAE, 0x2122, 0x3030, 0x303D]] |= EMOJI
    flags[0x600:0x1100] |= JOINING
    for a, b in ((0x3001, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7B0), (0x20000, 0x30000)):
        flags[a:b] |= CJK
    width = np.ones(LAST, np.uint8)
    start = np.arange(LAST, dtype=np.uint32)
    pool: list[int] = []
    for c, d in compatible().items():
        if len(d) == 1:
            start[ord(c)] = ord(d)
        else:
            width[ord(c)] = len(d)
            start[ord(c)] = len(pool)
            pool += map(ord, d)
    invisible = np.zeros(LAST, bool)
    invisible[list(map(ord, INVISIBLE))] = True
    like = np.arange(LAST, dtype=np.uint32)
    for c, d in LETTERS.items():
        like[ord(c)] = ord(d)
    pairs = {}
    for cp in range(0xC0, 0x20000):
        d = unicodedata.decomposition(chr(cp)).split()
        if len(d) == 2 and not d[0].startswith("<") and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            pairs[int(d[0], 16) << 21 | int(d[1], 16)] = cp
    keys = np.array(sorted(pairs), np.int64)
    return {"flags": flags, "ccc": ccc, "width": width, "start": start, "pool": np.array(pool, np.uint32),
            "invisible": invisible, "like": like, "keys": keys,
            "values": np.array([pairs[k] for k in keys.tolist()], np.uint32)}


def code_points(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all values, end-exclusive bounds of each value); null counts as empty."""
    a = a.cast(pa.large_string())
    a = a.fill_null("") if a.null_count else a
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if a.buffers()[2] else np.zeros(0, np.uint8)
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return cps, lead[off - off[0]]


def to_arrow(cps: np.ndarray, bounds: np.ndarray, null: np.ndarray) -> pa.Array:
    data = np.frombuffer(cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
    size = np.where(cps < 0x80, 1, np.where(cps < 0x800, 2, np.where(cps < 0x10000, 3, 4)))
    off = np.concatenate(([0], np.cumsum(size)))[bounds].astype(np.int64)
    valid = pa.array(~null).buffers()[1] if null.any() else None
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [valid, pa.py_buffer(off), pa.py_buffer(data)])


def slices(texts: pa.Array, most: int = 8_000_000) -> list[tuple[int, int]]:
    """Row ranges of a string array that hold at most about `most` bytes each (one row at least)."""
    a = texts.cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    out, lo = [], 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def _keep(cps: np.ndarray, row: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (cps, row) if keep.all() else (cps[keep], row[keep])


def _near(x: np.ndarray, row: np.ndarray, step: int) -> np.ndarray:
    """x of the neighbour in the same value, else 0."""
    out = np.zeros_like(x)
    if step < 0:
        out[1:] = np.where(row[1:] == row[:-1], x[:-1], 0)
    else:
        out[:-1] = np.where(row[1:] == row[:-1], x[1:], 0)
    return out


def compose(cps: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical ordering and composition of marks, one pass for each place in the longest run of marks."""
    ccc = t["ccc"][cps]
    at = np.flatnonzero(ccc)
    if len(at):
        first = np.ones(len(cps), bool)  # begins a run: a starter, or a value's first character
        first[1:] = (ccc[1:] == 0) | (row[1:] != row[:-1])
        base = np.maximum.accumulate(np.where(first, np.arange(len(cps)), 0))
        order = np.lexsort((at, ccc[at], base[at]))  # stable inside each run
        own = base[at]
        marks, cls = cps[at][order], ccc[at][order]
        cps = cps.copy()
        cps[at] = marks
        own_first = np.concatenate(([True], own[1:] != own[:-1]))
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(own_first, np.arange(len(at)), 0))
        gone = np.zeros(len(cps), bool)
        blocked = np.zeros(len(cps), np.uint8)  # by base: class of the last mark that stayed
        by_place = np.argsort(place, kind="stable")
        ends = np.cumsum(np.bincount(place))
        for lo, hi in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
            i = by_place[lo:hi]
            b = own[i]
            fit = (at[i] != b) & (t["ccc"][cps[b]] == 0) & (blocked[b] < cls[i])
            key = cps[b].astype(np.int64) << 21 | marks[i]
            j = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
            hit = fit & (t["keys"][j] == key)
            cps[b[hit]] = t["values"][j[hit]]
            gone[at[i[hit]]] = True
            blocked[b[~hit]] = cls[i[~hit]]
        cps, row = _keep(cps, row, ~gone)
    for lo_l, hi_l, lo_r, hi_r, make in (
        (0x1100, 0x1113, 0x1161, 0x1176, lambda x, y: 0xAC00 + ((x - 0x1100) * 21 + y - 0x1161) * 28),
        (0xAC00, 0xD7A4, 0x11A8, 0x11C3, lambda x, y: x + y - 0x11A7),
    ):
        x, y = cps[:-1].astype(np.int64), cps[1:].astype(np.int64)
        hit = (x >= lo_l) & (x < hi_l) & (y >= lo_r) & (y < hi_r) & (row[:-1] == row[1:])
        if lo_l == 0xAC00:
            hit &= (x - 0xAC00) % 28 == 0
        if hit.any():
            cps = cps.copy()
            k = np.flatnonzero(hit)
            cps[k] = make(x[k], y[k])
            stay = np.ones(len(cps), bool)
            stay[k + 1] = False
            cps, row = _keep(cps, row, stay)
    return cps, row


def plain_array(a: pa.Array) -> pa.Array:
    """The plain form of every value of a string array, as large_string."""
    t = tables()
    null = np.asarray(a.is_null())
    n = len(a)
    cps, bounds = code_points(a)
    if not len(cps) or cps.max() < 0x80:
        return a.cast(pa.large_string())
    row = np.repeat(np.arange(n), np.diff(bounds))
    # invisible characters
    drop = t["invisible"][cps]
    if drop.any():
        flags = t["flags"][cps]
        seen = np.where(drop, 0, flags)  # an invisible neighbour counts as no neighbour
        before, after = _near(seen, row, -1), _near(seen, row, 1)
        prev_vs = _near((cps == 0xFE0F).astype(np.uint16), row, -1)
        zwj = (cps == 0x200D) & (((before & EMOJI) > 0) | (prev_vs > 0)) & ((after & EMOJI) > 0)
        vs = (cps == 0xFE0F) & (((before & EMOJI) > 0) | np.isin(_near(cps, row, -1), np.arange(0x23, 0x3A)))
        script = ((cps == 0x200C) | (cps == 0x200D)) & (before & JOINING > 0) & (after & JOINING > 0)
        cps, row = _keep(cps, row, ~drop | zwj | vs | script)
    # compatibility forms; wide punctuation and the wide blank belong beside ideographs
    width, start = t["width"][cps], t["start"][cps]
    wide = ((cps >= 0xFF00) & (cps < 0xFF66) & ((t["flags"][cps] & WORD) == 0)) | (cps == 0x3000)
    if wide.any():
        cjk = (t["flags"][cps] & CJK) > 0
        belongs = wide & (_near(cjk, row, -1) | _near(cjk, row, 1))
        start = np.where(belongs, cps, start)
    if (width > 1).any():
        rep = width.astype(np.int64)
        out = np.repeat(start, rep)
        inner = np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)
        long = np.repeat(rep > 1, rep)
        out[long] = t["pool"][out[long] + inner[long]]
        cps, row = out, np.repeat(row, rep)
    else:
        cps = start
    # look-alike letters, judged by their word
    flags = t["flags"][cps]
    if (flags & LIKE).any():
        inside = (flags & (WORD | MARK)) > 0
        begins = inside & ~((_near(inside, row, -1)))
        word = np.cumsum(begins)
        own = np.flatnonzero(inside)
        foreign, latin = (
            np.bincount(word[own], weights=(flags[own] & kind) > 0, minlength=word[-1] + 1) > 0 for kind in (OTHER, LATIN)
        )
        own_script = foreign & ~latin
        change = ((flags & LIKE) > 0) & ~own_script[word]
        cps = np.where(change, t["like"][cps], cps)
    cps, row = compose(cps, row, t)
    return to_arrow(cps, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))), null)


def plain_columns(df: DataFrame, columns: list[str], suffix: str = "_plain", changed: str = "_changed") -> DataFrame:
    """df with <column><suffix> (the plain form) and <column><changed> (whether it differs; false for null) for each
    of the string columns. Existing columns of such names are replaced."""
    df = df.drop(*[c + s for c in columns for s in (suffix, changed) if c + s not in columns])
    schema = StructType(list(df.schema.fields))
    for c in columns:
        schema.add(c + suffix, "string").add(c + changed, "boolean")

    def run(batches):
        import pyarrow.compute as pc

        for b in batches:
            arrays, names = list(b.columns), list(b.schema.names)
            for c in columns:
                own = b.column(names.index(c))
                parts = [plain_array(own.slice(lo, hi - lo)) for lo, hi in slices(own)]
                plain = pa.concat_arrays(parts or [plain_array(own)]).cast(pa.string())
                arrays += [plain, pc.fill_null(pc.not_equal(plain, own.cast(pa.string())), False)]
                names += [c + suffix, c + changed]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def changed_values(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(field, record_id) of the values that the plain form changes, each once."""
    x = plain_columns(df.select(id_column, *columns), columns)
    fields = F.array(*[F.when(F.col(c + "_changed"), F.lit(c)) for c in columns])
    return x.select(F.explode(F.filter(fields, lambda f: f.isNotNull())).alias("field"), F.col(id_column).alias("record_id"))
