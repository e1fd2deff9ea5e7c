"""Characters that look like other characters, as tables. Letters that only look alike are fixed values; everything
with a rule in the Unicode data (widths, fonts, ligatures, spaces, composition) is derived from that rule."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-alike letters (Greek, Cyrillic, Armenian and phonetic letters drawn like Latin ones).
GREEK_LIKE = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορ" + "ϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXavop" + "cj"
CYRILLIC_LIKE = "АВЕЅІЈКМНОРСТУХЬѴаеѕіјорсухѵһԁԛԝӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXbVaesijopcyxvhdqwl"
OTHER_LIKE = "ոսցօɑɡıԼՕՏ"
OTHER_AS = "nugoagiLOS"
# Hyphens and minus signs drawn like the plain hyphen, and characters that are not drawn at all.
HYPHENS = "‐‑‒−﹣－"
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︀︎️﻿"

LETTERS = dict(zip(GREEK_LIKE + CYRILLIC_LIKE + OTHER_LIKE, GREEK_AS + CYRILLIC_AS + OTHER_AS, strict=True))


@lru_cache(maxsize=1)
def compatible() -> dict[str, str]:
    """Full-width, half-width, font and ligature forms and canonical singletons to their plain form."""
    out = {}
    for cp in [*range(0xA0, 0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        c = chr(cp)
        d = unicodedata.decomposition(c)
        if not d:
            continue
        kind = d.split()[0]
        if kind in ("<wide>", "<narrow>", "<font>") or (kind == "<compat>" and 0xFB00 <= cp <= 0xFB06):
            out[c] = unicodedata.normalize("NFKC", c)
        elif not kind.startswith("<") and unicodedata.normalize("NFC", c) != c:
            out[c] = unicodedata.normalize("NFC", c)
    for cp in range(0x80, 0x3001):
        if unicodedata.category(chr(cp)) == "Zs":
            out[chr(cp)] = " "
    out |= dict.fromkeys(HYPHENS, "-")
    return out


@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str]:
    """(matching, replace) of translate(): plain ASCII for accented, wide and look-alike characters; marks and
    invisible characters have no counterpart and vanish."""
    to = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        d = unicodedata.normalize("NFKD", chr(cp))
        if d[0].isascii() and d[0].isalpha():
            to[chr(cp)] = d[0]
    to |= {k: v for k, v in compatible().items() if len(v) == 1 and ord(k) < 0x10000}
    to |= LETTERS
    to |= {"ß": "s", "ø": "o", "Ø": "O", "đ": "d", "ł": "l", "–": "-", "—": "-", "’": "'", "º": "o", "ª": "a"}
    gone = [chr(c) for c in range(0x300, 0x370)] + list(INVISIBLE)
    gone = [c for c in dict.fromkeys(gone) if c not in to]
    return "".join(to) + "".join(gone), "".join(to.values())


def fold(c: Column) -> Column:
    """The comparison form: lower-case ASCII where a plain counterpart exists, look-alikes and wide forms mapped,
    invisible characters gone, runs of blanks as one. Null stays null."""
    x = F.translate(c, *fold_tables())
    x = F.replace(F.replace(F.replace(x, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬃ"), F.lit("ffi")), F.lit("ﬂ"), F.lit("fl"))
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
