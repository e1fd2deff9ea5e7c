"""Sizes of texts in tokens of a public tokenizer. The vocabulary file is a parameter and stays where it is."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

DEFAULT_FOLDER = "/opt/tokenizers"
DEFAULT_FILE = "byte_bpe_multi_50k.tiktoken"


def default_path() -> str:
    return os.path.join(DEFAULT_FOLDER, DEFAULT_FILE)


def default_pattern() -> str:
    """The pattern that splits texts before merging, published with the vocabulary files; without it sizes would mean
    something else, so there is no other."""
    from public_tokenizers import PATTERN

    return PATTERN


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """A tiktoken encoder from a file of ranks and a pattern."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_tokens(rows: DataFrame, text: str, path: str | None = None, out: str = "n_tokens", pattern: str | None = None) -> DataFrame:
    """rows without the text column, with the number of its tokens (0 for null and empty texts). Whole texts are
    counted; strings of special tokens count as ordinary text. An existing column of that name is replaced."""
    path, pattern = path or default_path(), pattern or default_pattern()  # resolved here, so executors need the file only
    rows = rows if out == text else rows.drop(out)
    keep = [f for f in rows.schema.fields if f.name != text]
    schema = StructType(list(keep)).add(out, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            i = b.schema.names.index(text)
            n = [len(e.encode_ordinary(x)) if x else 0 for x in b.column(i).to_pylist()]
            own = [j for j in range(b.num_columns) if j != i]
            yield pa.RecordBatch.from_arrays([b.column(j) for j in own] + [pa.array(n, pa.int64())], names=[b.schema.names[j] for j in own] + [out])

    return rows.mapInArrow(run, schema)
