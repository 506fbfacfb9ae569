"""Words of whole texts: ``[^\\x20\\x09-\\x0D]+``.

On bytes, ``split()`` divides at just these characters and ``lower()`` touches
only A-Z, so both work on the UTF-8 form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The same words in Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """Words as UTF-8; none for a null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that what is made of one stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def shingle_hashes(found: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of width words, joined by spaces; of all words if they are fewer."""
    if not found:
        return np.empty(0, np.uint64)
    whole, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= width:
        return np.array([digest(whole, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
    return np.fromiter((digest(whole[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))
