"""Posting blocks: an inverted index of a table's texts, cut by runs of documents.

Consecutive rows form blocks of at most BLOCK_DOCS documents and about BLOCK_BYTES
bytes (a longer text is a block by itself). A block gives one row for each key
(a term, a hash bucket) with the positions of its documents and their counts, so
the row of the commonest key is no longer than a block, and a key's rows can be
dealt by (key, part of the blocks).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_DOCS, BLOCK_BYTES = 2048, 8 << 20
#: ASCII letters in lower case, digits and all bytes beyond ASCII stay; the rest parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of anything beyond ASCII."""
    return text.translate(WORD_BYTES).split()


def blocks(batches):
    """(number of the first row, doc_ids as Arrow, texts as bytes) of blocks of rows (_row, doc_id, text as binary)."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        rows, at = b.column("_row").to_numpy(), 0
        while at < len(b):
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, side="right"))
            end = min(len(b), at + BLOCK_DOCS, max(at + 1, end))
            yield int(rows[at]), b.column("doc_id").slice(at, end - at), [t or b"" for t in b.column("text").slice(at, end - at).to_pylist()]
            at = end


def inverted(keys: list[np.ndarray], kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the keys (below kinds) of each document: distinct keys, where each one's postings begin (and the end), positions and counts."""
    width = max(1, len(keys))
    every = np.concatenate([k.astype(np.int64) * width + i for i, k in enumerate(keys)]) if keys else np.empty(0, np.int64)
    if kinds * width < 1 << 31:
        every = every.astype(np.int32)
    every.sort()
    first = np.flatnonzero(np.diff(every, prepend=-1))
    counts = np.diff(first, append=len(every)).astype(np.int32)
    key, doc = np.divmod(every[first], width)
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    return key[begin], np.append(begin, len(key)), doc.astype(np.int32), counts


def lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def headed(ids: pa.Array, rows: int) -> pa.ListArray:
    """A column of rows lists: the ids, then nulls."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(rows, len(ids))].astype(np.int32)), ids, mask=pa.array(np.arange(rows) > 0))


def numbered_rows(docs: DataFrame) -> DataFrame:
    """The rows blocks() reads. Their numbers follow partitions, so what reads them must be written before it is read twice."""
    return docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.col("text").cast("binary").alias("text"))
