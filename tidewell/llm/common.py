"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that separate words, as `[\x20\x09-\x0D]`.
BLANK = r"[\x20\x09-\x0D]"

U64 = np.uint64


def process_store() -> dict:
    """A dictionary that lives as long as the Python worker.

    The library reaches the workers by value, so its module globals are new in every task;
    what is dear to build (tokenizers, word caches) is kept here.
    """
    return sys.modules.setdefault("_tidewell_process_store", types.ModuleType("store")).__dict__


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each changed until no column of `df` has it, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def row_id() -> Column:
    """Number of a row: stable over retries, as the operators read written tables."""
    return F.monotonically_increasing_id()


def by_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """An iterator function for ``mapInArrow`` from a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    return run


def pieces(batches: Iterator[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most `limit` bytes of the column, or one row."""
    for batch in batches:
        col = batch.column(name)
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and the number of words before each text.

    Words are runs of bytes outside `[\\x20\\x09-\\x0D]`; A-Z count as a-z if `lower`. A word's hash
    is a polynomial in its bytes, computed from prefix sums over the whole batch and then mixed.
    """
    data = np.frombuffer(b" ".join([*texts, b" "]), dtype=np.uint8)
    if lower:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=offsets[1:])
    before = np.searchsorted(starts, offsets)
    seed = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(seed[data] * _powers(_BASE, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_BASE_INVERSE, len(data))[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), before


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of consecutive words, across the borders of texts too."""
    count = max(0, len(words) - n + 1)
    out = np.zeros(count, dtype=np.uint64)
    for i in range(n):
        out = mix(out * U64(_BASE) + words[i : i + count] + U64(i + 1))
    return out


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of a text column; a null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def append(docs: DataFrame, fields: str, function: Callable[[pa.RecordBatch], list], text: str, limit: int) -> DataFrame:
    """`docs` with new columns computed from batches of at most `limit` bytes of the text column.

    Columns of the same names, whatever the letter case, are replaced.
    """
    new = T._parse_datatype_string(fields)
    taken = {f.name.lower() for f in new}
    source = docs.select(*(column(c) for c in docs.columns if c.lower() not in taken))
    schema = T.StructType([*source.schema.fields, *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, limit):
            made = function(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *new.names])

    return source.mapInArrow(run, schema)
