"""Byte-pair encoding and decoding with forced boundaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.common import append, texts_of
from tidewell.llm.tokens import Source

#: Bytes of text that one step takes into memory, apart from a single longer document.
BATCH_BYTES = 8 << 20
#: A fragment ends at the first certain cut after so many bytes.
FRAGMENT_BYTES = 4096


def encode(docs: DataFrame, path: str, text: str = "text", fragment_bytes: int = FRAGMENT_BYTES) -> DataFrame:
    """`docs` with `ids` (binary: little-endian unsigned 32-bit numbers) and `n_tokens` of each whole text.

    Byte pairs that occur inside no vocabulary token, where the pre-tokenizer must break as well, are
    certain cuts: no merge crosses them. A text is cut at such pairs, its fragments are encoded
    independently, and their ids are joined, which equals encoding the text as a whole, whatever its
    length. Fragments are at least `fragment_bytes` long, the last one excepted. A text without any
    certain cut is one fragment.

    Null and empty texts have no ids. Every row is encoded for itself, so null, equal and clashing
    values in other columns don't matter; columns `ids` and `n_tokens` are replaced. No rows give no rows.
    """
    source = Source(docs.sparkSession, path)

    def run(batch: pa.RecordBatch) -> list:
        tokenizer = source.get()
        found = [tokenizer.encode_parts(x, fragment_bytes) for x in texts_of(batch, text)]
        ids = pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())
        return [ids, pa.array([len(x) for x in found], pa.int64())]

    return append(docs, "ids binary, n_tokens bigint", run, text, BATCH_BYTES)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """`rows` with `decoded`, the text of the packed ids, special tokens included.

    Bytes that are no UTF-8 become U+FFFD. Null and empty ids give the empty text.
    """
    source = Source(rows.sparkSession, path)

    def run(batch: pa.RecordBatch) -> list:
        tokenizer = source.get()
        packed = batch.column(ids).to_pylist()
        return [pa.array([tokenizer.decode(np.frombuffer(x or b"", dtype="<u4")) for x in packed], pa.string())]

    return append(rows, "decoded string", run, ids, BATCH_BYTES)
