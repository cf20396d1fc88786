"""Token counts without token ids."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.common import append, process_store, texts_of
from tidewell.llm.tokens import Source

#: Bytes of text that are encoded in one batch.
BATCH_BYTES = 1 << 20
#: A text is split at the first certain cut after so many bytes.
PIECE_BYTES = 1 << 16


def balanced(sizes: list[int], limit: int) -> Iterator[range]:
    """Runs of neighbours with at most `limit` bytes in total, or one item."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield range(start, i)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield range(start, len(sizes))


def count_tokens(
    docs: DataFrame, path: str, text: str = "text", batch_bytes: int = BATCH_BYTES, piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """`docs` with `n_bytes` (UTF-8) and `n_tokens` of each whole text.

    `path` is a file of the `tokenizers` library (`.json`) or of `sentencepiece` (`.model`). Only lengths
    leave the function. Long texts are split at certain cuts (see `bpe.encode`), and pieces are encoded in
    batches of about equal bytes, so that neither many short nor a few long texts make a batch large.
    Texts for `.model` files, and texts without a certain cut, are encoded whole.

    Null and empty texts count 0. Columns `n_bytes` and `n_tokens` are replaced; no rows give no rows.
    """
    if str(path).endswith(".model"):
        return append(docs, "n_bytes bigint, n_tokens bigint", _sentencepiece(docs, path, text), text, batch_bytes)
    source = Source(docs.sparkSession, path)

    def run(batch: pa.RecordBatch) -> list:
        tokenizer = source.get()
        texts = texts_of(batch, text)
        owners, parts, sizes = [], [], []
        for i, data in enumerate(texts):
            cuts = tokenizer.cuts(data, piece_bytes)
            for a, b in zip(cuts, cuts[1:], strict=False):
                owners.append(i)
                parts.append((a, b))
                sizes.append(b - a)
        counts = np.zeros(len(texts), dtype=np.int64)
        for group in balanced(sizes, batch_bytes):
            batched = [texts[owners[k]][slice(*parts[k])].decode("utf-8", "replace") for k in group]
            np.add.at(counts, owners[group.start : group.stop], tokenizer.lengths(batched))
        return [pa.array([len(x) for x in texts], pa.int64()), pa.array(counts)]

    return append(docs, "n_bytes bigint, n_tokens bigint", run, text, 8 * batch_bytes)


def _sentencepiece(docs: DataFrame, path: str, text: str):
    model = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(batch: pa.RecordBatch) -> list:
        import sentencepiece

        store = process_store()
        if ("model", path) not in store:
            store["model", path] = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        texts = texts_of(batch, text)
        counts = [len(store["model", path].encode(x.decode("utf-8", "replace"))) for x in texts]
        return [pa.array([len(x) for x in texts], pa.int64()), pa.array(counts, pa.int64())]

    return run
