"""Stupid-backoff language-model scores of every document against the rest of the corpus.

Count tables of n-grams are partitioned by hash. A document's n-grams don't travel one by one: each
block of documents sends its distinct n-grams once, with their counts in the block, to the tables, and
the tables answer with the corpus counts in the same order. So a frequent n-gram costs a table one
entry per block and not one per document, and its table is no larger than any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import U64, column, ngram_hashes, texts_of, word_hashes

ORDER = 3
BACKOFF = 0.4
#: Bytes of text in a block at least and at most, which bounds a task's memory; in between it grows with
#: the root of the corpus, so that blocks times tables grow no faster than the corpus.
BLOCK_BYTES = (4 << 20, 12 << 20)
#: Bytes of text for each count table.
TABLE_BYTES = 4 << 20
#: Bits of an n-gram's hash that are kept within its table. Of a table's two million n-grams, one
#: in a hundred million shares them with another.
KEY_BITS = 48
#: Texts are hashed in pieces of about so many bytes.
PIECE_BYTES = 1 << 20


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, count: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, count)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


class Grams:
    """The n-grams of a block of texts, one length at a time."""

    def __init__(self, texts: list[bytes], order: int, tables: int):
        sizes, words, group, held = [], [], [], 0
        for i, text in enumerate(texts):
            group.append(text)
            held += len(text)
            if held >= PIECE_BYTES or i + 1 == len(texts):
                hashes, before = word_hashes(group)
                words.append(hashes)
                sizes.append(np.diff(before))
                group, held = [], 0
        self.tables = tables
        self.words = np.concatenate([*words, np.zeros(0, dtype=np.uint64)])
        self.sizes = np.concatenate([*sizes, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        starts = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(self.words), dtype=np.int64) - np.repeat(starts, self.sizes)
        #: Longest n-gram that ends at each word without leaving its text.
        self.reach = np.minimum(place + 1, order).astype(np.int8)

    def keys(self, n: int) -> np.ndarray:
        """Table and kept bits of the n-grams that end at the words which reach so far, in order.

        Tables are ranges of the hash's first bits, so that sorted keys are sorted by table.
        """
        if n == 0:
            return np.zeros(min(1, len(self.words)), dtype=np.uint64)
        hashes = ngram_hashes(self.words, n)[self.reach[n - 1 :] >= n]
        table = ((hashes >> U64(32)) * U64(self.tables)) >> U64(32)
        return (table << U64(KEY_BITS)) | (hashes & U64((1 << KEY_BITS) - 1))


def _scores(grams: Grams, totals: list[np.ndarray], order: int, backoff: float) -> np.ndarray:
    """Sum of the scores' natural logarithms of each text, in millionths.

    `totals` has the corpus counts of each length's distinct keys. The text's own counts are taken off.
    """
    count, texts = len(grams.words), len(grams.sizes)
    if not count:
        return np.zeros(texts, dtype=np.int64)
    owner = np.repeat(np.arange(texts), grams.sizes)
    left = []
    for n in range(1, order + 1):
        known, at = np.unique(grams.keys(n), return_inverse=True)
        ends = grams.reach >= n
        _, where, times = np.unique(owner[ends] * len(known) + at, return_inverse=True, return_counts=True)
        here = np.zeros(count, dtype=np.int64)
        here[ends] = totals[n][at] - times[where]
        left.append(here)
    corpus = totals[0][0] - grams.sizes[owner]
    logs = np.zeros(count)
    open_ = np.ones(count, dtype=bool)
    for n in range(order, 0, -1):
        mine = open_ & (grams.reach >= n) & (left[n - 1] > 0)
        context = corpus if n == 1 else np.concatenate([[1], left[n - 2][:-1]])
        steps = grams.reach[mine] - n
        logs[mine] = steps * math.log(backoff) + np.log(left[n - 1][mine] / context[mine])
        open_ &= ~mine
    logs[open_] = grams.reach[open_] * math.log(backoff) - np.log(corpus[open_] + 1)
    return np.bincount(owner, np.rint(logs * 1e6), texts).astype(np.int64)


def score(
    docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """`doc_id`, `n_words` and `log_score` (sum of natural logarithms, in steps of 1e-6) of every row.

    Words are runs outside `[\\x20\\x09-\\x0D]`, A-Z lower-cased. A word's score is its n-gram's count over its
    context's, of the longest n-gram that occurs in the rest of the corpus, times `backoff` for every
    word of context given up; a word that occurs nowhere else has `backoff` once more over the number of
    the other words plus one. Counts are of all documents without the scored one, so a text without
    copies isn't judged by itself.

    1. Blocks of neighbouring rows send their distinct n-grams to the count tables, partitioned by hash.
    2. Each table adds up what it got and answers every block in the order of its keys.
    3. Blocks and answers are joined by block, and the logarithms are summed per document.

    Null, empty and blank texts have no words and the score 0. Every row is a document, rows of equal id
    or text too, and a null id stays null. Other columns aren't used. No rows give no rows. `docs` must
    be a written table, which is read in the same blocks twice.
    """
    size = F.coalesce(F.sum(F.octet_length(column(text).cast("string")).cast("long")), F.lit(0))
    total = docs.agg(size).first()[0]
    tables = max(1, -(-total // TABLE_BYTES))
    block_bytes = int(min(BLOCK_BYTES[1], max(BLOCK_BYTES[0], 256 * math.sqrt(total))))
    # The partition's number is taken in the plan: a task's own number changes under a union.
    rows = docs.select(
        F.spark_partition_id().alias("part"), column(id_column).cast("long").alias("doc_id"),
        column(text).cast("string").alias("text"),
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
        number, ids, texts, held = None, [], [], 0
        for batch in batches:
            if number is None and batch.num_rows:
                number = batch.column("part")[0].as_py() << 32
            for doc, data in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                if texts and held + len(data) > block_bytes:
                    yield number, ids, texts
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(doc)
                texts.append(data)
                held += len(data)
        if texts:
            yield number, ids, texts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts in blocks(batches):
            grams = Grams(texts, order, tables)
            for n in range(order + 1):
                keys, counts = np.unique(grams.keys(n), return_counts=True)
                if n == 0:
                    counts = counts * len(grams.words)  # the empty n-gram occurs before every word
                ends = np.searchsorted(keys >> U64(KEY_BITS), np.arange(tables + 1, dtype=np.uint64))
                for table in np.flatnonzero(np.diff(ends)).tolist():
                    part = slice(ends[table], ends[table + 1])
                    steps = np.diff(keys[part], prepend=U64(table << KEY_BITS))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "table": pa.array([table], pa.int64()), "block": pa.array([number], pa.int64()),
                            "place": pa.array([n * tables + table], pa.int64()), "n": pa.array([len(steps)], pa.int64()),
                            "keys": pa.array([_pack(steps)], pa.binary()), "counts": pa.array([_pack(counts[part])], pa.binary()),
                        }
                    )

    def answer(group: pa.Table) -> pa.Table:
        sizes = group.column("n").to_pylist()
        keys = [np.cumsum(_unpack(k, n)) for k, n in zip(group.column("keys").to_pylist(), sizes, strict=True)]
        counts = [_unpack(c, n) for c, n in zip(group.column("counts").to_pylist(), sizes, strict=True)]
        known, where = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(len(known), dtype=np.int64)
        np.add.at(totals, where, np.concatenate(counts).astype(np.int64))
        parts = np.split(totals[where], np.cumsum(sizes)[:-1])
        return pa.table(
            {
                "block": group.column("block"), "place": group.column("place"), "n": group.column("n"),
                "data": pa.array([_pack(p) for p in parts], pa.binary()),
                "docs": pa.nulls(len(sizes), pa.list_(pa.int64())), "sizes": pa.nulls(len(sizes), pa.list_(pa.int64())),
            }
        )

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for number, ids, texts in blocks(batches):
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number], pa.int64()), "place": pa.array([-1], pa.int64()),
                    "n": pa.array([len(texts)], pa.int64()),
                    "data": pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(texts))], pa.binary()),
                    "docs": pa.array([ids], pa.list_(pa.int64())),
                    "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                }
            )

    def join(group: pa.Table) -> pa.Table:
        import zstandard

        group = group.sort_by("place")  # the block's texts, then the answers in the order of the tables
        sizes = group.column("sizes")[0].as_py()
        data = zstandard.ZstdDecompressor().decompress(group.column("data")[0].as_py(), max_output_size=sum(sizes))
        ends = np.cumsum([0, *sizes])
        texts = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        grams = Grams(texts, order, tables)
        found: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in range(order + 1)]
        columns = (group.column(c).to_pylist()[1:] for c in ("place", "data", "n"))
        for place, packed, n in zip(*columns, strict=True):
            found[place // tables].append(_unpack(packed, n).astype(np.int64))
        totals = [np.concatenate(parts) for parts in found]
        return pa.table(
            {
                "doc_id": pa.array(group.column("docs")[0].as_py(), pa.int64()),
                "n_words": pa.array(grams.sizes),
                "log_score": pa.array(_scores(grams, totals, order, backoff) / 1e6),
            }
        )

    fields = "block bigint, place bigint, n bigint, data binary, docs array<bigint>, sizes array<bigint>"
    asked = rows.mapInArrow(ask, "`table` bigint, block bigint, place bigint, n bigint, keys binary, counts binary")
    answers = asked.groupBy("table").applyInArrow(answer, fields)
    met = answers.unionByName(rows.mapInArrow(carry, fields))
    return met.groupBy("block").applyInArrow(join, "doc_id bigint, n_words bigint, log_score double")
