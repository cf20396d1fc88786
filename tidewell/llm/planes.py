"""Token ids on disk as compressed bit or byte planes.

A dataset is a folder of Parquet files, written and read by Spark, so that it can lie in any store:

* `kind=chunk`: one row per block of `BLOCK_IDS` ids (the last block of a part is shorter): `part`,
  `start` (ids of the part before it), `n` and `planes`, an array of zstandard frames. Byte plane k holds
  byte k of every id, least significant first; bit plane k holds bit k of every id, eight to a byte.
* `kind=doc`: the document index: `part`, `start`, `n` and `id`.
* `parts`: the chunk index's upper level, one row per part: `part`, `first` (ids of all parts before it),
  `n`. A block is found by its part and `(position - first) // BLOCK_IDS`.

Parts are ranges of the document id in ascending order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import column, pieces, texts_of
from tidewell.llm.tokens import Source

BLOCK_IDS = 1 << 16
LEVEL = 3
_ROWS = "kind string, part int, start bigint, n bigint, id bigint, planes array<binary>"
_SCHEMA = pa.schema(
    [("kind", pa.string()), ("part", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("id", pa.int64()),
     ("planes", pa.list_(pa.binary()))]
)


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The block's planes, each compressed."""
    import zstandard

    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        rows = np.unpackbits(rows, axis=1, bitorder="little")
    packed = np.packbits(rows.T, axis=1, bitorder="little") if bits else np.ascontiguousarray(rows.T)
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    return [compress(plane.tobytes()) for plane in packed]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block; 32 planes are bits, 4 are bytes."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    rows = np.stack([np.frombuffer(expand(p), dtype=np.uint8) for p in planes])
    if len(planes) == 32:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little"), axis=0, bitorder="little")
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", id_column: str = "doc_id",
    block_ids: int = BLOCK_IDS, bits: bool = False,
) -> None:
    """Encode every whole text, close each document with `end_id`, and write the ids by ascending document id.

    Rows are range-partitioned and sorted by id, then by text, and each task streams through its part: it
    holds one batch of documents and one block. A lost task writes its part anew; Spark's committer
    publishes only whole tasks. Null ids come first; a null text has the end id only; equal ids stay
    side by side as documents of their own; an empty table writes no blocks. Other columns aren't stored.
    """
    source = Source(docs.sparkSession, tokenizer)
    ordered = docs.select(column(id_column).cast("long").alias("id"), column(text).cast("string").alias("text"))
    ordered = ordered.repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = source.get(), TaskContext.get().partitionId()
        waiting: list[np.ndarray] = []
        held = total = written = 0

        def block(ids: np.ndarray) -> pa.RecordBatch:
            row = {"kind": "chunk", "part": part, "start": written, "n": len(ids), "id": None}
            return pa.RecordBatch.from_pylist([{**row, "planes": to_planes(ids, bits)}], _SCHEMA)

        for batch in pieces(batches, "text", 4 << 20):
            found = [np.append(codec.encode_parts(x, 1 << 16), np.uint32(end_id)) for x in texts_of(batch)]
            sizes = np.array([len(x) for x in found], dtype=np.int64)
            starts = total + np.cumsum(sizes) - sizes
            total += int(sizes.sum())
            rows = len(found)
            columns = [
                pa.array(["doc"] * rows), pa.array([part] * rows, pa.int32()), pa.array(starts), pa.array(sizes),
                batch.column("id"), pa.nulls(rows, pa.list_(pa.binary())),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)
            waiting += found
            held += int(sizes.sum())
            if held >= block_ids:
                ids = np.concatenate(waiting)
                whole = len(ids) // block_ids * block_ids
                for a in range(0, whole, block_ids):
                    yield block(ids[a : a + block_ids])
                    written += block_ids
                waiting, held = [ids[whole:]], len(ids) - whole
        if held:
            yield block(np.concatenate(waiting))

    ordered.mapInArrow(run, _ROWS).write.partitionBy("kind").option("compression", "snappy").parquet(path)
    spark = docs.sparkSession
    index = _table(spark, path).where("kind = 'doc'").groupBy("part").agg(F.sum("n").alias("n"))
    # One row per part, so at most as many as the job had tasks.
    parts, first, rows = sorted((r["part"], r["n"]) for r in index.collect()), 0, []
    for part, n in parts:
        rows.append((part, first, n))
        first += n
    spark.createDataFrame(rows, "part int, first bigint, n bigint").coalesce(1).write.parquet(f"{path}/parts")


def _table(spark: SparkSession, path: str) -> DataFrame:
    schema = "part int, start bigint, n bigint, id bigint, planes array<binary>, kind string"
    kinds = [f"{path}/kind={k}" for k in ("doc", "chunk")]
    tables = []
    for kind in kinds:
        try:
            tables.append(spark.read.schema(schema).option("basePath", path).parquet(kind))
        except Exception as error:  # noqa: BLE001  an empty dataset has no folder of a kind
            if "PATH_NOT_FOUND" not in str(error):
                raise
    if not tables:
        return spark.createDataFrame([], schema)
    return tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """`id`, `start` (ids of all documents before it), `n_tokens` and `ids` (packed) of every document.

    Blocks and index entries of a part are sorted by position and streamed: a task holds one block
    and the documents that reach into the next.
    """
    index = spark.read.schema("part int, first bigint, n bigint").parquet(f"{path}/parts")
    count = max(1, index.agg(F.max("part")).first()[0] or 0) + 1
    rows = _table(spark, path).repartitionById(count, F.col("part"))
    rows = rows.sortWithinPartitions("part", "start", "kind")  # a chunk before the documents that start with it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, at = None, np.zeros(0, dtype=np.uint32), 0  # `at`: position of the first id held
        open_docs: deque[tuple[int, int, int | None]] = deque()

        def ready() -> Iterator[tuple]:
            nonlocal ids, at
            while open_docs and open_docs[0][0] + open_docs[0][1] <= at + len(ids):
                start, n, doc = open_docs.popleft()
                yield part, doc, start, n, ids[start - at : start - at + n].tobytes()
            if open_docs:
                ids, at = ids[open_docs[0][0] - at :], open_docs[0][0]

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, ids, at = row["part"], np.zeros(0, dtype=np.uint32), 0
                if row["kind"] == "doc":
                    open_docs.append((row["start"], row["n"], row["id"]))
                    out += ready()
                else:
                    if not open_docs:
                        ids, at = ids[:0], row["start"]
                    ids = np.concatenate([ids, from_planes(row["planes"], row["n"])])
                    out += ready()
            if out:
                names = ["part", "id", "start", "n_tokens", "ids"]
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    found = rows.mapInArrow(run, "part int, id bigint, start bigint, n_tokens bigint, ids binary")
    found = found.join(F.broadcast(index.select("part", "first")), "part")
    return found.select("id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids")
