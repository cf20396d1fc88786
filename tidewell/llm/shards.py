"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import column, unused
from tidewell.plans.blocks import pin

#: Entries of the matrix at most: 8 MB as 64-bit numbers, which bounds the table that is broadcast.
MATRIX_CELLS = 1 << 20


def exact_sizes(rows: int, parts: int) -> np.ndarray:
    """Sizes that differ by one at most and add up to `rows`."""
    return np.full(parts, rows // parts, dtype=np.int64) + (np.arange(parts) < rows % parts)


def communication_matrix(rows: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """How many rows each partition sends to each bucket in a uniformly random permutation.

    Partition by partition, the counts are a multivariate hypergeometric draw from what the
    buckets can still take, so that both margins are met exactly.
    """
    rng = np.random.default_rng(seed)
    left = sizes.astype(np.int64).copy()
    out = np.zeros((len(rows), len(sizes)), dtype=np.int64)
    for i, n in enumerate(rows):
        out[i] = rng.multivariate_hypergeometric(left, n, method="marginals") if n else 0
        left -= out[i]
    return out


def shuffle_into_shards(
    docs: DataFrame, shards: int, seed: int = 0, bucket_rows: int = 2048, written: bool = True
) -> DataFrame:
    """All rows and columns of `docs` with `shard` (int) and `slot` (long, gapless from 0 in a shard).

    The assignment is a uniformly random permutation cut into shards whose sizes differ by one at
    most. Each input partition is permuted locally, and the matrix says how many of its rows go to
    each bucket; a bucket is a run of about `bucket_rows` slots of one shard. After the exchange each
    bucket is permuted again. Only row counts of partitions reach the driver. A bucket has an exact
    size whatever the values are, so that no key, null or repeated row can make one heavy.

    `docs` must be a written table, whose partitions are the same in every pass; with
    `written=False` it is written to the shared folder first. An empty table gives no rows. Columns
    named `shard` or `slot` are replaced; any other column is kept as it is.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    docs = docs if written else pin(docs)
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    docs = docs.select(*map(column, keep))
    part, local, after, ends, bucket, first = unused(docs, "part", "local", "after", "ends", "bucket", "first")
    counts = docs.select(F.spark_partition_id().alias(part)).groupBy(part).count().collect()
    counts = sorted((r[0], r[1]) for r in counts)
    total = sum(n for _, n in counts)
    per_shard = exact_sizes(total, shards)
    most = max(1, MATRIX_CELLS // (shards * max(1, len(counts))))
    buckets = min(most, max(1, -(-int(per_shard[0]) // bucket_rows)))
    sizes = np.concatenate([exact_sizes(int(n), buckets) for n in per_shard])
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    spark = docs.sparkSession
    sent = spark.createDataFrame(
        [(p, [int(x) for x in row]) for (p, _), row in zip(counts, np.cumsum(matrix, axis=1), strict=True)],
        f"`{part}` int, `{ends}` array<bigint>",
    )
    starts = np.concatenate([np.cumsum(s) - s for s in sizes.reshape(shards, buckets)])
    places = spark.createDataFrame(
        [(b, b // buckets, int(s)) for b, s in enumerate(starts)], f"`{bucket}` int, shard int, `{first}` bigint"
    )
    # Within a partition the rows are sorted by a random number; their position there is the
    # lower 33 bits of the row number that Spark gives them.
    mixed = docs.select("*", F.spark_partition_id().alias(part), F.rand(seed).alias(local), F.rand(seed + 1).alias(after))
    mixed = mixed.sortWithinPartitions(local)
    mixed = mixed.withColumn(local, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    mixed = mixed.join(F.broadcast(sent), part)
    mixed = mixed.withColumn(bucket, F.size(F.filter(ends, lambda end: end <= F.col(local)))).drop(ends)
    order = Window.partitionBy(bucket).orderBy(after, part, local)
    placed = mixed.withColumn(local, F.row_number().over(order) - 1).join(F.broadcast(places), bucket)
    return placed.select(*map(column, keep), "shard", (F.col(first) + F.col(local)).cast("long").alias("slot"))
