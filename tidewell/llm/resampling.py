"""Target-distribution importance resampling over hashed n-grams."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import append, column, row_id, texts_of, unused
from tidewell.plans.blocks import pin

#: Bytes of text in one batch.
BATCH_BYTES = 8 << 20
#: A-Z become a-z, and every byte outside the words' class becomes a space.
CLEAN = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def pattern(words: int) -> regex.Pattern:
    """Matches `words` whole words with single spaces between; overlapped, it starts at every word."""
    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (words - 1))


class Buckets(dict):
    """The bucket of each n-gram seen so far: the CRC-32 of its bytes modulo their number."""

    def __init__(self, number: int):
        self.number = number

    def __missing__(self, gram: bytes) -> int:
        self[gram] = found = zlib.crc32(gram) % self.number
        return found


def cleaned(text: bytes) -> bytes:
    """UTF-8 text in lower case with all separators collapsed to single spaces."""
    return b" ".join(text.translate(CLEAN).split())


def ngrams(clean: bytes, patterns: list[regex.Pattern]) -> Iterator[bytes]:
    """All runs of words of the patterns' lengths in cleaned text."""
    for compiled in patterns:
        yield from map(regex.Match.group, compiled.finditer(clean, overlapped=True))


def bucket_counts(docs: DataFrame, buckets: int, longest: int = 1, text: str = "text") -> DataFrame:
    """All columns of `docs` with `n_words`, `n_features`, `buckets` (ascending) and `counts`.

    Features are all runs of 1 to `longest` words, repeats counted; a feature's bucket is the CRC-32 of its
    bytes modulo `buckets`. A document's arrays hold one entry for each bucket that it uses. A null text has
    none. Columns of the made names are replaced.
    """

    def run(batch: pa.RecordBatch) -> list:
        patterns, known = [pattern(n) for n in range(1, longest + 1)], Buckets(buckets)
        words, features, keys, counts, ends = [], [], [], [], [0]
        for data in texts_of(batch, text):
            clean = cleaned(data)
            own = Counter(map(known.__getitem__, ngrams(clean, patterns)))
            words.append(clean.count(b" ") + 1 if clean else 0)
            features.append(own.total())
            chosen = sorted(own)
            keys.extend(chosen)
            counts.extend(map(own.__getitem__, chosen))
            ends.append(len(keys))
        ends = pa.array(ends, pa.int32())
        return [
            pa.array(words, pa.int64()),
            pa.array(features, pa.int64()),
            pa.ListArray.from_arrays(ends, pa.array(keys, pa.int32())),
            pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
        ]

    fields = "n_words bigint, n_features bigint, buckets array<int>, counts array<bigint>"
    return append(docs, fields, run, text, BATCH_BYTES)


def totals(counted: DataFrame) -> DataFrame:
    """`bucket`, `n`: the features of a whole table in each bucket, summed on the map side first."""
    pairs = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return pairs.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row with `gain` array<bigint>, by bucket: floor(1000 ln of the ratio of the smoothed shares).

    `raw` and `target` are `totals`; with an empty table its shares are equal in all buckets.
    """
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left")
    both = both.join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    listed = both.agg(F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("x"))
    summed = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    listed = listed.withColumn("all_s", summed.select("all_s").scalar()).withColumn("all_t", summed.select("all_t").scalar())

    def gain(x: Column) -> Column:
        ratio = ((x["t"] + 1) * (F.col("all_s") + buckets)).cast("double") / (
            (x["s"] + 1) * (F.col("all_t") + buckets)
        ).cast("double")
        return F.floor(1000 * F.log(ratio)).cast("long")

    return listed.select(F.transform("x", gain).alias("gain"))


def weighted(counted: DataFrame, table: DataFrame) -> DataFrame:
    """`counted` without its arrays, with `weight`: the sum of the gains of a document's features."""
    (gain,) = unused(counted, "gain")
    products = F.zip_with("buckets", "counts", lambda b, c: F.get(F.col(gain), b) * c)
    weight = F.aggregate(products, F.lit(0).cast("long"), lambda a, x: a + x)
    return counted.withColumn(gain, table.scalar()).withColumn("weight", weight).drop("buckets", "counts", gain)


def noise(key: Column, seed: int) -> Column:
    """floor of 1000 times a Gumbel variate, from the first 32 bits of SHA-256 of `<seed>:<key>`."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((bits + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, eligible: Column, percent: int, key: str) -> DataFrame:
    """`scored` with `rank`: 1, 2, 3... for the drawn rows, null for all others.

    Of the N eligible rows, floor(percent * N / 100) with the highest `score` are drawn, ties to the
    smaller key (a null key last, then by row). Rows are sorted by ranges into a written table; a part's rows
    are numbered by themselves, and the sizes of the parts before it are added. Only these sizes, one number
    a part, are summed in one place.
    """
    part, fits, row, before, place = unused(scored, "part", "fits", "row", "before", "place")
    order = [F.col(fits).desc(), F.col("score").desc(), column(key).asc_nulls_last(), F.col(row)]
    numbered = scored.withColumn(fits, eligible).withColumn(row, row_id())
    parts = pin(numbered.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = parts.groupBy(part).agg(F.count(F.when(F.col(fits), 1)).alias(place))
    over = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(part, F.coalesce(F.sum(place).over(over), F.lit(0)).alias(before))
    drawn = parts.agg(F.floor(F.count(F.when(F.col(fits), 1)) * percent / 100).cast("long"))
    inside = parts.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    rank = F.col(place) + F.col(before)
    rank = F.when(F.col(fits) & (rank <= drawn.scalar()), rank).cast("long")
    return inside.join(F.broadcast(sizes), part).withColumn("rank", rank).drop(part, fits, row, before, place)


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    longest: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    min_words: int = 20,
    seed: int = 2024,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """All rows of `docs` with `n_words`, `n_features`, `weight`, `score` and `rank`, all long.

    `weight` is the sum, over a document's features, of the gain of the feature's bucket: the scaled logarithm
    of its smoothed share among all features of `target` over that among all features of `docs`. `score`
    adds Gumbel noise made from the key, so that the highest scores are a draw without replacement in
    proportion to the importance weights. `rank` numbers the draw: `percent` of the documents with at least
    `min_words` words. Columns named in `drop` are not carried to the result, which saves writing them.

    A text is counted once: its bucket counts are written with the row to the shared folder, and both the
    corpus totals and the weights read them there. The table of gains has `buckets` entries, whatever the input.

    A null or empty text has no features and weight 0. A null key counts as empty in the noise and
    comes last among ties; rows with one key get the same noise and are drawn each for itself. Without
    target rows the target's shares are equal. No rows give no rows. Columns of the made names are replaced.
    """
    made = ("weight", "score", "rank")
    source = docs.select(*(column(c) for c in docs.columns if c.lower() not in made))
    counted = bucket_counts(source, buckets, longest, text)
    counted = pin(counted.select(*(column(c) for c in counted.columns if c not in drop)))
    table = gains(totals(counted), totals(bucket_counts(target, buckets, longest, text)), buckets)
    scored = weighted(counted, table).withColumn("score", F.col("weight") + noise(column(key), seed))
    return ranked(scored, F.col("n_words") >= min_words, percent, key)
