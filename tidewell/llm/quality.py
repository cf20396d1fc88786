"""Quality rules: a few counts per document and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import BLANK, column, row_id, unused

#: Buckets of the hashed unigrams and bigrams. The two multinomials are tables of this size.
BUCKETS = 8192
#: Labelled rows of each class that are read at most: the trusted sample, and the one that sets the border.
TRUSTED_ROWS = 20_000
#: Share of the trusted rows of that sample which the border must keep.
KEEP = 0.995
#: Added to every bucket before the logarithm.
SMOOTHING = 1.0
#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Model:
    """Log ratio of each bucket as a one-row frame (`ratio` array<double>), and the border of the score."""

    ratios: DataFrame
    border: float


def _text(name: str) -> Column:
    return F.coalesce(column(name), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def word_keys(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def features(keys: Column) -> Column:
    """Buckets of all unigrams and bigrams of a document."""
    single = F.transform(keys, lambda k: F.pmod(k, F.lit(BUCKETS)).cast("int"))
    double = F.transform(
        F.slice(keys, 2, F.greatest(F.size(keys) - 1, F.lit(0))),
        lambda k, i: F.pmod(F.xxhash64(F.get(keys, i), k), F.lit(BUCKETS)).cast("int"),
    )
    return F.concat(single, double)


#: Up to so many different repeated windows are looked up one by one; more are found by sorting positions.
FEW = 16


def repeated_words(keys: Column) -> Column:
    """Words that lie in three-word windows which the document has twice or more.

    Windows are compared by 64-bit hashes of their word hashes. Documents in which all windows differ
    need one sort of numbers; the others find the positions of what is repeated, either way alike.
    """
    windows = F.transform(
        F.slice(keys, 3, F.greatest(F.size(keys) - 2, F.lit(0))),
        lambda k, i: F.xxhash64(F.get(keys, i), F.get(keys, i + 1), k),
    )

    def many(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = F.transform(
                s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])
            )
            return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

        return _with(pairs, twice)

    def few(w: Column, repeated: Column) -> Column:
        at = F.transform(w, lambda h, i: F.when(F.array_contains(repeated, h), i))
        return F.filter(at, lambda i: i.isNotNull())

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def count(w: Column) -> Column:
        ordered = F.sort_array(w)
        repeated = _with(ordered, lambda s: F.array_distinct(F.filter(s, lambda h, i: F.get(s, i + 1) == h)))
        return _with(
            repeated,
            lambda r: F.when(F.size(r) == 0, F.lit(0)).otherwise(
                _with(F.when(F.size(r) <= FEW, few(w, r)).otherwise(many(w)), covered)
            ),
        )

    return _with(windows, count).cast("long")


def _once(verdict: Column) -> Column:
    """The verdict, tied to the row it was computed for.

    Spark moves a filter on a column below the projections that compute it, and there writes the
    whole computation out wherever a part of it is used; inside a lambda that means once per word.
    A filter on a column that depends on the row's number stays above.
    """
    return F.when(row_id() >= 0, verdict)


def _with(value: Column, function: Callable[[Column], Column]) -> Column:
    """`function(value)` with the value computed once: a lambda over an array of one element binds it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs` with the base rules' counts, `base_failed` and the words' hashes `word_keys`.

    A null text counts as empty. An empty text has no words and fails. Columns of these names are
    replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "word_keys"]
    keep = [c for c in docs.columns if c.lower() not in made]
    source = docs.select(*map(column, keep))
    (words, lines) = unused(source, "words", "lines")
    value = _text(text)
    with_words = source.select(
        "*",
        words_of(value).alias(words),
        F.filter(F.split(value, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "").alias(lines),
    )
    counted = with_words.select(
        *map(column, keep),
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", words)).cast("long").alias("word_chars"),
        (F.char_length(value) - F.char_length(F.regexp_replace(value, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        word_keys(F.col(words)).alias("word_keys"),
    )
    ruled = counted.withColumn("n_repeat_words", repeated_words(F.col("word_keys")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return ruled.withColumn("base_failed", _once(failed))


def labelled(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """`doc_id`, `trusted` of at most `rows` documents a class, chosen by a hash of the id.

    Trusted are documents whose every label says quality 1, untrusted those with a quality 0.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    parts = []
    for quality in (1, 0):
        own = known.where(F.col("quality") == quality).select("doc_id", F.lit(quality).alias("trusted"))
        parts.append(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    return parts[0].unionByName(parts[1])


def scored(docs: DataFrame, ratios: DataFrame, keys: str = "word_keys", name: str = "score") -> DataFrame:
    """`docs` with the mean log ratio of each document's features; without features, 0."""
    (table,) = unused(docs, "ratios")
    total = F.aggregate(features(F.col(keys)), F.lit(0.0), lambda a, b: a + F.get(F.col(table), b))
    mean = F.when(F.size(keys) > 0, total / (2 * F.size(keys) - 1)).otherwise(F.lit(0.0))
    return docs.withColumn(table, ratios.scalar()).withColumn(name, mean).drop(table)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """Trusted and raw multinomials over hashed n-grams, and the border between the two classes.

    The raw counts come from every document, the trusted ones from the bounded sample, and so does
    the border. Without trusted rows, or without untrusted ones, every document reaches it.
    """
    sample = labelled(labels)
    source = docs.select(column("doc_id").alias("doc_id"), _text(text).alias("text"))
    marked = source.join(F.broadcast(sample), "doc_id", "left").select("trusted", words_of(F.col("text")).alias("w"))
    following = F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1)))
    pairs = marked.select("trusted", F.explode(F.arrays_zip("w", following.alias("v"))).alias("x"))
    keys = pairs.select("trusted", F.xxhash64("x.w").alias("a"), F.xxhash64("x.v").alias("b"), F.col("x.v").alias("v"))
    single, double = F.pmod("a", F.lit(BUCKETS)), F.pmod(F.xxhash64("a", "b"), F.lit(BUCKETS))
    grams = keys.select("trusted", F.explode(F.array(single, F.when(F.col("v").isNotNull(), double))).alias("bucket"))
    counts = grams.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("raw"), F.count(F.when(F.col("trusted") == 1, 1)).alias("target")
    )
    counts = {r["bucket"]: (r["raw"], r["target"]) for r in counts.collect()}
    raw = sum(r for r, _ in counts.values()) + SMOOTHING * BUCKETS
    target = sum(t for _, t in counts.values()) + SMOOTHING * BUCKETS
    spark = docs.sparkSession
    rows = spark.createDataFrame(
        [(b, float(counts.get(b, (0, 0))[0]), float(counts.get(b, (0, 0))[1])) for b in range(BUCKETS)],
        "bucket int, raw double, target double",
    )
    ratio = F.log((F.col("target") + SMOOTHING) / target) - F.log((F.col("raw") + SMOOTHING) / raw)
    listed = rows.select("bucket", ratio.alias("r")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("bucket", "r"))), lambda x: x["r"]).alias("ratio")
    )
    known = source.join(F.broadcast(sample), "doc_id").select(
        "trusted", word_keys(words_of(F.col("text"))).alias("keys")
    )
    rated = scored(known.where(F.size("keys") > 0), listed, "keys").select("trusted", "score").toArrow()
    return Model(listed, border(*(np.asarray(rated[c].to_numpy()) for c in ("trusted", "score"))))


def border(trusted: np.ndarray, scores: np.ndarray) -> float:
    """The score that parts the classes best among those that keep `KEEP` of the trusted rows.

    Scores of the bounded sample, sorted; the border lies half way between two neighbours.
    Minus infinity if a class is missing.
    """
    if not (trusted == 1).any() or not (trusted == 0).any():
        return float("-inf")
    values = np.unique(scores)
    good, bad = np.sort(scores[trusted == 1]), np.sort(scores[trusted == 0])
    lost = np.searchsorted(good, values) / len(good)
    caught = np.searchsorted(bad, values) / len(bad)
    best = int(np.argmax(np.where(lost <= 1 - KEEP, caught - lost, -1.0)))
    return float(values[best] if best == 0 else (values[best - 1] + values[best]) / 2)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs` with the base counts, `score` (double) and `kept` (boolean).

    A document is kept if the base rules pass and its mean log-likelihood ratio between the trusted
    and the raw multinomial reaches the border; the border is one fixed number, so equal texts get
    equal verdicts. Null and empty texts fail. Repeated rows are judged each for itself. Columns of the
    made names are replaced. `docs` needs `doc_id`, `labels` needs `doc_id` and `quality`.
    """
    model = fit(docs, labels, text)
    ruled = base_counts(docs.drop("score", "kept"), text)
    ruled = scored(ruled, model.ratios)
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(model.border))
    return ruled.withColumn("kept", _once(kept)).drop("word_keys")
