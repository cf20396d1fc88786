"""Repeated runs of lines: winnowed fingerprints find them, later occurrences are deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import BLANK, column, row_id, unused
from tidewell.plans.blocks import pin

#: Words of a run from which it counts as a repeated passage.
RUN_WORDS = 50

_TRIMMED = " \t\n\x0b\f\r"


def _digest(*parts: Column) -> Column:
    """128 bits over the parts, as two hashes of different seeds."""
    return F.struct(F.xxhash64(*parts).alias("h"), F.xxhash64(F.lit(7), *parts).alias("g"))


def _lines(rows: DataFrame) -> DataFrame:
    """One row per line with a word: `row`, `doc`, `at` (position), `key`, `words`, `start` (words before it)."""
    lines = rows.select("row", "doc", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    bare = lines.withColumn("bare", F.btrim("line", F.lit(_TRIMMED))).where("bare <> ''")
    keyed = bare.select(
        "row", "doc", "at", _digest(F.col("line")).alias("key"), F.size(F.split("bare", BLANK + "+")).alias("words")
    )
    before = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return keyed.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))


def _within(words: int) -> Window:
    """Lines that start within so many words from the start of the current one."""
    return Window.partitionBy("row").orderBy("start").rangeBetween(0, words - 1)


def _gram(lines: DataFrame, words: int, name: str) -> DataFrame:
    """Adds the digest of the lines that start within `words` words; null where fewer words follow."""
    own = _within(words)
    total, keys = F.sum("words").over(own), F.collect_list("key").over(own)
    return lines.withColumn(name, F.when(total >= words, _digest(keys)))


def _later_tails(lines: DataFrame, begins: DataFrame, run_words: int) -> DataFrame:
    """`row` and `start` of every line with which a passage ends that occurs earlier.

    Of the passages that end with a line, the shortest of `run_words` words decides: if a longer one occurs
    earlier, so does this one. It holds the run that begins with its first line, so only passages from the
    places where repeated runs begin (`begins`: `row`, `from`) are compared.
    """
    own = Window.partitionBy("row").orderBy("end").rangeBetween(-(run_words - 1), 0)
    tails = lines.withColumn("end", F.col("start") + F.col("words")).select(
        "row", "doc", "at", "start", F.min("start").over(own).alias("from"),
        F.when(F.sum("words").over(own) >= run_words, _digest(F.collect_list("key").over(own))).alias("tail"),
    )
    tails = pin(tails.where("tail is not null").join(begins, ["row", "from"], "left_semi"))
    here = F.struct("doc", "row", "at")
    first = pin(tails.groupBy("tail").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return tails.join(first, "tail").where(here > F.col("first")).select("row", "start")


def repeated_lines(
    docs: DataFrame, run_words: int = RUN_WORDS, text: str = "text", id_column: str = "doc_id", extend: bool = False
) -> DataFrame:
    """The lines to delete: `row` (row number) and `at` (positions from 0) of `docs` with that column.

    A run is a sequence of lines with a word, blank lines between them not counted. A line is deleted if
    it lies in a run of `run_words` words or more (a run ends with the line that reaches them) that occurs
    earlier in the corpus, ordered by document id (nulls first), row and position. With `extend`, runs may
    end with any line that follows, so that a line goes if it lies in any passage of `run_words` words or
    more that occurs earlier; without, the last lines of a repeated passage stay if no run begins late
    enough to hold them.

    1. Winnowing: the digest of about half a run's words, beginning at every line, and of these the
       smallest in each window of the other half. Every run of `run_words` words has such a fingerprint in
       it, and equal runs have equal ones.
    2. The positions of fingerprints that occur twice are the only places where runs can repeat.
    3. Extension both ways: the whole runs around these places, at every line that begins one, are
       compared with their earliest occurrence by 128-bit digests; what matches is deleted, and
       neighbouring matches join to longer passages. With `extend`, the passages that end with a line are
       compared in the same way (see `_later_tails`).

    Occurrences are joined with one earliest place, not with each other, so a line that a third of all
    documents share costs one row per occurrence. The earliest places are written first, so that both
    sides of the joins are plain exchanges, of which Spark splits a heavy key.
    """
    half = max(1, run_words // 2)
    lines = pin(_gram(_gram(_lines(docs), half, "part"), run_words, "run"))
    # Windows reach over the lines that start within the other half of the words.
    least = F.min(F.when(F.col("part").isNotNull(), F.struct("part", "at"))).over(_within(run_words - half + 1))
    marks = lines.withColumn("mark", least).where("run is not null and mark is not null")
    chosen = marks.select("row", F.col("mark.part").alias("part"), F.col("mark.at").alias("at")).distinct()
    twice = pin(chosen.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part"))
    places = marks.select("row", "doc", "at", "start", "run", F.col("mark.part").alias("part"))
    places = pin(places.join(twice, "part", "left_semi").drop("part"))
    here = F.struct("doc", "row", "at")
    first = pin(places.groupBy("run").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    later = places.join(first, "run").where(here > F.col("first")).select("row", "start")
    # A run covers the lines that start within its words; the last run that begins before a line decides.
    starts = lines.select("row", "at", "start").join(later.withColumn("begins", F.lit(True)), ["row", "start"], "left")
    covered = F.max("begins").over(Window.partitionBy("row").orderBy("start").rangeBetween(-(run_words - 1), 0))
    found = starts.withColumn("covered", covered).where("covered").select("row", "at")
    if not extend:
        return found
    begins = places.join(first, "run", "left_semi").select("row", F.col("start").alias("from"))
    tails = lines.select("row", "at", "start").join(_later_tails(lines, begins, run_words), ["row", "start"], "left_semi")
    return found.unionByName(tails.select("row", "at")).distinct()


def drop_repeated_lines(
    docs: DataFrame, run_words: int = RUN_WORDS, text: str = "text", id_column: str = "doc_id", extend: bool = False
) -> DataFrame:
    """All rows and columns of `docs` with repeated runs deleted from the text; adds `n_lines` and `n_deleted`.

    The first occurrence of a passage stays, in the order of document ids (see `repeated_lines`, also for `extend`). Texts
    without a deletion stay as they are, byte by byte; in the others the remaining lines, blank ones
    included, are joined by a newline again. Documents stay even if every line goes; their text is then
    empty or blank. A null text stays null and has no lines, an empty one has one. Of equal rows the first
    stays whole. A passage that repeats inside one document goes as well. Columns `n_lines` and `n_deleted`
    are replaced; no rows give no rows. `docs` must be a written table.
    """
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")]
    source = docs.select(*map(column, keep))
    row, gone = unused(source, "row", "gone")
    numbered = source.select("*", row_id().alias(row))
    plain = numbered.select(
        F.col(row).alias("row"), column(id_column).alias("doc"), column(text).cast("string").alias("text")
    )
    deleted = repeated_lines(plain, run_words, extend=extend)
    # Two lists per document, each no longer than its lines; flags by position make the lookup direct.
    lists = deleted.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias(gone)).withColumnRenamed("row", row)
    joined = numbered.join(lists.hint("shuffle_hash"), row, "left")
    split = F.split(column(text), "\n")
    ends = F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size(split)))
    # Between two deleted lines lies a slice of kept ones, which may be empty.
    slices = F.transform(
        F.col(gone), lambda p, i: F.slice(split, F.get(ends, i) + 2, p - F.get(ends, i) - 1)
    )
    tail = F.slice(split, F.element_at(gone, -1) + 2, F.size(split))
    kept = F.array_join(F.concat(F.flatten(slices), tail), "\n")
    changed = F.when(F.col(gone).isNull(), column(text)).otherwise(kept)
    return joined.select(
        *(changed.alias(c) if c == text else column(c) for c in keep),
        F.when(column(text).isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.when(F.col(gone).isNotNull(), F.col(gone))), F.lit(0)).cast("long").alias("n_deleted"),
    )
