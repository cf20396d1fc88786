"""Near-duplicate documents by MinHash: minima, bands, verification and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import U64, column, mix, ngram_hashes, pieces, row_id, texts_of, unused, word_hashes
from tidewell.llm.components import components
from tidewell.plans.blocks import pin

#: Bands and minima per band: a pair of similarity 0.8 shares a band with probability 0.99994.
BANDS, ROWS = 32, 6
#: Pairs whose signatures agree in less than the threshold minus this many standard errors are no links.
ERRORS = 4.5
#: Members of a shingle in one block of comparisons.
BLOCK = 2048
#: Texts of one batch; the word hashes take some 36 times as much meanwhile.
BATCH_BYTES = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Words per shingle, and the least similarity in hundredths."""

    words: int = 5
    percent: int = 80


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles as 64-bit hashes.

    Words are lower-cased in A-Z. A text of fewer words has its whole sequence as its only shingle, and a
    text without words the empty set.
    """
    hashes, before = word_hashes(texts)
    grams = ngram_hashes(hashes, words)
    out = []
    for a, b in zip(before[:-1], before[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            out.append(ngram_hashes(hashes[a:b], int(b - a)) ^ U64(b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and summands of the universal hash functions, the same in every run."""
    numbers = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
    low = (numbers >> U64(32)).astype(np.uint32)
    return low[:count] | np.uint32(1), low[count:]


def signatures(sets: list[np.ndarray], count: int = BANDS * ROWS) -> np.ndarray:
    """Minima of `count` hash functions for each non-empty set: an array of 32-bit numbers."""
    out = np.zeros((len(sets), count), dtype=np.uint32)
    if not sets:
        return out
    starts = np.cumsum([0, *map(len, sets[:-1])])
    values = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    hashed = np.empty_like(values)
    for k, (a, b) in enumerate(zip(*_functions(count), strict=True)):
        np.multiply(values, a, out=hashed)
        np.add(hashed, b, out=hashed)
        hashed ^= hashed >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(hashed, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), rows.shape[:2])
    for r in range(ROWS):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return keys


def set_key(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


_VERTICES = "row bigint, doc bigint, n_shingles bigint, key binary, bands array<bigint>, signature binary"


def _vertices(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for big in batches for b in pieces([big], "text", BATCH_BYTES)):
            sets = shingle_sets(texts_of(batch), words)
            full = [i for i, s in enumerate(sets) if len(s)]
            made = signatures([sets[i] for i in full])
            keys = band_keys(made).view(np.int64)
            own: list[list] = [[None] * len(sets) for _ in range(3)]
            for k, i in enumerate(full):
                own[0][i], own[1][i], own[2][i] = set_key(sets[i]), keys[k], made[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(own[0], pa.binary()), pa.array(own[1], pa.list_(pa.int64())), pa.array(own[2], pa.binary()),
                ],
                ["row", "doc", "n_shingles", "key", "bands", "signature"],
            )

    return docs.select("row", "doc", "text").mapInArrow(run, _VERTICES)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """`key` and `shingles` (array of 64-bit hashes) of rows `key`, `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for big in batches for b in pieces([big], "text", BATCH_BYTES)):
            sets = shingle_sets(texts_of(batch), words)
            arrays = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), arrays], ["key", "shingles"])

    return docs.select("key", "text").mapInArrow(run, "key binary, shingles array<bigint>")


def _least_agreeing(rule: Rule) -> int:
    """Agreeing minima that a pair must have at least."""
    share, count = rule.percent / 100, BANDS * ROWS
    return int(count * (share - ERRORS * (share * (1 - share) / count) ** 0.5))


def _close(pairs: DataFrame, vertices: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (`a`, `b`) whose full sets are similar enough.

    Sizes and signatures are compared first: a pair that fails there can't reach the threshold, or only
    with the chance of `ERRORS` standard errors.
    """
    facts = vertices.select("key", "n_shingles", "signature")
    for side in "ab":
        named = facts.select(
            F.col("key").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("signature").alias(f"s{side}")
        )
        pairs = pairs.join(named, side)
    few, many = F.least("na", "nb"), F.greatest("na", "nb")
    least, count = _least_agreeing(rule), BANDS * ROWS

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(s).to_pylist()), dtype=np.uint32).reshape(-1, count) for s in ("sa", "sb")
            )
            keep = (left == right).sum(axis=1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    sized = pairs.where(100 * few >= rule.percent * many).select("a", "b", "sa", "sb")
    return _confirmed(sized.mapInArrow(agree, "a binary, b binary"), sets, rule)


def _confirmed(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (`a`, `b`) that reach the threshold on full sets."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("key").alias(side), F.col("shingles").alias(f"x{side}")), side)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("xa"), batch.column("xb"), strict=True):
                x, y = left.values.to_numpy(), right.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= rule.percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(confirm, "a binary, b binary")


def _shared(keys: DataFrame, vertices: DataFrame, sets: DataFrame) -> DataFrame:
    """`key`, `n` (size) and `shared` of the members `key`: the shingles that a second member has, rarest first."""
    own = keys.join(vertices.select("key", "n_shingles"), "key").join(sets, "key")
    own = own.select("key", F.col("n_shingles").alias("n"), F.explode("shingles").alias("shingle"))
    spread = pin(own.groupBy("shingle").agg(F.count(F.lit(1)).alias("spread")).where("spread > 1"))
    listed = own.join(spread, "shingle").groupBy("key", "n")
    return listed.agg(F.sort_array(F.collect_list(F.struct("spread", "shingle"))).alias("shared"))


def _rest(members: DataFrame, vertices: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links (`a`, `b`) between members (`key`, `root`, `n`, `shared`) of different components.

    Shingles are ordered by how many members have them, rarest first. Two sets that reach the threshold
    share one among the first of each, as far as what follows it is large enough: so copies with
    too many words of their own meet nobody, whatever the size of their group. Shingles that only
    one component has, as most common ones of a large group, are left out; in the others, whoever is outside
    the largest component meets the members of all other ones. They meet inside a task, which looks at
    sizes and signatures, and only what passes leaves it, to be confirmed on full sets.
    """
    least = F.ceil(F.col("n") * rule.percent / 100)
    listed = members.withColumn("take", F.size("shared") - least + 1).where("take > 0")
    first = listed.select(
        "key", "root", "n", (F.col("n") - F.size("shared")).alias("alone"),
        F.posexplode(F.slice("shared", F.lit(1), F.col("take").cast("int"))).alias("i", "s"),
    )
    # `rest`: the shingle itself and those after it, which is all that two sets can still share.
    first = pin(first.select("key", "root", "n", F.col("s.shingle").alias("shingle"), (F.col("n") - F.col("alone") - F.col("i")).alias("rest")))
    counts = first.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("count"))
    main = counts.groupBy("shingle").agg(
        F.max(F.struct("count", "root")).alias("main"), F.count("root").alias("roots"), F.sum("count").alias("members")
    )
    main = main.where("roots > 1").select("shingle", "main.root", "members").withColumnRenamed("root", "main")
    met = first.join(pin(main), "shingle").join(vertices.select("key", "signature"), "key")
    # Blocks of a frequent shingle's members meet pair by pair, each pair of blocks in a group of its own.
    blocks = F.ceil(F.col("members") / BLOCK)
    met = met.withColumn("own", F.pmod(F.xxhash64("key"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    held = met.select("shingle", "low", "high", "own", "key", "root", "main", "n", "rest", "signature")
    sorted_ = held.repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high")
    likely = sorted_.mapInArrow(_met(rule), "a binary, b binary")
    return _confirmed(likely.distinct(), sets, rule)


def _met(rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of members of a shingle's block, or of two blocks, whose sizes, shared shingles and signatures allow a link.

    Rows come sorted by block, so a run of equal ones is a block or a pair of them; a run that a batch cuts waits
    for the next batch.
    """
    least, count = _least_agreeing(rule), BANDS * ROWS
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def meet(rows: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        keys, roots, mains = (rows.column(c).combine_chunks() for c in ("key", "root", "main"))
        component = pc.index_in(roots, pc.unique(roots)).to_numpy()
        outside = pc.not_equal(roots, mains).to_numpy(zero_copy_only=False)
        own, low, high, n, rest = (rows.column(c).to_numpy() for c in ("own", "low", "high", "n", "rest"))
        signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, count)
        left, right = [], []
        for s, e in zip(starts, ends, strict=True):
            for i in (np.flatnonzero(outside[s:e]) + s).tolist():
                meets = component[s:e] != component[i]
                # A pair of two members outside is looked at once.
                meets[: i - s] &= ~outside[s:i]
                meets &= np.minimum(rest[s:e], rest[i]) * (100 + rule.percent) >= rule.percent * (n[s:e] + n[i])
                if low[s] != high[s]:
                    meets &= own[s:e] != own[i]
                at = np.flatnonzero(meets) + s
                if len(at):
                    at = at[(signature[at] == signature[i]).sum(axis=1) >= least]
                    left += [i] * len(at)
                    right += at.tolist()
        pairs = np.array([left, right], dtype=np.int64)
        a, b = (keys.take(pa.array(side)) for side in pairs)
        first = pc.less(a, b)
        return pa.RecordBatch.from_arrays([pc.if_else(first, a, b), pc.if_else(first, b, a)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            block = np.stack([rows.column(c).to_numpy() for c in ("shingle", "low", "high")])
            borders = np.flatnonzero((block[:, 1:] != block[:, :-1]).any(axis=0)) + 1
            if len(borders):
                whole = int(borders[-1])
                yield meet(rows.slice(0, whole), np.concatenate([[0], borders[:-1]]), borders)
                rows = rows.slice(whole)
            held = rows
        if held is not None and held.num_rows:
            yield meet(held, np.array([0]), np.array([held.num_rows]))

    return run


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """`docs` with `n_shingles`, `component_id` and `first_of_group`.

    Documents with equal shingle sets are one vertex. Vertices that share a band meet in a bucket. First,
    each is compared with its bucket's smallest vertex (pairs in proportion to the members, however
    many there are), and the links found are joined to components. Where a bucket still holds several
    components, its members are compared with the one that has the fewest shingles of its own, and
    what then lies in different components across these, as far as the rarest shingles allow (see
    `_rest`). So a link is lost only if two sets share no band, or if their signatures differ by more
    than `ERRORS` standard errors. Links are confirmed on full sets.

    `component_id` is the smallest id reachable by links, `first_of_group` marks one row of each
    component: the one with the smallest id, and among rows of equal id the first. A null, empty or blank
    text has no shingles and is a group of its own. A null id counts as larger than any other; if all ids
    of a group are null, so is its `component_id`. Columns of the made names are replaced.
    """
    made = ["n_shingles", "component_id", "first_of_group"]
    keep = [c for c in docs.columns if c.lower() not in made]
    (row,) = unused(docs, "row")
    rows = docs.select(*map(column, keep), row_id().alias(row))
    source = rows.select(F.col(row).alias("row"), column(id_column).cast("long").alias("doc"), column(text).cast("string").alias("text"))
    hashed = pin(_vertices(source, rule.words))
    order = F.struct(F.coalesce("doc", F.lit((1 << 63) - 1)).alias("place"), F.col("row"), F.col("doc"))
    full = hashed.where("key is not null")
    # Copies have equal bands and signatures; a class keeps those of its first row.
    vertices = pin(
        full.groupBy("key").agg(F.min(order).alias("least"), F.min("n_shingles").alias("n_shingles"))
        .join(full.select("row", "bands", "signature"), F.col("least.row") == F.col("row")).drop("row")
    )
    spread = vertices.select(F.explode("bands").alias("bucket"), "key")
    buckets = spread.groupBy("bucket").agg(F.min("key").alias("pivot"), F.count("key").alias("n")).where("n > 1")
    # Aggregates are written before they are joined with what they aggregate: the join then has two
    # plain exchanges, of which Spark splits a heavy key.
    buckets = pin(buckets)
    members = pin(spread.join(buckets.select("bucket", "pivot"), "bucket"))
    wanted = members.select("key").distinct()
    first_rows = vertices.join(wanted, "key", "left_semi").select("key", F.col("least.row").alias("row"))
    sets = pin(_sets(first_rows.join(source.select("row", "text"), "row"), rule.words))
    star = members.where("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    found = components(_close(star, vertices, sets, rule))
    placed = members.join(found.withColumnRenamed("vertex", "key"), "key", "left")
    placed = placed.select("bucket", "key", "pivot", F.coalesce("root", "key").alias("root"))
    pivots = found.select(F.col("vertex").alias("pivot"), F.col("root").alias("main"))
    placed = pin(placed.join(pivots, "pivot", "left").withColumn("main", F.coalesce("main", "pivot")).drop("pivot"))
    mixed = pin(placed.where(F.col("root") != F.col("main")).select("bucket").distinct())
    mixed = placed.join(mixed, "bucket", "left_semi")
    shared = pin(_shared(mixed.select("key").distinct(), vertices, sets))
    # A second star around the member of each such bucket that has the fewest shingles of its own.
    apart = mixed.join(shared.select("key", (1 - F.size("shared") / F.col("n")).alias("alone")), "key")
    centre = pin(apart.groupBy("bucket").agg(F.min(F.struct("alone", "key", "root")).alias("centre")))
    star = mixed.join(centre, "bucket").where(F.col("root") != F.col("centre.root"))
    star = star.select(F.least("key", "centre.key").alias("a"), F.greatest("key", "centre.key").alias("b")).distinct()
    found = components(_as_links(found).unionByName(_close(star, vertices, sets, rule)))
    members = shared.join(found.withColumnRenamed("vertex", "key"), "key", "left")
    more = _rest(members.withColumn("root", F.coalesce("root", "key")), vertices, sets, rule)
    found = components(_as_links(found).unionByName(more))
    classes = vertices.select("key", "least").join(found.withColumnRenamed("vertex", "key"), "key", "left")
    classes = classes.withColumn("root", F.coalesce("root", "key"))
    first = pin(classes.groupBy("root").agg(F.min("least").alias("first")))
    named = classes.join(first, "root").select("key", "first")
    verdict = hashed.select("row", "n_shingles", "key").join(named, "key", "left").select(
        F.col("row").alias(row), "n_shingles", F.col("first.doc").alias("component"), F.col("first.row").alias("leader")
    )
    out = rows.join(verdict, row)
    alone = F.col("leader").isNull()
    return out.select(
        *map(column, keep),
        "n_shingles",
        _where(alone, column(id_column).cast("long"), F.col("component")).alias("component_id"),
        (alone | (F.col("leader") == F.col(row))).alias("first_of_group"),
    )


def _as_links(found: DataFrame) -> DataFrame:
    """Components as the links of stars, which later links are added to."""
    return found.select(F.col("vertex").alias("a"), F.col("root").alias("b"))


def _where(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)
