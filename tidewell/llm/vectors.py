"""Near-duplicate embeddings by a forest of random-projection trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import column, row_id
from tidewell.llm.components import components
from tidewell.plans.blocks import pin

#: Vectors that the splits are fitted on at most; every vector is indexed.
SAMPLE = 16_384
#: Vectors of a leaf at which splitting ends.
LEAF = 256
#: Vectors of the sample that a node needs to be split.
LEAST_SAMPLE = 16
#: Half the width of the overlap, in standard deviations of the node's projections.
SPILL = 0.1
#: Recall that the forest must reach on measured pairs, in every class of density.
RECALL = 0.98
#: Vectors of the sample whose links within it are searched exhaustively, and links kept of each.
PROBES, PROBE_LINKS = 4096, 16
#: Pairs from which a class of density is measured by itself.
LEAST_PAIRS = 100
#: Trees from which a forest is given up for one of half the depth.
MOST_TREES = 16
#: A node is split if its deviation is so many times that of a pair at the threshold at least.
NARROW = 1.5
#: Lengths of vectors in one table; more are an error.
LENGTHS = 1000
#: Rows of one side of a comparison; a larger leaf is compared block by block.
BLOCK = 1024


@dataclass(frozen=True)
class Tree:
    """One direction per level, and the threshold and overlap of every node, as a heap."""

    directions: np.ndarray
    thresholds: np.ndarray
    spill: np.ndarray


def separation(cosine: float) -> float:
    """Chance that one split parts two unit vectors of this cosine, for a spread-out cloud.

    Their difference along a random direction is normal with deviation `gap` times that of the cloud;
    they part if it exceeds the overlap and the threshold lies between.
    """
    gap = math.sqrt(2 - 2 * cosine)
    steps = np.linspace(0, 6, 2001)
    weight = np.exp(-(steps**2) / 2)
    beyond = np.maximum(0, gap * steps - 2 * SPILL) / math.sqrt(2 * math.pi)
    return float(min(0.5, (weight * beyond).sum() / weight.sum()))


def trees_for(depth: int, cosine: float) -> int:
    """Trees with which a pair at the threshold meets in some leaf with the chance `RECALL`."""
    meet = (1 - separation(cosine)) ** depth
    return 4 if meet > 0.99 else max(4, math.ceil(math.log(1 - RECALL) / math.log(1 - meet)))


def grow(sample: np.ndarray, trees: int, depth: int, seed: int, narrow: float = 0.0, first: int = 0) -> list[Tree]:
    """Trees of random splits, each at a random place near the median of the node's sample.

    A node whose deviation is below `narrow` stays whole. `first` is the number of the first tree.
    """
    forest = []
    for t in range(first, first + trees):
        rng = np.random.default_rng((seed, t))
        directions = rng.standard_normal((depth, sample.shape[1]))
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        thresholds, spill = np.full(1 << depth, np.nan), np.zeros(1 << depth)
        node = np.ones(len(sample), dtype=np.int64)
        for level in range(depth):
            at = sample @ directions[level]
            for k in range(1 << level, 2 << level):
                own = at[node == k]
                if len(own) >= LEAST_SAMPLE and own.std() >= narrow:
                    thresholds[k] = np.quantile(own, rng.uniform(0.45, 0.55))
                    spill[k] = SPILL * own.std()
            node = np.where(np.isnan(thresholds[node]), node, 2 * node + (at >= thresholds[node]))
            node = np.where(node >= 2 << level, node, 0)  # an unsplit node takes no further part
        forest.append(Tree(directions, thresholds, spill))
    return forest


def leaves(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of vectors and the leaves they lie in; one in an overlap lies in both children."""
    at, node = np.arange(len(vectors)), np.ones(len(vectors), dtype=np.int64)
    ended: list[tuple[np.ndarray, np.ndarray]] = []
    for direction in tree.directions:
        here = tree.thresholds[node]
        stop = np.isnan(here)
        ended.append((at[stop], node[stop]))
        at, node, here = at[~stop], node[~stop], here[~stop]
        projected, width = (vectors @ direction)[at], tree.spill[node]
        left, right = projected < here + width, projected >= here - width
        at, node = np.concatenate([at[left], at[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
    ended.append((at, node))
    return np.concatenate([a for a, _ in ended]), np.concatenate([n for _, n in ended])


def probes(sample: np.ndarray, cosine: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs to measure recall with: one vector of each, the other one, and the class of the pair.

    Class 0 are made pairs exactly at the threshold, each from a vector of the sample towards another one; they
    stand for links too rare for the sample. The others are links inside the sample, found by comparing
    `PROBES` vectors with all of it, in classes by the logarithm of the vector's number of links.
    """
    rng = np.random.default_rng((seed, 1 << 20))
    own = rng.permutation(len(sample))[:PROBES]
    some = sample[own]
    other = sample[rng.integers(0, len(sample), len(own))]
    side = other - (other * some).sum(axis=1, keepdims=True) * some
    length = np.linalg.norm(side, axis=1, keepdims=True)
    usable = length[:, 0] > 1e-6
    made = cosine * some[usable] + math.sqrt(1 - cosine * cosine) * side[usable] / length[usable]
    left, right, kinds = [some[usable]], [made], [np.zeros(len(made), dtype=np.int64)]
    for start in range(0, len(own), 256):
        i, j = np.nonzero(some[start : start + 256] @ sample.T >= cosine)
        i, j = np.stack([i, j])[:, own[start + i] != j]
        links = np.bincount(i, minlength=256)
        mixed = rng.permutation(len(i))
        mixed = mixed[np.argsort(i[mixed], kind="stable")]
        rank = np.arange(len(i)) - np.repeat(np.cumsum(links) - links, links)
        i, j = i[mixed[rank < PROBE_LINKS]], j[mixed[rank < PROBE_LINKS]]
        left.append(some[start + i])
        right.append(sample[j])
        kinds.append(1 + np.log2(links[i]).astype(np.int64))
    return np.concatenate(left), np.concatenate(right), np.concatenate(kinds)


def meets(tree: Tree, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the two vectors of each pair share a leaf."""
    codes = [(at << 24) | leaf for at, leaf in (leaves(tree, left), leaves(tree, right))]
    out = np.zeros(len(left), dtype=bool)
    out[np.intersect1d(*codes) >> 24] = True
    return out


def reached(met: np.ndarray, kinds: np.ndarray) -> bool:
    """Whether the recall is reached for made pairs, for all links, and in every class of enough pairs."""
    sets = [kinds == 0, kinds > 0, *(kinds == k for k in np.unique(kinds) if (kinds == k).sum() >= LEAST_PAIRS)]
    return all(met[own].mean() >= RECALL for own in sets if own.any())


def measured(sample: np.ndarray, depth: int, cosine: float, seed: int) -> list[Tree]:
    """A forest that is grown until its measured recall is reached.

    Nodes no wider than a dense topic, in which a split parts most links, stay whole and are compared
    exhaustively. If `MOST_TREES` don't do, the depth is halved; without a split recall is 1.
    """
    left, right, kinds = probes(sample, cosine, seed)
    narrow = NARROW * math.sqrt((2 - 2 * cosine) / sample.shape[1])
    while depth:
        forest, met = [], np.zeros(len(left), dtype=bool)
        while len(forest) < MOST_TREES:
            forest += grow(sample, 1, depth, seed, narrow, len(forest))
            if np.isnan(forest[-1].thresholds).all():
                return forest[-1:]
            met |= meets(forest[-1], left, right)
            if len(forest) >= 4 and reached(met, kinds):
                return forest
        depth //= 2
    return grow(sample, 1, 0, seed)


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype="<f8").reshape(len(vectors), -1)


def _keyed(rows: DataFrame) -> DataFrame:
    """`row`, `id`, `size` (components; null if unusable), `key` and `vector` (packed doubles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sizes, keys, packed = [], [], []
            for vector in batch.column("vector"):
                usable = None
                if vector.is_valid and len(vector) and not vector.values.null_count:
                    usable = vector.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zero
                    scale = np.abs(usable).max()
                    usable = usable if np.isfinite(scale) and scale > 0 else None
                if usable is not None:
                    # A power of two keeps every digit, and squares neither overflow nor vanish.
                    usable = np.ldexp(usable, -int(np.frexp(scale)[1]))
                data = None if usable is None else usable.astype("<f8").tobytes()
                sizes.append(None if data is None else len(usable))
                keys.append(None if data is None else xxhash.xxh3_128_digest(data))
                packed.append(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()),
                 pa.array(packed, pa.binary())],
                ["row", "id", "size", "key", "vector"],
            )

    return rows.mapInArrow(run, "row bigint, id bigint, size int, key binary, vector binary")


def _linked(classes: DataFrame, cosine: float, seed: int) -> DataFrame:
    """Per comparison: `key`, `found` (rows linked to it there), `other` (a key it is linked to)."""
    spark = classes.sparkSession
    found = classes.groupBy("size").agg(F.count("key").alias("n")).limit(LENGTHS + 1).collect()
    if len(found) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths: each length needs a forest of its own")
    parts = []
    for size, count in sorted((r["size"], r["n"]) for r in found):
        own = classes.where(F.col("size") == size)
        some = own.select("vector", "key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toArrow()
        sample = _unit(_matrix(some.column("vector").to_pylist()))
        # A node of the last level keeps LEAST_SAMPLE vectors of the sample, and a leaf about LEAF of all.
        depth = max(0, math.ceil(math.log2(max(1, min(count / LEAF, len(sample) / LEAST_SAMPLE)))))
        forest = measured(sample, depth, cosine, seed)
        parts.append(_compare(own, spark.sparkContext.broadcast(forest), cosine))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _compare(classes: DataFrame, forest, cosine: float) -> DataFrame:
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column("vector").to_pylist()))
            routed = [leaves(tree, unit) for tree in forest.value]
            # Every vector's leaves in all trees, as tree << 40 | leaf, so that a pair that meets several
            # times is counted in the first place only.
            where = np.concatenate([(t << 40) | leaf for t, (_, leaf) in enumerate(routed)])
            at = np.concatenate([a for a, _ in routed])
            order = np.lexsort((where, at))
            at, where = at[order], where[order]
            first = np.searchsorted(at, np.arange(batch.num_rows + 1))
            lists = [where[a:b].astype("<i8").tobytes() for a, b in zip(first, first[1:], strict=False)]
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(where), rows.column("key"), rows.column("copies"), rows.column("vector"),
                 pa.array([lists[i] for i in at], pa.binary())],
                ["leaf", "key", "copies", "vector", "places"],
            )

    routed = classes.select("key", "copies", "vector").mapInArrow(
        route, "leaf bigint, key binary, copies bigint, vector binary, places binary"
    )
    routed = pin(routed)
    blocks = routed.groupBy("leaf").agg(F.ceil(F.count("key") / BLOCK).cast("int").alias("blocks"))
    own = routed.join(pin(blocks), "leaf").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # Each block meets every block of its leaf once: pairs (low, high) with low <= high.
    pairs = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select(
        "leaf", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "own",
        "key", "copies", "vector", "places",
    )

    def block(group: pa.Table) -> pa.Table:
        leaf, low, high = (group.column(c)[0].as_py() for c in ("leaf", "low", "high"))
        side = group.column("own").to_numpy()
        keys, places = group.column("key").to_pylist(), group.column("places").to_pylist()
        copies = group.column("copies").to_numpy()
        unit = _unit(_matrix(group.column("vector").to_pylist()))
        left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
        i, j = np.nonzero(unit[left] @ unit[right].T >= cosine)
        i, j = left[i], right[j]
        if low == high:
            i, j = i[i < j], j[i < j]
        lists = [np.frombuffer(p, dtype="<i8") for p in places]
        lists = [x[: np.searchsorted(x, leaf)] for x in lists]
        earlier = np.full((len(keys), max(map(len, lists))), -1, dtype=np.int64)
        for k, x in enumerate(lists):
            earlier[k, : len(x)] = x
        new = np.ones(len(i), dtype=bool)
        for start in range(0, len(i), 1 << 14):
            a, b = earlier[i[start : start + (1 << 14)]], earlier[j[start : start + (1 << 14)]]
            for own in a.T:
                new[start : start + (1 << 14)] &= ~((own[:, None] == b) & (own[:, None] >= 0)).any(axis=1)
        i, j = i[new], j[new]
        found = np.bincount(i, copies[j], len(keys)) + np.bincount(j, copies[i], len(keys))
        least = np.arange(len(keys))
        # One link per vector and round: the smallest neighbour, then the smallest of that one, and so on.
        while True:
            now = least.copy()
            np.minimum.at(now, j, now[i])
            np.minimum.at(now, i, now[j])
            now = now[now]
            if (now == least).all():
                break
            least = now
        some = np.flatnonzero(found > 0)
        return pa.table(
            {
                "key": pa.array([keys[k] for k in some], pa.binary()),
                "found": pa.array(found[some].astype(np.int64)),
                "other": pa.array([keys[least[k]] for k in some], pa.binary()),
            }
        )

    return pairs.groupBy("leaf", "low", "high").applyInArrow(block, "key binary, found bigint, other binary")


def near_vectors(
    rows: DataFrame, cosine: float = 0.9, vector: str = "embedding", id_column: str = "vec_id", seed: int = 2
) -> DataFrame:
    """`rows` with `n_links`, `component_id` and `first_of_group`.

    Equal vectors are one class with a number of copies. A forest of trees splits the space: every node at
    a random place near the median along a random direction, with an overlap whose vectors go to both
    sides. Nodes that are narrow against a pair at the threshold, as dense topics are, aren't split, and
    trees are added until the recall measured on exhaustively found links of the sample, in every class
    of density, and on made pairs at the threshold is `RECALL` (see `measured`). The splits come from a
    bounded sample, but every vector is routed through every tree. Vectors
    of a leaf are compared by cosine in double precision, large leaves block by block, so that a dense
    cluster is spread over many tasks. A pair counts where it meets first. Only a link to one neighbour per
    vector and comparison leaves it, beside the number of links.

    Vectors that are null, empty or zero, or that hold null, NaN or infinite components, link with
    nothing; so do vectors of different lengths, of which more than `LENGTHS` are an error. `component_id` is the smallest id reachable, null ids
    counting as larger than any; `first_of_group` marks one row of each component. Repeated rows are links
    of each other. Columns of the made names are replaced; no rows give no rows.
    """
    keep = [c for c in rows.columns if c.lower() not in ("n_links", "component_id", "first_of_group")]
    numbered = rows.select(*map(column, keep), row_id().alias("_row_of_vector"))
    source = numbered.select(
        F.col("_row_of_vector").alias("row"), column(id_column).cast("long").alias("id"),
        column(vector).cast("array<double>").alias("vector"),
    )
    keyed = pin(_keyed(source))
    usable = keyed.where("key is not null")
    order = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("place"), F.col("row"), F.col("id"))
    classes = usable.groupBy("key").agg(F.min(order).alias("least"), F.count("row").alias("copies"))
    classes = pin(classes.join(usable.select("row", "size", "vector"), F.col("least.row") == F.col("row")).drop("row"))
    if classes.isEmpty():
        alone = numbered.withColumn("n_links", F.lit(0).cast("long"))
        alone = alone.withColumn("component_id", column(id_column).cast("long"))
        return alone.withColumn("first_of_group", F.lit(True)).drop("_row_of_vector")
    linked = pin(_linked(classes, cosine, seed))
    found = components(linked.select(F.col("key").alias("a"), F.col("other").alias("b")))
    counts = linked.groupBy("key").agg(F.sum("found").alias("found"))
    named = classes.select("key", "least", "copies").join(found.withColumnRenamed("vertex", "key"), "key", "left")
    named = pin(named.join(counts, "key", "left").withColumn("root", F.coalesce("root", "key")))
    first = pin(named.groupBy("root").agg(F.min("least").alias("first")))
    facts = named.join(first, "root").select(
        "key", "first", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links")
    )
    verdict = keyed.select("row", "key").join(facts, "key", "left")
    out = numbered.join(verdict, F.col("_row_of_vector") == F.col("row"))
    alone = F.col("first").isNull()
    return out.select(
        *map(column, keep),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, column(id_column).cast("long")).otherwise(F.col("first.id")).alias("component_id"),
        (alone | (F.col("first.row") == F.col("row"))).alias("first_of_group"),
    )
