"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.plans.blocks import pin


def _roots(u: np.ndarray, v: np.ndarray, count: int) -> np.ndarray:
    """The smallest of `count` numbered vertices that each one reaches by the links."""
    root = np.arange(count)
    while True:
        least = np.minimum(root[u], root[v])
        hooked = root.copy()
        np.minimum.at(hooked, root[u], least)
        np.minimum.at(hooked, root[v], least)
        while not np.array_equal(hooked, hooked[hooked]):
            hooked = hooked[hooked]
        if np.array_equal(hooked, root):
            return root
        root = hooked


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars around the smallest vertex of each component that they form alone."""
    links = list(batches)
    if not links:
        return
    ends = [pa.concat_arrays([x.column(side) for x in links]) for side in ("u", "v")]
    every = pc.unique(pa.concat_arrays(ends))
    every = every.take(pc.sort_indices(every))
    u, v = (pc.index_in(side, every).to_numpy() for side in ends)
    root = _roots(u, v, len(every))
    leaf = np.flatnonzero(root != np.arange(len(every)))
    yield pa.RecordBatch.from_arrays([every.take(pa.array(leaf)), every.take(pa.array(root[leaf]))], ["u", "v"])


def _contracted(edges: DataFrame) -> DataFrame:
    return pin(edges.mapInArrow(_stars, edges.schema))


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no vertex has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    found = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return found.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _star(edges: DataFrame) -> DataFrame:
    """`u`, `v`, and the smallest vertex `m` among `u` and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Written, so that the join sees two plain exchanges, of which Spark can split a heavy vertex.
    return edges.join(pin(least), "u")


def components(links: DataFrame) -> DataFrame:
    """`vertex` and `root`, the smallest vertex it reaches, for every vertex of the links (`a`, `b`).

    A large-star step links the larger neighbours of a vertex to its smallest neighbour, a small-star
    step the smaller ones; alternating, they turn each component into a star around its smallest vertex in
    a number of rounds that grows with the logarithm of its size. Before the rounds and between them, a task
    replaces the links of its own partition by the stars of the components that these form alone, which
    spares rounds and links. The smallest neighbour is aggregated before the exchange, and a vertex with
    very many links is a skewed side of a join, which Spark splits. Rounds end when all links are
    stars; each is written to the shared folder, and only that answer reaches the driver.

    Vertices may have any ordered type. Links to itself, repeated ones and both directions are fine;
    null ends are dropped. Without links there are no rows.
    """
    ordered = links.where(F.col("a") != F.col("b"))
    ordered = ordered.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = _contracted(ordered)
    while not _settled(edges):
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = _star(edges.unionByName(turned)).where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(pin(large))  # every v is smaller than its u
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        edges = _contracted(small.distinct())
    roots = edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(roots)
