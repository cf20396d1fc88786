"""Packing by lexical retrieval: neighbours under BM25 fill each seed document's window."""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import column, pieces, row_id, texts_of
from tidewell.llm.tokens import Source
from tidewell.plans.blocks import pin

WINDOW = 2048
#: Token ids of one shard of the index, on average: memory of a task, whatever the table's size.
SHARD_TOKENS = 1 << 19
K1, B = 1.2, 0.75
#: Dimensions of the projected term weights that documents are grouped by, and documents the groups are fitted on.
DIMENSIONS, SAMPLE = 64, 4096
#: Groups at most; larger ones are dealt over several shards.
GROUPS = 512
#: Texts or ids that a worker has in its hands at once; all it makes of them is several times as large.
BATCH_BYTES = 1 << 20
_FIELDS = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


@dataclass
class Item:
    """What is left of a document: its ids from `start` on."""

    doc: int | None
    ids: np.ndarray
    start: int

    def __len__(self) -> int:
        return len(self.ids) - self.start


@dataclass(frozen=True)
class Corpus:
    """Number of items, items that hold each term, and mean length, over the whole table."""

    count: int
    spread: np.ndarray
    mean: float

    def idf(self, terms: np.ndarray) -> np.ndarray:
        spread = self.spread[terms]
        return np.log((self.count - spread + 0.5) / (spread + 0.5))


class Index:
    """BM25 over the items of one shard, as an inverted index in arrays.

    Frequencies and mean length are those of the corpus, or of the shard without one. The inverse document frequency is the logarithm of (N - n + 0.5) / (n + 0.5) where that is
    positive; terms of half the items or more say nothing about a document and have no list.
    """

    def __init__(self, items: list[Item], corpus: Corpus | None = None):
        sizes = np.array([len(x) for x in items], dtype=np.int64)
        owner = np.repeat(np.arange(len(items)), sizes)
        terms = np.concatenate([x.ids[x.start :] for x in items]).astype(np.int64)
        keys, counts = np.unique(terms * len(items) + owner, return_counts=True)
        terms, owner = keys // len(items), keys % len(items)
        known, starts, spread = np.unique(terms, return_index=True, return_counts=True)
        if corpus is None:
            idf, mean = np.log((len(items) - spread + 0.5) / (spread + 0.5)), sizes.mean()
        else:
            idf, mean = corpus.idf(known), corpus.mean
        useful = idf > 0
        keep = np.repeat(useful, spread)
        norm = K1 * (1 - B + B * sizes / mean)
        weight = np.repeat(idf, spread) * counts * (K1 + 1) / (counts + norm[owner])
        self.owner, self.weight = owner[keep], weight[keep]
        self.spread = spread[useful]
        self.starts = np.cumsum(self.spread) - self.spread
        number = np.full(len(known), -1)
        number[useful] = np.arange(useful.sum())
        self.number = np.repeat(number, spread)[keep]
        order = np.argsort(self.owner, kind="stable")
        self.terms = self.number[order]
        self.first = np.searchsorted(self.owner[order], np.arange(len(items) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """Scores of all items for the terms of the seed, each term once."""
        terms = self.terms[self.first[seed] : self.first[seed + 1]]
        if not len(terms):
            return np.zeros(len(self.first) - 1)
        spread = self.spread[terms]
        ends = np.cumsum(spread)
        at = np.arange(ends[-1]) + np.repeat(self.starts[terms] - ends + spread, spread)
        return np.bincount(self.owner[at], self.weight[at], minlength=len(self.first) - 1)

    def keep(self, wanted: np.ndarray) -> None:
        """Takes all other items off the lists; the scores of the wanted ones stay as they are."""
        kept = wanted[self.owner]
        self.owner, self.weight, self.number = self.owner[kept], self.weight[kept], self.number[kept]
        self.spread = np.bincount(self.number, minlength=len(self.spread))
        self.starts = np.cumsum(self.spread) - self.spread


Piece = tuple[Item, int, int]


def fill(items: list[Item], window: int, last: bool, corpus: Corpus | None = None) -> Iterator[list[tuple[Item, int, int]]]:
    """Windows as lists of (item, start, length); what fills no window stays in `items`.

    The seed is the first unused item. Its unused neighbours follow by falling score (then in order)
    as long as the window has room; the one that reaches its end is cut, and its rest seeds the next
    window. If `last`, the rest is laid into sequences whose lengths are powers of two.
    """
    if not items:
        return
    index = Index(items, corpus)
    unused = np.ones(len(items), dtype=bool)
    left = sum(map(len, items))
    following, seed = 0, None
    listed = len(items)
    while left >= window:
        if 4 * unused.sum() < 3 * listed:
            listed = unused.sum()
            index.keep(unused)
        if seed is None:
            while not unused[following]:
                following += 1
            seed = following
        pieces, room, scores, at = [], window, None, seed
        while True:
            item, take = items[at], min(room, len(items[at]))
            pieces.append((item, item.start, take))
            item.start += take
            room -= take
            left -= take
            unused[at] = len(item) > 0
            if not room:
                break
            if scores is None:
                scores = np.where(unused, index.scores(seed), -1)
            scores[at] = -1
            at = int(np.argmax(scores))
        yield pieces
        seed = at if unused[at] else None
    rest = [x for x, u in zip(items, unused, strict=True) if u]
    items[:] = rest
    if last:
        queue = deque(rest)
        for bit in range(window.bit_length() - 1, -1, -1):
            if left & (1 << bit):
                pieces, room = [], 1 << bit
                while room:
                    item, take = queue[0], min(room, len(queue[0]))
                    pieces.append((item, item.start, take))
                    item.start += take
                    room -= take
                    if not len(item):
                        queue.popleft()
                yield pieces
        items.clear()


def _ids(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if len(data) == 2 * size else "<u4")


def _rests(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Ids of each document after the windows of its own."""
    columns = (batch.column(c).to_pylist() for c in ("ids", "size", "rest"))
    return [_ids(data, size)[size - rest :] for data, size, rest in zip(*columns, strict=True)]


def _sizes(rests: list[np.ndarray]) -> np.ndarray:
    return np.fromiter(map(len, rests), dtype=np.int64, count=len(rests))


def _bags(rests: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids of each document in ascending order, how often it holds them, and where its own begin and end."""
    ids = np.concatenate([np.zeros(0, dtype=np.uint16), *rests])
    width = int(ids.max(initial=0)) + 1
    kind = np.uint32 if len(rests) * width < 1 << 32 else np.uint64
    keys = np.repeat(np.arange(len(rests), dtype=kind) * kind(width), _sizes(rests)) + ids
    keys.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]]))
    owner, terms = np.divmod(keys[first], kind(width))
    cuts = np.searchsorted(owner, np.arange(len(rests) + 1))
    return terms.astype(np.int64), np.diff(first, append=len(keys)), cuts


def _frequencies(encoded: DataFrame) -> np.ndarray:
    """Documents whose rest holds each id; one number per id of the tokenizer reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = np.zeros(0, dtype=np.int64)
        for batch in pieces(batches, "ids", BATCH_BYTES):
            own = np.bincount(_bags(_rests(batch))[0], minlength=len(spread))
            own[: len(spread)] += spread
            spread = own
        some = np.flatnonzero(spread)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(spread[some])], ["term", "n"])

    counted = encoded.select("ids", "size", "rest").mapInArrow(run, "term bigint, n bigint")
    found = counted.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    terms = found.column("term").to_numpy()
    out = np.zeros(int(terms.max()) + 1 if len(terms) else 0, dtype=np.int64)
    out[terms] = found.column("n").to_numpy()
    return out


def directions(rests: list[np.ndarray], corpus: Corpus, plane: np.ndarray) -> np.ndarray:
    """Unit vectors of the projected BM25 weights of documents; zero for one without a telling term."""
    out = np.zeros((len(rests), plane.shape[1]), dtype=np.float32)
    terms, counts, cuts = _bags(rests)
    norm = K1 * (1 - B + B * _sizes(rests) / corpus.mean)
    weight = np.maximum(0, corpus.idf(terms)) * counts * (K1 + 1) / (counts + np.repeat(norm, np.diff(cuts)))
    weight = weight.astype(np.float32)
    for k, (a, b) in enumerate(itertools.pairwise(cuts.tolist())):
        out[k] = weight[a:b] @ plane[terms[a:b]]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def centres(sample: np.ndarray, groups: int) -> np.ndarray:
    """Centres of so many groups of unit vectors by their cosine."""
    rng = np.random.default_rng(6)
    found = sample[rng.choice(len(sample), groups, replace=False)]
    for _ in range(12):
        own = np.argmax(sample @ found.T, axis=1)
        found = np.stack([sample[own == k].sum(axis=0) if (own == k).any() else found[k] for k in range(groups)])
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
    return found


def _grouped(encoded: DataFrame, corpus: Corpus, tokens: int, shard_tokens: int) -> DataFrame:
    """The documents dealt out by groups of similar ones, in order of `shard`; a large group has several shards."""
    some = encoded.where("rest > 0").orderBy(F.xxhash64("row"), "row").limit(SAMPLE)
    tail = F.expr("substring(ids, int(1 + length(ids) div size * (size - rest)))")
    table = some.select(tail.alias("ids"), F.col("rest").alias("size"), "rest").toArrow()
    rests = [x for batch in table.to_batches() for x in _rests(batch)]
    plane = np.random.default_rng(5).standard_normal((len(corpus.spread), DIMENSIONS)).astype(np.float32)
    sample = directions(rests, corpus, plane)
    middle = centres(sample, min(GROUPS, len(sample), -(-tokens // shard_tokens)))
    sizes = np.bincount(np.argmax(sample @ middle.T, axis=1), [len(x) for x in rests], len(middle))
    shards = np.maximum(1, np.ceil(sizes / sizes.sum() * tokens / shard_tokens)).astype(np.int64)
    facts = encoded.sparkSession.sparkContext.broadcast((corpus, plane, middle, shards, np.cumsum(shards) - shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, plane, middle, shards, first = facts.value
        for batch in pieces(batches, "ids", BATCH_BYTES):
            where = directions(_rests(batch), corpus, plane)
            own = np.argmax(where @ middle.T, axis=1)
            salt = batch.column("salt").to_numpy()
            # Documents without a telling term are near to nothing; they go anywhere.
            shard = np.where(where.any(axis=1), first[own] + salt % shards[own], salt % shards.sum())
            yield batch.set_column(batch.schema.get_field_index("salt"), "shard", pa.array(shard))

    salted = encoded.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(1 << 40)))
    dealt = salted.mapInArrow(run, "row bigint, doc_id bigint, ids binary, size bigint, rest bigint, shard bigint")
    return dealt.repartition(int(shards.sum()), "shard").sortWithinPartitions("shard", "row")


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, text: str = "text", id_column: str = "doc_id",
    window: int = WINDOW, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """All documents in sequences of `window` ids, one row per piece with its packed `ids`.

    A document is its ids and `end_id`. Frequencies of terms, the number of documents and their mean length
    are those of the whole table. Documents go to shards of about `shard_tokens` ids by content: groups of
    similar term weights, fitted on a bounded sample, of which large ones are dealt over several shards. A
    shard has an inverted index of its own, so that neighbours are searched within a shard only. Each seed
    takes its nearest unused neighbours until its window is full; the last neighbour is cut, and its rest
    seeds the next window. What is left of a shard joins the next one of the partition, and what is left of a partition is laid into sequences whose lengths are powers of two, so
    that nothing is padded. `window` must be a power of two.

    Null and empty texts are documents of the end id only. Equal ids and repeated rows are documents of
    their own; a null id is kept. Documents longer than a window fill windows of their own first. Other
    columns aren't used. An empty table gives no rows. `sequence_id` is unique, not gapless.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    source = Source(docs.sparkSession, tokenizer)
    wanted = docs.select(
        row_id().alias("row"), column(id_column).cast("long").alias("doc_id"), column(text).cast("string").alias("text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = source.get()
        for batch in pieces(batches, "text", BATCH_BYTES):
            ids, sizes = codec.encode_batch(texts_of(batch), 1 << 16)
            ids, sizes = np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), sizes + 1
            data = ids.astype("<u2" if ids.max() < 1 << 16 else "<u4")
            ends = np.concatenate([[0], np.cumsum(sizes)]) * data.itemsize
            packed = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.Array.from_buffers(pa.binary(), len(sizes), packed)]
                + [pa.array(sizes), pa.array(sizes % window)],
                ["row", "doc_id", "ids", "size", "rest"],
            )

    encoded = pin(wanted.mapInArrow(encode, "row bigint, doc_id bigint, ids binary, size bigint, rest bigint"))
    facts = encoded.where("rest > 0").agg(F.count("row"), F.sum("rest")).first()
    corpus = None
    if facts[0]:
        corpus = Corpus(facts[0], _frequencies(encoded), facts[1] / facts[0])
        encoded = _grouped(encoded, corpus, facts[1], shard_tokens)
    shared = docs.sparkSession.sparkContext.broadcast(corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = shared.value
        sequence = TaskContext.get().partitionId() << 33
        items: list[Item] = []
        held, shard = 0, None

        def rows(windows: Iterator[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out = []
            for pieces_ in windows:
                offset = 0
                for item, start, length in pieces_:
                    ids = item.ids[start : start + length].astype("<u4").tobytes()
                    out.append((item.doc, start, length, len(item.ids), sequence, offset, ids))
                    offset += length
                sequence += 1
                if len(out) >= 2000:
                    yield table(out)
                    out = []
            if out:
                yield table(out)

        def whole(item: Item) -> Iterator[list[Piece]]:
            while len(item) >= window:
                yield [(item, item.start, window)]
                item.start += window

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "ids", "size", batch.schema.names[-1])]
            for doc, data, size, own in zip(*columns, strict=True):
                # A shard may be larger than the sample made it seem; small ones share an index.
                if held >= 2 * shard_tokens or (own != shard and 2 * held >= shard_tokens):
                    yield from rows(fill(items, window, last=False, corpus=corpus))
                    held = sum(map(len, items))
                shard = own
                item = Item(doc, _ids(data, size).astype(np.uint32), 0)
                if len(item) >= window:
                    yield from rows(whole(item))
                if len(item):
                    items.append(item)
                    held += len(item)
        yield from rows(fill(items, window, last=True, corpus=corpus))

    def table(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 6 + [pa.binary()]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return encoded.mapInArrow(run, _FIELDS)
