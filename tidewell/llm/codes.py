"""Compression of vectors to codes: product codebooks by exact k-means with norm-of-sum bounds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import column, unused
from tidewell.plans.blocks import pin

#: Entries of a codebook are bounded in so many groups, each by one number a vector and part.
GROUPS = 4
#: Up to this magnitude, and this many components a part, sums of products are exact in doubles.
NARROW, NARROW_WIDTH = 1 << 21, 512
#: Relative room for the rounding of square roots and differences of bounds.
ROOM = 1e-9
#: Bytes of vectors in one batch.
BATCH_BYTES = 4 << 20
#: Sums of large integers travel as digits to this base, so that no sum overflows.
BASE = 10**15


@dataclass(frozen=True)
class Codebooks:
    """All states of the codebooks, oldest first: for each part an array (entries, components)."""

    history: list[list[np.ndarray]]
    scale: int

    @property
    def wide(self) -> bool:
        """Whether integers are too large for exact doubles; then Python integers are used."""
        return any(c.dtype == object for c in self.history[0])

    def digest(self) -> str:
        """SHA-256 of the last entries' decimal components by part, entry and position."""
        values = (str(int(v)) for part in self.history[-1] for v in part.ravel())
        return hashlib.sha256(",".join(values).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite


def _integers(vectors: list, length: int, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x) of every component, one row a vector; missing last components count 0."""
    if wide:
        # Above 2^53 a double is an integer itself.
        rows = [[math.floor(scale * x) if abs(x) < 2.0**53 else scale * int(x) for x in v] for v in vectors]
        out = np.zeros((len(rows), length), dtype=object)
        for i, row in enumerate(rows):
            out[i, : len(row)] = row
        return out
    out = np.zeros((len(vectors), length))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(scale * out)


def _rows(vectors: pa.Array, length: int, scale: int, wide: bool) -> np.ndarray:
    """`_integers` of a batch's column; vectors of full length are taken as one block of numbers."""
    if not wide and len(vectors) and pc.all(pc.equal(pc.list_value_length(vectors), length)).as_py():
        return np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), length))
    return _integers(vectors.to_pylist(), length, scale, wide)


def _cuts(length: int, parts: int) -> list[slice]:
    return [slice(p * length // parts, (p + 1) * length // parts) for p in range(parts)]


def _groups(entries: int) -> list[slice]:
    ends = np.linspace(0, entries, min(GROUPS, entries) + 1).astype(int)
    return [slice(int(a), int(b)) for a, b in zip(ends, ends[1:], strict=False)]


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    if x.dtype == object:
        return ((x[:, None, :] - entries[None]) ** 2).sum(axis=2) if x.shape[1] else np.zeros((len(x), len(entries)), object)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)[None]


def _below(values: np.ndarray) -> np.ndarray:
    """The numbers as half floats, none of them above its value."""
    clipped = np.minimum(values, 65504.0)
    half = clipped.astype(np.float16)
    return np.where(half.astype(float) > clipped, np.nextafter(half, np.float16(-np.inf)), half)


def displacements(books: Codebooks, part: int) -> np.ndarray:
    """Net displacement of every entry from each earlier state to the last one: (state, entry).

    This is the norm of the sum of an entry's moves, at most the sum of their norms.
    """
    now = books.history[-1][part]
    moved = [((now - then) ** 2).sum(axis=1).astype(float) if now.shape[1] else np.zeros(len(now)) for then in (s[part] for s in books.history)]
    return np.sqrt(np.array(moved)) * (1 + ROOM)


def _net(moved: np.ndarray, stamps: np.ndarray, assigned: np.ndarray, group: slice) -> np.ndarray:
    """The largest net displacement in a group since each row's stamp, the row's own entry left out."""
    inside = moved[:, group]
    first = inside.argmax(axis=1)
    rest = inside.copy()
    rest[np.arange(len(rest)), first] = 0.0
    own = group.start + first[stamps] == assigned
    return np.where(own, rest.max(axis=1)[stamps], inside.max(axis=1)[stamps])


@dataclass
class State:
    """What is remembered of rows: for each part the entry; for each part and group a lower bound of the
    distance to the group's other entries, and the state of the codebooks that the bound speaks of."""

    assigned: np.ndarray
    bounds: np.ndarray
    stamps: np.ndarray


def assign(rows: np.ndarray, books: Codebooks, state: State | None) -> tuple[State, np.ndarray, np.ndarray]:
    """The nearest entry of every part (ties to the lower index), squared distances, distances computed.

    A group whose bound, less the net displacement of its entries since the bound's stamp, is above
    the exact distance to the row's own entry cannot hold a nearer or an equally near one. All other groups
    are scanned exactly, and get a new bound and stamp.
    """
    cuts = _cuts(rows.shape[1], len(books.history[0]))
    now, groups = len(books.history) - 1, _groups(len(books.history[0][0]))
    count, shape = len(rows), (len(rows), len(cuts), len(groups))
    errors = np.zeros(count, dtype=rows.dtype)
    computed = np.zeros(count, dtype=np.int64)
    new = State(np.zeros(shape[:2], np.uint8), np.zeros(shape, np.float16), np.full(shape, now, np.uint8))
    for p, cut in enumerate(cuts):
        x, entries = rows[:, cut], books.history[-1][p]
        if state is None:
            own, best = np.zeros(count, int), _distances(x, entries[:1])[:, 0]
            low = np.full((count, len(groups)), -1.0)
        else:
            own = state.assigned[:, p].astype(int)
            best = ((x - entries[own]) ** 2).sum(axis=1) if x.shape[1] else np.zeros(count, x.dtype)
            moved = displacements(books, p)
            low = np.column_stack(
                [state.bounds[:, p, g].astype(float) - _net(moved, state.stamps[:, p, g], own, group) for g, group in enumerate(groups)]
            )
        computed += 1
        start, start_error = own, best
        reach = np.sqrt(best.astype(float)) * (1 + ROOM)
        scanned = []
        for g, group in enumerate(groups):
            near = np.arange(count) if books.wide else np.flatnonzero(low[:, g] * (1 - ROOM) <= reach)
            d = _distances(x[near], entries[group])
            computed[near] += group.stop - group.start
            scanned.append((near, d))
            if len(near):
                least = d.argmin(axis=1)
                value, index = d[np.arange(len(near)), least], group.start + least
                better = (value < best[near]) | ((value == best[near]) & (index < own[near]))
                own, best = own.copy(), best.copy()
                own[near[better]], best[near[better]] = index[better], value[better]
        changed = own != start
        for g, group in enumerate(groups):
            near, d = scanned[g]
            bounds, stamps = new.bounds[:, p, g], new.stamps[:, p, g]
            if state is not None:
                bounds[:], stamps[:] = state.bounds[:, p, g], state.stamps[:, p, g]
                # The entry that a row left joins the others of its group.
                left = changed & (start >= group.start) & (start < group.stop)
                bounds[left] = _below(np.minimum(low[left, g] * (1 - ROOM), np.sqrt(start_error[left].astype(float))))
                stamps[left] = now
            if len(near):
                others = d.astype(float)
                mine = (own[near] >= group.start) & (own[near] < group.stop)
                others[np.flatnonzero(mine), own[near[mine]] - group.start] = np.inf
                bounds[near] = _below(np.sqrt(others.min(axis=1)) * (1 - ROOM))
                stamps[near] = now
        new.assigned[:, p] = own
        errors = errors + best
    return new, errors, computed


def _stored(df: DataFrame, fields: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(fields).fields])


def _cells(state: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in state], pa.binary())


def _restored(batch: pa.RecordBatch, names: list[str], books: Codebooks) -> State:
    parts, groups = len(books.history[0]), len(_groups(len(books.history[0][0])))
    raw = [b"".join(batch.column(n).to_pylist()) for n in names]
    shape = (batch.num_rows, parts, groups)
    return State(
        np.frombuffer(raw[0], np.uint8).reshape(shape[:2]),
        np.frombuffer(raw[1], np.float16).reshape(shape),
        np.frombuffer(raw[2], np.uint8).reshape(shape),
    )


def _pass(df: DataFrame, books: Codebooks, vector: str, length: int, names: list[str], first: bool, last: bool) -> DataFrame:
    """One assignment of all rows, with the state written in the columns `names`; the last one gives results."""
    held, (code, error, computed) = names[:3], names[3:]
    bare = df if first else df.drop(*held, computed)
    fields = f"`{code}` string, `{error}` bigint" if last else ", ".join(f"`{n}` binary" for n in held)
    carried = bare.columns
    schema = _stored(bare, f"{fields}, `{computed}` bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = max(1, BATCH_BYTES // (8 * max(1, length)))
        for whole in batches:
            for start in range(0, whole.num_rows, limit):
                batch = whole.slice(start, limit)
                rows = _rows(batch.column(vector), length, books.scale, books.wide)
                state, errors, n = assign(rows, books, None if first else _restored(batch, held, books))
                before = 0 if first else batch.column(computed).to_numpy()
                kept = [batch.column(f) for f in carried]
                if last:
                    made = [
                        pa.array([row.tobytes().hex() for row in state.assigned], pa.string()),
                        pa.array([int(e) if e < 2**63 else None for e in errors], pa.int64()),
                    ]
                else:
                    made = [_cells(state.assigned), _cells(state.bounds), _cells(state.stamps)]
                yield pa.RecordBatch.from_arrays([*kept, *made, pa.array(before + n, pa.int64())], schema.names)

    return df.mapInArrow(run, schema)


def _moved(df: DataFrame, books: Codebooks, vector: str, length: int, assigned: str) -> list[np.ndarray]:
    """The codebooks after one update: the componentwise floor of the mean; unused entries stay.

    A task sums its rows itself and sends one number for each component of an entry that it met. What comes to
    the driver is as large as the codebooks.
    """
    parts, entries = len(books.history[0]), len(books.history[0][0])
    cuts = _cuts(length, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), dtype=np.int64)
        sums = np.zeros((entries, length), dtype=object)
        for batch in batches:
            rows = _rows(batch.column(vector), length, books.scale, books.wide)
            codes = np.frombuffer(b"".join(batch.column(assigned).to_pylist()), np.uint8).reshape(-1, parts)
            for p, cut in enumerate(cuts):
                counts[p] += np.bincount(codes[:, p], minlength=entries)
                part = np.zeros((entries, cut.stop - cut.start), dtype=rows.dtype)
                if books.wide:
                    np.add.at(part, codes[:, p], rows[:, cut])
                    sums[:, cut] += part
                    continue
                for i in range(part.shape[1]):
                    part[:, i] = np.bincount(codes[:, p], rows[:, cut.start + i], minlength=entries)
                sums[:, cut] += part.astype(np.int64).astype(object)
        out = []
        for p, cut in enumerate(cuts):
            for e in np.flatnonzero(counts[p]).tolist():
                out.append((p, e, -1, 0, int(counts[p, e])))
                for at in range(cut.start, cut.stop):
                    value, sign, digit = abs(int(sums[e, at])), 1 if sums[e, at] >= 0 else -1, 0
                    while value:
                        value, rest = divmod(value, BASE)
                        out.append((p, e, at, digit, sign * rest))
                        digit += 1
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int32()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list("peadv"))

    sent = df.select(column(vector), column(assigned)).mapInArrow(run, "p int, e int, a int, d int, v bigint")
    summed = sent.groupBy("p", "e", "a", "d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    counts, sums = {}, {}
    for r in summed.toLocalIterator():
        if r["a"] < 0:
            counts[r["p"], r["e"]] = int(r["v"])
        else:
            at = r["p"], r["e"], r["a"]
            sums[at] = sums.get(at, 0) + int(r["v"]) * BASE ** r["d"]
    after = [part.copy() for part in books.history[-1]]
    for (p, e), n in counts.items():
        for i, at in enumerate(range(cuts[p].start, cuts[p].stop)):
            after[p][e, i] = sums.get((p, e, at), 0) // n
    return after


def compress(
    vectors: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
) -> tuple[DataFrame, Codebooks]:
    """Codes of all usable vectors and the history of the codebooks.

    The frame holds all columns of `vectors` with `code` (two hex digits a part), `error` (squared distance
    of the integers to their entries, summed over the parts; null beyond the range of a long) and
    `n_distances` (distances computed in all rounds; a plain search computes `parts * entries` in each).

    Components become integers floor(scale * x). A vector is cut into `parts` consecutive parts, whose
    codebooks start as the parts of the `entries` smallest keys (ties by the vector, null keys last). Each round
    assigns every part to its nearest entry and moves the entries to the floor of the mean of their parts; a last
    assignment follows. The search is exact: bounds of earlier rounds, kept with a stamp of the state they speak
    of and lowered by the net displacement of the entries since, only spare scans that cannot change the
    result. Rows carry their bounds through written tables; nothing but the codebooks reaches the driver.

    Vectors that are null or hold null or non-finite components are dropped. All vectors have as many components
    as the longest one; missing last ones count 0, and parts differ by one component where the number does not
    divide. Fewer rows than `entries` give fewer entries. Repeated rows are coded each for itself. Columns
    of the made names are replaced. No rows give no rows and empty codebooks.
    """
    if not 0 < entries <= 256 or rounds < 0 or rounds > 254:
        raise ValueError("1 to 256 entries and 0 to 254 rounds")
    made = ("code", "error", "n_distances")
    kind = T.ArrayType(T.DoubleType())
    value = column(vector).cast(kind)
    source = vectors.select(*(column(c) for c in vectors.columns if c.lower() not in made)).where(usable(value))
    largest = F.max(F.aggregate(value, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))
    seeds = source.orderBy(column(key).asc_nulls_last(), value).select(value.alias("x")).limit(entries).collect()
    length, high = source.agg(F.max(F.size(value)), largest).first()
    length = length or 0
    wide = (high or 0.0) * scale >= NARROW or -(-length // parts) > NARROW_WIDTH
    first = _integers([s["x"] for s in seeds], length, scale, wide)
    books = Codebooks([[first[:, cut] for cut in _cuts(length, parts)]], scale)
    names = [*unused(source, "assigned", "bounds", "stamps"), *made]
    if not seeds:
        empty = source.select("*", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(n) for n in made[1:]))
        return empty, books
    state = source
    for turn in range(rounds):
        state = pin(_pass(state, books, vector, length, names, turn == 0, False))
        books = Codebooks([*books.history, _moved(state, books, vector, length, names[0])], scale)
    return _pass(state, books, vector, length, names, rounds == 0, True), books


def with_group_sums(coded: DataFrame, group: str, value: str = "error", name: str = "label_error") -> DataFrame:
    """`coded` with the sum of `value` over all rows of an equal `group`, nulls together.

    Sums are combined on the map side. The join has plain shuffles on both sides, so that Spark
    can split the rows of a frequent group. A sum beyond the range of a long is null.
    """
    (at,) = unused(coded, "at")
    rows = coded.drop(name)
    sums = rows.groupBy(column(group).alias(at)).agg(F.try_sum(value).alias(name))
    return rows.join(sums, column(group).eqNullSafe(F.col(at)), "left").drop(at)
