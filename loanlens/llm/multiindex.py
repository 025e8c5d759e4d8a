"""Near-duplicates among vectors by an inverted multi-index.

Each half of the unit vectors has its own codebook; a vector's cell is a pair of codewords, one of
a grid. A vector looks for others in the cells whose two distances, beyond those to its own cell,
sum up to no more than a bound: these are the cells that a traversal of both sorted sequences of
codewords meets first. The bound is set so that of vectors just similar enough, with noise in
either half or in both, the wanted share is met. What lies in the cells is verified in full.

The grid is dealt to tasks by its rows, that is by codewords of the first half. A task first takes
in the members of a row, sorted by their cells, and then streams the vectors that visit it.

Large groups of like vectors would make quadratic work. Their centres are found in the sample
that the codebooks are learned from. All vectors within half the largest angle of a centre are
linked to each other, which needs no comparison; only vectors near such a ball that are not in it
are compared with its members.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import sent, stored
from loanlens.llm.components import components

#: Vectors, at most, that codebooks, bound and centres are learned from: those of smallest hash.
SAMPLE = 16_384
#: Vectors of the sample that noise is added to, to find the bound.
TRIED = 2_048
#: Share of the least similar pairs that must be met.
RECALL = 0.99
#: Codewords per half: a quarter of the root of the number of vectors, up to this.
CODEWORDS = 2_048
ROUNDS = 8
#: A ball is sought where so many vectors of the sample are alike, and this share of them.
BALL_LEAST, BALL_SHARE, BALLS = 32, 0.002, 64
#: Members that a task holds at a time, on average; rows with more are split.
MEMBERS = 4_096
#: Pairs that are verified at a time.
TOGETHER = 20_000

MEMBER, VISITOR = 0, 1
SENT = """zone int, split int, kind int, id long, hash long, weight long, node long, cell int,
    room double, vector binary"""
FOUND = "id long, hash long, n_links long, node long, other long"


class Index(NamedTuple):
    """What is learned: codebooks, the bound, balls, and into how many parts zones are split."""

    cosine: float
    halves: tuple[np.ndarray, np.ndarray]
    bound: float
    centres: np.ndarray
    splits: np.ndarray


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _distances(half: np.ndarray, codewords: np.ndarray) -> np.ndarray:
    """Squared distances beyond that to the nearest codeword."""
    d = (codewords**2).sum(axis=1) - 2 * half @ codewords.T
    return d - d.min(axis=1, keepdims=True)


def _split(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = vectors.shape[1] // 2
    return vectors[:, :middle], vectors[:, middle:]


def _codebook(half: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    words = half[rng.permutation(len(half))[:k]].copy()
    for _ in range(ROUNDS):
        nearest = _distances(half, words).argmin(axis=1)
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, nearest, half)
        words[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return words


def _at_cosine(vectors: np.ndarray, cosine: float, rng, where: slice) -> np.ndarray:
    """Vectors at just this cosine, that differ in some dimensions only as far as possible."""
    noise = np.zeros_like(vectors)
    noise[:, where] = rng.standard_normal(vectors[:, where].shape)
    noise -= (noise * vectors).sum(axis=1, keepdims=True) * vectors
    size = np.linalg.norm(noise, axis=1, keepdims=True)
    noise = np.divide(noise, size, out=np.zeros_like(noise), where=size > 0)
    return unit(cosine * vectors + np.sqrt(1 - cosine**2) * noise)


def _bound(vectors: np.ndarray, halves, cosine: float, recall: float, rng) -> float:
    middle, most = vectors.shape[1] // 2, 0.0
    some = vectors[rng.permutation(len(vectors))[:TRIED]]
    own = [_distances(h, words) for h, words in zip(_split(some), halves, strict=True)]
    for where in (slice(None), slice(0, middle), slice(middle, None)):
        near = _at_cosine(some, cosine, rng, where)
        beyond = sum(
            d[np.arange(len(some)), _distances(h, words).argmin(axis=1)]
            for d, h, words in zip(own, _split(near), halves, strict=True)
        )
        most = max(most, float(np.quantile(beyond, recall)))
    return most + 1e-9


def _half_angle(cosine: float, times: float) -> float:
    """Cosine of so many times half the angle."""
    return float(np.cos(min(np.pi, times * np.arccos(cosine) / 2)))


def _balls(vectors: np.ndarray, cosine: float) -> np.ndarray:
    """Centres around which many vectors of the sample lie within half the angle."""
    least = max(BALL_LEAST, int(BALL_SHARE * len(vectors)))
    left, centres = vectors, []
    sizes = np.concatenate(
        [(left[i : i + 1024] @ left.T >= cosine).sum(axis=1) for i in range(0, len(left), 1024)]
        or [np.empty(0, np.int64)]
    )
    while len(centres) < BALLS and len(left) and sizes.max() >= least:
        best = sizes.argmax()
        near = left @ left[best] >= cosine
        centre = left[near].mean(axis=0)
        centre /= np.linalg.norm(centre)
        inside = left @ centre >= _half_angle(cosine, 1)
        if inside.sum() >= least:
            centres.append(centre)
        gone = inside | (np.arange(len(left)) == best)
        left, sizes = left[~gone], sizes[~gone]
    return np.array(centres).reshape(len(centres), vectors.shape[1])


def _ball_of(vectors: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """The ball of each vector, or -1, and all cosines to centres."""
    to = vectors @ index.centres.T
    if not to.shape[1]:
        return np.full(len(vectors), -1), to
    # A little less than half the angle, so that rounding cannot link what is not.
    inside = to.max(axis=1) >= _half_angle(index.cosine, 1) + 1e-12
    return np.where(inside, to.argmax(axis=1), -1), to


def learned(sample: np.ndarray, n: int, cosine: float, recall: float = RECALL) -> Index:
    """An index for n vectors from some of them."""
    rng = np.random.default_rng(1)
    vectors = unit(sample)
    k = int(np.clip(round(np.sqrt(n) / 4), 1, min(CODEWORDS, len(vectors))))
    halves = tuple(_codebook(h, k, rng) for h in _split(vectors))
    bound = _bound(vectors, halves, cosine, recall, rng)
    index = Index(cosine, halves, bound, _balls(vectors, cosine), np.ones(0, np.int64))
    ball, _ = _ball_of(vectors, index)
    zone = np.where(ball >= 0, k + ball, _distances(_split(vectors)[0], halves[0]).argmin(axis=1))
    share = np.bincount(zone, minlength=k + len(index.centres)) / len(vectors)
    return index._replace(splits=np.maximum(1, np.ceil(share * n / MEMBERS)).astype(np.int64))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("embedding")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _ball_members(batches: Iterator[pa.RecordBatch], value) -> Iterator[pa.RecordBatch]:
    index = Index(*value.value)
    for batch in batches:
        if batch.num_rows:
            ball, _ = _ball_of(unit(_vectors(batch)), index)
            inside = pa.array(ball >= 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ball, pa.int32()).filter(inside),
                    batch.column("id").filter(inside),
                    batch.column("weight").filter(inside),
                ],
                ["ball", "id", "weight"],
            )


def _deal(batches: Iterator[pa.RecordBatch], value, nodes: np.ndarray):
    """Each vector to its own zone, and as a visitor to the zones it may have links in."""
    index = Index(*value.value)
    k = len(index.halves[0])
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = _vectors(batch)
        vectors = unit(raw)
        ids, hashes = (batch.column(c).to_numpy() for c in ("id", "hash"))
        ball, to = _ball_of(vectors, index)
        beyond, second = (
            _distances(h, words) for h, words in zip(_split(vectors), index.halves, strict=True)
        )
        home = np.where(ball >= 0, k + ball, beyond.argmin(axis=1))
        split = hashes.astype(np.uint64) % index.splits[home].astype(np.uint64)
        parts = [(np.arange(len(ids)), home, split.astype(np.int64), MEMBER, np.zeros(len(ids)))]
        # Rows of the grid, for vectors in no ball, and balls, for vectors in no later ball.
        who, row = np.nonzero((beyond <= index.bound) & (ball < 0)[:, None])
        visits = [(who, row, index.bound - beyond[who, row])]
        near = to >= _half_angle(index.cosine, 3) - 1e-9
        near &= ball[:, None] < np.arange(to.shape[1])
        who, which = np.nonzero(near)
        visits.append((who, k + which, np.zeros(len(who))))
        for who, zone, room in visits:
            times = index.splits[zone]
            again = np.repeat(np.arange(len(who)), times)
            nth = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
            parts.append((who[again], zone[again], nth, VISITOR, room[again]))
        node = np.where(ball >= 0, nodes[ball], ids) if len(nodes) else ids
        cell = np.where(ball >= 0, 0, second.argmin(axis=1))
        data = pa.array([v.tobytes() for v in raw], pa.binary())
        for who, zone, nth, kind, room in parts:
            for start in range(0, len(who), 20_000):
                at = who[start : start + 20_000]
                end = start + len(at)
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(zone[start:end], pa.int32()),
                        pa.array(nth[start:end], pa.int32()),
                        pa.array(np.full(len(at), kind), pa.int32()),
                        batch.column("id").take(rows),
                        batch.column("hash").take(rows),
                        batch.column("weight").take(rows),
                        pa.array(node[at], pa.int64()),
                        pa.array(cell[at], pa.int32()),
                        pa.array(room[start:end], pa.float64()),
                        data.take(rows),
                    ],
                    [c.split()[0] for c in SENT.split(",")],
                )


class _Zone:
    """Members of a zone in the order of their cells, and what has been found about them."""

    def __init__(self, index: Index, grid: bool):
        self.index, self.grid, self.parts = index, grid, []

    def take(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)

    def sort(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        order = np.argsort(columns[4], kind="stable")
        self.ids, self.hashes, self.weights, self.nodes, cell, self.vectors = (
            c[order] for c in columns
        )
        cells = len(self.index.halves[1])
        self.first = np.searchsorted(cell, np.arange(cells))
        self.size = np.bincount(cell, minlength=cells)
        self.links = np.zeros(len(order), np.int64)
        self.root = np.arange(len(order))

    def _pairs(self, vectors, room) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Visitors and the members they have to be compared with."""
        if self.grid:
            beyond = _distances(_split(vectors)[1], self.index.halves[1])
            who, cell = np.nonzero((beyond <= room[:, None]) & (self.size > 0))
            first, size = self.first[cell], self.size[cell]
        else:
            who = np.arange(len(vectors))
            first, size = np.zeros(len(who), np.int64), np.full(len(who), len(self.ids))
        total = np.cumsum(size)
        start = 0
        while start < len(who):
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + TOGETHER, "right")))
            n = size[start:stop]
            begin = first[start:stop] - (total[start:stop] - n - before)
            yield (
                np.repeat(who[start:stop], n),
                np.repeat(begin, n) + np.arange(n.sum()),
            )
            start = stop

    def visit(self, ids, hashes, weights, nodes, room, vectors) -> tuple[np.ndarray, ...]:
        """Links of some visitors: how many, and one member of those each is linked to."""
        n_links = np.zeros(len(ids), np.int64)
        one = np.full(len(ids), -1)
        for x, y in self._pairs(vectors, room):
            if self.grid:  # of two vectors of the grid the one of smaller hash visits
                less = hashes[x] < self.hashes[y]
                less |= (hashes[x] == self.hashes[y]) & (ids[x] < self.ids[y])
                x, y = x[less], y[less]
            cosines = np.einsum("ij,ij->i", vectors[x], self.vectors[y])
            linked = cosines >= self.index.cosine
            x, y = x[linked], y[linked]
            np.add.at(n_links, x, self.weights[y])
            np.add.at(self.links, y, weights[x])
            # Members that share a visitor belong together.
            lowest = np.full(len(ids), len(self.ids))
            np.minimum.at(lowest, x, y)
            known = one[x] >= 0
            self._tie(lowest[x], y)
            self._tie(one[x[known]], y[known])
            fresh = (one < 0) & (lowest < len(self.ids))
            one[fresh] = lowest[fresh]
        some = one >= 0
        return ids[some], hashes[some], n_links[some], nodes[some], self.nodes[one[some]]

    def _tie(self, a: np.ndarray, b: np.ndarray) -> None:
        """Gives tied members the same root: the smallest."""
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def _found(id_, hash_, n_links, node, other) -> pa.RecordBatch:
    columns = (id_, hash_, n_links, node, other)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in FOUND.split(",")]
    )


def _compare(batches: Iterator[pa.RecordBatch], value, dtype: str, ball_weights: np.ndarray):
    """Links within zones, which come one after another, members first."""
    index = Index(*value.value)
    k = len(index.halves[0])
    current, zone, sorted_ = None, None, False

    def closed():
        if zone is not None:
            if not sorted_:
                zone.sort()
            base = 0 if zone.grid else ball_weights[current[0] - k] - zone.weights
            yield _found(
                zone.ids, zone.hashes, zone.links + base, zone.nodes, zone.nodes[zone.root]
            )

    for batch in batches:
        names = ("zone", "split", "kind", "id", "hash", "weight", "node", "cell", "room")
        zones, splits, kinds, ids, hashes, weights, nodes, cells, rooms = (
            batch.column(c).to_numpy() for c in names
        )
        if not len(ids):
            continue
        data = b"".join(batch.column("vector").to_pylist())
        vectors = unit(np.frombuffer(data, dtype).reshape(len(ids), -1))
        change = (np.diff(zones) != 0) | (np.diff(splits) != 0) | (np.diff(kinds) != 0)
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), len(ids)]
        for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
            here = (int(zones[start]), int(splits[start]))
            if here != current:
                yield from closed()
                current, zone, sorted_ = here, None, False
            own = slice(start, stop)
            if kinds[start] == MEMBER:
                if zone is None:
                    zone = _Zone(index, here[0] < k)
                zone.take(
                    ids[own], hashes[own], weights[own], nodes[own], cells[own], vectors[own]
                )
            elif zone is not None:  # else nobody is at home
                if not sorted_:
                    zone.sort()
                    sorted_ = True
                yield _found(
                    *zone.visit(
                        ids[own], hashes[own], weights[own], nodes[own], rooms[own], vectors[own]
                    )
                )
    yield from closed()


def _comparable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, two hashes of the embedding; hashes are NULL for what links with nothing."""
    sound = F.expr(
        """vec_id IS NOT NULL AND coalesce(
             forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))
             AND exists(embedding, x -> x != 0), false)"""
    )
    return vectors.select("vec_id", "embedding").select(
        "vec_id",
        "embedding",
        F.when(sound, F.xxhash64("embedding")).alias("hash"),
        F.when(sound, F.xxhash64(F.lit(1), "embedding")).alias("hash2"),
    )


def vector_duplicates(
    vectors: DataFrame, cosine: float = 0.95, recall: float = RECALL
) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept, for vectors linked from a cosine on.

    Vectors that are NULL, empty, zero or hold NULL or non-finite values link with nothing, nor do
    rows without vec_id (their component_id is NULL) or vectors of another than the commonest
    length (of equally common ones the longest). Rows that repeat an id and its vector are one
    vector and have its result each. Vectors that share an id share its component. Other columns
    are ignored. Of pairs at just the wanted cosine the share recall is expected to be found, of
    closer ones more; equal vectors, and vectors in one ball, always.
    """
    rows = _comparable(vectors)
    sound = rows.filter("hash IS NOT NULL")
    common = (
        sound.groupBy(F.size("embedding").alias("size"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.desc("size"))
        .first()
    )
    width = common["size"] if common else 0
    distinct = stored(
        sound.filter(F.size("embedding") == width)
        .groupBy("hash", "hash2", F.col("vec_id").cast("long").alias("id"))
        .agg(F.first("embedding").alias("embedding"))
        .groupBy("hash", "hash2")
        .agg(
            F.min("id").alias("id"),
            F.count("*").alias("weight"),
            F.first("embedding").alias("embedding"),
        )
    )
    n = distinct.count()
    bare = rows.select("vec_id", "hash", "hash2")
    if not n:
        return bare.select(
            "vec_id",
            F.lit(0).cast("long").alias("n_links"),
            F.col("vec_id").cast("long").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    sample = distinct.orderBy("hash", "hash2").limit(SAMPLE).select("embedding").toArrow()
    column = sample.column("embedding").combine_chunks()
    index = learned(column.flatten().to_numpy().reshape(len(column), width), n, cosine, recall)
    dtype = "float32" if pa.types.is_float32(column.type.value_type) else "float64"
    value = sent(distinct, tuple(index))

    balls = len(index.centres)
    nodes, weights = (np.zeros(balls, np.int64) for _ in range(2))
    if balls:
        members = distinct.mapInArrow(
            functools.partial(_ball_members, value=value), "ball int, id long, weight long"
        )
        for row in members.groupBy("ball").agg(F.min("id"), F.sum("weight")).collect():
            nodes[row[0]], weights[row[0]] = row[1], row[2]
    found = stored(
        distinct.mapInArrow(functools.partial(_deal, value=value, nodes=nodes), SENT)
        .repartition("zone", "split")
        .sortWithinPartitions("zone", "split", "kind")
        .mapInArrow(
            functools.partial(_compare, value=value, dtype=dtype, ball_weights=weights), FOUND
        )
    )
    links = found.filter("node != other").select(
        F.col("node").alias("a"), F.col("other").alias("b")
    )
    classes = components(links).withColumnsRenamed({"node": "_node", "component": "_component"})
    per_vector = found.groupBy("id", "hash").agg(
        F.sum("n_links").alias("n"), F.max("node").alias("_node")
    )
    known = (
        distinct.select("id", "hash", "hash2", "weight")
        .join(per_vector, ["id", "hash"])
        .join(classes, "_node", "left")
        .select(
            "hash",
            "hash2",
            (F.col("n") + F.col("weight") - 1).alias("n_links"),
            F.coalesce("_component", "_node").alias("component_id"),
        )
    )
    own = F.col("vec_id").cast("long")
    component = F.coalesce("component_id", own)
    return bare.join(known, ["hash", "hash2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == own, F.lit(True)).alias("kept"),
    )
