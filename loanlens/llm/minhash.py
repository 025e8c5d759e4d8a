"""Near-duplicate classes by b-bit MinHash.

Each distinct set of word shingles gets minima under many hash functions. Bands of minima give
candidates, the low bits of all minima, packed, estimate their likeness, and what remains is
confirmed on full sets.

Copies of a set count as one node from the start. Within a bucket of a band no pairs are listed:
first every member meets the bucket's smallest member (a star), links join components, and only
members of buckets that still hold several components are compared further, in blocks of bounded
size inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.llm.common import U64, hashed, mixed, runs, sent, slices, spaced_words, stored
from loanlens.llm.components import components

#: Minima per band and bands. A pair at a similarity of 0.8 shares no band with a chance of
#: (1 - 0.8**5)**36, which is 6 in 10 million; above 0.85, 1 in a billion.
ROWS, BANDS = 5, 36
#: Low bits kept of each minimum.
BITS = 4
#: Bits of the filter that spares documents without candidates; a bound of 1 MB for each task.
#: It lets through every document with candidates, and ever more others the fuller it is.
FILTER_BITS = 1 << 23
#: Members of a block when the rest of a bucket is compared.
BLOCK = 256
#: Shingles that are hashed at a time: as many as the CPU's cache holds.
CHUNK = 65_536

SIGNATURE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("key_low", T.LongType()),
        T.StructField("key_high", T.LongType()),
        T.StructField("signature", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
SET_SCHEMA = "id long, shingles binary"
PAIR_SCHEMA = "a long, b long"


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, as 64-bit hashes, and where each text's begin.

    A text of fewer words is one shingle; a text without words has none.
    """
    tokens, starts = spaced_words(texts)
    codes = hashed(tokens)
    counts = np.diff(starts)
    rows = np.repeat(np.arange(len(counts)), np.maximum(counts - words + 1, 0))
    if len(codes) >= words:
        rolled = np.full(len(codes) - words + 1, U64(words))
        for j in range(words):
            rolled = mixed(rolled + codes[j : j + len(rolled)])
        place = np.arange(len(rolled))
        row_of = np.searchsorted(starts, place, "right") - 1
        rolled = rolled[place + words <= starts[row_of + 1]]
    else:
        rolled = np.empty(0, U64)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        whole = np.empty(len(short), U64)
        for i, row in enumerate(short):
            value = np.array([counts[row]], U64)
            for code in codes[starts[row] : starts[row + 1]]:
                value = mixed(value + code)
            whole[i] = value[0]
        rolled, rows = np.concatenate([rolled, whole]), np.concatenate([rows, short])
    order = np.lexsort((rolled, rows))
    rolled, rows = rolled[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (rows[1:] != rows[:-1])
    rolled, rows = rolled[new], rows[new]
    return rolled, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(counts)))])


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    seeds = (seeds >> U64(32)).astype(np.uint32)
    return seeds[:n], seeds[n:] | np.uint32(1)


def minima(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Smallest value of each text's shingles under each of n functions; no text is empty."""
    xor, factor = _functions(n)
    low = (shingles >> U64(32)).astype(np.uint32)
    out = np.empty((len(starts) - 1, n), np.uint32)
    first = 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + CHUNK, "right")) - 1)
        part = low[starts[first] : starts[last]]
        at = starts[first:last] - starts[first]
        for k in range(n):
            out[first:last, k] = np.minimum.reduceat((part ^ xor[k]) * factor[k], at)
        first = last
    return out


def _packed(values: np.ndarray) -> np.ndarray:
    """Low BITS (4) of each minimum, two to a byte."""
    low = (mixed(values.astype(U64)) & U64((1 << BITS) - 1)).astype(np.uint8)
    if low.shape[1] % 2:
        low = np.pad(low, ((0, 0), (0, 1)))
    return low[:, ::2] << BITS | low[:, 1::2]


def estimates(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Similarity of packed signatures by counting bits, less what low bits agree by chance."""
    differ = left ^ right
    differ = differ | differ >> 1
    differ = (differ | differ >> 2) & np.uint8(0x11)
    agree = 1 - np.bitwise_count(differ).sum(axis=-1, dtype=np.int64) / n
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def _band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    bands = values.shape[1] // rows
    keys = np.tile(np.arange(1, bands + 1, dtype=U64), (len(values), 1))
    for j in range(rows):
        keys = mixed(keys * U64(0x9E3779B97F4A7C15) + values[:, j::rows][:, :bands].astype(U64))
    return keys


def signatures(
    docs: DataFrame, *, words: int = 5, rows: int = ROWS, bands: int = BANDS
) -> DataFrame:
    """Set size, key of the whole set, packed signature and band keys of each row of docs.

    docs has columns id and text. Rows without words have size 0 and NULL elsewhere.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            shingles, starts = shingle_sets(batch.column("text"), words)
            sizes = np.diff(starts)
            full = np.flatnonzero(sizes)
            begins = starts[:-1][full]
            packed = keys = np.empty((0, 0))
            low = high = np.empty(0, np.int64)
            if len(full):
                values = minima(shingles, np.append(begins, starts[-1]), rows * bands)
                packed, keys = _packed(values), _band_keys(values, rows)
                low = np.add.reduceat(mixed(shingles), begins).view(np.int64)
                high = np.bitwise_xor.reduceat(mixed(~shingles), begins).view(np.int64)
            at = np.full(len(sizes), -1)
            at[full] = np.arange(len(full))
            take = pa.array(at, mask=at < 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(low).take(take),
                    pa.array(high).take(take),
                    pa.array([x.tobytes() for x in packed], pa.binary()).take(take),
                    pa.array([x.view(np.int64) for x in keys], pa.list_(pa.int64())).take(take),
                ],
                SIGNATURE_SCHEMA.names,
            )

    return docs.select("id", "text").mapInArrow(each, SIGNATURE_SCHEMA)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the documents whose id is wanted; texts are not shuffled."""
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    marked = np.zeros(FILTER_BITS // 64, U64)
    own = wanted.select(slot.alias("slot")).select(
        F.expr("slot DIV 64").alias("at"), F.expr("shiftleft(1L, int(slot % 64))").alias("bit")
    )
    # At most FILTER_BITS / 64 rows.
    for at, bits in own.groupBy("at").agg(F.bit_or("bit")).collect():
        marked[at] = np.int64(bits).view(U64)
    shared = sent(docs, marked)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value
        for batch in batches:
            at = batch.column("slot").to_numpy(zero_copy_only=False).astype(U64)
            batch = batch.filter(pa.array((marked[at >> U64(6)] >> (at & U64(63)) & U64(1)) > 0))
            for part in slices([batch], "text"):
                shingles, starts = shingle_sets(part.column("text"), words)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(
                            [shingles[i:j].tobytes() for i, j in zip(starts, starts[1:])],
                            pa.binary(),
                        ),
                    ],
                    ["id", "shingles"],
                )

    found = docs.filter("id IS NOT NULL").withColumn("slot", slot).mapInArrow(each, SET_SCHEMA)
    return found.join(wanted, "id", "left_semi").dropDuplicates(["id"])


def _alike(pairs: DataFrame, nodes: DataFrame, n: int, least: float) -> DataFrame:
    """Pairs whose signatures' estimate reaches a bound."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(
                    batch.num_rows, -1
                )
                for c in ("left", "right")
            )
            keep = pa.array(estimates(left, right, n) >= least)
            yield batch.select(["a", "b"]).filter(keep)

    own = nodes.select("id", "signature")
    return (
        pairs.join(own.toDF("a", "left"), "a")
        .join(own.toDF("b", "right"), "b")
        .select("a", "b", "left", "right")
        .mapInArrow(each, PAIR_SCHEMA)
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs with 100 * intersection >= share * union, counted on their full sets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                left = np.frombuffer(left.as_buffer(), U64)
                right = np.frombuffer(right.as_buffer(), U64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= share * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (
        pairs.join(sets.toDF("b", "right"), "b")
        .join(sets.toDF("a", "left"), "a")
        .select("a", "b", "left", "right")
        .mapInArrow(each, PAIR_SCHEMA)
    )


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _cut(share: int, n: int) -> float:
    """Five standard deviations of the estimate below the similarity asked for."""
    chance, s = 2.0**-BITS, share / 100
    agree = chance + (1 - chance) * s
    return s - 5 * (agree * (1 - agree) / n) ** 0.5 / (1 - chance)


def _divided(members: DataFrame) -> DataFrame:
    """Members (key, id, component) of buckets that hold several components.

    With the bucket's largest component, and into how many blocks that and the rest are cut.
    """
    by_part = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    heavy = (
        by_part.groupBy("key")
        .agg(
            F.max(F.struct("n", "component")).alias("most"),
            F.sum("n").alias("all"),
            F.count("*").alias("parts"),
        )
        .filter("parts > 1 and all > 2")
        .select(
            "key",
            F.col("most.component").alias("heavy"),
            F.ceil(F.col("most.n") / BLOCK).cast("int").alias("heavy_blocks"),
            F.ceil((F.col("all") - F.col("most.n")) / BLOCK).cast("int").alias("blocks"),
        )
    )
    return members.join(heavy, "key")


def _rest(
    divided: DataFrame, nodes: DataFrame, sets: DataFrame, n: int, least: float, share: int
) -> DataFrame:
    """Links across components of a bucket that hold several.

    A bucket's largest component is never compared with itself. Members are dealt to blocks, and
    a task compares two blocks at a time: first signatures, each pair in the first band that it
    shares, then full sets. No pair is listed but those that are linked, and of these only as
    many as join what is apart within the two blocks.
    """
    dealt = divided.withColumn("inside", F.expr("component = heavy"))
    among = F.when(F.col("inside"), F.col("heavy_blocks")).otherwise(F.col("blocks"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), among).cast("int"))
    meetings = F.expr(
        """CASE WHEN inside THEN transform(sequence(0, blocks - 1), i -> struct(i, -1 - block AS j))
           ELSE concat(
             transform(sequence(0, blocks - 1),
                       i -> struct(least(i, block) AS i, greatest(i, block) AS j)),
             transform(sequence(0, heavy_blocks - 1), i -> struct(block AS i, -1 - i AS j)))
           END"""
    )

    about = nodes.select("id", "signature", "bands").join(sets, "id")
    met = (
        dealt.withColumn("met", F.explode(meetings))
        .select(
            F.xxhash64("key", "met.i", "met.j").alias("meeting"), "key", "id", "component"
        )
        .join(about, "id")
        .select("meeting", "key", "id", "component", "signature", "bands", "shingles")
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def compared(table: pa.Table) -> pa.RecordBatch:
            meeting = table.column("meeting").to_numpy()
            found: list[tuple[int, int]] = []
            begins = runs(meeting)
            for i, j in zip(begins, np.append(begins[1:], len(meeting))):
                found += _meeting(table.slice(i, j - i), n, least, share)
            return pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"]
            )

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            meeting = held.column("meeting").to_numpy()
            if not len(meeting):
                continue
            last = int(runs(meeting)[-1])
            if last:
                yield compared(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield compared(held)

    return (
        met.repartition("meeting")
        .sortWithinPartitions("meeting")
        .mapInArrow(each, PAIR_SCHEMA)
        .distinct()
    )


def _meeting(table: pa.Table, n: int, least: float, share: int) -> list[tuple[int, int]]:
    """Links that join components among the members of two blocks of a bucket."""
    ids = table.column("id").to_numpy()
    key = table.column("key")[0].as_py()
    signature = np.frombuffer(
        b"".join(table.column("signature").to_pylist()), np.uint8
    ).reshape(len(ids), -1)
    bands = np.array(table.column("bands").to_pylist(), np.int64)
    sets = [np.sort(np.frombuffer(s, U64)) for s in table.column("shingles").to_pylist()]
    part = table.column("component").to_numpy().copy()
    found = []
    for x in range(len(ids) - 1):
        other = x + 1 + np.flatnonzero(part[x + 1 :] != part[x])
        other = other[estimates(signature[x], signature[other], n) >= least]
        if not len(other):
            continue
        first = (bands[other] == bands[x]).argmax(axis=1)
        other = other[bands[x][first] == key]
        if not len(other) or not len(sets[x]):
            continue
        sizes = np.array([len(sets[y]) for y in other])
        theirs = np.concatenate([sets[y] for y in other])
        at = np.searchsorted(sets[x], theirs).clip(max=len(sets[x]) - 1)
        total = np.concatenate([[0], np.cumsum(sets[x][at] == theirs)])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        both = total[ends[1:]] - total[ends[:-1]]
        for y in other[100 * both >= share * (len(sets[x]) + sizes - both)]:
            if part[y] != part[x]:
                found.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
                part[part == part[y]] = part[x]
    return found


def near_duplicates(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = 5,
    share: int = 80,
    rows: int = ROWS,
    bands: int = BANDS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept): the class of each document.

    Documents are linked where 100 * intersection >= share * union of their sets of distinct
    shingles of so many words; component_id is the smallest id that can be reached, and kept
    marks it. Other columns of docs play no part.

    A text of fewer words is one shingle. A NULL, empty or blank text has no shingles and is
    linked with nothing. A row without an id keeps NULL as its component and is kept. Repeated
    rows share a class; an id is expected to have one text, and each row gets the class of its
    own. An empty table gives an empty result.
    """
    docs = docs.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")
    )
    n = rows * bands
    least = _cut(share, n)
    made = stored(signatures(docs, words=words, rows=rows, bands=bands))
    keyed = made.filter("n_shingles > 0 and id is not null")
    nodes = stored(
        keyed.groupBy("key_low", "key_high").agg(
            F.min("id").alias("id"),
            F.first("signature").alias("signature"),
            F.first("bands").alias("bands"),
        )
    )
    banded = nodes.select("id", F.explode("bands").alias("key"))
    buckets = (
        banded.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    )
    members = stored(banded.join(buckets, "key"))
    star = members.filter("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    tried = stored(_alike(star.distinct(), nodes, n, least))
    links = stored(_confirmed(tried, stored(_sets(docs, _ids(tried), words)), share))
    parts = components(links)
    labelled = stored(
        members.filter("n > 2")
        .join(parts.select(F.col("node").alias("id"), "component"), "id", "left")
        .select("key", "id", F.coalesce("component", "id").alias("component"))
    )
    divided = stored(_divided(labelled))
    sets = stored(_sets(docs, divided.select("id").distinct(), words))
    rest = stored(_rest(divided, nodes, sets, n, least, share))
    if rest.take(1):
        parts = components(parts.toDF("a", "b").unionByName(rest))
    classes = (
        nodes.select("id", "key_low", "key_high")
        .join(parts.toDF("id", "component"), "id", "left")
        .select("key_low", "key_high", F.coalesce("component", "id").alias("component"))
    )
    joined = keyed.select("id", "n_shingles", "key_low", "key_high").join(
        classes, ["key_low", "key_high"]
    )
    bare = made.filter("not (n_shingles > 0 and id is not null)")
    result = joined.select("id", "n_shingles", "component").unionByName(
        bare.select("id", "n_shingles", F.col("id").alias("component"))
    )
    return result.select(
        F.col("id").alias(id_column),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )
