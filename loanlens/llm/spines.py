"""Tries of conversations, shared by many shards.

Every conversation is a path of turns. Sorted paths are dealt to shards by ranges of (path, id), so
that not even equal conversations need one task. A shard lays its part of the trie out as balanced
parentheses: a node is an opening one, its subtree what stands up to the matching closing one. That
place is found over blocks of excess with a tree of block minima; leaves are counted by the rank of
"()" pairs, members and savings by cumulative arrays over the nodes in order.

A node can reach into other shards only if it lies on the path of the shard's first or last
conversation. All others are finished where they are. The two spines, with sums of what hangs off
them, go on to a merge with the spines of neighbouring shards, some shards at a time, until one
trie is left; at every step nodes that leave the outer spines are finished.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.relations import BROADCAST_ROWS
from loanlens.llm.common import stored

#: Turns of a shard, on average. A shard is held by one task, 40 bytes a turn.
SHARD_TURNS = 200_000
#: Shards whose spines are merged at a time.
FAN = 16
#: Parentheses of a block.
BLOCK = 16
#: Turns that a conversation may take over from the first of its hundred, at most.
SHARED_TURNS = 5
CENTURY = 100

ENDS_NOWHERE = hashlib.sha256(b"").hexdigest()
NO_ID = np.iinfo(np.int64).max

FINISHED, SPINE, ENDS = 0, 1, 2
#: What a shard or a merge returns: finished nodes, nodes of the outer spines, and pieces of the
#: lists of conversations that end at nodes of spines.
PART = """kind int, shard long, seq long, key string, parent_key string, depth long,
    conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long,
    saved_tokens long, ends_sha256 string, chars long, is_left boolean, ends string"""
ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
SCHEMA = pa.schema([(c.split()[0], ARROW[c.split()[1]]) for c in PART.split(",")])
RESULT = [
    "conv_id",
    "depth",
    "parent_conv_id",
    "n_convs",
    "n_children",
    "n_leaves",
    "saved_tokens",
    "ends_sha256",
]


class Parentheses:
    """A trie as balanced parentheses, from the depths of its nodes in order. Node 0 is the root."""

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        steps = np.diff(depth, append=-1)
        # Between a node's opening and the next one's stand all the closings that lead there.
        closings = 1 - steps
        self.opens = np.arange(n) + np.concatenate([[0], np.cumsum(closings[:-1])])
        self.bits = np.zeros(2 * n, np.int8)
        self.bits[self.opens] = 1
        self.excess = np.cumsum(2 * self.bits.astype(np.int64) - 1)
        self.rank = np.concatenate([[0], np.cumsum(self.bits, dtype=np.int64)])
        self._blocks()

    def _blocks(self) -> None:
        """Minima of blocks, and of pairs of blocks, pairs of pairs and so on above them."""
        count = -(-len(self.bits) // BLOCK)
        self.width = 1
        while self.width < count:
            self.width *= 2
        padded = np.full(self.width * BLOCK, np.iinfo(np.int64).max)
        padded[: len(self.bits)] = self.excess
        self.padded = padded.reshape(self.width, BLOCK)
        self.least = np.empty(2 * self.width, np.int64)
        self.least[self.width :] = self.padded.min(axis=1)
        level = self.width
        while level > 1:
            level //= 2
            below = self.least[2 * level : 4 * level]
            self.least[level : 2 * level] = np.minimum(below[::2], below[1::2])

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """Where the closing parenthesis of each opening one is: the next smaller excess."""
        wanted = self.excess[opens] - 1
        found = np.full(len(opens), -1)
        block = opens // BLOCK
        for step in range(1, BLOCK):
            place = opens + step
            here = (found < 0) & (place // BLOCK == block)
            here[here] = self.excess[place[here]] <= wanted[here]
            found[here] = place[here]
        todo = np.flatnonzero(found < 0)
        # Up and to the right until a node's minimum is small enough, then down to its block.
        node = block[todo] + self.width
        left_child = np.zeros(len(todo), bool)
        searching = np.ones(len(todo), bool)
        while searching.any():
            s = np.flatnonzero(searching)
            left_child[s] = node[s] % 2 == 0
            right = s[left_child[s]]
            fits = self.least[node[right] + 1] <= wanted[todo[right]]
            node[right[fits]] += 1
            searching[right[fits]] = False
            up = np.concatenate([s[~left_child[s]], right[~fits]])
            node[up] //= 2
        while len(todo):
            inner = np.flatnonzero(node < self.width)
            if not len(inner):
                break
            first = 2 * node[inner]
            node[inner] = first + (self.least[first] > wanted[todo[inner]])
        if len(todo):
            rows = self.padded[node - self.width]
            found[todo] = (node - self.width) * BLOCK + np.argmax(
                rows <= wanted[todo][:, None], axis=1
            )
        return found

    def subtrees(self) -> np.ndarray:
        """For every node the node after its subtree's last."""
        return self.rank[self.find_close(self.opens)]

    def leaves(self) -> np.ndarray:
        """Whether each node is a "()" pair."""
        return self.bits[self.opens + 1] == 0


def _parents(depth: np.ndarray) -> np.ndarray:
    """The parent of every node: the last one before it that is a level up. The root's is -1."""
    n = len(depth)
    keys = depth * n + np.arange(n)
    order = np.argsort(keys, kind="stable")
    place = np.searchsorted(keys[order], (depth - 1) * n + np.arange(n)) - 1
    parents = order[np.maximum(place, 0)]
    parents[0] = -1
    return parents


def _range_least(values: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The least of values[i:stops[i]] for every i, from minima of doubling stretches."""
    n = len(values)
    out = np.empty(n, values.dtype)
    sizes = stops - np.arange(n)
    level, width = values, 1
    while True:
        mine = (sizes >= width) & (sizes < 2 * width)
        own = np.flatnonzero(mine)
        out[own] = np.minimum(level[own], level[stops[own] - width])
        if 2 * width > n:
            return out
        level = np.minimum(level[: len(level) - width], level[width:])
        width *= 2


class Trie:
    """Nodes in order, each with what ends there and sums of finished nodes that hang off it."""

    def __init__(self, depth, chars, members, least, children, leaves, saved):
        self.depth, self.chars = depth, chars
        #: Conversations that end at a node or beneath finished children, the least of them.
        self.members, self.least = members, least
        self.children, self.leaves, self.saved = children, leaves, saved
        shape = Parentheses(depth)
        self.parent = _parents(depth)
        self.stop = shape.subtrees()
        childless = shape.leaves() & (children == 0)
        self.n_children = children + np.bincount(self.parent[1:], minlength=len(depth))
        self.n_convs = self.beneath(members)
        self.conv_id = _range_least(least, self.stop)
        self.n_leaves = self.beneath(leaves + childless)
        self.saved_tokens = self.beneath(saved + (self.n_convs - 1) * chars)

    def beneath(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.stop] - total[:-1]

    def path(self, node: int) -> list[int]:
        """The nodes from the root to one."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]

    def hanging(self, spine: np.ndarray) -> tuple[np.ndarray, ...]:
        """What each node of the spine carries once all others are finished."""
        off = np.flatnonzero(~spine)
        off = off[spine[self.parent[off]]]
        at = self.parent[off]

        def plus(own, beneath):
            out = own.copy()
            np.add.at(out, at, beneath)
            return out

        least = self.least.copy()
        np.minimum.at(least, at, self.conv_id[off])
        return (
            plus(self.members, self.n_convs[off]),
            least,
            plus(self.children, np.ones(len(off), np.int64)),
            plus(self.leaves, self.n_leaves[off]),
            plus(self.saved, self.saved_tokens[off]),
        )


def _parts(
    trie: Trie, spine: np.ndarray, left: np.ndarray, keys: np.ndarray, shard: int, sha: np.ndarray
) -> dict[str, np.ndarray]:
    """Rows of finished nodes, then of the spine. keys are set for nodes that are or were on one."""
    n = len(trie.depth)
    members, least, children, leaves, saved = trie.hanging(spine)
    parent = np.maximum(trie.parent, 0)
    orphan = (trie.parent < 0) | spine[parent]

    def split(finished, carried):
        return np.where(spine, carried, finished)

    return {
        "kind": np.where(spine, SPINE, FINISHED),
        "shard": np.full(n, shard),
        "seq": np.arange(n),
        "key": keys,
        "parent_key": np.where((trie.parent >= 0) & orphan, keys[parent], None),
        "depth": trie.depth,
        "conv_id": split(trie.conv_id, least),
        "parent_conv_id": np.where(orphan, None, trie.conv_id[parent]),
        "n_convs": split(trie.n_convs, members),
        "n_children": split(trie.n_children, children),
        "n_leaves": split(trie.n_leaves, leaves),
        "saved_tokens": split(trie.saved_tokens, saved),
        "ends_sha256": sha,
        "chars": trie.chars,
        "is_left": left,
        "ends": np.full(n, None, object),
    }


def _of_conversations(ids: np.ndarray, turns: np.ndarray, chars: np.ndarray, ends: np.ndarray):
    """The trie of sorted conversations, and for each the node where it ends.

    Turns, a number each, stand end to end; a conversation's stop at its entry in ends.
    """
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    # A turn is shared if it and all before it equal the previous conversation's.
    owner = np.repeat(np.arange(len(ids)), sizes)
    level = np.arange(len(turns)) - starts[owner]
    before = np.maximum(owner - 1, 0)
    other = starts[before] + level
    same = (owner > 0) & (level < sizes[before])
    same[same] = turns[np.flatnonzero(same)] == turns[other[same]]
    broken = np.concatenate([[0], np.cumsum(~same)])
    new = broken[1:] > broken[starts[owner]]
    depth = np.concatenate([[0], level[new] + 1])
    lengths = np.concatenate([[0], chars[new]])
    # Where a conversation ends: its last new turn, or, without any, where its equal ended.
    made = np.concatenate([[0], np.cumsum(new)])
    own = made[ends] > made[starts]
    at = np.where(own, made[ends], 0)
    return depth, lengths, np.maximum.accumulate(at)


def _path_keys(turns: np.ndarray) -> list[str]:
    """A name for each prefix of a path: the root's first."""
    state, out = hashlib.sha256(), []
    out.append(state.hexdigest())
    for turn in turns:
        state.update(turn.tobytes())
        out.append(state.hexdigest())
    return out


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie of one shard, whose conversations come in order."""
    ids, pairs, chars, sizes = [], [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        path = batch.column("path")
        flat = path.flatten()
        ids.append(batch.column("conv_id").to_numpy())
        sizes.append(np.diff(path.offsets.to_numpy()))
        pair = [flat.field(name).to_numpy(zero_copy_only=False) for name in ("a", "b")]
        pairs.append(np.ascontiguousarray(np.stack(pair, 1), np.int64))
        chars.append(flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64))
    if not ids:
        return
    ids, chars = np.concatenate(ids), np.concatenate(chars)
    ends = np.cumsum(np.concatenate(sizes), dtype=np.int64)
    turns = np.concatenate(pairs)
    shard = TaskContext.get().partitionId()
    depth, lengths, at = _of_conversations(ids, _comparable(turns), chars, ends)
    n = len(depth)
    zeros = np.zeros(n, np.int64)
    members = np.bincount(at, minlength=n)
    least = np.full(n, NO_ID)
    np.minimum.at(least, at, ids)
    trie = Trie(depth, lengths, members, least, zeros, zeros, zeros)
    left = np.zeros(n, bool)
    first, last = slice(0, ends[0]), slice(ends[-2] if len(ends) > 1 else 0, ends[-1])
    left[: ends[0] + 1] = True
    spine = left.copy()
    right = trie.path(n - 1)
    spine[right] = True
    keys = np.full(n, None, object)
    keys[: ends[0] + 1] = _path_keys(turns[first])
    keys[right] = _path_keys(turns[last])
    sha = np.where(spine, None, ENDS_NOWHERE)
    # Conversations that end at the same node stand together, in the order of their ids.
    heads = np.flatnonzero(np.diff(at, prepend=-1))
    tails = np.append(heads[1:], len(at))
    lists = []
    for head, tail in zip(heads, tails, strict=True):
        node, text = at[head], ",".join(map(str, ids[head:tail].tolist()))
        if spine[node]:
            lists.append((node, text))
        else:
            sha[node] = hashlib.sha256(text.encode()).hexdigest()
    yield from _batches(_parts(trie, spine, left, keys, shard, sha))
    if lists:
        yield from _batches(
            {
                "kind": np.full(len(lists), ENDS),
                "shard": np.full(len(lists), shard),
                "key": [keys[node] for node, _ in lists],
                "ends": [text for _, text in lists],
            }
        )


def _comparable(turns: np.ndarray) -> np.ndarray:
    """Numbers that are equal where turns, two hashes each, are."""
    order = np.lexsort((turns[:, 1], turns[:, 0]))
    ordered = turns[order]
    first = np.concatenate([[False], (ordered[1:] != ordered[:-1]).any(axis=1)])
    out = np.empty(len(turns), np.int64)
    out[order] = np.cumsum(first[: len(turns)])
    return out


def _batches(rows: dict) -> Iterator[pa.RecordBatch]:
    """Rows by column as record batches; columns that are not given are NULL."""
    n = len(rows["key"])
    arrays = [
        pa.array(rows[field.name], field.type, from_pandas=True)
        if field.name in rows
        else pa.nulls(n, field.type)
        for field in SCHEMA
    ]
    yield from pa.Table.from_arrays(arrays, schema=SCHEMA).to_batches(max_chunksize=20_000)


def _merged(rows: pd.DataFrame, outermost: bool) -> pd.DataFrame:
    """The spines of neighbouring shards as one trie; finished nodes and the new outer spines."""
    rows = rows.sort_values(["shard", "seq"], ignore_index=True)
    shard = int(rows["shard"].iloc[0]) // FAN
    codes, _ = pd.factorize(rows["key"])  # numbered as they first come, which is the trie's order
    first = np.concatenate([[0], np.flatnonzero(np.diff(np.maximum.accumulate(codes))) + 1])
    n = len(first)

    def summed(name: str) -> np.ndarray:
        out = np.zeros(n, np.int64)
        np.add.at(out, codes, rows[name].to_numpy(np.int64))
        return out

    least = np.full(n, NO_ID)
    np.minimum.at(least, codes, rows["conv_id"].to_numpy(np.int64))
    trie = Trie(
        rows["depth"].to_numpy(np.int64)[first],
        rows["chars"].to_numpy(np.int64)[first],
        summed("n_convs"),
        least,
        summed("n_children"),
        summed("n_leaves"),
        summed("saved_tokens"),
    )
    spine = left = np.zeros(n, bool)
    if not outermost:
        lead = rows["shard"].to_numpy() == rows["shard"].iloc[0]
        left = np.zeros(n, bool)
        left[codes[lead & rows["is_left"].to_numpy(bool)]] = True
        spine = left.copy()
        spine[trie.path(n - 1)] = True
    keys = rows["key"].to_numpy(object)[first]
    out = pd.DataFrame(_parts(trie, spine, left, keys, shard, np.full(n, None, object)))
    return out[SCHEMA.names]


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node, from the pieces of its list as they come in order."""
    state, current = None, None
    for batch in batches:
        keys, shas = [], []
        for key, text in zip(
            batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True
        ):
            if key != current:
                if state is not None:
                    keys.append(current)
                    shas.append(state.hexdigest())
                state, current = hashlib.sha256(text.encode()), key
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_pydict(
            {"key": pa.array(keys, pa.string()), "sha": pa.array(shas, pa.string())}
        )
    if state is not None:
        yield pa.RecordBatch.from_pydict({"key": [current], "sha": [state.hexdigest()]})


def shared_turns(conv_id: Column) -> Column:
    """How many of its first turns a conversation takes over."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (SHARED_TURNS + 1)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): turns of every conversation, the first few those of its hundred's first.

    A turn is (a, b, n): two hashes of role and text, and the text's code points. Turns are in
    the order of turn (NULL first), role and text; NULL role or text is empty. Repeated rows are
    turns like others. Rows without conv_id are in no conversation.
    """
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    own = (
        conversations.filter("conv_id IS NOT NULL")
        .select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))
        .select(
            "conv_id",
            F.expr(
                """transform(turns, t -> struct(
                       xxhash64(t.role, t.text) AS a, xxhash64(1, t.role, t.text) AS b,
                       length(t.text) AS n))"""
            ).alias("own"),
        )
    )
    own = stored(own)
    base = own.filter(F.col("conv_id") % CENTURY == 0).select(
        F.col("conv_id").alias("_base"), F.slice("own", 1, SHARED_TURNS).alias("_shared")
    )
    h = shared_turns(F.col("conv_id")).cast("int")
    return (
        own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % CENTURY)
        .join(base, "_base", "left")
        .withColumn("_h", h)
        .select(
            "conv_id",
            F.expr(
                """concat(coalesce(slice(_shared, 1, _h), slice(own, 1, 0)),
                          slice(own, _h + 1, size(own)))"""
            ).alias("path"),
        )
    )


def _counted(table: DataFrame) -> DataFrame:
    """Marked for broadcast if a bounded count finds few rows, else joined by shuffle."""
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(table) if few else table


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations, the empty one included.

    An empty table has no node. See rebuilt for NULLs, ties and repeated rows; other columns are
    ignored.
    """
    paths = stored(rebuilt(conversations))
    total = paths.agg(F.sum(F.size("path") + 1)).first()[0] or 0
    shards = max(1, -(-total // SHARD_TURNS))
    parts = [
        stored(
            paths.repartitionByRange(shards, "path", "conv_id")
            .sortWithinPartitions("path", "conv_id")
            .mapInArrow(_shard, PART)
        )
    ]
    top = parts[0].agg(F.max("shard")).first()[0] or 0
    while True:
        outermost = top < FAN
        spines = parts[-1].filter(F.col("kind") == SPINE)
        merge = _outermost if outermost else _inner
        parts.append(
            stored(
                spines.groupBy(F.floor(F.col("shard") / FAN).alias("group")).applyInPandas(
                    merge, PART
                )
            )
        )
        if outermost:
            break
        top //= FAN

    finished = parts[0].filter(F.col("kind") == FINISHED)
    for part in parts[1:]:
        finished = finished.unionByName(part.filter(F.col("kind") == FINISHED))
    # Nodes that were on a spine: as many as shards times the turns of a conversation.
    named = finished.filter("key IS NOT NULL")
    shas = (
        parts[0]
        .filter(F.col("kind") == ENDS)
        .select("key", "shard", "ends")
        .repartition("key")
        .sortWithinPartitions("key", "shard")
        .mapInArrow(_hashed_ends, "key string, sha string")
    )
    mothers = named.select(
        F.col("key").alias("parent_key"), F.col("conv_id").alias("_mother")
    )
    return (
        finished.join(_counted(mothers), "parent_key", "left")
        .join(_counted(stored(shas)), "key", "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_mother"))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", "sha", F.lit(ENDS_NOWHERE)))
        .select(*RESULT)
    )


def _inner(rows: pd.DataFrame) -> pd.DataFrame:
    return _merged(rows, False)


def _outermost(rows: pd.DataFrame) -> pd.DataFrame:
    return _merged(rows, True)
