"""Shards by a weighted hash tree of regions, racks and shards.

A document descends the tree: at each node every child draws a number from a hash of the key and
the child's name, exponentially distributed with the child's weight as its rate, and the smallest
draw wins. A child wins with the share of its weight, and if one child's weight changes, rows
only move into or out of that child's subtree. A new shard that comes in a region of its own
therefore takes rows only into itself.

Everything is column expressions; rows within a shard are numbered piece by piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import stored

#: Rows that are numbered together in one window.
PIECE_ROWS = 20_000

#: A tree: names to subtrees, and at the leaves names to (shard, weight).
Tree = dict


def regular_tree(regions: int = 2, racks: int = 2, shards: int = 4) -> Tree:
    """Regions of racks of shards, each shard of weight 1, numbered from 0."""
    number = iter(range(regions * racks * shards))
    return {
        f"region{r}": {
            f"rack{r}.{k}": {f"shard{r}.{k}.{s}": (next(number), 1.0) for s in range(shards)}
            for k in range(racks)
        }
        for r in range(regions)
    }


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, alone in a rack of a region of its own."""
    return tree | {f"region+{shard}": {f"rack+{shard}": {f"shard+{shard}": (shard, weight)}}}


def weight(tree: Tree | tuple) -> float:
    return tree[1] if isinstance(tree, tuple) else sum(weight(child) for child in tree.values())


def _uniform(key: Column, name: str) -> Column:
    """Between 0 and 1, neither included."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11) + F.lit(0.5)) * F.lit(2.0**-53)


def shard_of(key: Column, tree: Tree | tuple) -> Column:
    """The shard that a key descends to; a NULL key has a shard as well."""
    if isinstance(tree, tuple):
        return F.lit(tree[0])
    children = [(name, child) for name, child in tree.items() if weight(child) > 0]
    if len(children) == 1:
        return shard_of(key, children[0][1])
    draws = F.array_min(
        F.array(
            *(
                F.struct(
                    (-F.log(_uniform(key, name)) / weight(child)).alias("draw"),
                    F.lit(i).alias("child"),
                )
                for i, (name, child) in enumerate(children)
            )
        )
    )
    chosen = F.lit(None).cast("int")
    for i, (_, child) in reversed(list(enumerate(children))):
        chosen = F.when(draws["child"] == i, shard_of(key, child)).otherwise(chosen)
    return chosen


def _numbered(rows: DataFrame, count: int, n_shards: int) -> DataFrame:
    """Adds slot: 0, 1, ... within each shard, without a gap.

    Rows of a shard are cut by a hash into pieces of bounded size, as many as the table asks
    for. A window numbers each piece, and the pieces before it in the shard shift its numbers.
    """
    pieces = max(1, -(-count // (PIECE_ROWS * n_shards)))
    cut = rows.withColumn(
        "piece", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(pieces)).cast("int")
    )
    sizes = cut.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    shifts = sizes.select("shard", "piece", (F.sum("n").over(before) - F.col("n")).alias("shift"))
    own = Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size")
    return (
        cut.withColumn("nth", F.row_number().over(own))
        .join(shifts, ["shard", "piece"])
        .withColumn("slot", F.col("shift") + F.col("nth") - 1)
        .drop("piece", "nth", "shift")
    )


def sharded(
    docs: DataFrame,
    tree: Tree | None = None,
    more: Tree | None = None,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of each row of docs.

    shard is where the id descends to in the tree, grown_shard where it would in the tree with
    more. size is the UTF-8 bytes of the text plus 1; a NULL text counts as empty. Repeated rows,
    and rows without an id, share a shard and get a slot each. An empty table gives an empty
    result.
    """
    tree = tree or regular_tree()
    n_shards = max(1, len(_leaves(tree)))
    more = more or grown(tree, n_shards)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    key = F.col(id_column)
    rows = stored(
        docs.select(
            key.alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            shard_of(key, tree).alias("shard"),
            shard_of(key, more).alias("grown_shard"),
        )
    )
    return _numbered(rows, rows.count(), n_shards).withColumnRenamed("doc_id", id_column)


def _leaves(tree: Tree | tuple) -> list[int]:
    if isinstance(tree, tuple):
        return [tree[0]]
    return [shard for child in tree.values() for shard in _leaves(child)]
