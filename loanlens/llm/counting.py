"""Token counts that follow edits.

A document's text is cut into pre-token groups at gaps, where white space follows something else:
no pre-token crosses a gap, and what stands on one side has no say in how the other is encoded.
Leaves of some groups each, with their characters and tokens, are the bottom of a segment tree
whose nodes hold the sums. An edit re-encodes the leaves that it touches and the neighbours that
its boundaries lean on, and updates the sums above them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loanlens.llm.common import sent, slices, with_field

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# A fixed value: how this vocabulary's texts are cut into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GAP = re.compile(r"(?<=\S)(?=[ \n])")
#: Pre-token groups of a leaf.
GROUPS = 32
#: Counts of groups that a task remembers; beyond that it begins anew.
REMEMBERED = 500_000

EDITS = "array<struct<start: int, stop: int, text: string>>"


class Counter:
    """Tokens of pre-token groups, each distinct one encoded once as long as it is remembered."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as file:
            lines = (line.split() for line in file)
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.pattern = pattern
        self.encoding, self.known = None, {}

    def __getstate__(self):
        return self.__dict__ | {"encoding": None, "known": {}}

    def counts(self, groups: list[str]) -> list[int]:
        if self.encoding is None:
            import tiktoken

            self.encoding = tiktoken.Encoding(
                "counted", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={}
            )
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, out = self.known, []
        for group in groups:
            n = known.get(group)
            if n is None:
                n = known[group] = len(self.encoding.encode_ordinary(group))
            out.append(n)
        return out

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of each leaf of a text."""
        groups = GAP.split(text) if text else []
        tokens = self.counts(groups)
        firsts = range(0, len(groups), GROUPS)
        return (
            [sum(map(len, groups[i : i + GROUPS])) for i in firsts],
            [sum(tokens[i : i + GROUPS]) for i in firsts],
        )


class SegmentTree:
    """Sums of characters and tokens over leaves; node 1 is the root, i has children 2i, 2i + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.width = 1
        while self.width < max(1, len(chars)):
            self.width *= 2
        self.chars, self.tokens = ([0] * 2 * self.width for _ in range(2))
        for sums, leaves in ((self.chars, chars), (self.tokens, tokens)):
            sums[self.width : self.width + len(leaves)] = leaves
            for node in range(self.width - 1, 0, -1):
                sums[node] = sums[2 * node] + sums[2 * node + 1]

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> SegmentTree:
        """A tree from the sums of its nodes, as stored."""
        tree = cls.__new__(cls)
        tree.width, tree.chars, tree.tokens = len(chars) // 2, list(chars), list(tokens)
        return tree

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where that leaf begins."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        more, extra = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more
            self.tokens[node] += extra
            node //= 2

    def edit(self, text: str, start: int, stop: int, put: str, counter: Counter) -> tuple[str, int]:
        """The text with a stretch replaced, and how many characters were encoded for it."""
        size = len(text)
        first, left = self.leaf_at(start - 1) if start else (0, 0)
        last, right = (self.width - 1, size) if stop >= size else self.leaf_at(stop)
        if stop < size:
            right += self.chars[last + self.width]
        region = text[left:start] + put + text[stop:right]
        chars, tokens = counter.leaves(region)
        room = last + 1 - first
        if len(chars) > room:
            self._rebuild(first, last, chars, tokens)
        else:
            chars, tokens = (own + [0] * (room - len(own)) for own in (chars, tokens))
            for leaf, *sums in zip(range(first, last + 1), chars, tokens):
                self.put(leaf, *sums)
        return text[:start] + put + text[stop:], len(region)

    def _rebuild(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """The tree with other leaves instead of first to last; sums are added up anew, from
        leaves without characters left out. Nothing is encoded."""
        old = self.chars[self.width :]
        kept = [[i for i in own if old[i]] for own in (range(first), range(last + 1, self.width))]
        made = []
        for sums, new in ((self.chars, chars), (self.tokens, tokens)):
            own = sums[self.width :]
            made.append([own[i] for i in kept[0]] + new + [own[i] for i in kept[1]])
        self.__init__(*made)


def _types() -> list[T.StructField]:
    return [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("tree_chars", T.ArrayType(T.IntegerType())),
        T.StructField("tree_tokens", T.ArrayType(T.IntegerType())),
    ]


def counted(docs: DataFrame, counter: Counter | None = None, text_column: str = "text") -> DataFrame:
    """docs with n_tokens and the sums of the tree's nodes, tree_chars and tree_tokens.

    Columns of those names are replaced. A NULL text counts as empty and has no tokens. Texts are
    encoded whole. An empty table gives an empty result.
    """
    docs = docs.drop(*(f.name for f in _types()))
    shared = sent(docs, counter or Counter())
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, text_column):
            trees = [
                SegmentTree(*own.leaves(t or "")) for t in batch.column(text_column).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([t.tokens[1] for t in trees], pa.int64()),
                    pa.array([t.chars for t in trees], pa.list_(pa.int32())),
                    pa.array([t.tokens for t in trees], pa.list_(pa.int32())),
                ],
                [*names, *(f.name for f in _types())],
            )

    return docs.mapInArrow(each, T.StructType([*docs.schema, *_types()]))


def recounted(
    docs: DataFrame,
    counter: Counter | None = None,
    text_column: str = "text",
    edits_column: str = "edits",
) -> DataFrame:
    """Counted docs after edits: text, n_tokens and both trees as they are then, and encoded_chars.

    The column of edits is an array of (start, stop, text): code points start to stop of the text
    as it stood before any of the edits give way to a text. Edits must not overlap; of two at one
    place the first in the array comes first. NULL edits, and NULL among them, change nothing; a
    stretch beyond the text's end is cut there. A NULL text with edits counts as empty.
    encoded_chars is how many characters were encoded for the edits.
    """
    docs = docs.drop("encoded_chars")
    shared = sent(docs, counter or Counter())
    names = docs.columns
    place = {c: names.index(c) for c in (text_column, "n_tokens", "tree_chars", "tree_tokens")}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, text_column):
            texts = batch.column(text_column).to_pylist()
            made: list[tuple] = []
            for text, edits, chars, tokens in zip(
                texts,
                batch.column(edits_column).to_pylist(),
                batch.column("tree_chars").to_pylist(),
                batch.column("tree_tokens").to_pylist(),
            ):
                edits = [e for e in edits or () if e]
                tree, encoded = SegmentTree.of(chars, tokens), 0
                text = text if text is not None or not edits else ""
                # From the last to the first, so that places need no shifting.
                order = sorted(range(len(edits)), key=lambda i: (edits[i]["start"], i))
                size = len(text or "")
                for i in reversed(order):
                    start = min(max(edits[i]["start"], 0), size)
                    stop = min(max(edits[i]["stop"], start), size)
                    text, n = tree.edit(text, start, stop, edits[i]["text"] or "", own)
                    encoded += n
                made.append((text, tree.tokens[1], tree.chars, tree.tokens, encoded))
            columns = list(batch.columns)
            out = list(zip(*made)) if made else [[]] * 5
            kinds = (columns[place[text_column]].type, pa.int64(), *[pa.list_(pa.int32())] * 2)
            for name, values, kind in zip(place, out, kinds):
                columns[place[name]] = pa.array(list(values), kind)
            columns.append(pa.array(list(out[4]), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [*names, "encoded_chars"])

    return docs.mapInArrow(each, with_field(docs, "encoded_chars", T.LongType()))
