"""SentencePiece encoding and decoding of DataFrames with a public model.

A text is cut into words that no piece can cross. The distinct words of a batch are sorted, which
lays out their trie, and the forward pass keeps one state for each of the trie's nodes, that is
for each distinct prefix: words share the states of what they have in common. For a unigram model
the trie is walked depth-first; for a BPE model level by level, which shares as much and does
all prefixes of one length in a few array operations.

A state of a unigram model is the best score of a prefix and the last piece that reaches it. A
BPE model has one encoding per prefix, and its state is the last piece of it: a piece may follow
another if merging the two together leaves them as they are, and of the pieces that end at a
place exactly one follows the state at its beginning. So the same pass gives exactly the
encoding that merging gives, without merging.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loanlens.llm.common import U64, sent, slices, with_field

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Longest words, and how many at once, that are walked level by level; others are merged.
LEVELS, TOGETHER = 32, 20_000
#: Bits of the places for pairs of pieces that a task remembers; others are worked out anew.
REMEMBERED = 21
#: Words that a task remembers the ids of; with more, it forgets them before the next slice.
WORDS = 150_000
#: Of the hash that finds pieces.
FACTOR = U64(0x9E3779B97F4A7C15)
NEVER = float("-inf")


class Pieces:
    """The pieces of a model and the forward passes over words."""

    def __init__(
        self,
        scores: dict[str, float],
        ids: dict[str, int],
        *,
        unigram: bool,
        unknown: int = 0,
        byte_ids: dict[int, int] | None = None,
        prefix: bool = True,
    ):
        self.scores, self.ids, self.unigram = scores, ids, unigram
        self.unknown, self.byte_ids, self.prefix = unknown, byte_ids or {}, prefix
        self.longest = max(map(len, scores), default=1)
        self.missing = min(scores.values(), default=0.0) - 10
        joining = sorted({c for p in scores if len(p) > 1 for c in p} - {SPACE})
        inner = "".join(map(re.escape, joining))
        # Spaces with what follows, or a run that starts after a character that joins nothing.
        crossing = any(SPACE in p.lstrip(SPACE) for p in scores)
        if crossing:
            self.words = re.compile(r"(?s).+")
        elif inner:
            self.words = re.compile(f"(?s){SPACE}+[{inner}]*|[{inner}]+|.")
        else:
            self.words = re.compile(f"(?s){SPACE}+|.")
        self.plain: set[str] | None = None
        self._forget()

    @classmethod
    def load(cls, path: str = MODEL_FILE) -> Pieces:
        """Pieces of a model file, read on the driver."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        special = [
            model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
            for i in range(n)
        ]
        names = [model.id_to_piece(i) for i in range(n)]
        normal = {names[i]: i for i in range(n) if not special[i]}
        kind = sentencepiece_kind(path)
        return cls(
            {p: model.get_score(i) for p, i in normal.items()},
            normal,
            unigram=kind == 1,
            unknown=model.unk_id(),
            byte_ids={int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)},
        )

    # Words

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return self.words.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def number(self, pieces: Iterable[str]) -> list[int]:
        """Ids of pieces; one that is not in the model becomes its bytes, or else unknown."""
        out = []
        for piece in pieces:
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in piece.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def encode_lists(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of some lists, end to end, and where each word's begin.

        Words that were met before are not walked again, until there are too many to remember.
        """
        if len(self.number_of) > WORDS:
            self._forget()
        number = self.number_of
        new = sorted(set().union(*lists).difference(number))
        if new:
            ids, begins = self.encode_words(new)
            number.update(zip(new, range(len(number), len(number) + len(new))))
            self.word_begins = np.concatenate([self.word_begins, begins[1:] + len(self.word_ids)])
            self.word_ids = np.concatenate([self.word_ids, ids])
        code = np.fromiter(map(number.__getitem__, chain.from_iterable(lists)), np.int64)
        return _gathered(self.word_ids, self.word_begins, code)

    def _forget(self) -> None:
        self.number_of: dict[str, int] = {}
        self.word_ids, self.word_begins = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some distinct words, end to end, and where each word's begin.

        The words must be sorted.
        """
        if self.unigram:
            return _joined([self.number(p) for p in self._viterbi(words)])
        plain = self._tables()
        # Runs of spaces have pieces of equal rank: there order decides, not pairs. Characters
        # without a piece have no number to keep in a table.
        odd = np.fromiter(
            (
                len(w) > LEVELS or w.startswith(SPACE * 2) or not plain.issuperset(w)
                for w in words
            ),
            bool,
            len(words),
        )
        level = np.flatnonzero(~odd)
        rest = np.flatnonzero(odd)
        parts = [(rest, *_joined([self.number(self.merged(words[i])) for i in rest]))]
        for first in range(0, len(level), TOGETHER):
            own = level[first : first + TOGETHER]
            parts.append((own, *self._levels([words[i] for i in own])))
        sizes = np.zeros(len(words), np.int64)
        for own, _, starts in parts:
            sizes[own] = np.diff(starts)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(begins[-1], np.int32)
        for own, ids, starts in parts:
            out[np.arange(len(ids)) + np.repeat(begins[own] - starts[:-1], np.diff(starts))] = ids
        return out, begins

    # Unigram models

    def _viterbi(self, words: list[str]) -> Iterator[list[str]]:
        score, step, last = [0.0], [0], ""
        for word in words:
            same = _common(last, word)
            del score[same + 1 :], step[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                best, by = score[end - 1] + self.missing, 1
                for size in range(1, min(self.longest, end) + 1):
                    own = self.scores.get(word[end - size : end])
                    if own is not None and score[end - size] + own > best:
                        best, by = score[end - size] + own, size
                score.append(best)
                step.append(by)
            yield _walked(word, step)
            last = word

    # BPE models

    def _tables(self) -> set[str]:
        if self.plain is None:
            names = sorted(self.ids, key=self.ids.get)
            size = max(self.ids.values()) + 1
            self.name = [""] * size
            for piece in names:
                self.name[self.ids[piece]] = piece
            self.plain = {p for p in names if len(p) == 1}
            hashes = np.array([_string_hash(p) for p in names], U64)
            order = np.argsort(hashes)
            self.hashes, self.by_hash = hashes[order], np.array([self.ids[p] for p in names])[order]
            if (self.hashes[1:] == self.hashes[:-1]).any():
                raise ValueError("two pieces have one hash")
            self.maybe = np.zeros(1 << 20, bool)
            self.maybe[_slot(self.hashes)] = True
            # A pair of pieces tried per place, and whether its second may follow its first.
            self.pairs = np.full(1 << REMEMBERED, -1, np.int64)
            self.fits = np.zeros(1 << REMEMBERED, bool)
        return self.plain

    def _levels(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A level of the trie at a time: all distinct prefixes of one length."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        depth = int(lengths.max(initial=0))
        points = np.zeros((depth, n), np.uint32)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths)
        column = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
        points[column, np.repeat(np.arange(n), lengths)] = flat
        hashes = np.zeros((depth + 1, n), U64)
        for d in range(depth):
            hashes[d + 1] = hashes[d] * FACTOR + points[d] + U64(1)
        power = FACTOR ** np.arange(self.longest + 1, dtype=U64)
        # node[d][i]: the first word with the prefix of length d that word i has.
        node = np.zeros((depth + 1, n), np.int64)
        piece = np.full((depth + 1, n), -1, np.int64)
        size = np.zeros((depth + 1, n), np.int64)
        same = np.ones(n, bool)
        same[:1] = False
        for d in range(1, depth + 1):
            same[1:] &= points[d - 1, 1:] == points[d - 1, :-1]
            node[d] = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
            open_ = np.flatnonzero(~same & (lengths >= d))
            for by in range(min(d, self.longest), 0, -1):
                start = d - by
                hash_ = hashes[d, open_] - hashes[start, open_] * power[by]
                some = np.flatnonzero(self.maybe[_slot(hash_)])
                at = np.searchsorted(self.hashes, hash_[some]).clip(max=len(self.hashes) - 1)
                real = self.hashes[at] == hash_[some]
                some, ids = open_[some[real]], self.by_hash[at[real]]
                before = piece[start, node[start, some]]
                good = self._follow(before, ids)
                piece[d, some[good]], size[d, some[good]] = ids[good], by
                open_ = open_[size[d, open_] == 0]
                if not len(open_):
                    break
            if len(open_):
                raise ValueError(f"no piece ends {words[open_[0]][:d]!r}")
        steps, of = [], []
        left, row = lengths.copy(), np.arange(n)
        while len(row):
            own = node[left[row], row]
            steps.append(piece[left[row], own])
            of.append(row)
            left[row] -= size[left[row], own]
            row = row[left[row] > 0]
        ids, of = np.concatenate(steps[::-1]), np.concatenate(of[::-1])
        order = np.argsort(of, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])

    def _follow(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the one before it (-1: it is the first)."""
        keys = (before + 1) * len(self.name) + ids
        slot = (keys.view(U64) * FACTOR) >> U64(64 - REMEMBERED)
        out = self.fits[slot]
        missing = np.flatnonzero(self.pairs[slot] != keys)
        if len(missing):
            new, which = np.unique(keys[missing], return_inverse=True)
            answers = []
            for key in new.tolist():
                first, second = divmod(key, len(self.name))
                a, b = self.name[first - 1] if first else "", self.name[second]
                answers.append(self.merged(a + b) == ([a, b] if a else [b]))
            out[missing] = np.array(answers)[which]
            # Of pairs that share a place the last stays, the same one in both tables.
            self.pairs[slot[missing]] = keys[missing]
            self.fits[slot[missing]] = out[missing]
        return out

    def merged(self, word: str) -> list[str]:
        """Pieces of a word by merging the best pair first, the leftmost of equals."""
        if len(word) > LEVELS:
            return self._merged_long(word)
        parts, score = list(word), self.scores.get
        ranks = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (best := max(ranks)) > NEVER:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = score(parts[i - 1] + parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = score(parts[i] + parts[i + 1], NEVER)
        return parts

    def _merged_long(self, word: str) -> list[str]:
        parts: list[str | None] = list(word)
        left, right = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if i >= 0 and j < len(parts):
                score = self.scores.get(parts[i] + parts[j])
                if score is not None:
                    heapq.heappush(heap, (-score, i, parts[i], parts[j]))

        for i in range(len(word) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [p for p in parts if p is not None]

    # Decoding

    def bytes_by_id(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that every id stands for, end to end, and where each id's begin."""
        size = max([*self.ids.values(), *self.byte_ids.values(), self.unknown]) + 1
        out = [b""] * size
        for piece, i in self.ids.items():
            out[i] = piece.replace(SPACE, " ").encode()
        for byte, i in self.byte_ids.items():
            out[i] = bytes([byte])
        out[self.unknown] = " ⁇ ".encode()
        starts = np.concatenate([[0], np.cumsum([len(b) for b in out])])
        return np.frombuffer(b"".join(out), np.uint8), starts


def sentencepiece_kind(path: str) -> int:
    """Model type in the file's trainer settings: 1 unigram, 2 BPE."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    return model.trainer_spec.model_type


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * U64(0xD6E8FEB86659FD93)) >> U64(44)


def _string_hash(text: str) -> int:
    value = 0
    for c in text:
        value = (value * int(FACTOR) + ord(c) + 1) % 2**64
    return value


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while a[low] == b[low]:
        low += 1
    return low


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
    return np.fromiter((i for x in lists for i in x), np.int32, starts[-1]), starts


def _walked(word: str, step: list[int]) -> list[str]:
    out, at = [], len(word)
    while at:
        out.append(word[at - step[at] : at])
        at -= step[at]
    return out[::-1]


def _gathered(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple:
    """The runs values[starts[i] : starts[i + 1]] for each i of which, and where each begins."""
    sizes = (starts[1:] - starts[:-1])[which]
    begins = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = np.arange(begins[-1]) - np.repeat(begins[:-1] - starts[:-1][which], sizes)
    return values[at], begins


def encoded(
    docs: DataFrame, pieces: Pieces | None = None, text_column: str = "text", ids_column: str = "ids"
) -> DataFrame:
    """docs with a column of piece ids, an array<int>; a column of that name is replaced.

    Whole texts are encoded. NULL gives NULL, an empty text an empty array. Other columns and
    repeated rows stay; an empty table gives an empty result.
    """
    pieces = pieces or Pieces.load()
    docs = docs.drop(ids_column)
    shared = sent(docs, pieces)
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            column, _, _ = _encode(shared.value, batch.column(text_column))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*names, ids_column])

    return docs.mapInArrow(each, with_field(docs, ids_column, T.ArrayType(T.IntegerType())))


def _encode(own: Pieces, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids per text as a list column; all of them end to end, and where each text's begin."""
    lists = [own.split(t) for t in pc.fill_null(texts, "").to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
    ids, begins = own.encode_lists(lists)
    rows = begins[starts]
    column = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids))
    if texts.null_count:
        column = pc.if_else(texts.is_valid(), column, pa.scalar(None, column.type))
    return column, ids, rows


def encoded_and_checked(
    docs: DataFrame,
    pieces: Pieces | None = None,
    text_column: str = "text",
    ids_column: str = "ids",
    check_column: str = "round_trip",
) -> DataFrame:
    """docs with piece ids instead of the text, and whether they decode to that text.

    As decoded(encoded(docs)) compared with the text, but in one pass, which neither sends the
    text back nor keeps a second worker. NULL gives NULL ids, and true, as NULL decodes to NULL.
    Columns of the names given are replaced.
    """
    pieces = pieces or Pieces.load()
    docs = docs.drop(ids_column, check_column)
    shared = sent(docs, (pieces, *pieces.bytes_by_id()))
    names = [c for c in docs.columns if c != text_column]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, values, value_starts = shared.value
        for batch in slices(batches, text_column):
            texts = batch.column(text_column)
            column, ids, rows = _encode(own, texts)
            raw, begins = _gathered(values, value_starts, ids)
            whole, ends = raw.tobytes(), begins[rows]
            same = []
            for text, i, j in zip(texts.to_pylist(), ends, ends[1:]):
                first = i + 1 if own.prefix and whole[i : i + 1] == b" " and i < j else i
                back = whole[first:j]
                same.append(
                    text is None
                    or back == text.encode()
                    or back.decode(errors="replace") == text
                )
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, column, pa.array(same, pa.bool_())], [*names, ids_column, check_column]
            )

    checked = with_field(docs.drop(text_column), ids_column, T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(each, checked.add(check_column, T.BooleanType()))


def decoded(
    docs: DataFrame, pieces: Pieces | None = None, ids_column: str = "ids", text_column: str = "text"
) -> DataFrame:
    """docs with the text that a column of piece ids stands for; a column of that name is replaced.

    Bytes that are not UTF-8 become U+FFFD, unknown pieces " ⁇ ". NULL gives NULL, an empty
    array an empty text; NULL inside an array counts as unknown, and ids outside the model fail.
    """
    pieces = pieces or Pieces.load()
    docs = docs.drop(text_column)
    shared = sent(docs, (*pieces.bytes_by_id(), pieces.unknown))
    prefix, names = pieces.prefix, docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, starts, unknown = shared.value
        for batch in batches:
            lists = batch.column(ids_column)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = pc.fill_null(lists.flatten(), unknown).to_numpy(zero_copy_only=False)
            if len(flat) and not 0 <= flat.min() <= flat.max() < len(starts) - 1:
                raise ValueError("an id is not in the model")
            raw, begins = _gathered(values, starts, flat)
            ends = begins[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
            whole = raw.tobytes()
            texts = []
            for i, j in zip(ends, ends[1:]):
                first = i + 1 if prefix and whole[i : i + 1] == b" " and i < j else i
                texts.append(whole[first:j].decode(errors="replace"))
            mask = np.asarray(lists.is_null()) if lists.null_count else None
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string(), mask=mask)], [*names, text_column]
            )

    return docs.mapInArrow(each, with_field(docs, text_column, T.StringType()))

