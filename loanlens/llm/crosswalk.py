"""Two tokenizers side by side: which tokens of one stand for which of the other.

Tokens of both are laid over the bytes of a text. Where tokens of both end together the text is
cut, and what lies between two cuts is a group. A stretch of tokens, wherever it begins and ends,
is a fragment: an open head up to the first cut that is seen within it, closed groups, and an open
tail after the last one. Two neighbouring fragments make a fragment, in which the tail of one and
the head of the other have been joined and cut; the order in which fragments are joined makes no
difference. So very long documents are cut into pieces, which tasks turn to fragments, and joined
in a tree.

A pair of ids is linked in a document if tokens of theirs share a byte. Documents that hold a pair
are counted over the corpus. To keep that small, a task lists the pairs of a few MB of text
once, numbers them, and keeps each document's links as numbers; only the lists are shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import pickle
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.llm.common import sent, slices, stored, with_field

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# A fixed value: how texts are cut into pre-tokens before their bytes are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes beyond which a document is cut into pieces, about as long, for several tasks.
PIECE_BYTES = 64_000
#: Bytes of a fragment within a piece.
FRAGMENT_BYTES = 16_000
#: Fragments that are joined at a time.
FAN = 8
#: Bytes of text whose pairs are listed together.
LISTED_BYTES = 8_000_000
#: No token of either model crosses such a space, and both begin one there.
GAP = re.compile(r"(?<=\S) (?=\S)")

PLAIN_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
LISTED = """slice long, pairs array<long>, n_docs array<int>, held array<int>, links binary,
    times binary"""


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable characters of Latin-1 stand for themselves, the other bytes, in order, for the
    letters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def models(byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> dict:
    """What tasks need of both tokenizers: plain values, read on the driver."""
    with open(byte_model, encoding="utf-8") as file:
        described = json.load(file)
    special = {token["content"] for token in described["added_tokens"]}
    letters = byte_of_letter()
    ranks = {
        bytes(letters[c] for c in token): i
        for token, i in described["model"]["vocab"].items()
        if token not in special
    }
    with open(piece_model, "rb") as file:
        return {"ranks": ranks, "pieces": file.read()}


class Tokenizers:
    """Both tokenizers in a task, and tables of their tokens."""

    def __init__(self, ranks: dict[bytes, int], pieces: bytes):
        import sentencepiece
        import tiktoken

        self.a = tiktoken.Encoding(
            "bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        n_a, n_b = max(ranks.values()) + 1, self.b.vocab_size()
        a_bytes = [b""] * n_a
        for token, i in ranks.items():
            a_bytes[i] = token
        b_bytes = [self._piece(i) for i in range(n_b)]
        self.a_bytes, self.b_bytes = (pa.array(x, pa.binary()) for x in (a_bytes, b_bytes))
        self.a_size, self.b_size = (
            np.array(list(map(len, x)), np.int64) for x in (a_bytes, b_bytes)
        )
        self.n_a, self.n_b = n_a, n_b
        self.written = pa.array(
            [f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)]
        )

    @classmethod
    def of(cls, value: dict) -> Tokenizers:
        """Those of a broadcast value, built once per worker."""
        if "built" not in value:
            value["built"] = cls(value["ranks"], value["pieces"])
        return value["built"]

    def _piece(self, i: int) -> bytes:
        name = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(name[3:5], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i):
            return b""
        return name.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[Tokens, np.ndarray, Tokens, np.ndarray]:
        """Tokens of a space and each text, end to end, and how many each text has.

        A text has none if its tokens, joined, are not the space and the text.
        """
        a = [self.a.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        b = self.b.encode(texts, num_threads=1)
        a_n = np.fromiter(map(len, a), np.int64, len(a))
        b_n = np.fromiter(map(len, b), np.int64, len(b))
        a = np.concatenate(a).astype(np.int64) if a else np.empty(0, np.int64)
        b = np.fromiter(itertools.chain.from_iterable(b), np.int64, int(b_n.sum()))
        joined = b"".join([b" " + t.encode() for t in texts])
        if _content(self.a_bytes, a) != joined or _content(self.b_bytes, b) != joined:
            good = np.fromiter(
                (
                    _content(self.a_bytes, x) == whole and _content(self.b_bytes, y) == whole
                    for x, y, whole in zip(
                        np.split(a, np.cumsum(a_n)[:-1]),
                        np.split(b, np.cumsum(b_n)[:-1]),
                        (b" " + t.encode() for t in texts),
                        strict=True,
                    )
                ),
                bool,
                len(texts),
            )
            a, b = a[np.repeat(good, a_n)], b[np.repeat(good, b_n)]
            a_n, b_n = a_n * good, b_n * good
        return Tokens.laid(a, self.a_size), a_n, Tokens.laid(b, self.b_size), b_n


def _content(names: pa.Array, ids: np.ndarray) -> bytes:
    """The bytes of tokens, joined."""
    if not len(ids):
        return b""
    taken = names.take(pa.array(ids))
    _, ends, data = taken.buffers()
    return data.to_pybytes()[: np.frombuffer(ends, np.int32)[len(ids)]]


class Tokens(NamedTuple):
    """Ids, and where in the bytes each token begins and ends."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def laid(cls, ids: np.ndarray, size: np.ndarray, begin: int = 0) -> Tokens:
        ends = begin + np.cumsum(size[ids])
        return cls(ids, ends - size[ids], ends)

    def part(self, start: int | None, stop: int | None) -> Tokens:
        return Tokens(*(x[start:stop] for x in self))

    def then(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(x) for x in zip(self, other, strict=True)))


class Closed(NamedTuple):
    """Whole groups, one after another: counts, the groups as text, pairs and how often."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    text: bytes
    pairs: np.ndarray
    times: np.ndarray


NO_GROUPS = Closed(0, 0, 0, 0, b"", np.empty(0, np.int64), np.empty(0, np.int64))


class Groups:
    """Tokens of A and B that begin and end together, cut into groups."""

    def __init__(self, tok: Tokenizers, a: Tokens, b: Tokens):
        self.tok, self.a, self.b = tok, a, b
        self.begin = int(a.starts[0]) if len(a.ids) else 0
        size = int(a.ends[-1]) - self.begin if len(a.ids) else 0
        ends = np.zeros(size + 1, bool)
        ends[b.ends - self.begin] = True
        self.a_cut = ends[a.ends - self.begin]
        #: How many tokens of B end at or before a byte.
        self.b_ended = np.cumsum(ends, dtype=np.int32)
        ends[:] = False
        ends[a.ends - self.begin] = True
        self.b_cut = ends[b.ends - self.begin]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of B each of A overlaps, and the pairs of ids."""
        first = self.b_ended[self.a.starts - self.begin]
        last = self.b_ended[self.a.ends - 1 - self.begin]
        n = (last - first + 1).astype(np.int64)
        total = np.cumsum(n)
        place = np.arange(total[-1] if len(n) else 0) + np.repeat(first - total + n, n)
        return n, np.repeat(self.a.ids, n) * self.tok.n_b + self.b.ids[place]

    def text(self) -> tuple[memoryview, np.ndarray, np.ndarray]:
        """a1,a2|b1;a3|b2,b3; as bytes, where each entry ends, and entries up to each token of B."""
        a_in = np.cumsum(self.a_cut) - self.a_cut
        b_in = np.cumsum(self.b_cut) - self.b_cut
        b_first = np.concatenate([[0], np.flatnonzero(self.b_cut) + 1])
        a_past = np.flatnonzero(self.a_cut) + 1
        n = len(self.a.ids) + len(self.b.ids)
        entry = np.empty(n, np.int64)
        entry[np.arange(len(self.a.ids)) + b_first[a_in]] = (
            self.a.ids + self.tok.n_a * self.a_cut
        )
        b_place = np.arange(len(self.b.ids)) + a_past[b_in]
        entry[b_place] = 2 * self.tok.n_a + self.b.ids + self.tok.n_b * self.b_cut
        if not n:
            return memoryview(b""), np.zeros(1, np.int64), b_place
        _, ends, data = self.tok.written.take(pa.array(entry)).buffers()
        return memoryview(data), np.frombuffer(ends, np.int32)[: n + 1], b_place

    def closed(self) -> Closed:
        if not len(self.a.ids):
            return NO_GROUPS
        n, pairs = self.links()
        data, ends, _ = self.text()
        return Closed(
            len(self.a.ids),
            len(self.b.ids),
            int(self.a_cut.sum()),
            int(n.sum()),
            bytes(data[: ends[-1]]),
            *np.unique(pairs, return_counts=True),
        )


def joined_groups(parts: Iterable[Closed]) -> Closed:
    parts = list(parts)
    pairs, where = np.unique(np.concatenate([p.pairs for p in parts]), return_inverse=True)
    times = np.zeros(len(pairs), np.int64)
    np.add.at(times, where, np.concatenate([p.times for p in parts]))
    sums = (sum(p[i] for p in parts) for i in range(4))
    return Closed(*sums, b"".join(p.text for p in parts), pairs, times)


class Fragment(NamedTuple):
    """A stretch of tokens. Without a cut (seen false) all of it is the head."""

    seen: bool
    head_a: Tokens
    head_b: Tokens
    closed: Closed
    tail_a: Tokens
    tail_b: Tokens


NO_TOKENS = Tokens(*(np.empty(0, np.int64) for _ in range(3)))


def fragment(tok: Tokenizers, a: Tokens, b: Tokens) -> Fragment:
    cuts = np.intersect1d(a.ends, b.ends, assume_unique=True)
    if not len(cuts):
        return Fragment(False, a, b, NO_GROUPS, NO_TOKENS, NO_TOKENS)
    (a1, a2), (b1, b2) = (np.searchsorted(x.ends, cuts[[0, -1]], "right") for x in (a, b))
    inner = Groups(tok, a.part(a1, a2), b.part(b1, b2)).closed()
    return Fragment(
        True, a.part(0, a1), b.part(0, b1), inner, a.part(a2, None), b.part(b2, None)
    )


def joined(tok: Tokenizers, x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring stretches."""
    open_a, open_b = (x.tail_a, x.tail_b) if x.seen else (x.head_a, x.head_b)
    middle = fragment(tok, open_a.then(y.head_a), open_b.then(y.head_b))
    if not middle.seen:  # then y has no cut either
        if not x.seen:
            return middle
        return x._replace(tail_a=middle.head_a, tail_b=middle.head_b)
    groups = [middle.closed]
    if x.seen:  # the middle begins where a group does
        first = Groups(tok, middle.head_a, middle.head_b).closed()
        groups = [x.closed, first, middle.closed]
        head = x.head_a, x.head_b
    else:
        head = middle.head_a, middle.head_b
    tail = middle.tail_a, middle.tail_b
    if y.seen:  # the middle ends with y's head, at a cut
        groups.append(y.closed)
        tail = y.tail_a, y.tail_b
    return Fragment(True, *head, joined_groups(groups), *tail)


def folded(tok: Tokenizers, parts: list[Fragment]) -> Fragment:
    """Neighbours joined two by two until one is left."""
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [joined(tok, *p) if len(p) == 2 else p[0] for p in pairs]
    return parts[0]


def fragments(tok: Tokenizers, a: Tokens, b: Tokens, width: int) -> list[Fragment]:
    """A fragment for each range of so many bytes, of the tokens that begin in it."""
    stop = max(a.ends[-1], b.ends[-1])
    bounds = np.arange(min(a.starts[0], b.starts[0]), stop, width)
    at_a, at_b = (np.append(np.searchsorted(x.starts, bounds), len(x.ids)) for x in (a, b))
    return [
        fragment(tok, a.part(at_a[i], at_a[i + 1]), b.part(at_b[i], at_b[i + 1]))
        for i in range(len(bounds))
    ]


def whole(tok: Tokenizers, found: Fragment) -> Closed:
    """The groups of a document whose first and last bytes the fragment holds."""
    return joined_groups([Groups(tok, found.head_a, found.head_b).closed(), found.closed])


# Documents in slices


class _Listed:
    """Documents of a slice: their counts, and their pairs by number in the slice's list."""

    def __init__(self, number: int, id_type: pa.DataType):
        self.number, self.id_type = number, id_type
        self.ids, self.counts, self.shas = [], [], []
        self.held, self.pairs, self.times, self.bytes = [], [], [], 0

    def add(self, ids, counts, shas, held, pairs, times, size) -> None:
        self.ids += ids
        self.counts.append(counts)
        self.shas += shas
        self.held.append(held)
        self.pairs.append(pairs)
        self.times.append(times)
        self.bytes += size

    def row(self) -> pa.RecordBatch:
        pairs, where = np.unique(np.concatenate(self.pairs), return_inverse=True)
        n_docs = np.bincount(where, minlength=len(pairs))
        counts = np.concatenate(self.counts)
        docs = pa.StructArray.from_arrays(
            [
                pa.array(self.ids, self.id_type),
                *(pa.array(counts[:, i]) for i in range(4)),
                pa.array(self.shas, pa.string()),
            ],
            ["doc_id", *PLAIN_COUNTS, "groups_sha256"],
        )

        def listed(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        return pa.RecordBatch.from_arrays(
            [
                listed(docs),
                pa.array([self.number], pa.int64()),
                listed(pa.array(pairs, pa.int64())),
                listed(pa.array(n_docs, pa.int32())),
                listed(pa.array(np.concatenate(self.held), pa.int32())),
                pa.array([_packed(where)], pa.binary()),
                pa.array([_packed(np.concatenate(self.times))], pa.binary()),
            ],
            ["docs", "slice", "pairs", "n_docs", "held", "links", "times"],
        )


def _packed(values: np.ndarray) -> bytes:
    """Small numbers, as differences, compressed."""
    return pa.compress(
        np.diff(values, prepend=0).astype(np.int32).tobytes(), codec="zstd", asbytes=True
    )


def _unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.int64)
    raw = pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.int32), dtype=np.int64)


def _digested(tok: Tokenizers, texts: list[str]):
    """Counts and hash of each text, and its distinct pairs with how often they are linked."""
    a, a_n, b, b_n = tok.encode(texts)
    groups = Groups(tok, a, b)
    a_end, b_end = np.cumsum(a_n), np.cumsum(b_n)

    def per_text(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[a_end] - total[a_end - a_n]

    n, codes = groups.links()
    n_links = per_text(n)
    counts = np.stack([a_n, b_n, per_text(groups.a_cut), n_links], 1)
    data, ends, b_place = groups.text()
    shas, start = [], 0
    for i in range(len(texts)):
        if not a_n[i]:
            shas.append("")
            continue
        stop = b_place[b_end[i] - 1] + 1
        shas.append(hashlib.sha256(data[ends[start] : ends[stop] - 1]).hexdigest())
        start = stop
    text_of = np.repeat(np.arange(len(texts)), n_links)
    keys = np.sort(text_of * (tok.n_a * tok.n_b) + codes)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
    first = np.asarray(first, np.int64)
    times = np.diff(np.append(first, len(keys)))
    owner, pairs = np.divmod(keys[first], tok.n_a * tok.n_b)
    return counts, shas, np.bincount(owner, minlength=len(texts)), pairs, times


def _short(batches: Iterator[pa.RecordBatch], value) -> Iterator[pa.RecordBatch]:
    tok = Tokenizers.of(value.value)
    number, part = TaskContext.get().partitionId() << 32, None
    for batch in slices(batches, "text"):
        texts = pc.fill_null(batch.column("text"), "").to_pylist()
        some = [i for i, t in enumerate(texts) if t]
        counts, held = np.zeros((len(texts), 4), np.int64), np.zeros(len(texts), np.int64)
        shas, pairs, times = [""] * len(texts), *(np.empty(0, np.int64) for _ in range(2))
        if some:
            own_counts, own_shas, own_held, pairs, times = _digested(tok, [texts[i] for i in some])
            counts[some], held[some] = own_counts, own_held
            for i, sha in zip(some, own_shas, strict=True):
                shas[i] = sha
        if part is None:
            part = _Listed(number, batch.column("doc_id").type)
        part.add(
            batch.column("doc_id").to_pylist(), counts, shas, held, pairs, times,
            sum(map(len, texts)),
        )
        if part.bytes >= LISTED_BYTES:
            yield part.row()
            number, part = number + 1, None
    if part is not None:
        yield part.row()


# Very long documents


def cut(text: str, size: int) -> list[str]:
    """Pieces of about so many characters; a space and each piece, joined, are a space and the text."""
    out, start = [], 0
    while start < len(text):
        gap = GAP.search(text, start + size)
        out.append(text[start : gap.start() if gap else len(text)])
        if gap is None:
            break
        start = gap.end()
    return out


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for i, text in enumerate(batch.column("text").to_pylist()):
            doc_id = batch.column("doc_id").slice(i, 1)
            pieces, begin = cut(text, size), 0
            for place, piece in enumerate(pieces):
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_id,
                        pa.array([number], pa.int64()),
                        pa.array([place], pa.int32()),
                        pa.array([len(pieces)], pa.int32()),
                        pa.array([begin], pa.int64()),
                        pa.array([piece], pa.string()),
                    ],
                    ["doc_id", "number", "place", "n_pieces", "begin", "piece"],
                )
                begin += 1 + len(piece.encode())
            number += 1


def _dumped(found: Fragment | None) -> bytes | None:
    """As plain tuples and arrays, which open without this package."""
    if found is None:
        return None
    return pickle.dumps(tuple(tuple(x) if isinstance(x, tuple) else x for x in found), protocol=5)


def _loaded(data: bytes) -> Fragment:
    seen, head_a, head_b, closed, tail_a, tail_b = pickle.loads(data)
    return Fragment(
        seen, Tokens(*head_a), Tokens(*head_b), Closed(*closed), Tokens(*tail_a), Tokens(*tail_b)
    )


def _fragments(batches: Iterator[pa.RecordBatch], value, width: int) -> Iterator[pa.RecordBatch]:
    """The fragment of each piece; NULL if its tokens do not give the piece back."""
    tok = Tokenizers.of(value.value)
    for batch in batches:
        out = []
        for piece, begin in zip(
            batch.column("piece").to_pylist(), batch.column("begin").to_pylist(), strict=True
        ):
            a, a_n, b, _ = tok.encode([piece])
            found = None
            if a_n[0]:
                a, b = (Tokens(x.ids, x.starts + begin, x.ends + begin) for x in (a, b))
                found = folded(tok, fragments(tok, a, b, width))
            out.append(_dumped(found))
        yield batch.drop_columns(["piece", "begin"]).append_column(
            "fragment", pa.array(out, pa.binary())
        )


def _joining(value, fan: int):
    """Neighbouring pieces of a document made one."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        one = rows.iloc[:1].assign(place=rows["place"].iloc[0] // fan)
        one["n_pieces"] = -(-int(one["n_pieces"].iloc[0]) // fan)
        found = None
        if rows["fragment"].notna().all():
            tok = Tokenizers.of(value.value)
            found = folded(tok, [_loaded(x) for x in rows["fragment"]])
        one["fragment"] = [_dumped(found)]
        return one

    return join


def _finished(batches: Iterator[pa.RecordBatch], value) -> Iterator[pa.RecordBatch]:
    """A slice of its own for each long document."""
    tok = Tokenizers.of(value.value)
    for batch in batches:
        for i, data in enumerate(batch.column("fragment").to_pylist()):
            ids = batch.column("doc_id").slice(i, 1)
            groups = whole(tok, _loaded(data)) if data is not None else NO_GROUPS
            sha = hashlib.sha256(groups.text[:-1]).hexdigest() if groups.n_a else ""
            part = _Listed(-1 - batch.column("number")[i].as_py(), ids.type)
            counts = np.array([groups[:4]], np.int64)
            held = np.array([len(groups.pairs)])
            part.add(ids.to_pylist(), counts, [sha], held, groups.pairs, groups.times, 0)
            yield part.row()


def _listed_schema(id_type: T.DataType) -> T.StructType:
    counts = [T.StructField(c, T.LongType()) for c in PLAIN_COUNTS]
    doc = T.StructType(
        [T.StructField("doc_id", id_type), *counts, T.StructField("groups_sha256", T.StringType())]
    )
    rest = T._parse_datatype_string(LISTED)
    return T.StructType([T.StructField("docs", T.ArrayType(doc)), *rest])


def _slices(docs: DataFrame, value, piece_bytes: int) -> DataFrame:
    """Slices of documents with their pairs; long documents are slices alone."""
    docs = docs.select("doc_id", "text")
    schema = _listed_schema(docs.schema["doc_id"].dataType)
    is_long = F.coalesce(F.octet_length("text") > piece_bytes, F.lit(False))
    short = docs.filter(~is_long).mapInArrow(functools.partial(_short, value=value), schema)
    pieces = docs.filter(is_long).mapInArrow(
        functools.partial(_cut, size=piece_bytes),
        T.StructType(
            [
                docs.schema["doc_id"],
                *T._parse_datatype_string(
                    "number long, place int, n_pieces int, begin long, piece string"
                ),
            ]
        ),
    )
    joining = stored(
        pieces.repartition("number", "place").mapInArrow(
            functools.partial(_fragments, value=value, width=FRAGMENT_BYTES),
            with_field(pieces.drop("piece", "begin"), "fragment", T.BinaryType()),
        )
    )
    left = joining.agg(F.max("n_pieces")).first()[0] or 0
    while left > 1:
        joining = stored(
            joining.groupBy("number", F.floor(F.col("place") / FAN)).applyInPandas(
                _joining(value, FAN), joining.schema
            )
        )
        left = -(-left // FAN)
    long = joining.mapInArrow(functools.partial(_finished, value=value), schema)
    return stored(short.unionByName(long))


def pair_counts(parts: DataFrame, n_b: int) -> DataFrame:
    """(pair, n_docs, best) of all pairs: documents that hold it, and whether none of its A id's
    pairs is in more."""
    pairs = parts.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p"))
    counts = stored(
        pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n_docs").alias("n_docs"))
    )
    a = (F.col("pair") / n_b).cast("long")
    most = counts.groupBy(a.alias("a")).agg(F.max("n_docs").alias("most"))
    # As many rows as A has tokens, at most.
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select(
        "pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best")
    )


def _weighed(parts: pa.Table, marks: pa.Table) -> pa.Table:
    """Sums over each document's links of what is known of their pairs."""
    out = []
    numbers = marks.column("number").to_numpy()
    known = np.zeros(len(numbers), np.int64)
    known[numbers] = marks.column("mark").to_numpy()
    for i in range(parts.num_rows):
        docs = parts.column("docs").slice(i, 1).combine_chunks().flatten()
        held = parts.column("held")[i].values.to_numpy()
        links, times = (
            _unpacked(parts.column(c)[i].as_py(), int(held.sum())) for c in ("links", "times")
        )
        ends = np.cumsum(held, dtype=np.int64)

        def per_doc(values: np.ndarray, ends=ends, held=held) -> pa.Array:
            total = np.concatenate([[0], np.cumsum(values)])
            return pa.array(total[ends] - total[ends - held])

        mark = known[links]
        out.append(
            pa.table(
                {name: docs.field(name) for name in ("doc_id", *PLAIN_COUNTS)}
                | {"n_best": per_doc(times * (mark & 1)), "count_sum": per_doc(times * (mark >> 1))}
                | {"groups_sha256": docs.field("groups_sha256")}
            )
        )
    return pa.concat_tables(out)


def aligned(
    docs: DataFrame,
    *,
    byte_model: str = BYTE_MODEL,
    piece_model: str = PIECE_MODEL,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256.

    NULL and empty texts, and texts that one tokenizer does not give back, have no tokens: zeros
    and an empty groups_sha256. Repeated rows count as documents of their own. doc_id may be NULL;
    other columns are ignored. The longest text without a single space is one piece.
    """
    value = sent(docs, models(byte_model, piece_model))
    parts = _slices(docs, value, piece_bytes)
    n_b = Tokenizers.of(dict(models(byte_model, piece_model))).n_b
    counts = pair_counts(parts, n_b)
    listed = parts.select("slice", F.posexplode("pairs").alias("number", "pair"))
    marks = listed.join(counts, "pair").select(
        F.col("slice").alias("of"), "number", (F.col("n_docs") * 2 + F.col("best").cast("long")).alias("mark")
    )
    kinds = {"n_best": "long", "count_sum": "long", "groups_sha256": "string"}
    doc = parts.schema["docs"].dataType.elementType
    schema = T.StructType(
        [doc[c] for c in ("doc_id", *PLAIN_COUNTS)]
        + [T.StructField(c, T._parse_datatype_string(k)) for c, k in kinds.items()]
    )
    return (
        parts.select("slice", "docs", "held", "links", "times")
        .groupBy("slice")
        .cogroup(marks.groupBy("of"))
        .applyInArrow(_weighed, schema)
    )


def _as_groups(batches: Iterator[pa.RecordBatch], value) -> Iterator[pa.RecordBatch]:
    tok = Tokenizers.of(value.value)
    for batch in slices(batches, "text"):
        out = []
        for text in batch.column("text").to_pylist():
            if not text:
                out.append([])
                continue
            a, _, b, _ = tok.encode([text])
            groups = Groups(tok, a, b)
            a_stops, b_stops = (np.flatnonzero(x) + 1 for x in (groups.a_cut, groups.b_cut))
            cuts = a.ends[groups.a_cut]
            out.append(
                [
                    {"start": start, "stop": stop, "a": a.ids[i:j].tolist(), "b": b.ids[k:m].tolist()}
                    for start, stop, i, j, k, m in zip(
                        [0, *cuts[:-1].tolist()], cuts.tolist(), [0, *a_stops[:-1]], a_stops,
                        [0, *b_stops[:-1]], b_stops, strict=True,
                    )
                ]
                if len(cuts)
                else []
            )
        kind = pa.list_(
            pa.struct(
                [
                    ("start", pa.int64()),
                    ("stop", pa.int64()),
                    ("a", pa.list_(pa.int32())),
                    ("b", pa.list_(pa.int32())),
                ]
            )
        )
        yield batch.append_column("groups", pa.array(out, kind))


def token_groups(
    docs: DataFrame, *, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL
) -> DataFrame:
    """(doc_id, text, groups): bytes of a space and the text, and the ids of A and of B there."""
    value = sent(docs, models(byte_model, piece_model))
    kind = "array<struct<start: long, stop: long, a: array<int>, b: array<int>>>"
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(
        functools.partial(_as_groups, value=value),
        with_field(docs, "groups", T._parse_datatype_string(kind)),
    )
