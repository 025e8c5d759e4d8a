"""Where documents repeat benchmark items: phrases and near phrases, from a positional index.

For every document the places of each word of the benchmark are stored, list by list, in a
Parquet table: an inverted index that is split by document, as no query needs lists of several
documents together. A window of 13 words is then sought from its rarest word on: each place of
that word proposes a start, and the other words' lists, shifted by their offsets and taken from
rare to frequent, leave the starts where all of them agree.

The benchmark goes to the tasks in blocks of bounded size; each block has an index of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import plain_words, slices, stored

#: Words of a window.
WINDOW = 13
#: Benchmark text, in characters, that is sent to tasks at once.
BLOCK_CHARS = 16_000_000

INDEX_SCHEMA = (
    "id long, text_key long, n_words int, terms array<int>, ends array<int>, places array<int>"
)
MATCH_SCHEMA = "id long, text_key long, phrase int, start int, stop int"


class Phrases:
    """The distinct windows of a block of items, as numbers of words."""

    def __init__(self, items: list[tuple], window: int):
        words, starts = plain_words(pa.array([t for _, t in items], pa.string()))
        coded = words.dictionary_encode()
        self.words = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False)
        known: dict[bytes, int] = {}
        self.items: list[tuple] = []
        rows = []
        for (item, _), i, j in zip(items, starts, starts[1:]):
            for at in range(i, max(j - window, i) + 1) if j > i else ():
                phrase = codes[at : min(at + window, j)]
                number = known.setdefault(phrase.tobytes(), len(known))
                if number == len(rows):
                    rows.append(np.pad(phrase, (0, window - len(phrase)), constant_values=-1))
                self.items.append((number, item))
        self.codes = np.array(rows, np.int32).reshape(len(rows), window)
        self.lengths = (self.codes >= 0).sum(axis=1).astype(np.int32)

    def ranked(self, counts: np.ndarray) -> np.ndarray:
        """Offsets of each window's words, the rarest first; missing words last."""
        often = np.where(self.codes >= 0, counts[self.codes], np.iinfo(np.int64).max)
        return np.argsort(often, axis=1, kind="stable").astype(np.int32)


def _index(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, starts = plain_words(batch.column("text"))
            coded = words.dictionary_encode()
            number = pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1)
            codes = number.to_numpy(zero_copy_only=False)[
                coded.indices.to_numpy(zero_copy_only=False)
            ] if len(words) else np.empty(0, np.int32)
            known = np.flatnonzero(codes >= 0)
            rows = np.searchsorted(starts, known, "right") - 1
            places = (known - starts[rows]).astype(np.int32)
            order = np.lexsort((places, codes[known], rows))
            rows, terms, places = rows[order], codes[known][order], places[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
            begins = np.flatnonzero(new)
            each_row = np.concatenate(
                [[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))]
            ).astype(np.int32)
            lists = np.concatenate(
                [[0], np.cumsum(np.bincount(rows[begins], minlength=batch.num_rows))]
            ).astype(np.int32)
            ends = np.append(begins[1:], len(rows)) - each_row[rows[begins]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("text_key"),
                    pa.array(np.diff(starts).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(lists), pa.array(terms[begins])),
                    pa.ListArray.from_arrays(pa.array(lists), pa.array(ends.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(each_row), pa.array(places)),
                ],
                ["id", "text_key", "n_words", "terms", "ends", "places"],
            )

    return docs.mapInArrow(each, INDEX_SCHEMA)


def _list_sizes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and term of each stored list, and how many places it has."""
    lists = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(batch.num_rows), lists)
    ends = batch.column("ends").flatten().to_numpy(zero_copy_only=False)
    sizes = ends.copy()
    inner = rows[1:] == rows[:-1]
    sizes[1:][inner] -= ends[:-1][inner]
    return rows, batch.column("terms").flatten().to_numpy(zero_copy_only=False), sizes


def _counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """Places of each term in the whole index; the driver gets one number per benchmark word."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            _, terms, sizes = _list_sizes(batch)
            np.add.at(total, terms, sizes)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), pa.array(total[found])], ["term", "n"]
        )

    counts = np.zeros(n_terms, np.int64)
    sums = (
        index.select("terms", "ends")
        .mapInArrow(each, "term int, n long")
        .groupBy("term")
        .agg(F.sum("n").alias("n"))
    )
    for term, n in sums.collect():
        counts[term] = n
    return counts


def _agreeing(at: np.ndarray, place: np.ndarray, term: np.ndarray, slop: int) -> np.ndarray:
    """Whether a word stands at a place, or within slop words of it."""
    found = at[place] == term
    for by in range(1, slop + 1):
        found |= (at[place - by] == term) | (at[place + by] == term)
    return found


def _matches(index: DataFrame, phrases: Phrases, counts: np.ndarray, slop: int) -> DataFrame:
    ranked = phrases.ranked(counts)
    codes, lengths = phrases.codes, phrases.lengths
    window = codes.shape[1]
    number = np.arange(len(codes))
    rarest = codes[number, ranked[:, 0]]
    # Windows by their rarest word: those of word t are by_term[first[t] : first[t + 1]].
    by_term = np.argsort(rarest, kind="stable")
    first = np.searchsorted(rarest[by_term], np.arange(len(counts) + 1))
    gap = window + slop

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms, sizes = _list_sizes(batch)
            n_words = batch.column("n_words").to_numpy(zero_copy_only=False).astype(np.int64)
            base = gap + np.concatenate([[0], np.cumsum(n_words + gap)])
            at = np.full(base[-1] + gap, -1, np.int32)
            term = np.repeat(terms, sizes)
            row = np.repeat(rows, sizes)
            place = base[row] + batch.column("places").flatten().to_numpy(zero_copy_only=False)
            at[place] = term
            times = first[term + 1] - first[term]
            some = np.flatnonzero(times)
            times = times[some]
            run = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            phrase = by_term[np.repeat(first[term[some]], times) + run]
            start = np.repeat(place[some], times) - ranked[phrase, 0]
            row = np.repeat(row[some], times)
            fits = (start >= base[row]) & (start + lengths[phrase] <= base[row] + n_words[row])
            phrase, start, row = phrase[fits], start[fits], row[fits]
            for k in range(1, window):
                offset = ranked[phrase, k]
                wanted = codes[phrase, offset]
                here = (wanted < 0) | _agreeing(at, start + offset, wanted, slop)
                phrase, start, row = phrase[here], start[here], row[here]
            start -= base[row]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(row)),
                    batch.column("text_key").take(pa.array(row)),
                    pa.array(phrase.astype(np.int32)),
                    pa.array(start.astype(np.int32)),
                    pa.array((start + lengths[phrase]).astype(np.int32)),
                ],
                ["id", "text_key", "phrase", "start", "stop"],
            )

    return index.mapInArrow(each, MATCH_SCHEMA)


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column).cast("string")
    return docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.xxhash64(text).alias("text_key"),
        text.alias("text"),
    )


def phrase_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_column: str = "doc_id",
    item_column: str = "item_id",
    text_column: str = "text",
    window: int = WINDOW,
    slop: int = 0,
    block_chars: int = BLOCK_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """(documents, matches): sizes in words, and where windows of items occur.

    documents has id, text_key and n_words, a row per row of docs. matches has id, text_key,
    item, and start and stop in words of the document. A window is so many consecutive words of
    an item; an item of fewer, but not none, is one window. With slop 0 a match is the exact
    phrase; else each word stands within slop words of its place beside the window's rarest word
    (a proximity match).

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case.
    A NULL text has no words; items without words match nothing. text_key tells rows with equal
    ids and different texts apart. Empty tables give empty results. Other columns play no part.
    """
    docs = _keyed(docs, id_column, text_column)
    spark = docs.sparkSession
    items = benchmark.select(
        F.col(item_column).alias("item"), F.col(text_column).cast("string").alias("text")
    ).filter("text is not null")
    chars = items.agg(F.sum(F.length("text") + 100)).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    sizes, found = None, None
    for number in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == number)
        phrases = Phrases([tuple(r) for r in own.collect()], window)
        index = stored(_index(docs, phrases.words))
        sizes = index.select("id", "text_key", "n_words") if sizes is None else sizes
        matches = _matches(index, phrases, _counts(index, len(phrases.words)), slop)
        named = spark.createDataFrame(
            sorted(set(phrases.items), key=str), f"phrase int, item {items.schema['item'].dataType.simpleString()}"
        )
        matches = matches.join(F.broadcast(named), "phrase").select(
            "id", "text_key", "item", "start", "stop"
        )
        found = matches if found is None else found.unionByName(matches)
    return sizes, found


def _covered(spans: str) -> Column:
    """Words under at least one of an array of (start, stop)."""
    return F.expr(
        f"""aggregate(array_sort({spans}), struct(0 AS n, 0 AS reached),
              (a, s) -> struct(
                a.n + greatest(s.stop - greatest(s.start, a.reached), 0) AS n,
                greatest(a.reached, s.stop) AS reached)).n"""
    ).cast("long")


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, one_in: int = 20, id_column: str = "doc_id", **options
) -> DataFrame:
    """Per row of docs: its id, text_key, n_words, n_hit, items (sorted) and contaminated.

    A word inside a match is hit; a document is contaminated if any word is and
    one_in * n_hit >= n_words. Options and special cases: see phrase_matches.
    """
    sizes, matches = phrase_matches(docs, benchmark, id_column=id_column, **options)
    hit = (
        matches.groupBy("id", "text_key")
        .agg(
            F.collect_set(F.struct("start", "stop")).alias("spans"),
            F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"),
        )
        .select(
            F.col("id").alias("hit_id"),
            F.col("text_key").alias("hit_key"),
            "items",
            _covered("spans").alias("n_hit"),
        )
    )
    same = sizes["id"].eqNullSafe(hit["hit_id"]) & (sizes["text_key"] == hit["hit_key"])
    joined = sizes.join(hit, same, "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
    return joined.select(
        F.col("id").alias(id_column),
        "text_key",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias(
            "contaminated"
        ),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    id_column = options.get("id_column", "doc_id")
    text_column = options.get("text_column", "text")
    dirty = (
        contamination(docs, benchmark, **options)
        .filter("contaminated")
        .select(F.col(id_column).alias("dirty_id"), F.col("text_key").alias("dirty_key"))
        .distinct()
    )
    same = docs[id_column].cast("long").eqNullSafe(dirty["dirty_id"]) & (
        F.xxhash64(docs[text_column].cast("string")) == dirty["dirty_key"]
    )
    return docs.join(dirty, same, "left_anti")
