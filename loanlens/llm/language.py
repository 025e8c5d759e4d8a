"""Language of a text by cross-parsing entropy.

The suffix automaton of each language's labelled text knows every string that occurs in it. A
text is parsed greedily into the longest phrases that the automaton knows; the language that
needs the fewest phrases, each weighed by the bits of a pointer into its sample, wins.

Automata are dense tables, so a task parses thousands of pieces of text abreast, one symbol of
each a step, with one array lookup per language. Where a piece begins inside a text, the parse
of the piece before goes on until both begin a phrase at one place: from there on they are the
same, so the count is that of one parse of the whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.llm.common import remainder, sent, slices

#: Labelled rows per language that the automata are built from, and characters of all of them.
#: Texts are taken whole; one with more characters is not learned from.
SAMPLE_ROWS, SAMPLE_CHARS = 200, 80_000
#: Bytes of all tables at most; with many languages each gets a sample of fewer texts.
MODEL_BYTES = 256_000_000
#: Letters of a language, by frequency in its sample, that get a symbol of their own.
LETTERS = 200
#: Symbols that are parsed abreast with others.
PIECE = 256

#: Symbols: a letter that the language's sample lacks, no letter, one of its rare letters.
UNSEEN, GAP, RARE = 0, 1, 2
STARTED = 1 << 30

UNDETERMINED = "und"


class Automata:
    """Dense transition tables of one suffix automaton per language.

    An entry is the next state's row, with STARTED set where a new phrase begins: a symbol that
    cannot follow starts the next phrase.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        often = {
            k: Counter(c for t in texts for c in map(_folded, t) if c) for k, texts in samples.items()
        }
        # Codes of texts: letters of any sample by number, from 2 on.
        number = {c: i + 2 for i, c in enumerate(sorted(set().union(*often.values())))}
        self.codes = np.full(0x110000, GAP, np.int32)
        for point in range(0x110000):
            if folded := _folded(chr(point)):
                self.codes[point] = number.get(folded, UNSEEN)
        self.symbols, self.tables, self.bits = [], [], []
        for language in self.languages:
            count = often[language]
            ranked = sorted(count, key=lambda c: (-count[c], c))
            own = np.full(len(number) + 2, UNSEEN, np.uint8)
            own[GAP] = GAP
            for i, c in enumerate(ranked):
                own[number[c]] = i + 3 if i < LETTERS else RARE
            width = min(len(ranked), LETTERS) + 3
            left = MODEL_BYTES // (len(samples) * width * 8)
            kept = []
            for text in samples[language]:
                part = own[self.coded(pa.array([text]))[0]]
                if len(part) <= left:
                    kept.append(part)
                    left -= len(part)
            self.symbols.append(own)
            self.tables.append(_dense(_automaton(kept), width))
            self.bits.append(np.log2(2 + sum(map(len, kept))))

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all texts with runs of gaps as one, where each begins, which have letters."""
        texts = pc.fill_null(texts, "")
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "replace"), np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        codes = self.codes[points]
        seen = np.concatenate([[0], np.cumsum(codes != GAP, dtype=np.int64)])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP)
        keep[starts[:-1][sizes > 0]] = True
        kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
        return codes[keep], kept[starts], seen[starts[1:]] > seen[starts[:-1]]

    def phrases(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Phrases that each language needs for each text."""
        sizes = np.diff(starts)
        pieces = -(-sizes // PIECE)
        text = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begins = starts[:-1][text] + nth * PIECE
        lengths = np.minimum(starts[1:][text] - begins, PIECE)
        order = np.argsort(-lengths, kind="stable")
        place = np.empty(len(text), np.int64)
        place[order] = np.arange(len(text))
        # Where the text goes on after each piece, -1 at its end.
        after = np.full(len(text), -1, np.int64)
        after[:-1] = np.where(text[1:] == text[:-1], place[1:], -1)
        text, begins, lengths, after = (x[order] for x in (text, begins, lengths, after))
        out = np.zeros((len(sizes), len(self.languages)), np.int64)
        for k, flat in enumerate(self.tables):
            count = _parsed(flat, self.symbols[k][codes], begins, lengths, after)
            out[:, k] = np.bincount(text, count, len(sizes)).astype(np.int64)
        return out


def _parsed(flat, symbols, begins, lengths, after) -> np.ndarray:
    """Phrases that begin in each piece, the longest pieces first."""
    n = len(begins)
    going = np.searchsorted(-lengths, -np.arange(PIECE), "left")
    state = np.zeros(n, np.int32)
    count = np.zeros(n, np.int64)
    began = np.zeros((PIECE, n), bool)
    for step in range(PIECE):
        m = going[step]
        if not m:
            break
        found = flat[state[:m] + symbols[begins[:m] + step]]
        began[step, :m] = found >> 30
        count[:m] += began[step, :m]
        state[:m] = found & (STARTED - 1)
    # Each piece was begun anew; now the one before goes on in it. Where its own parse turns out
    # not to be the right one at its end, what follows it is done again.
    end, more = state.copy(), np.zeros(n, np.int64)
    todo = np.flatnonzero(after >= 0)
    while len(todo):
        to = after[todo]
        own, active = end[todo], np.arange(len(todo))
        last, gain = state[to], np.zeros(len(todo), np.int64)
        for step in range(PIECE):
            over = step >= lengths[to[active]]
            last[active[over]] = own[over]
            active, own = active[~over], own[~over]
            if not len(active):
                break
            found = flat[own + symbols[begins[to[active]] + step]]
            first, again = found >> 30 > 0, began[step, to[active]]
            gain[active] += first.astype(np.int64) - again
            apart = ~(first & again)
            active, own = active[apart], found[apart] & (STARTED - 1)
        last[active] = own
        more[to] = gain
        changed = to[last != end[to]]
        end[to] = last
        todo = changed[after[changed] >= 0]
    return count + more


def _folded(char: str) -> str:
    """A letter in lower case, '' for all else."""
    return char.lower()[0] if char.isalpha() else ""


def _automaton(parts: list[np.ndarray]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of some strings (states by number, 0 the root)."""
    steps: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    for part in parts:
        last = 0
        for symbol in part.tolist():
            if symbol in steps[last]:
                q = steps[last][symbol]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = _split(steps, link, length, last, symbol, q)
                continue
            new = len(steps)
            steps.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and symbol not in steps[p]:
                steps[p][symbol] = new
                p = link[p]
            if p >= 0:
                q = steps[p][symbol]
                link[new] = (
                    q if length[q] == length[p] + 1 else _split(steps, link, length, p, symbol, q)
                )
            last = new
    return steps


def _split(steps, link, length, p: int, symbol: int, q: int) -> int:
    """The state for the shorter strings of q, taken out of it."""
    new = len(steps)
    steps.append(dict(steps[q]))
    length.append(length[p] + 1)
    link.append(link[q])
    while p >= 0 and steps[p].get(symbol) == q:
        steps[p][symbol] = new
        p = link[p]
    link[q] = new
    return new


def _dense(steps: list[dict[int, int]], width: int) -> np.ndarray:
    root = np.full(width, STARTED, np.int32)
    for symbol, to in steps[0].items():
        root[symbol] = STARTED | to * width
    out = np.tile(root, (len(steps), 1))
    for state, own in enumerate(steps[1:], 1):
        for symbol, to in own.items():
            out[state, symbol] = to * width
    return out.ravel()


def fit(labelled: DataFrame, *, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Automata:
    """Automata from a sample of id, text and lang.

    Per language at most so many rows, the first by a hash of id and text, and so many characters
    of whole texts. This sample is all that the driver gets. Texts with more characters, or none,
    are not learned from, and a language that has no others is not known.
    """
    place = F.xxhash64("id", "text")
    known = labelled.filter(f"lang is not null and length(text) between 1 and {chars}")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("lang").orderBy("place")
    drawn = (
        known.join(F.broadcast(counts), "lang")
        .withColumn("place", place)
        # Three times the rows wanted on average, so that the window below stays small.
        .filter(F.pmod("place", F.lit(1_000_000)) * F.col("n") < 3_000_000 * (rows + 3))
        .withColumn("nth", F.row_number().over(ordered))
        .withColumn("so_far", F.sum(F.length("text")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .filter((F.col("nth") <= rows) & (F.col("so_far") <= chars))
        .select("lang", "place", "text")
    )
    samples: dict[str, list[str]] = {}
    for language, _, text in sorted(tuple(r) for r in drawn.collect()):
        samples.setdefault(language, []).append(text)
    return Automata(samples)


def predictions(
    docs: DataFrame, model: Automata, *, unlearned: str | None = UNDETERMINED
) -> DataFrame:
    """Adds lang_pred and score to docs, from its column text alone.

    lang_pred is "und", with score 0, where the text is NULL or has no letter. If nothing was
    learned, a text with letters gets what unlearned says, with score 0. Else score is how much cheaper the winner is than the runner-up, 0 to 1, and 1 if
    only one language is known. The first in alphabetical order wins a tie, with score 0.
    """
    shared = sent(docs, model)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    schema = T.StructType(
        [
            *docs.schema,
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = shared.value
        for batch in slices(batches, "text"):
            codes, starts, lettered = automata.coded(batch.column("text"))
            lang = np.full(batch.num_rows, UNDETERMINED, object)
            lang[lettered] = unlearned
            score = np.zeros(batch.num_rows)
            if automata.languages:
                cost = automata.phrases(codes, starts) * np.array(automata.bits)
                best = cost.argmin(axis=1)
                ranked = np.sort(cost, axis=1)
                score[lettered] = 1.0
                if len(automata.languages) > 1:
                    gap = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-9)
                    score[lettered] = gap[lettered]
                lang[lettered] = np.array(automata.languages, object)[best[lettered]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score)],
                [*names, "lang_pred", "score"],
            )

    return docs.mapInArrow(each, schema)


def learning_rows(docs: DataFrame, *, held_out: int = 0, parts: int = 5) -> DataFrame:
    """id, text and lang of the rows that may be learned from."""
    return docs.filter(remainder("doc_id", parts) != held_out).select(
        F.col("doc_id").alias("id"), "text", "lang"
    )
