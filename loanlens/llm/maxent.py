"""A hashed maximum-entropy language model.

Words belong to classes. The class of the next word is predicted by a softmax over weights that
are looked up by hashes of what came before: the last word, the one before it (a skip), and both
together (an n-gram). The word within its class is predicted the same way: a class's words are
the leaves of a tree, and every node on the way to a word is a softmax over at most FAN children,
with weights that are looked up by hashes of context and node. Without weights a word has its
share of the class's training tokens, with half a token more for each known word and for all
unknown ones together. Words outside the frequent ones share a leaf per class, in which that
share alone decides. The probabilities of all texts sum to one.

Training goes over all training documents in rounds. In a round every task starts from the same
weights, takes gradient steps (Adagrad) over its documents, and returns what changed; the changes
are averaged by tokens. Scoring is one pass in batches of numpy, and a join for rare words only.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import U64, hashed_each, mixed, runs, sent, slices, spaced_words, stored

#: Rows of the weight table that features are hashed to, and a block of them in a shuffle. The rows
#: of both tables are powers of two.
ROWS, BLOCK = 8192, 512  # rows fit 16 bits, which sort fastest
#: The commonest words are classes of their own; the others fall into classes by how they end.
OWN, ENDINGS = 7, 16
#: Children of a node in the tree of a class's words, and rows of the table of their weights.
FAN, INNER_ROWS = 16, 65_536
#: Words with counts and paths that every task gets: a bound of 6 MB.
FREQUENT = 120_000
#: Tokens of a gradient step or of a batch of scores.
STEP = 16_384
#: Decisions whose logits are worked out at a time.
PIECE = 4_096
#: So few rows are not worth an operation on all of them at once.
FEW = 64
#: Rounds of training; each goes over its share of the documents, together over all.
ROUNDS = 2
RATE = 0.2
#: The token after the last word of a text.
END = int(mixed(np.array([12345], U64)).view(np.int64)[0])


@dataclass
class Counts:
    """What the tasks get: totals, frequent words by hash, classes, and the trees of their words.

    Paths go by frequent word, then by class for the words that are not; flat, with starts.
    log_rest is the log10 of the weight of a class's shared leaf, or of a class that has no tree.
    """

    tokens: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray
    own: np.ndarray
    log_prior: np.ndarray = field(default=None)
    log_rest: np.ndarray = field(default=None)
    starts: np.ndarray = field(default=None)
    nodes: np.ndarray = field(default=None)
    choices: np.ndarray = field(default=None)
    node_prior: np.ndarray = field(default=None)

    @property
    def classes(self) -> int:
        return ENDINGS + OWN + 1

    def find(self, words: np.ndarray) -> np.ndarray:
        """Places of words by hash, -1 where a word is not among the frequent."""
        if not len(self.hashes):
            return np.full(len(words), -1)
        at = np.searchsorted(self.hashes, words).clip(max=len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, at, -1)

    def decisions(self, found: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Token, node and chosen child of every decision on the ways to some words."""
        which = np.where(found >= 0, found, len(self.hashes) + kinds)
        begins, sizes = self.starts[which], self.starts[which + 1] - self.starts[which]
        token = np.repeat(np.arange(len(which)), sizes)
        before = np.cumsum(sizes) - sizes
        at = np.arange(len(token)) + (begins - before)[token]
        return token, self.nodes[at], self.choices[at]


def _tree(weights: list[float], first: int) -> tuple[list[list[tuple[int, int]]], list[list[float]]]:
    """Way to each leaf as (node, child), and each node's children's weights; nodes from first on.

    A Huffman tree: heavy leaves have short ways.
    """
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    inner: list[list[float]] = []
    while len(heap) > 1:
        # The first node takes what leaves full ones for all others.
        take = FAN if inner else (len(heap) - 2) % (FAN - 1) + 2
        taken = [heapq.heappop(heap) for _ in range(take)]
        for child, (_, i) in enumerate(taken):
            up[i] = (len(inner), child)
        heapq.heappush(heap, (sum(w for w, _ in taken), len(weights) + len(inner)))
        inner.append([w for w, _ in taken])
    ways = []
    for i in range(len(weights)):
        way, at = [], i
        while at in up:
            node, child = up[at]
            way.append((first + node, child))
            at = len(weights) + node
        ways.append(way)
    return ways, inner


def _endings(words: pa.Array) -> np.ndarray:
    """Class of each word by its last two bytes."""
    words = words.cast(pa.large_binary())
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(1, np.uint8)
    last = raw[ends[1:] - 1].astype(U64)
    before = np.where(ends[1:] - ends[:-1] > 1, raw[np.maximum(ends[1:] - 2, 0)], 0).astype(U64)
    return (mixed(last * U64(256) + before) % U64(ENDINGS)).astype(np.int64)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and ending classes of the distinct tokens, place of each token among them, an end
    after each text, and each text's start.
    """
    words, starts = spaced_words(texts)
    n = len(starts) - 1
    ids, kinds = np.empty(0, np.int64), np.empty(0, np.int64)
    ends = starts[1:] + np.arange(n)
    is_word = np.ones(len(words) + n, bool)
    is_word[ends] = False
    which = np.empty(len(is_word), np.int64)
    if len(words):
        coded = words.dictionary_encode()
        which[is_word] = coded.indices.to_numpy(zero_copy_only=False)
        ids, kinds = hashed_each(coded.dictionary).view(np.int64), _endings(coded.dictionary)
    which[ends] = len(ids)
    ids, kinds = np.append(ids, END), np.append(kinds, ENDINGS + OWN)
    return ids, kinds, which, np.concatenate([[0], ends + 1])


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, kind, n): tokens of all texts, words by 64-bit hash, summed up within tasks first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged() -> tuple[np.ndarray, ...]:
            ids, kinds, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            begins = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            return ids[begins], kinds[order][begins], np.add.reduceat(n[order], begins)

        for batch in slices(batches, "text"):
            ids, kinds, which, _ = _tokens(batch.column("text"))
            held.append((ids, kinds, np.bincount(which, minlength=len(ids))))
            size += len(ids)
            if size > 1_500_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, merged())), names)

    names = ["word", "kind", "n"]
    return (
        docs.select("text")
        .mapInArrow(each, "word long, kind long, n long")
        .groupBy("word")
        .agg(F.first("kind").alias("kind"), F.sum("n").alias("n"))
    )


def _gathered(counts: DataFrame) -> Counts:
    """Totals and the frequent words. The driver gets FREQUENT words at most, and class sums."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Words per power of 2**(1/4) of their count tell from which count on they fit.
    grade = F.floor(F.log2("n") * 4).cast("int")
    grades = {r[0]: r[1] for r in counts.groupBy(grade.alias("g")).count().collect()}
    least, kept = math.inf, 0
    for g in sorted(grades, reverse=True):
        if kept + grades[g] > FREQUENT:
            break
        least, kept = g, kept + grades[g]
    found = counts.filter(grade >= least) if kept else counts.limit(0)
    rows = found.select("word", "n", "kind").collect()
    rows = np.array([tuple(r) for r in rows], np.int64).reshape(-1, 3)
    rows = rows[np.argsort(rows[:, 0])]
    plain = rows[rows[:, 0] != END]
    top = plain[np.lexsort((plain[:, 0], -plain[:, 1]))[:OWN], 0]
    model = Counts(tokens, distinct, rows[:, 0].copy(), rows[:, 1].copy(), top)
    kind = F.col("kind")
    for i, word in enumerate(top.tolist()):
        kind = F.when(F.col("word") == word, F.lit(ENDINGS + i)).otherwise(kind)
    known, total = np.zeros(model.classes), np.zeros(model.classes)
    for k, words, n in (
        counts.groupBy(kind.cast("int").alias("k")).agg(F.count("*"), F.sum("n")).collect()
    ):
        known[k], total[k] = words, n
    model.log_prior = np.log((total + 1) / (total.sum() + model.classes)).astype(np.float32)
    _grow(model, rows[:, 2], total + 0.5 * (known + 1))
    return model


def _grow(model: Counts, kinds: np.ndarray, size: np.ndarray) -> None:
    """Adds the trees of classes of a size: a leaf per frequent word and one for all others."""
    kinds = np.where(np.isin(model.hashes, model.own), ENDINGS, kinds)
    ways: list[list[tuple[int, int]]] = [[] for _ in range(len(kinds) + model.classes)]
    inner: list[list[float]] = []
    rest = size.copy()
    for kind in range(ENDINGS):
        words = np.flatnonzero(kinds == kind)
        rest[kind] -= (model.counts[words] + 0.5).sum()
        found, nodes = _tree([*(model.counts[words] + 0.5).tolist(), rest[kind]], len(inner))
        for place, way in zip([*words.tolist(), len(kinds) + kind], found):
            ways[place] = way
        inner += nodes
    model.log_rest = np.log10(rest)
    model.starts = np.concatenate([[0], np.cumsum(list(map(len, ways)))]).astype(np.int64)
    flat = np.array([d for way in ways for d in way], np.int32).reshape(-1, 2)
    model.nodes, model.choices = flat[:, 0].copy(), flat[:, 1].copy()
    model.node_prior = np.full((len(inner), FAN), -1e30, np.float32)
    for node, weights in enumerate(inner):
        model.node_prior[node, : len(weights)] = np.log(np.array(weights) / sum(weights))


def _batches(texts: pa.Array, model: Counts) -> Iterator[tuple[np.ndarray, ...]]:
    """Words, places among the frequent, classes, hashes of contexts and text of tokens.

    Some thousands at a time. What depends on a word alone is worked out once for each distinct one.
    """
    ids, kinds, which, starts = _tokens(texts)
    for i, word in enumerate(model.own.tolist()):
        kinds[ids == word] = ENDINGS + i
    found = model.find(ids)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    place = np.arange(len(which)) - starts[text]
    # Two more for what is before a text: of its first token, and of its first two.
    seen = np.append(ids.view(U64), [U64(1), U64(2)])
    one = np.where(place > 0, np.roll(which, 1), len(ids))
    two = np.where(place > 1, np.roll(which, 2), len(ids) + 1)
    last, skip, both = mixed(seen * U64(3)), mixed(seen * U64(5)), mixed(seen) * U64(7)
    for i in range(0, len(which), STEP):
        part = slice(i, i + STEP)
        contexts = np.stack(
            [last[one[part]], skip[two[part]], mixed(both[two[part]] + seen[one[part]])], axis=1
        )
        yield ids[which[part]], found[which[part]], kinds[which[part]], contexts, text[part]


def _class_rows(contexts: np.ndarray) -> np.ndarray:
    return (contexts & U64(ROWS - 1)).astype(np.int16)


def _inner_rows(contexts: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Rows of the weights of decisions, by context and node."""
    mix = (contexts ^ (nodes.astype(U64) * U64(0x9E3779B97F4A7C15))[:, None]) * U64(0xD6E8FEB86659FD93)
    return ((mix >> U64(32)) & U64(INNER_ROWS - 1)).astype(np.uint16)


def _powers(
    weights: np.ndarray, prior: np.ndarray, rows: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of some decisions' children, their exponentials, and the sums of these."""
    logits = np.take(weights, rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        logits += np.take(weights, rows[:, k], axis=0)
    logits += prior
    with np.errstate(over="ignore"):
        powers = np.exp(logits)
    sums = np.einsum("ij->i", powers)
    if len(sums) and not (sums.min() > 1e-30 and sums.max() < 1e30):
        # A shift of all children changes no chance, but costs more than all the rest.
        logits -= logits.max(axis=1, keepdims=True)
        powers = np.exp(logits)
        sums = np.einsum("ij->i", powers)
    return logits, powers, sums


def _log_softmax(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray) -> np.ndarray:
    logits, _, sums = _powers(weights, prior, rows)
    logits -= np.log(sums)[:, None]
    return logits


def _log_chosen(
    weights: np.ndarray, prior: np.ndarray, rows: np.ndarray, chosen: np.ndarray
) -> np.ndarray:
    """The chosen children's part of _log_softmax, in pieces that stay in a core's cache."""
    out = np.empty(len(chosen), np.float32)
    for i in range(0, len(chosen), PIECE):
        part = slice(i, i + PIECE)
        logits, _, sums = _powers(weights, prior[part] if prior.ndim == 2 else prior, rows[part])
        out[part] = logits[np.arange(len(sums)), chosen[part]] - np.log(sums)
    return out


def _row_sums(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a table that decisions look up, and the sums of these decisions' values.

    All rows take their first value at once, then all that have one their second, and so on.
    """
    rows, width = rows.ravel(), rows.shape[1]
    order = np.argsort(rows, kind="stable")  # counts its way, as rows have 16 bits
    rows = rows[order]
    begins = runs(rows)
    sizes = np.diff(begins, append=len(rows))
    often = np.argsort(~np.minimum(sizes, 65_535).astype(np.uint16), kind="stable")
    begins, sizes = begins[often], sizes[often]
    order //= width
    sums = np.take(values, order[begins], axis=0).astype(np.float64)
    more = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1))
    # The few rows with the most values take all that are left, row by row.
    taken = int(np.argmax(more < FEW)) + 1
    for nth, n in enumerate(more[: taken - 1].tolist(), 1):
        sums[:n] += np.take(values, order[begins[:n] + nth], axis=0)
    if n := int(more[taken - 1]):
        left = sizes[:n] - taken
        starts = np.cumsum(left) - left
        at = np.arange(left.sum()) + np.repeat(begins[:n] + taken - starts, left)
        rest = np.take(values, order[at], axis=0).astype(np.float64)
        sums[:n] += np.add.reduceat(rest, starts, axis=0)
    return rows[begins], sums


def _learn(
    weights: np.ndarray, squares: np.ndarray, prior: np.ndarray, rows: np.ndarray, chosen: np.ndarray
) -> None:
    """A gradient step (Adagrad) over some decisions."""
    if not len(chosen):
        return
    _, slope, sums = _powers(weights, prior, rows)
    slope /= sums[:, None]
    slope.reshape(-1)[np.arange(0, slope.size, slope.shape[1]) + chosen] -= 1
    touched, sums = _row_sums(slope, rows)
    # Most rows of the table are touched: a step over all of it costs less than picking them.
    total = np.zeros_like(weights)
    total[touched] = sums
    step = total * total
    squares += step
    np.sqrt(squares, out=step)
    np.divide(total, step, out=step)
    step *= np.float32(RATE)
    weights -= step


def _round(docs: DataFrame, model: Counts, weights: list[np.ndarray]) -> list[np.ndarray]:
    """The weights of classes and of words within them after one round over docs."""
    shared = sent(docs, (model, weights))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, begin = shared.value
        own, tokens = [w.copy() for w in begin], 0
        squares = [np.full_like(w, 1e-4) for w in own]
        # Freed at once; after that the C library keeps what a step frees for the next one, where it
        # would give it back and ask for it again page by page. A hint: nothing depends on it.
        np.empty(31 << 20, np.uint8)
        for batch in slices(batches, "text"):
            for _, found, kinds, contexts, _ in _batches(batch.column("text"), model):
                _learn(own[0], squares[0], model.log_prior, _class_rows(contexts), kinds)
                token, nodes, chosen = model.decisions(found, kinds)
                rows = _inner_rows(np.take(contexts, token, axis=0), nodes)
                prior = np.take(model.node_prior, nodes, axis=0)
                _learn(own[1], squares[1], prior, rows, chosen)
                tokens += len(kinds)
        for which in range(len(own) if tokens else 0):
            change = (own[which] - begin[which]) * np.float32(tokens)
            blocks = range(0, len(change), BLOCK)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([which] * len(blocks), pa.int32()),
                    pa.array(blocks, pa.int32()),
                    pa.array([tokens] * len(blocks), pa.int64()),
                    pa.array([change[i : i + BLOCK].tobytes() for i in blocks], pa.binary()),
                ],
                names,
            )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for which, block, tokens, change in zip(*(c.to_pylist() for c in batch.columns)):
                own = total.setdefault((which, block), [0, 0.0])
                own[0] += tokens
                own[1] = own[1] + np.frombuffer(change, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in total], pa.int32()),
                pa.array([k[1] for k in total], pa.int32()),
                pa.array([v[0] for v in total.values()], pa.int64()),
                pa.array([v[1].astype(np.float32).tobytes() for v in total.values()], pa.binary()),
            ],
            names,
        )

    names = ["which", "block", "tokens", "change"]
    schema = "which int, block int, tokens long, change binary"
    sums = (
        docs.select("text")
        .mapInArrow(each, schema)
        .repartition("which", "block")
        .mapInArrow(summed, schema)
    )
    out = [w.copy() for w in weights]
    # As many rows as the tables have blocks.
    for which, block, tokens, change in sums.collect():
        part = out[which][block : block + BLOCK]
        part += np.frombuffer(change, np.float32).reshape(part.shape) / tokens
    return out


@dataclass
class Model:
    counts: Counts
    weights: np.ndarray
    inner: np.ndarray
    words: DataFrame


def fit(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of all texts of docs (columns id and text; a NULL text counts as empty)."""
    words = stored(token_counts(docs))
    counts = _gathered(words)
    weights = [
        np.zeros((ROWS, counts.classes), np.float32),
        np.zeros((INNER_ROWS, FAN), np.float32),
    ]
    for number in range(rounds if counts.tokens else 0):
        share = docs.filter(F.pmod(F.xxhash64("id", "text"), F.lit(rounds)) == number)
        weights = _round(share, counts, weights)
    return Model(counts, *weights, words)


def _counted_pairs(text: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct pairs of a text and a word, sorted, and how often each occurs."""
    order = np.lexsort((word, text))
    text, word = text[order], word[order]
    first = np.union1d(runs(text), runs(word))
    return text[first], word[first], np.diff(first, append=len(text))


def scored(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, n_known, train_tokens, base_score and score.

    n_tokens counts the end of a text as a token, n_known those that occur in training.
    base_score is the sum over tokens of log10((c + 0.5) / (N + 0.5 * (V + 1))), c being a
    token's count, N that of all training tokens and V the number of distinct ones. score is the
    model's log10 probability of the text. A NULL text counts as empty and is one token, its end.
    With no training documents every token is unknown. Columns of these names are replaced.
    """
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    docs = docs.drop(*made)
    kept = [c for c in docs.columns if c != text_column]
    shared = sent(docs, (model.counts, model.weights, model.inner))
    counts = model.counts

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights, inner = shared.value
        for batch in slices(batches, "text"):
            n = batch.num_rows
            tokens, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
            logs, score = np.zeros(n), np.zeros(n)
            rare_text, rare_word = [], []
            for ids, found, kinds, contexts, text in _batches(batch.column("text"), model):
                own = _log_chosen(weights, model.log_prior, _class_rows(contexts), kinds)
                score += np.bincount(text, own / math.log(10), n)
                token, nodes, chosen = model.decisions(found, kinds)
                if len(token):
                    rows = _inner_rows(np.take(contexts, token, axis=0), nodes)
                    prior = np.take(model.node_prior, nodes, axis=0)
                    own = _log_chosen(inner, prior, rows, chosen)
                    score += np.bincount(text[token], own / math.log(10), n)
                tokens += np.bincount(text, minlength=n)
                frequent = found >= 0
                known += np.bincount(text[frequent], minlength=n)
                own = np.zeros(len(ids))
                own[frequent] = np.log10(model.counts[found[frequent]] + 0.5)
                logs += np.bincount(text, own, n)
                # What the trees don't decide: classes of one word, and the shared leaves.
                shares = ~frequent | (kinds >= ENDINGS)
                score += np.bincount(text[shares], (own - model.log_rest[kinds])[shares], n)
                rare_text.append(text[~frequent])
                rare_word.append(ids[~frequent])
            text = np.concatenate(rare_text or [np.empty(0, np.int64)])
            word = np.concatenate(rare_word or [np.empty(0, np.int64)])
            text, word, times = _counted_pairs(text, word)
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])
            rare = pa.StructArray.from_arrays([pa.array(word), pa.array(times)], ["word", "times"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    *(pa.array(x) for x in (tokens, known, logs, score)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rare),
                ],
                ["row", "tokens", "known", "logs", "score", "rare"],
            )

    # Numbers of rows that hold once they are written.
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    others = [F.struct(*kept).alias("kept")] if kept else [F.struct().alias("kept")]
    rows = numbered.select(
        F.struct("_row", *others).alias("row"), F.col(text_column).cast("string").alias("text")
    )
    row_type = rows.schema["row"].dataType.simpleString()
    part = stored(
        rows.mapInArrow(
            each,
            f"row {row_type}, tokens long, known long, logs double, score double, "
            "rare array<struct<word: long, times: long>>",
        )
    )
    rare = (
        part.select(F.col("row._row").alias("_row"), F.inline("rare"))
        .join(model.words.select("word", "n"), "word", "left")
        .groupBy("_row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("more_logs"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        )
    )
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    size = math.log10(counts.tokens + 0.5 * (counts.distinct + 1))
    return (
        part.select("*", F.col("row._row").alias("_row"))
        .join(rare, "_row", "left")
        .select(
            *(F.col(f"row.kept.`{c}`").alias(c) for c in kept),
            F.col("tokens").alias("n_tokens"),
            (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(counts.tokens).cast("long").alias("train_tokens"),
            (logs - F.col("tokens") * size).alias("base_score"),
            (F.col("score") + F.coalesce("more_logs", F.lit(0.0))).alias("score"),
        )
    )
