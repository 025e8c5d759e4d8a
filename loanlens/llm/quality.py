"""Text quality by a sparse ensemble of rules.

Statistics of each text are columns. The paths of a forest of shallow trees are conjunctions of
bounds on them; a lasso logistic regression over these rules sets most of their weights to zero;
what is left is compiled into one column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.llm.common import slices, spaced_words, split_words, stored

TREES, DEPTH = 12, 3
#: Strength of the lasso.
LASSO = 0.002

STATISTICS = (
    "log_chars",
    "mean_word",
    "upper_share",
    "digit_share",
    "mark_share",
    "symbol_share",
    "bar_share",
    "exclaim_share",
    "high_share",
    "line_share",
    "repeated_words",
    "top_word_share",
    "marked_words",
    "repeated_lines",
)
MARKS, SYMBOLS = b".,;:!?'\"()-", b"#$%&*@^~=<>{}[]\\/_|+`"


@dataclass(frozen=True)
class Rule:
    """Bounds that all hold: (statistic, "<=" or ">", threshold)."""

    bounds: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        met = F.lit(True)
        for name, sign, threshold in self.bounds:
            met = met & (F.col(name) <= threshold if sign == "<=" else F.col(name) > threshold)
        return met.cast("double")


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        """Probability of good quality, as an expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.weights.items():
            total = total + weight * rule.column()
        return 1 / (1 + F.exp(-total))


def _per_row(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def _repeats(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and how often the commonest occurs."""
    n = len(starts) - 1
    rows = np.repeat(np.arange(n), np.diff(starts))
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
    begins = np.flatnonzero(new)
    counts = np.diff(np.append(begins, len(rows)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, rows[begins], counts)
    return np.bincount(rows[begins], minlength=n), most


def _codes(values: pa.Array) -> np.ndarray:
    if not len(values):
        return np.empty(0, np.int64)
    return values.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def statistics_of(texts: pa.Array) -> list[np.ndarray]:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, ends, data = texts.buffers()
    starts = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data else np.empty(0, np.uint8)
    starts = starts - starts[0]

    def count(chars: bytes) -> np.ndarray:
        wanted = np.zeros(256, bool)
        wanted[list(chars)] = True
        return _per_row(wanted[raw], starts)

    size = np.maximum(np.diff(starts), 1)
    letters = np.maximum(count(bytes(range(65, 91)) + bytes(range(97, 123))), 1)
    words, word_starts = spaced_words(texts)
    n_words = np.maximum(np.diff(word_starts), 1)
    distinct, most = _repeats(_codes(words), word_starts)
    marked = pc.match_substring_regex(words, r"[#$%&*!|]$").to_numpy(zero_copy_only=False)
    lines, line_starts = split_words(pc.split_pattern(texts, "\n"))
    n_lines = np.maximum(np.diff(line_starts), 1)
    distinct_lines, _ = _repeats(_codes(lines), line_starts)
    return [
        np.log1p(np.diff(starts)),
        (size - count(b" \t\n\r\x0b\x0c")) / n_words,
        count(bytes(range(65, 91))) / letters,
        count(b"0123456789") / size,
        count(MARKS) / size,
        count(SYMBOLS) / size,
        count(b"|") / n_words,
        count(b"!") / n_words,
        _per_row(raw >= 128, starts) / size,
        np.diff(line_starts) / n_words,
        1 - distinct / n_words,
        most / n_words,
        _per_row(marked, word_starts) / n_words,
        1 - distinct_lines / n_lines,
    ]


def with_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs without the text, with a column for each statistic of the whole text.

    A NULL or empty text has the statistics of no words and no lines. Columns of the input that
    are named like a statistic are replaced.
    """
    docs = docs.drop(*STATISTICS)
    names = [c for c in docs.columns if c != text_column]
    schema = T.StructType(
        [f for f in docs.schema if f.name != text_column]
        + [T.StructField(s, T.DoubleType()) for s in STATISTICS]
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            values = statistics_of(batch.column(text_column))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in names),
                    *(pa.array(v.astype(float)) for v in values),
                ],
                [*names, *STATISTICS],
            )

    return docs.mapInArrow(each, schema)


def _paths(node, bounds: tuple = ()) -> Iterator[tuple]:
    """Bounds on the way to each node of a tree, inner nodes included."""
    if bounds:
        yield bounds
    if node.subtreeDepth() > 0:
        split = node.split()
        name, threshold = STATISTICS[split.featureIndex()], split.threshold()
        yield from _paths(node.leftChild(), (*bounds, (name, "<=", threshold)))
        yield from _paths(node.rightChild(), (*bounds, (name, ">", threshold)))


def _simplified(bounds: tuple) -> Rule:
    """The tightest bound on each side of each statistic."""
    tight: dict[tuple[str, str], float] = {}
    for name, sign, threshold in bounds:
        known = tight.get((name, sign), threshold)
        tight[(name, sign)] = (min if sign == "<=" else max)(known, threshold)
    return Rule(tuple(sorted((name, sign, t) for (name, sign), t in tight.items())))


def fit(rows: DataFrame, *, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleEnsemble:
    """The ensemble from rows with the statistics and a column quality, 0 or 1.

    Rows without a label count for nothing. With labels of one kind, or none, there are no rules
    and the score is the share of ones, as if one of each had been seen before.
    """
    known = stored(rows.filter("quality IN (0, 1)").select(F.col("quality").cast("double"), *STATISTICS))
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0.0))).first()
    share = (ones + 1) / (n + 2)
    if not 0 < ones < n:
        return RuleEnsemble(float(np.log(share / (1 - share))), {})
    forest = RandomForestClassifier(
        labelCol="quality", numTrees=trees, maxDepth=depth, seed=7, maxBins=64, subsamplingRate=0.8
    ).fit(VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(known))
    rules = sorted(
        {_simplified(p) for tree in forest.trees for p in _paths(tree._java_obj.rootNode())},
        key=lambda r: r.bounds,
    )
    if not rules:
        return RuleEnsemble(float(np.log(share / (1 - share))), {})
    named = [f"rule{i}" for i in range(len(rules))]
    met = known.select("quality", *(r.column().alias(c) for r, c in zip(rules, named)))
    lines = VectorAssembler(inputCols=named, outputCol="features").transform(met)
    model = LogisticRegression(
        labelCol="quality", elasticNetParam=1.0, regParam=lasso, maxIter=40, standardization=False
    ).fit(lines.select("quality", "features"))
    weights = {r: float(w) for r, w in zip(rules, model.coefficients.toArray()) if w}
    return RuleEnsemble(float(model.intercept), weights)
