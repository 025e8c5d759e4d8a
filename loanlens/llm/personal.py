"""Personal data by weak supervision.

Candidates are spans of fixed formats (the base) and of looser ones. Labelers vote on each: its
own format, a check digit, gazetteers, words around it, characters beside it. How often each
combination of votes occurs in the corpus is summed up by Spark; from that table expectation
maximisation estimates how far each labeler can be relied on, without any labels, and a logistic
classifier is trained on the estimated probabilities. It decides on the looser candidates; base
spans always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.llm.common import bounded_batches, slices, with_field

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "contact", "obfuscated")
KINDS = BASE_KINDS + MORE_KINDS
LABELERS = ("format", "digits", "gazetteer", "context", "border")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
CONTACT = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
OBFUSCATED = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,8}"
)

# Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io de fr es uk eu us ca au at ch it nl be pl pt se no dk fi ie jp cn in br mx ru za nz".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
IBAN_COUNTRIES = frozenset("AD AE AT BE BG BR CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LT LU LV MC MT NL NO PL PT RO SA SE SI SK TR".split())
CARD_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)")
SPEAKING_FOR = {
    "email": "mail e-mail email contact write kontakt correo courriel",
    "ip": "ip host server address client login",
    "card": "card visa mastercard amex credit karte tarjeta carte",
    "phone": "phone call tel fax mobile telefon téléphone teléfono",
    "iban": "iban account bank konto compte cuenta",
    "ssn": "ssn social security",
    "contact": "phone call tel fax mobile contact",
    "obfuscated": "mail e-mail email contact write",
}
SPEAKING_AGAINST = "version isbn issn order serial item part page vol doi section chapter"

FOR = {
    kind: re.compile(r"(?i)(?<!\w)(?:" + "|".join(map(re.escape, words.split())) + r")(?!\w)")
    for kind, words in SPEAKING_FOR.items()
}
AGAINST = re.compile(r"(?i)(?<!\w)(?:" + SPEAKING_AGAINST.replace(" ", "|") + r")(?!\w)")
#: Characters before a span in which words count as its context.
BEFORE = 40

SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())])
)
SPAN_SCHEMA = T.ArrayType(
    T.StructType()
    .add("kind", T.StringType())
    .add("start", T.IntegerType())
    .add("stop", T.IntegerType())
    .add("base", T.BooleanType())
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @, so that long runs cost their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(text):
        parts = run[0].split(".")
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            stop = at + sum(map(len, four)) + 3
            small = (p.lstrip("0") for p in four)
            if all(len(p) < 4 and int(p or 0) <= 255 for p in small):
                yield at, stop
            at = stop + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, stop) of the four base kinds, in that order."""
    found = []
    if "@" in text:
        found += [(i, 0, j) for i, j in _emails(text)]
    if DIGIT.search(text):
        found += [(i, 1, j) for i, j in _addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _digits(m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Looser candidates that overlap neither a base span nor one another, the first kind first."""
    found: list[tuple[int, int, int]] = []
    if DIGIT.search(text):
        for kind, pattern in ((4, IBAN), (5, SSN), (6, CONTACT)):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    if "at]" in text or "at)" in text:
        found += [(m.start(), 7, m.end()) for m in OBFUSCATED.finditer(text)]
    # Base spans may overlap one another; where they reach so far tells what is taken.
    starts = [i for i, _, _ in base]
    reach = list(accumulate((j for _, _, j in base), max))
    taken: list[tuple[int, int, int]] = []
    for start, kind, stop in sorted(found, key=lambda s: (s[1], s[0])):
        before = bisect_left(starts, stop)
        if before and reach[before - 1] > start:
            continue
        at = bisect_left(taken, (start, 0, 0))
        if at and taken[at - 1][2] > start or at < len(taken) and taken[at][0] < stop:
            continue
        taken.insert(at, (start, kind, stop))
    return taken


def votes(text: str, start: int, kind: int, stop: int) -> tuple[int, ...]:
    """1, -1 or 0 (no opinion) of each labeler."""
    name, span = KINDS[kind], text[start:stop]
    digits = _digits(span)
    format_ = 1 if kind < 4 else 0
    check = gazetteer = 0
    if name == "card":
        gazetteer = 1 if CARD_ISSUERS.match(digits) else -1
        check = 1
    elif name == "ip":
        gazetteer = -1 if digits.strip("0") == "" or span.startswith("0.") else 1
    elif name == "email":
        gazetteer = 1 if span.rpartition(".")[2].lower() in TOP_DOMAINS else -1
    elif name == "phone":
        gazetteer = 1 if any(digits[:n] in CALLING_CODES for n in (1, 2)) else -1
    elif name == "iban":
        plain = span.replace(" ", "")
        gazetteer = 1 if plain[:2] in IBAN_COUNTRIES else -1
        moved = plain[4:] + plain[:4]
        check = 1 if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else -1
        format_ = 1 if 15 <= len(plain) <= 34 else -1
    elif name == "ssn":
        area = int(digits[:3])
        gazetteer = -1 if area in (0, 666) or area >= 900 else 0
        check = -1 if digits[3:5] == "00" or digits[5:] == "0000" else 0
    elif name == "contact":
        gazetteer = -1 if digits[0] in "01" or digits[3] in "01" else 0
        format_ = 1 if span[0] == "(" else 0
    else:
        gazetteer = 1 if re.split(r"\W+", span.rstrip("]) "))[-1].lower() in TOP_DOMAINS else -1
    before = text[max(0, start - BEFORE) : start]
    context = 1 if FOR[name].search(before) else -1 if AGAINST.search(before) else 0
    beside = text[start - 1 : start] + text[stop : stop + 1]
    border = -1 if any(c.isalnum() for c in beside) else 1 if not beside.strip() else 0
    return format_, check, gazetteer, context, border


def _candidates(text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + loose_spans(text, base))


class SpanClassifier:
    """Probability that a candidate is personal data, by its kind and votes."""

    def __init__(self, counts: dict[tuple, int]):
        self.patterns = {}
        self.reliability = np.full(len(LABELERS), 0.8)
        if not counts:
            return
        patterns = sorted(counts)
        kinds = np.array([p[0] for p in patterns])
        cast = np.array([p[1:] for p in patterns], float)
        weight = np.array([counts[p] for p in patterns], float)
        truth = self._expectation_maximisation(kinds, cast, weight)
        weights = self._logistic(self._features(kinds, cast), truth, weight)
        scores = 1 / (1 + np.exp(-self._features(kinds, cast) @ weights))
        self.patterns = dict(zip(patterns, scores.tolist()))

    def _expectation_maximisation(self, kinds, cast, weight, rounds: int = 60) -> np.ndarray:
        """Probability of each pattern; labelers are independent given the truth."""
        prior = np.full(len(KINDS), 0.5)
        truth = np.full(len(kinds), 0.5)
        for _ in range(rounds):
            odds = np.log(prior / (1 - prior))[kinds]
            odds = odds + cast @ np.log(self.reliability / (1 - self.reliability))
            truth = 1 / (1 + np.exp(-odds))
            agreed = np.where(cast > 0, truth[:, None], 1 - truth[:, None]) * (cast != 0)
            # As if each labeler had been right 8 times in 10 before.
            right = (agreed * weight[:, None]).sum(axis=0) + 8
            cast_at_all = ((cast != 0) * weight[:, None]).sum(axis=0) + 10
            self.reliability = np.clip(right / cast_at_all, 0.55, 0.99)
            yes = np.bincount(kinds, weight * truth, len(KINDS)) + 1
            prior = np.clip(yes / (np.bincount(kinds, weight, len(KINDS)) + 2), 0.05, 0.95)
        return truth

    @staticmethod
    def _features(kinds: np.ndarray, cast: np.ndarray) -> np.ndarray:
        return np.hstack([np.eye(len(KINDS))[kinds], cast > 0, cast < 0]).astype(float)

    @staticmethod
    def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
        """Newton steps with a small ridge."""
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-x @ w))
            slope = x.T @ (weight * (y - p)) - 0.1 * w
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
            step = np.linalg.solve(curve, slope)
            w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        return w

    def personal(self, text: str) -> list[tuple[int, int, int]]:
        """Base spans and the looser ones that the classifier takes for personal data."""
        return [
            (i, kind, j)
            for i, kind, j in _candidates(text)
            if kind < 4 or self.patterns.get((kind, *votes(text, i, kind, j)), 0) >= 0.5
        ]


def fit(docs: DataFrame, text_column: str = "text") -> SpanClassifier:
    """The classifier of a corpus. The driver gets one count per combination of votes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                for i, kind, j in _candidates(text or ""):
                    seen[(kind, *votes(text, i, kind, j))] += 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([list(p) for p in seen], pa.list_(pa.int32())),
                pa.array(list(seen.values()), pa.int64()),
            ],
            ["pattern", "n"],
        )

    bounded_batches(docs.sparkSession)
    counts = (
        docs.select(F.col(text_column).cast("string").alias("text"))
        .mapInArrow(each, "pattern array<int>, n long")
        .groupBy("pattern")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    return SpanClassifier({tuple(p): n for p, n in counts})


def _with_spans(docs: DataFrame, model: SpanClassifier, text_column: str, masked: bool) -> DataFrame:
    names = docs.columns
    place = names.index(text_column)
    schema = docs.schema if masked else with_field(docs, "spans", SPAN_SCHEMA)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            texts = batch.column(text_column).to_pylist()
            found = [model.personal(t or "") for t in texts]
            columns = list(batch.columns)
            if masked:
                columns[place] = pa.array(
                    [t if t is None else mask(t, s) for t, s in zip(texts, found)],
                    columns[place].type,
                )
            else:
                columns.append(
                    pa.array(
                        [
                            [
                                {"kind": KINDS[k], "start": i, "stop": j, "base": k < 4}
                                for i, k, j in spans
                            ]
                            for spans in found
                        ],
                        SPAN_TYPE,
                    )
                )
            yield pa.RecordBatch.from_arrays(columns, names if masked else [*names, "spans"])

    return docs.mapInArrow(each, schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans get one mark."""
    out, done = [], 0
    for i, kind, j in spans:
        if i >= done:
            out += [text[done:i], f"[{KINDS[kind].upper()}]"]
        done = max(done, j)
    return "".join([*out, text[done:]])


def personal_spans(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with a column spans: kind, start and stop in code points, and whether it is a base span.

    Spans are ordered by start, then kind. A NULL or empty text has none. The input's other
    columns stay; one named spans is replaced. Rows are judged one by one, so repeated rows
    get equal spans. An empty table gives an empty result.
    """
    docs = docs.drop("spans")
    return _with_spans(docs, fit(docs, text_column), text_column, masked=False)


def redacted(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with personal data in the text replaced by marks such as [EMAIL]; NULL stays NULL."""
    return _with_spans(docs, fit(docs, text_column), text_column, masked=True)
