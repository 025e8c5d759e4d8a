"""The language model's softmax and gradient step against plain versions."""

import numpy as np
import pyarrow as pa
import pytest

from loanlens.llm import maxent


def plain_log_softmax(weights, prior, rows):
    logits = weights.astype(np.float64)[rows.astype(int)].sum(axis=1) + prior
    top = logits.max(axis=1, keepdims=True)
    return logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))


@pytest.mark.parametrize("scale", [0.5, 60.0])  # the larger leaves the range of exponentials
def test_log_softmax_equals_a_plain_one(scale):
    rng = np.random.default_rng(1)
    weights = (rng.normal(size=(40, 16)) * scale).astype(np.float32)
    prior = np.log(rng.random((200, 16)) + 0.01).astype(np.float32)
    prior[:50, 9:] = -1e30  # nodes with fewer children
    rows = rng.integers(0, 40, (200, 3)).astype(np.uint16)
    found = maxent._log_softmax(weights, prior, rows)
    wanted = plain_log_softmax(weights, prior, rows)
    assert np.allclose(found, wanted, rtol=1e-4, atol=1e-3)
    assert np.allclose(np.exp(found.astype(np.float64)).sum(axis=1), 1, atol=1e-3)


def test_a_gradient_step_equals_a_plain_one():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(40, 16)).astype(np.float32)
    squares = rng.random((40, 16)).astype(np.float32) + np.float32(0.01)
    prior = np.zeros((300, 16), np.float32)
    rows = (rng.zipf(1.4, (300, 3)) % 30).astype(np.uint16)  # rows 30 to 39 stay untouched
    rows[0] = 7  # one row for all features of a decision
    chosen = rng.integers(0, 16, 300)
    slope = np.exp(plain_log_softmax(weights, prior, rows))
    slope[np.arange(300), chosen] -= 1
    sums = np.zeros((40, 16))
    for own, places in zip(slope, rows):
        for place in places:
            sums[place] += own
    wanted_squares = squares + sums**2
    wanted = weights - maxent.RATE * sums / np.sqrt(wanted_squares)
    maxent._learn(weights, squares, prior, rows, chosen)
    assert np.allclose(squares, wanted_squares, rtol=1e-4)
    assert np.allclose(weights, wanted, rtol=1e-4, atol=1e-5)
    before = weights.copy()
    maxent._learn(weights, squares, prior[:0], rows[:0], chosen[:0])
    assert (weights == before).all()


@pytest.mark.parametrize("few", [1, 3, 1000])  # all by turns, the last row by row, all row by row
@pytest.mark.parametrize("n", [1, 700])
def test_sums_over_rows_equal_plain_ones(monkeypatch, few, n):
    monkeypatch.setattr(maxent, "FEW", few)
    rng = np.random.default_rng(3)
    values = rng.normal(size=(n, 5)).astype(np.float32)
    rows = (rng.zipf(1.3, (n, 3)) % 50).astype(np.uint16)
    rows[: n // 2, 1] = 65_535  # one row in half of the decisions
    wanted = {}
    for own, places in zip(values.astype(np.float64), rows.tolist()):
        for place in places:
            wanted[place] = wanted.get(place, 0) + own
    found, sums = maxent._row_sums(values, rows)
    assert len(found) == len(wanted) and set(found.tolist()) == set(wanted)
    assert all(np.allclose(s, wanted[r]) for r, s in zip(found.tolist(), sums))


def test_chosen_logarithms_are_those_of_the_whole_softmax(monkeypatch):
    monkeypatch.setattr(maxent, "PIECE", 64)
    rng = np.random.default_rng(4)
    weights = rng.normal(size=(40, 16)).astype(np.float32)
    rows = rng.integers(0, 40, (300, 3)).astype(np.uint16)
    chosen = rng.integers(0, 16, 300)
    for prior in (np.zeros(16, np.float32), rng.normal(size=(300, 16)).astype(np.float32)):
        wanted = maxent._log_softmax(weights, prior, rows)[np.arange(300), chosen]
        assert np.array_equal(maxent._log_chosen(weights, prior, rows, chosen), wanted)
    assert not len(maxent._log_chosen(weights, prior[:0], rows[:0], chosen[:0]))


def plain_contexts(words):
    """Of every token of a text and its end."""
    mixed = lambda x: int(maxent.mixed(np.array([x % 2**64], np.uint64))[0])
    for i in range(len(words) + 1):
        one = words[i - 1] if i > 0 else 1
        two = words[i - 2] if i > 1 else 2
        yield [mixed(one * 3), mixed(two * 5), mixed(mixed(two) * 7 + one)]


def test_a_word_is_looked_up_once_in_a_batch(monkeypatch):
    asked = []
    hashes = np.sort(maxent.hashed_each(pa.array(["a", "bb"])).view(np.int64))
    model = maxent.Counts(4, 2, hashes, np.array([2, 2]), hashes[:1])
    monkeypatch.setattr(
        maxent.Counts, "find", lambda self, x, old=maxent.Counts.find: asked.append(x) or old(self, x)
    )
    texts = ["a bb c", None, "C " * 50, "", "bb " * 3000 + "a"]
    words = [(t or "").lower().split() for t in texts]
    coded = {w: int(maxent.hashed_each(pa.array([w]))[0]) for w in ("a", "bb", "c")}
    monkeypatch.setattr(maxent, "STEP", 1000)
    parts = [np.concatenate(x) for x in zip(*maxent._batches(pa.array(texts), model))]
    ids, found, kinds, contexts, text = parts
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    own = [[coded[w] for w in t] for t in words]
    assert ids.tolist() == [x for t in own for x in [*map(signed, t), maxent.END]]
    assert text.tolist() == [i for i, t in enumerate(own) for _ in range(len(t) + 1)]
    assert contexts.tolist() == [c for t in own for c in plain_contexts(t)]
    assert [hashes[f] if f >= 0 else None for f in found] == [x if x in hashes else None for x in ids]
    assert (kinds[ids == hashes[0]] == maxent.ENDINGS).all()
    assert (kinds[ids == maxent.END] == maxent.ENDINGS + maxent.OWN).all()
    # Three words and the end, not the 3,058 tokens.
    assert sum(map(len, asked)) == 4


def test_words_that_are_not_frequent_are_counted_text_by_text():
    text = np.array([0, 0, 0, 1, 1, 4, 4, 4, 4])
    word = np.array([9, -5, 9, 9, 9, 7, 7, -5, 7])
    found = maxent._counted_pairs(text, word)
    assert [*zip(*(x.tolist() for x in found))] == [
        (0, -5, 1), (0, 9, 2), (1, 9, 2), (4, -5, 1), (4, 7, 3)
    ]
    assert [len(x) for x in maxent._counted_pairs(text[:0], word[:0])] == [0, 0, 0]
