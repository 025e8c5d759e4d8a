"""Links between vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.llm import multiindex
from loanlens.llm.multiindex import vector_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.95):
    """Per id: links and component; rows of one id are one vector here."""
    sound = {
        i: np.array(v, np.float64)
        for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    }
    ids = sorted(sound)
    root, n_links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    if ids:
        x = np.array([sound[i] for i in ids]).astype(np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1)), strict=True):
            n_links[ids[a]] += 1
            n_links[ids[b]] += 1
            low, high = sorted((find(ids[a]), find(ids[b])))
            root[high] = low
    return {i: (n_links[i], find(i), find(i) == i) for i, _ in rows}


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    return {r[0]: tuple(r[1:]) for r in vector_duplicates(df, **options).collect()}


def near(rng, base, cosine):
    noise = rng.standard_normal(len(base))
    base = base / np.linalg.norm(base)
    noise -= noise @ base * base
    noise /= np.linalg.norm(noise)
    return cosine * base + np.sqrt(1 - cosine**2) * noise


def clustered(seed, n=500, width=32):
    """Vectors far apart, and near ones at cosines around the limit."""
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(width) for _ in range(n)]
    for _ in range(n):
        base = rows[rng.integers(len(rows))]
        rows.append(near(rng, base, rng.choice([0.999, 0.99, 0.97, 0.955, 0.94])) * 3)
    return [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_all_pairs(spark, seed):
    rows = clustered(seed)
    got, expected = found(spark, rows), brute(rows)
    links = sum(n for n, *_ in expected.values())
    assert links > 800
    missed = sum(expected[i][0] - got[i][0] for i in got)
    assert all(got[i][0] <= expected[i][0] for i in got)
    assert missed <= 0.01 * links
    # Every pair counts on both sides, and classes are those of the links found.
    assert sum(n for n, *_ in got.values()) % 2 == 0
    if not missed:
        assert got == expected


def test_hot_groups_are_exact(spark, monkeypatch):
    """A third of all vectors alike, a second group near it, and vectors between the two."""
    monkeypatch.setattr(multiindex, "MEMBERS", 64)
    monkeypatch.setattr(multiindex, "CODEWORDS", 1)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(24)
    other = near(rng, base, 0.93)
    rows = [near(rng, base, rng.uniform(0.99, 0.9999)) for _ in range(300)]
    rows += [near(rng, other, rng.uniform(0.99, 0.9999)) for _ in range(100)]
    rows += [near(rng, base, rng.uniform(0.93, 0.985)) for _ in range(100)]
    rows += [rng.standard_normal(24) for _ in range(300)]
    rows = [(i + 10, [float(x) for x in v]) for i, v in enumerate(rows)]
    sample = np.array([v for _, v in rows], np.float32)
    assert len(multiindex.learned(sample, len(rows), 0.95).centres) >= 2
    # One codeword: every vector visits the only cell, so nothing may be missed.
    assert found(spark, rows) == brute(rows)


def test_exact_copies(spark):
    rng = np.random.default_rng(6)
    base = [float(x) for x in rng.standard_normal(8)]
    rows = [(i, base) for i in range(50)] + [(100 + i, [-x for x in base]) for i in range(3)]
    rows += [(200, [2 * x for x in base])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows)[7] == (50, 0, False)


def test_what_links_with_nothing(spark):
    rows = [
        (1, [1.0, 0.0, 0.0]),
        (2, [1.0, 0.01, 0.0]),
        (3, None),
        (4, []),
        (5, [0.0, 0.0, 0.0]),
        (6, [float("nan"), 1.0, 0.0]),
        (7, [float("inf"), 1.0, 0.0]),
        (8, [1.0, None, 0.0]),
        (9, [1.0, 0.0]),
        (10, [3e38, 3e36, 0.0]),
        (11, [1e-40, 0.0, 0.0]),
    ]
    got = found(spark, rows)
    expected = {i: (0, i, True) for i in range(3, 10)}
    expected |= {i: (3, 1, i == 1) for i in (1, 2, 10, 11)}
    assert got == expected


def test_rows_without_id_repeated_rows_and_other_columns(spark):
    v, w = [1.0, 2.0], [2.0, -1.0]
    df = spark.createDataFrame(
        [(1, v, 0), (1, v, 0), (2, v, 0), (None, v, 0), (None, None, 0), (3, w, 1)], SCHEMA
    )
    for name in ("id", "hash", "component_id", "n_links", "node", "weight", "kept"):
        df = df.withColumn(name, F.lit("clash"))
    rows = sorted(map(tuple, vector_duplicates(df).collect()), key=str)
    assert rows == [
        (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True),
        (None, 0, None, True), (None, 0, None, True),
    ]


def test_vectors_that_share_an_id(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0)], SCHEMA
    )
    assert sorted(map(tuple, vector_duplicates(df).collect())) == [
        (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False),
    ]


def test_empty_table_one_vector_and_one_dimension(spark):
    assert found(spark, []) == {}
    assert found(spark, [(5, [1.0, 2.0])]) == {5: (0, 5, True)}
    assert found(spark, [(5, [1.0]), (6, [2.0]), (7, [-3.0])]) == {
        5: (1, 5, True), 6: (1, 5, False), 7: (0, 7, True),
    }


def test_the_bound_meets_the_wanted_share():
    """Pairs at the limit with their noise in all dimensions, and in one half only."""
    rng = np.random.default_rng(9)
    sample = rng.standard_normal((4000, 64)).astype(np.float32)
    index = multiindex.learned(sample, 60_000, 0.95)
    assert len(index.halves[0]) == 61
    tried = multiindex.unit(rng.standard_normal((3000, 64)))
    own = [
        multiindex._distances(h, w)
        for h, w in zip(multiindex._split(tried), index.halves, strict=True)
    ]
    for where in (slice(None), slice(0, 32), slice(32, 64)):
        like = multiindex._at_cosine(tried, 0.95, rng, where)
        assert np.allclose((like * tried).sum(axis=1), 0.95)
        beyond = sum(
            d[np.arange(3000), multiindex._distances(h, w).argmin(axis=1)]
            for d, h, w in zip(own, multiindex._split(like), index.halves, strict=True)
        )
        assert (beyond <= index.bound).mean() > 0.97
