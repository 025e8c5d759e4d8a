"""Near-duplicates and decontamination against plain versions."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loanlens.llm import minhash, queries
from loanlens.llm.components import components
from loanlens.llm.decontaminate import contamination, decontaminated, phrase_matches
from loanlens.llm.minhash import near_duplicates
from tests.llm.helpers import corpus, documents, odd_texts, plain, sentence, spaced


def classes(rows, words, share=80):
    sets = {}
    for i, text in rows:
        w = spaced(text)
        grams = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
        sets[i] = grams if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= share * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("words", [4, 5])
def test_classes_equal_brute_force(spark, words):
    rows = corpus()
    found = near_duplicates(documents(spark, rows), words=words).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == classes(rows, words)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies a few words apart from each other, in blocks smaller than their buckets."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(5)
    base = sentence(rng, 90).split()
    rows = []
    for i in range(80):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(90)] = f"new{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    found = near_duplicates(documents(spark, rows), words=4).collect()
    expected = classes(rows, 4)
    assert {r[0]: tuple(r[1:]) for r in found} == expected
    assert 1 < len({v[1] for v in expected.values()}) < 80


def test_repeated_rows_rows_without_id_and_other_columns(spark):
    docs = documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)])
    docs = docs.withColumn("id", F.lit(7)).withColumn("component_id", F.lit(8))
    more = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    found = near_duplicates(docs.unionByName(more)).collect()
    assert sorted((r[0] or -1, r[2] or -1, r[3]) for r in found) == [
        (-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True),
    ]


def test_empty_tables(spark):
    empty = documents(spark, odd_texts()).limit(0)
    assert near_duplicates(empty).collect() == []
    items = spark.createDataFrame([], "item_id long, text string")
    assert contamination(empty, items).collect() == []
    assert contamination(documents(spark, [(1, "a b")]), items).first()["n_hit"] == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {found[i] for i in range(31)} == {0}
    assert {found[100 + i] for i in range(20)} == {100}


def test_estimates_follow_similarity():
    import numpy as np
    rng = random.Random(2)
    words = [f"w{i}" for i in range(1000)]
    texts = [" ".join(words), " ".join(words[:900] + [f"x{rng.random()}" for _ in range(100)])]
    shingles, starts = minhash.shingle_sets(pa.array(texts), 1)
    values = minhash._packed(minhash.minima(shingles, starts, 1800))
    estimate = minhash.estimates(values[:1], values[1:], 1800)[0]
    assert abs(estimate - 900 / 1100) < 0.05
    assert np.isclose(minhash.estimates(values[:1], values[:1], 1800)[0], 1)


def hits(rows, items, window=13):
    windows = {}
    for item, text in items:
        w = plain(text)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    out = {}
    for i, text in rows:
        w = plain(text)
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if named := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= named
        out[i] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block_chars", [16_000_000, 700])
def test_contamination_equals_brute_force(spark, block_chars):
    rng = random.Random(3)
    items = [(i, sentence(rng, rng.randrange(3, 40), 60)) for i in range(30)]
    items += [(30, None), (31, ""), (32, "..."), (33, items[4][1]), (34, "w1 w2")]
    rows = corpus(4, 20)
    for i in range(200, 260):
        words = sentence(rng, rng.randrange(0, 300), 60).split()
        at = rng.randrange(len(words) + 1)
        words[at:at] = (items[rng.randrange(30)][1] or "").upper().split()
        rows.append((i, ", ".join(words)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows)
    found = contamination(docs, benchmark, block_chars=block_chars).collect()
    expected = hits(rows, items)
    assert {r[0]: tuple(r[2:]) for r in found} == expected
    kept = decontaminated(docs, benchmark, block_chars=block_chars)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.collect()} == {i for i, v in expected.items() if not v[3]}


def test_proximity_allows_words_to_shift(spark):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = documents(spark, [(1, "x alpha beta of gamma delta y"), (2, "alpha x x x delta beta")])
    exact = phrase_matches(docs, benchmark)[1]
    near = phrase_matches(docs, benchmark, slop=1)[1]
    assert exact.count() == 0
    assert {r["id"] for r in near.collect()} == {1}


def test_contamination_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    name = "op2_benchmark_decontamination"
    result = queries.registered()[name](spark, folder)
    cursor = connection.execute(queries.oracles()[name])
    assert [c[0] for c in cursor.description] == result.columns
    assert sorted(map(tuple, result.collect())) == sorted(cursor.fetchall())
    assert hashlib.sha256(b"").hexdigest() in {r["items_sha256"] for r in result.collect()}


def test_hashes_that_agree_by_half_make_no_link():
    rng = np.random.default_rng(3)
    one = np.unique(rng.integers(0, 2**63, 50).astype(np.uint64))
    # The same upper halves as the first set, then the first set itself but for one hash.
    two = one ^ np.uint64(1)
    three = np.append(one[:-1], np.uint64(5))
    sets = [s.tobytes() for s in (one, two, three)]
    table = pa.table(
        {
            "id": [7, 8, 9],
            "key": [1, 1, 1],
            "component": [7, 8, 9],
            "signature": [bytes(90)] * 3,
            "bands": [[1, 2]] * 3,
            "shingles": pa.array(sets, pa.binary()),
        }
    )
    assert minhash._meeting(table, 180, 0.5, 80) == [(7, 9)]
