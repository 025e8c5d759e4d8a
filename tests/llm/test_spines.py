"""The prefix trie against a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.llm import queries, spines

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = []
    for path, convs in members.items():
        todo, leaves, saved = [path], 0, 0
        while todo:
            node = todo.pop()
            leaves += not children[node]
            saved += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
            todo += children[node]
        ends = ",".join(str(c) for c in sorted(c for c in convs if paths[c] == path))
        out.append(
            (
                min(convs),
                len(path),
                min(members[path[:-1]]) if path else None,
                len(convs),
                len(children[path]),
                leaves,
                saved,
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def trie_of(spark, rows):
    found = spines.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return sorted(map(tuple, found.collect()), key=str)


def conversations(seed=3, n=260, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        kind = rng.random()
        for t in range(rng.randrange(1, longest)):
            text = f"{rng.randrange(3)}é" * (t + 1) if kind < 0.7 else "same"
            rows.append((c, t, rng.choice(["user", "assistant"]) if kind < 0.9 else "user", text))
    return rows


@pytest.mark.parametrize("shard_turns, fan", [(200_000, 16), (40, 2), (7, 3), (1, 2)])
def test_equals_a_plain_trie_whatever_the_shards(spark, monkeypatch, shard_turns, fan):
    monkeypatch.setattr(spines, "SHARD_TURNS", shard_turns)
    monkeypatch.setattr(spines, "FAN", fan)
    rows = conversations()
    assert trie_of(spark, rows) == plain_trie(rows)


def test_a_third_of_all_conversations_alike(spark, monkeypatch):
    monkeypatch.setattr(spines, "SHARD_TURNS", 50)
    rows = conversations(5, 120)
    # Copies far from the first of their hundred, which has no turns to give.
    rows += [(100_000 + 100 * i + 7, t, "user", f"hot {t}") for i in range(70) for t in range(4)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_nulls_ties_repeated_rows_and_turnless_conversations(spark):
    rows = [
        (None, 0, "user", "nobody's"),
        (1, None, None, None),
        (1, 0, "user", ""),
        (1, 0, "user", ""),
        (2, 1, "b", "x"),
        (2, 1, "a", "y"),
        (2, 1, "a", "x"),
        (-3, 0, "user", "below zero"),
        (7, 5, "user", "a" * 100_000),
        (300, 0, "user", "base"),
        (301, 0, "user", "own"),
        (301, 1, "user", None),
    ] + [(c, 0, "user", "hello") for c in range(400, 420)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_long_conversations_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(spines, "SHARD_TURNS", 3000)
    sizes = {300: 3000, 400: 2500, 500: 2500, 600: 1200}
    rows = [(c, t, "user", f"{t:04}") for c, n in sizes.items() for t in range(n)]
    found = {r[1]: r for r in trie_of(spark, rows)}
    assert sorted(found) == list(range(3001))
    for depth, row in found.items():
        n_convs = sum(n >= depth for n in sizes.values())
        assert (row[0], row[3], row[5]) == (300, n_convs, 1)
        saved = sum(4 * (sum(n >= d for n in sizes.values()) - 1) for d in range(max(depth, 1), 3001))
        assert row[6] == saved
    ends = {2500: b"400,500", 1200: b"600", 3000: b"300"}
    for depth, row in found.items():
        assert row[7] == hashlib.sha256(ends.get(depth, b"")).hexdigest()


def test_empty_table_and_other_columns(spark):
    assert trie_of(spark, []) == []
    rows = conversations(9, 30)
    wide = spark.createDataFrame(rows, SCHEMA)
    for name in ("path", "own", "depth", "key", "n_convs", "_base", "turns"):
        wide = wide.withColumn(name, F.lit("clash"))
    assert sorted(map(tuple, spines.prefix_trie(wide).collect()), key=str) == plain_trie(rows)


def test_closing_parentheses_and_range_minima():
    rng = random.Random(2)
    depth = [0]
    for _ in range(3000):
        depth.append(rng.randrange(max(1, depth[-1] - 3), depth[-1] + 2))
    shape = spines.Parentheses(np.array(depth))
    stack, close = [], {}
    for i, bit in enumerate(shape.bits.tolist()):
        if bit:
            stack.append(i)
        else:
            close[stack.pop()] = i
    assert not stack
    assert shape.find_close(shape.opens).tolist() == [close[o] for o in shape.opens.tolist()]
    stops = shape.subtrees()
    values = np.array([rng.randrange(1000) for _ in depth])
    least = spines._range_least(values, stops)
    assert least.tolist() == [min(values[i:s]) for i, s in enumerate(stops.tolist())]


def test_sql_gives_the_same(spark):
    rows = conversations(11, 230)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.execute(queries.PREFIX_TRIE_SQL).fetchall()
    assert sorted(map(tuple, found), key=str) == plain_trie(rows)
