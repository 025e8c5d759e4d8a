"""Operators that look at one text at a time, against plain versions."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loanlens.llm import language, maxent, personal, pieces, quality, queries, sharding
from loanlens.llm.counting import PATTERN, VOCABULARY, Counter, SegmentTree, counted, recounted
from loanlens.llm.weighted import fingerprinted
from tests.llm.helpers import corpus, documents, held_out, odd_texts, sentence, spaced
from tests.llm.test_pairs import classes, hits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    with open(VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_follow_edits(spark, encoding):
    rng = random.Random(3)
    alphabet = "ab T.'s \n\n  \t\xa0\x1c\x85é中1"
    counter = Counter()
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300)))
        tree = SegmentTree(*counter.leaves(text))
        for _ in range(4):
            start = rng.randint(0, len(text))
            stop = min(len(text), start + rng.choice([0, 0, 1, 3, 50]))
            put = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 4, 40])))
            text, _ = tree.edit(text, start, stop, put, counter)
            assert tree.tokens[1] == len(encoding.encode_ordinary(text))
            assert tree.chars[1] == len(text)


def test_leaves_stay_small_under_edits():
    counter, rng = Counter(), random.Random(6)
    text = " ".join(rng.choice(["one", "two", "three"]) for _ in range(2000))
    tree = SegmentTree(*counter.leaves(text))
    for _ in range(60):
        start = rng.randrange(len(text) // 2, len(text) // 2 + 40)
        put = " ".join(["four", "five"] * rng.choice([1, 40, 300]))
        text, encoded = tree.edit(text, start, start + 5, put, counter)
        assert encoded <= len(put) + 2 * 34 * 6
    assert max(tree.chars[tree.width :]) <= 33 * 12 and tree.chars[1] == len(text)
    assert tree.tokens[1] == sum(counter.leaves(text)[1])


def test_every_text_is_edited(spark, encoding, tmp_path):
    rows = [(i, "abc defgh ij, klm no pqrs tuv wx yz 0123456789"[:i]) for i in range(46)]
    rows += [(100, None), (101, "é中" * 9), (101, "é中" * 9)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op3_token_counts(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        text = texts[r["doc_id"]]
        edited = ""
        if text is not None:
            half = len(text) // 2
            stop = min(half + 3, len(text))
            edited = text[:half] + "; see " + text[:20] + " " + text[stop : max(len(text) - 8, stop)] + "."
        assert r["n_tokens"] == len(encoding.encode_ordinary(text or ""))
        assert r["n_tokens_edited"] == len(encoding.encode_ordinary(edited)), edited
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_token_counts_of_tables(spark, encoding):
    rows = corpus()
    docs = counted(documents(spark, rows), Counter())
    edits = F.expr(
        "CASE doc_id WHEN 1 THEN array(struct(2 AS start, 5 AS stop, 'new words' AS text), "
        "struct(0 AS start, 0 AS stop, 'first ' AS text)) END"
    )
    after = recounted(docs.withColumn("edits", edits).withColumn("encoded_chars", F.lit(1)))
    before = {r["doc_id"]: r["n_tokens"] for r in docs.collect()}
    texts = dict(rows)
    assert before == {i: len(encoding.encode_ordinary(t or "")) for i, t in rows}
    for r in after.collect():
        text = texts[r["doc_id"]]
        if r["doc_id"] == 1:
            text = "first " + text[:2] + "new words" + text[5:]
        assert (r["text"], r["n_tokens"]) == (text, len(encoding.encode_ordinary(text or "")))
    assert recounted(docs.limit(0).withColumn("edits", edits)).count() == 0


def test_language_of_held_out_texts(spark):
    rng = random.Random(1)
    letters = {"aa": "abcde ", "bb": "efgha ", "cc": "xyzab "}
    rows = [
        (i, "".join(rng.choices(letters[lang], k=rng.randrange(30, 400))), lang, "s", 0)
        for i, lang in enumerate(rng.choices(list(letters), k=150))
    ]
    rows += [(i, t, None, "s", 0) for i, t in odd_texts()] + [(None, "abc", "aa", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")
    model = language.fit(language.learning_rows(docs))
    found = language.predictions(docs.withColumn("score", F.lit("x")), model).collect()
    right = [r["lang"] == r["lang_pred"] for r in found if held_out(r["doc_id"], 5, 0) and r["lang"]]
    assert sum(right) > 0.95 * len(right)
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found}
    assert by_id[900] == by_id[901] == by_id[902] == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in found)
    nothing = language.fit(language.learning_rows(docs.limit(0)))
    assert language.predictions(docs, nothing).filter("lang_pred != 'und'").count() == 0


@pytest.mark.parametrize("piece", [2, 3, 256])  # the parse of a text does not depend on it
def test_phrases_are_longest_matches(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    samples = ["the cat sat", "the mat", "ababababab"]
    model = language.Automata({"en": samples})
    rng = random.Random(4)
    parts = [model.coded(pa.array([s]))[0].tolist() for s in samples]
    known = {tuple(p[i:j]) for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    texts = ["".join(rng.choice("theca smqb") for _ in range(rng.randrange(1, 90))) for _ in range(150)]
    texts += ["", "a", "ab" * 300, "babab" * 70, "t" * 600, "the mat " * 90]
    codes, starts, _ = model.coded(pa.array(texts))
    found = model.phrases(codes, starts)[:, 0].tolist()
    for text, i, j, wanted in zip(texts, starts, starts[1:], found):
        count, at, word = 0, 0, codes[i:j].tolist()
        while at < len(word):
            size = 1
            while at + size < len(word) and tuple(word[at : at + size + 1]) in known:
                size += 1
            count, at = count + 1, at + size
        assert wanted == count, text


def test_scripts_with_many_letters_are_told_apart(spark):
    rng = random.Random(5)
    letters = {"aa": range(0x4E00, 0x4E00 + 600), "bb": range(0x5E00, 0x5E00 + 600)}
    rows = [
        (i, "".join(map(chr, rng.choices(letters[lang], k=rng.randrange(5, 200)))), lang)
        for i, lang in enumerate(rng.choices(list(letters), k=120))
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(language.learning_rows(docs))
    assert max(len(set(s.tolist())) for s in model.symbols) > language.LETTERS
    assert language.predictions(docs, model).filter("lang != lang_pred").count() == 0


def test_texts_are_learned_whole_or_not_at_all(spark):
    rows = [(1, "abcd" * 20, "aa"), (2, "wxyz" * 50, "bb"), (3, "klmn" * 5, "bb"), (3, "klmn" * 5, "bb")]
    labelled = spark.createDataFrame(rows, "id long, text string, lang string")
    model = language.fit(labelled, chars=100)
    assert model.languages == ["aa", "bb"]
    cost = model.phrases(*model.coded(pa.array(["abcd" * 20, "klmn" * 5, "wxyz"]))[:2]).tolist()
    assert cost == [[1, 80], [20, 1], [4, 4]]


def test_quality_rules(spark):
    result = queries.registered()["op5_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = result.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    assert result.count() == 1000


def test_quality_of_odd_tables(spark):
    docs = documents(spark, odd_texts()).select("doc_id", "text", F.lit(1).alias("log_chars"))
    rows = quality.with_statistics(docs)
    assert rows.count() == len(odd_texts())
    for label in (None, 1, 0):
        known = rows.withColumn("quality", F.lit(label).cast("int"))
        scores = rows.select(quality.fit(known).score().alias("s")).collect()
        assert all(0 <= r["s"] <= 1 for r in scores)
    assert quality.with_statistics(docs.limit(0)).count() == 0


def uniform(doc_id, name):
    seed = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42)
    return ((xxhash.xxh64_intdigest(name.encode(), seed) >> 11) + 0.5) * 2.0**-53


def descended(doc_id, tree):
    while not isinstance(tree, tuple):
        if len(tree) > 1:
            name = min(
                tree, key=lambda c: -math.log(uniform(doc_id, c)) / sharding.weight(tree[c])
            )
        else:
            (name,) = tree
        tree = tree[name]
    return tree[0]


def test_shards_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_ROWS", 3)
    rows = [(i, t) for i, t in corpus()]
    docs = documents(spark, rows + rows[:3])
    found = sharding.sharded(docs).collect()
    tree = sharding.regular_tree()
    texts = dict(rows)
    slots = collections.defaultdict(list)
    for r in found:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert r["shard"] == descended(r["doc_id"], tree)
        assert r["grown_shard"] == descended(r["doc_id"], sharding.grown(tree, 16))
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(found) == len(rows) + 3
    assert sharding.sharded(docs.limit(0)).count() == 0
    assert sharding.sharded(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == len(found)


PERSONAL = [
    "mail a.b@c.de, x@y and z@q-1.com.au@w.org",
    "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 00000000000000000001.1.1.1",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 1234",
    "+49 (0) 30 1234567 +1 2 +1 (755) 555-9729 tel",
    "iban DE89 3704 0044 0532 0130 00 and GB00 1234 5678 9012 34",
    "ssn 123-45-6789, call (755) 555-9729; jo [at] mail [dot] com",
    "@@@ +++ ... 1" + "9" * 5000 + " " + "a" * 100_000 + "@",
]


def test_base_spans_equal_the_patterns():
    patterns = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    rng = random.Random(6)
    alphabet = "a@.1 23+-()é9"
    texts = PERSONAL[:-1] + [
        "".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)
    ]
    for text in texts:
        expected = []
        for kind, pattern in enumerate(patterns):
            for m in re.finditer(pattern, text):
                digits = [c for c in m[0] if c in "0123456789"]
                if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                    continue
                if kind == 2:
                    values = [int(c) for c in digits][::-1]
                    total = sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values))
                    if not 12 <= len(digits) <= 19 or total % 10:
                        continue
                if kind == 3 and not 9 <= len(digits) <= 15:
                    continue
                expected.append((m.start(), kind, m.end()))
        assert personal.base_spans(text) == sorted(expected), text


def test_personal_spans_and_redaction(spark):
    rows = list(enumerate(PERSONAL)) + odd_texts()
    docs = documents(spark, rows).withColumn("spans", F.lit(1))
    found = {r["doc_id"]: r["spans"] for r in personal.personal_spans(docs).collect()}
    kinds = {i: {s["kind"] for s in spans} for i, spans in found.items()}
    assert kinds[0] == {"email"} and "card" in kinds[2] and "phone" in kinds[3]
    assert "ssn" in kinds[5] and "iban" in kinds[4]
    for i, text in rows:
        base = [(s["start"], personal.KINDS.index(s["kind"]), s["stop"]) for s in found[i] if s["base"]]
        assert base == personal.base_spans(text or "")
    clean = {r["doc_id"]: r["text"] for r in personal.redacted(docs).collect()}
    assert clean[0].startswith("mail [EMAIL], x@y") and clean[900] is None
    assert clean[904] == "one two three"
    assert personal.personal_spans(docs.limit(0)).count() == 0


def test_fingerprints(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, 300, 150)) for i in range(0, 80, 2)] + odd_texts()
    rows += [rows[3]]
    found = fingerprinted(documents(spark, rows)).collect()
    texts = dict(rows)
    order = sorted(texts)
    assert len(found) == len(rows)
    bias = []
    for r in found:
        i = r["doc_id"]
        own, following = texts[i] or "", texts[order[(order.index(i) + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r["near_edited"]), (following, r["near_next"])):
            a, b = (
                collections.Counter(w for w in re.split(r"[ \t-\r]+", t) if w) for t in (own, other)
            )
            union = sum((a | b).values())
            if i < 80 and union:
                bias.append(near - sum((a & b).values()) / union)
    assert abs(np.mean(bias)) < 0.03 and np.std(bias) < 0.1
    prints = {r["doc_id"]: r["fingerprint"] for r in found}
    assert prints[900] == prints[901] == prints[902] == ""
    assert fingerprinted(documents(spark, rows).limit(0)).count() == 0
    single = fingerprinted(documents(spark, [(1, "a b c d")])).first()
    assert single["near_next"] == 1.0


def test_a_repeated_row_has_the_fingerprint_of_its_text(spark):
    rng = random.Random(9)
    text, other = sentence(rng, 200, 60), sentence(rng, 200, 60)
    rows = [(1, text), (1, text), (1, text), (2, text), (3, other)]
    found = fingerprinted(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    assert len({r["fingerprint"] for r in found if r["doc_id"] < 3}) == 1
    assert {r["near_next"] for r in found if r["doc_id"] == 1} == {1.0}
    once = {r["doc_id"]: r for r in fingerprinted(documents(spark, rows[2:])).collect()}
    assert all(r == once[r["doc_id"]] for r in found)


def test_language_model(spark):
    rows = corpus()
    docs = documents(spark, rows).select("doc_id", "text", F.lit(0).alias("score"))
    training = docs.filter("doc_id % 5 != 1")
    model = maxent.fit(training.select(F.col("doc_id").alias("id"), "text"))
    tokens = {i: [*spaced(t), None] for i, t in rows}
    counts = collections.Counter(w for i in tokens if i % 5 != 1 for w in tokens[i])
    n = sum(counts.values())
    size = math.log10(n + 0.5 * (len(counts) + 1))
    found = maxent.scored(docs.unionByName(docs.limit(2)), model).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["train_tokens"]) == (len(own), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        base = sum(math.log10(counts[w] + 0.5) - size for w in own)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)
    nothing = maxent.fit(training.limit(0).select(F.col("doc_id").alias("id"), "text"))
    assert maxent.scored(docs, nothing).filter("n_known > 0").count() == 0
    assert maxent.scored(docs.limit(0), model).count() == 0


def test_words_outside_the_frequent_count_as_often_as_they_occur(spark, monkeypatch):
    monkeypatch.setattr(maxent, "FREQUENT", 2)
    rows = [(1, "a a a b b c d d"), (2, "d d c new new new"), (2, "d d c new new new"), (3, None)]
    docs = documents(spark, rows).select("doc_id", "text")
    model = maxent.fit(docs.filter("doc_id = 1").select(F.col("doc_id").alias("id"), "text"))
    assert len(model.counts.hashes) <= 2
    counts = collections.Counter([*spaced(rows[0][1]), None])
    n = sum(counts.values())
    size = math.log10(n + 0.5 * (len(counts) + 1))
    found = sorted(maxent.scored(docs, model).collect(), key=lambda r: r["doc_id"])
    for r, (_, text) in zip(found, rows, strict=True):
        own = [*spaced(text), None]
        assert (r["n_tokens"], r["n_known"]) == (len(own), sum(counts[w] > 0 for w in own))
        base = sum(math.log10(counts[w] + 0.5) - size for w in own)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)


def test_class_probabilities_sum_to_one(spark):
    model = maxent.fit(documents(spark, corpus()).select(F.col("doc_id").alias("id"), "text"))
    rows = np.random.default_rng(1).integers(0, maxent.ROWS, (50, 3))
    logs = maxent._log_softmax(model.weights, model.counts.log_prior, rows)
    assert np.allclose(np.exp(logs).sum(axis=1), 1, atol=1e-4)


def test_context_tells_words_of_one_class_apart(spark):
    """The same words, equally frequent and of one ending class, in two contexts."""
    rng = random.Random(4)
    pairs = [("left", "kaxab"), ("right", "mozab")]
    filler = [f"f{i}" for i in range(maxent.OWN)]  # commoner, so classes of their own
    rows = []
    for i in range(300):
        words = []
        for _ in range(20):
            words += [*rng.choice(pairs), *(rng.choice(filler) for _ in range(8))]
        rows.append((i, " ".join(words)))
    model = maxent.fit(documents(spark, rows).select(F.col("doc_id").alias("id"), "text"))
    asked = [(1, "left kaxab"), (2, "left mozab"), (3, "right mozab"), (4, "right kaxab")]
    docs = documents(spark, asked).select("doc_id", "text")
    scores = {r["doc_id"]: r["score"] for r in maxent.scored(docs, model).collect()}
    assert scores[1] > scores[2] + 0.2 and scores[3] > scores[4] + 0.2


def test_probabilities_of_words_sum_to_one(spark, monkeypatch):
    """All words after one context, with some outside the frequent ones, and one unknown."""
    monkeypatch.setattr(maxent, "FREQUENT", 150)
    docs = documents(spark, corpus()).select(F.col("doc_id").alias("id"), "text")
    model = maxent.fit(docs)
    counts, rng = model.counts, np.random.default_rng(2)
    assert 0 < len(counts.hashes) <= 150 and len(counts.node_prior) > 2
    context = rng.integers(1, 2**62, (1, 3)).astype(np.uint64)
    total = np.zeros(maxent.ENDINGS)
    words = [(r["word"], r["kind"], r["n"]) for r in model.words.collect()]
    words = [w for w in words if w[0] not in counts.own and w[1] < maxent.ENDINGS]
    unknown = [(k, k, 0) for k in range(maxent.ENDINGS)]
    for word, kind, n in words + unknown:
        found = counts.find(np.array([word]))
        _, nodes, chosen = counts.decisions(found, np.array([kind]))
        log = 0.0 if found[0] >= 0 else math.log10(n + 0.5) - counts.log_rest[kind]
        if len(nodes):
            rows = maxent._inner_rows(context[np.zeros(len(nodes), int)], nodes)
            logs = maxent._log_softmax(model.inner, counts.node_prior[nodes], rows)
            log += logs[np.arange(len(nodes)), chosen].sum() / math.log(10)
        total[kind] += 10**log
    assert np.allclose(total, 1, atol=1e-3)


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    rng = random.Random(2)
    alphabet = "aeio ubcdth rsn THE  \n\t0123.,!-_'éüß中文日本😀"
    names = [model.id_to_piece(i).replace("▁", " ") for i in range(300, 31000)]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["".join(rng.choice(names) for _ in range(rng.randrange(9))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(10_000 + i, t) for i, t in odd_texts()]
    docs = documents(spark, rows).withColumn("ids", F.lit(1))
    found = pieces.decoded(pieces.encoded(docs), text_column="back").collect()
    for r in found:
        if r["text"] is None:
            assert r["ids"] is None and r["back"] is None
        else:
            assert r["ids"] == model.encode(r["text"])
            assert r["back"] == r["text"]
    assert pieces.encoded(docs.limit(0)).count() == 0


def test_what_is_remembered_does_not_change_pieces(monkeypatch):
    rng = random.Random(8)
    lists = [
        [sentence(rng, rng.randrange(1, 30)) for _ in range(20)] + ["", "a" * 50, "  x\u2603"]
        for _ in range(4)
    ]
    whole = pieces.Pieces.load()
    wanted = [whole.encode_lists([whole.split(t) for t in texts]) for texts in lists]
    monkeypatch.setattr(pieces, "WORDS", 1)
    monkeypatch.setattr(pieces, "REMEMBERED", 2)  # four places for all pairs
    small = pieces.Pieces.load()
    for texts, (ids, begins) in zip(lists, wanted):
        found = small.encode_lists([small.split(t) for t in texts])
        assert found[0].tolist() == ids.tolist() and found[1].tolist() == begins.tolist()
    assert small.encode_lists([[], []])[0].tolist() == []


def test_unigram_pieces_have_the_best_score():
    rng = random.Random(3)
    names = {"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 4))) for _ in range(25)}
    names = {n for n in names if "▁" not in n.lstrip("▁")} | {"a", "b", "▁"}
    scores = {n: -rng.random() * 5 for n in names}
    model = pieces.Pieces(scores, {n: i + 1 for i, n in enumerate(sorted(names))}, unigram=True)

    def best(word):
        if not word:
            return 0.0
        return max(
            scores[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in scores
        )

    words = sorted({"▁" + "".join(rng.choice("ab") for _ in range(rng.randrange(8))) for _ in range(60)})
    ids, starts = model.encode_words(words)
    name = {i: n for n, i in model.ids.items()}
    for k, word in enumerate(words):
        found = [name[i] for i in ids[starts[k] : starts[k + 1]]]
        assert "".join(found) == word
        assert math.isclose(sum(scores[p] for p in found), best(word))


def test_pipeline_equals_its_stages_by_hand(spark):
    result = corpus_pipeline.run(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    kept = [(r["doc_id"], r["text"]) for r in rows if any(c.isalpha() for c in r["text"] or "")]
    of = classes(kept, 5)
    kept = [(i, t) for i, t in kept if of[i][2]]
    dirty = hits(kept, [tuple(r) for r in items])
    kept = {i: t for i, t in kept if not dirty[i][3]}
    assert {r["doc_id"] for r in result} == set(kept)
    assert all(r["round_trip"] for r in result)
    back = pieces.decoded(
        spark.createDataFrame([(r["doc_id"], r["ids"]) for r in result], "doc_id long, ids array<int>")
    )
    for r in back.collect():
        assert not personal.base_spans(r["text"])
        if not personal.base_spans(kept[r["doc_id"]]):
            assert r["text"] == kept[r["doc_id"]]


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(None, "some words here"), (1, "a b c"), (1, "a b c"), *odd_texts()]
    docs = documents(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_language_stage_without_labels_and_with_some(spark):
    texts = ["the cat and the dog", "der Hund und die Katze", "1 2 3", None]
    docs = documents(spark, list(enumerate(texts))).withColumn("lang", F.lit(None).cast("string"))
    stage = corpus_pipeline.identify_language
    found = stage(spark, docs, SF)
    assert found.columns == docs.columns
    assert {(r["doc_id"], r["lang"]) for r in found.collect()} == {(0, None), (1, None)}
    learned = [i for i in range(1000, 1060) if not held_out(i, 5, 0)]
    labelled = documents(spark, [(i, texts[i % 2]) for i in learned])
    labelled = labelled.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    kept = documents(spark, [(2000, texts[0])]).withColumn("lang", F.lit("de"))
    found = stage(spark, docs.unionByName(labelled).unionByName(kept), SF).collect()
    by_id = {r["doc_id"]: r["lang"] for r in found}
    assert len(found) == len(learned) + 3
    assert (by_id[0], by_id[1], by_id[2000]) == ("en", "de", "de")


def test_language_stage_keeps_clashing_columns(spark):
    docs = documents(spark, [(i, f"the text number {i} of them") for i in range(8)])
    docs = docs.withColumn("score", F.lit("mine")).withColumn("lang_pred", F.lit(7))
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {(r["score"], r["lang_pred"]) for r in kept.collect()} == {("mine", 7)}


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    rng = random.Random(3)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, a), (3, c), (3, c), (None, a), (None, a), (4, None)]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), SF)
    found = sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()))
    assert found == sorted([(0, a), (0, a), (1, a), (1, b), (3, c), (4, "")])
    # Without texts that share an id, repeated rows are one document.
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows[3:]), SF)
    found = sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()))
    assert found == sorted([(0, a), (0, a), (2, a), (3, c), (4, "")])


def test_one_pass_checks_what_decoding_gives(spark):
    texts = [t for _, t in odd_texts()] + ["a ▁ b", "▁", "  two", "é" * 40, "tail ", "\ufffd x"]
    docs = documents(spark, list(enumerate(texts))).withColumn("round_trip", F.lit("clash"))
    plain = pieces.decoded(pieces.encoded(docs), text_column="decoded").select(
        "doc_id", "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip")
    )
    checked = pieces.encoded_and_checked(docs)
    assert checked.columns == ["doc_id", "lang", "source", "n_chars", "ids", "round_trip"]
    assert sorted(checked.select("doc_id", "ids", "round_trip").collect()) == sorted(plain.collect())
    assert checked.filter("NOT round_trip").count() == 2
