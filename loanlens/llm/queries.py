"""The queries of this subpackage: each operator over its whole table, and SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm import language, maxent, personal, quality
from loanlens.llm.common import remainder, stored, table
from loanlens.llm.counting import EDITS, counted, recounted
from loanlens.llm.crosswalk import aligned
from loanlens.llm.decontaminate import contamination
from loanlens.llm.minhash import near_duplicates
from loanlens.llm.multiindex import vector_duplicates
from loanlens.llm.pieces import decoded, encoded
from loanlens.llm.sharding import sharded
from loanlens.llm.spines import prefix_trie
from loanlens.llm.weighted import fingerprinted


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def _held_out(parts: int, held_out: int) -> Column:
    """Whether a row is held out; one without an id is not learned from, nor held out."""
    return F.coalesce(remainder("doc_id", parts) == held_out, F.lit(False)).alias("held_out")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text, and after two edits: its middle gets a remark, its end loses a word.

    The edits are made of the text's own words, so that they differ from text to text. Every text
    is edited: one too short for both stretches loses less. A NULL text is not.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    middle = "least(length(text) DIV 2 + 3, length(text))"
    edits = F.expr(
        f"""CASE WHEN text IS NOT NULL THEN CAST(array(
              struct(length(text) DIV 2, {middle},
                     concat('; see ', substring(text, 1, 20), ' ')),
              struct(greatest(length(text) - 8, {middle}), length(text), '.')) AS {EDITS}) END"""
    )
    before = counted(docs).withColumn("edits", edits).withColumn("n_before", F.col("n_tokens"))
    return recounted(before).select(
        "doc_id",
        F.col("n_before").alias("n_tokens"),
        F.col("n_tokens").alias("n_tokens_edited"),
        "encoded_chars",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("edited_sha256"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(language.learning_rows(docs))
    return language.predictions(docs.select("doc_id", "text"), model).select(
        "doc_id", _held_out(5, 0), "lang_pred", "score"
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated labels of a document count by their mean; a tie counts as 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = stored(quality.with_statistics(docs))
    labels = (
        table(spark, sf_dir, "labels")
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    )
    learned = rows.filter(remainder("doc_id", 3) != 1).join(labels, "doc_id")
    score = quality.fit(learned).score()
    return rows.select("doc_id", _held_out(3, 1), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    written = "transform({}, s -> concat_ws(':', s.kind, s.start, s.stop))"
    base = "filter(spans, s -> s.base)"
    return personal.personal_spans(docs).select(
        "doc_id",
        *(
            F.expr(f"size(filter(spans, s -> s.base AND s.kind = '{kind}'))")
            .cast("long")
            .alias(f"n_{kind}")
            for kind in personal.BASE_KINDS
        ),
        F.sha2(F.array_join(F.expr(written.format(base)), ","), 256).alias("base_sha256"),
        F.array_join(F.expr(written.format("spans")), ",").alias("spans"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = docs.filter(remainder("doc_id", 5) != 1)
    model = maxent.fit(training.select(F.col("doc_id").alias("id"), "text"))
    return maxent.scored(docs, model).select(
        "doc_id",
        _held_out(5, 1),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decoded(encoded(docs), text_column="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(table(spark, sf_dir, "embeddings"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = (
    op1_minhash_near_dedup,
    op2_benchmark_decontamination,
    op3_token_counts,
    op4_language_id,
    op5_quality,
    op6_sharding,
    op7_pii,
    op8_fingerprints,
    op9_lm_scoring,
    op10_sentencepiece,
    op11_embedding_near_dedup,
    op12_tokenizer_alignment,
    op13_prefix_trie,
)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracles() -> dict[str, str]:
    return {
        "op2_benchmark_decontamination": DECONTAMINATION_SQL,
        "op13_prefix_trie": PREFIX_TRIE_SQL,
    }


DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (
  SELECT g.doc_id, g.i, g.n, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.phrase = x.phrase),
hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)
"""

# The checksum is worked out bit by bit: -1 stands for a shift, 0 to 255 for a byte to take in.
PREFIX_TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(
      list_prepend(4294967295, flatten(list_transform(
        string_split(CAST(c AS VARCHAR), ''),
        lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda s, x: CASE WHEN x >= 0 THEN xor(s, x)
                        WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END),
    4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
turns AS (
  SELECT k.c, 0 AS src, t.pos, t.role, t.text FROM convs k JOIN t ON t.c = k.base AND t.pos <= k.h
  UNION ALL
  SELECT k.c, 1, t.pos, t.role, t.text FROM convs k JOIN t ON t.c = k.c AND t.pos > k.h),
paths AS (
  SELECT k.c, CASE WHEN count(u.role) = 0 THEN [] ELSE
      list(md5(concat(u.role, chr(0), u.text)) ORDER BY u.src, u.pos) END AS path,
    CASE WHEN count(u.role) = 0 THEN [] ELSE list(length(u.text) ORDER BY u.src, u.pos) END AS sizes
  FROM convs k LEFT JOIN turns u ON u.c = k.c GROUP BY k.c),
spots AS (
  SELECT c, len(path) AS n, d, array_to_string(path[1:d], ' ') AS node,
    array_to_string(path[1:d - 1], ' ') AS parent, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size,
    path
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM paths)),
nodes AS (
  SELECT node, d, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs,
    any_value(size) AS size, any_value(path[1:d]) AS path,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends
  FROM spots GROUP BY node, d),
kids AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
beneath AS (
  SELECT array_to_string(path[1:up], ' ') AS node, up AS d,
    sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM (SELECT n.path, n.n_convs, n.size, k.n_children, unnest(range(0, n.d + 1)) AS up
        FROM nodes n LEFT JOIN kids k ON k.parent = n.node AND k.d = n.d)
  GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
  coalesce(k.n_children, 0) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN beneath b ON b.node = n.node AND b.d = n.d
LEFT JOIN nodes p ON n.d > 0 AND p.node = n.parent AND p.d = n.d - 1
LEFT JOIN kids k ON k.parent = n.node AND k.d = n.d
"""
