"""Training documents from raw ones: five stages, each applied to all that the one before kept.

    language ID -> near-duplicates -> decontamination -> personal data -> piece ids

Every stage is a function of (spark, docs, sf_dir). What it returns is written as Parquet to the
folder in spark.checkpoint.dir and read again as the next stage's docs, so that a lost executor
costs no more than the running stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.functions.relations import with_position
from loanlens.llm import language, personal
from loanlens.llm.common import stored, table
from loanlens.llm.decontaminate import decontaminated
from loanlens.llm.minhash import near_duplicates
from loanlens.llm.pieces import encoded_and_checked


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter, or NULL, go.

    A NULL lang becomes the predicted one; a given lang is a label and stays. If nothing was
    learned, documents with a letter are kept and lang stays as it is. All other columns stay,
    those that are called lang_pred or score too.
    """
    model = language.fit(language.learning_rows(docs))
    aside = {c: f"_given_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    lang = F.coalesce("lang", "lang_pred").alias("lang")
    return (
        language.predictions(docs.withColumnsRenamed(aside), model, unlearned=None)
        .filter(~F.col("lang_pred").eqNullSafe(language.UNDETERMINED))
        .select(*(lang if c == "lang" else F.col(aside.get(c, c)).alias(c) for c in docs.columns))
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each class of near-duplicates.

    Shingles of five words, similarity of 0.8 or more. Of rows that repeat an id and its text one
    stays. Different texts that share an id are documents of their own, in the order of a hash of
    the text; they are numbered for that, which takes another shuffle. Rows without an id stay.
    """
    named, bare = docs.filter("doc_id IS NOT NULL"), docs.filter("doc_id IS NULL")
    sign = F.xxhash64("text").alias("_sign")
    ids = named.select("doc_id", sign).groupBy("doc_id")
    repeats = ids.agg(F.count("*").alias("n"), F.min("_sign").alias("a"), F.max("_sign").alias("b"))
    told = repeats.agg(F.max("n").alias("n"), F.bool_or(F.col("a") != F.col("b")).alias("shared"))
    repeated, shared = told.select(F.coalesce("n", F.lit(0)) > 1, F.col("shared")).first()
    if not shared:
        kept = near_duplicates(docs).filter("kept").select("doc_id").distinct()
        rows = named.join(kept, "doc_id", "left_semi")
        rows = rows.dropDuplicates(["doc_id"]) if repeated else rows
        return rows.unionByName(bare)
    texts = named.select("doc_id", sign).distinct()
    numbers = stored(with_position(texts, ["doc_id", "_sign"], "_number"))
    numbered = stored(
        named.withColumn("_sign", sign).join(numbers, ["doc_id", "_sign"])
        .dropDuplicates(["_number"])
    )
    single = numbered.select(F.col("_number").alias("doc_id"), "text")
    kept = near_duplicates(single).filter("kept").select(F.col("doc_id").alias("_number"))
    rows = numbered.join(kept, "_number", "left_semi").select(*docs.columns)
    return rows.unionByName(bare)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words repeats benchmark windows."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by marks such as [EMAIL]; n_chars is that of the new text."""
    clean = personal.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, whose decoded form is the text again.

    Documents for which that does not hold are kept and marked by round_trip = false. A NULL
    text has NULL ids and n_tokens; an empty one has none. Repeated rows are encoded each.
    """
    ids = encoded_and_checked(docs.select("doc_id", "lang", "source", "text"))
    n_tokens = F.size("ids").cast("long").alias("n_tokens")
    return ids.select("doc_id", "lang", "source", n_tokens, "ids", "round_trip")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact),
    ("pieces", encode_pieces),
]

#: No stage but the third can be said in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
