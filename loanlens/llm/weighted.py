"""Document fingerprints by consistent weighted sampling, in column expressions alone.

A text's terms are its words, weighted by how often they occur. Weights are cut into chunks of
at most CHUNK, which leaves the sums of smaller and of larger weights of two texts as they are,
and a hash deals each chunk to one of the bins of a fingerprint. Within its bin a chunk draws,
from the same hash, r and c from a Gamma(2, 1) distribution and b uniform. Its weight w is
rounded down to y = exp(r * (t - b)) with t = floor(ln w / r + b), and the chunk with the
smallest c / (y * exp(r)) is the bin's sample, together with its t. Two texts have equal samples
in a bin with a chance that is the generalised Jaccard similarity of what the bin holds: the sum
of the smaller weights over the sum of the larger. Chunks keep bins about equally heavy, so that
the share of equal samples among bins that either text fills estimates that of whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.llm.common import stored

#: Bins of a fingerprint, a power of two of at most 256, and the largest weight of a chunk.
BINS, CHUNK = 64, 2
#: White space between words.
SPACES = "[ \\t-\\r]+"
#: What stands for an empty bin.
EMPTY = "f" * 8


def _uniform(bits: Column, first: int, n: int) -> Column:
    """n bits of a hash as a number between 0 and 1, neither included."""
    cut = F.shiftrightunsigned(bits, first).bitwiseAND(F.lit(2**n - 1))
    return (cut + F.lit(0.5)) * F.lit(2.0**-n)


def _drawn(term: Column, weight: Column) -> Column:
    """A chunk's draw as a long: its rank above, what identifies the sample below."""
    more = F.xxhash64(term, F.lit(1))
    r = -F.log(_uniform(term, 8, 28) * _uniform(term, 36, 28))
    c = -F.log(_uniform(more, 0, 21) * _uniform(more, 21, 21))
    b = _uniform(more, 42, 21)
    t = F.floor(F.log(weight) / r + b)
    log_a = F.log(c) - r * (t - b + F.lit(1.0))
    # Below 2**31, so that the rank keeps its order when it is moved up by 32 bits.
    rank = F.floor((F.greatest(log_a, F.lit(-63.0)) + F.lit(64.0)) * F.lit(2.0**24))
    # Bits that the bin does not fix; never those that stand for an empty bin.
    name = F.shiftrightunsigned(F.xxhash64(term, t), 8) % F.lit(2**32 - 1)
    return F.shiftleft(rank, 32).bitwiseOR(name)


def fingerprints(texts: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """keys and samples (an array of an int per bin, NULL if empty) of each text that has words.

    texts has a column text besides keys, which must tell its rows apart. If texts is partitioned
    by some of the keys, nothing is shuffled.
    """
    words = texts.select(*keys, F.explode(F.split("text", SPACES)).alias("word"))
    terms = (
        words.filter("word != ''")
        .select(*keys, F.xxhash64("word").alias("word"))
        .groupBy(*keys, "word")
        .agg(F.count("*").alias("n"))
    )
    chunks = terms.select(
        *keys, "word", "n", F.explode(F.expr(f"sequence(0L, (n - 1) DIV {CHUNK})")).alias("chunk")
    ).select(
        *keys,
        F.xxhash64("word", "chunk").alias("term"),
        F.least(F.col("n") - CHUNK * F.col("chunk"), F.lit(CHUNK)).cast("double").alias("weight"),
    )
    drawn = (
        chunks.select(
            *keys,
            F.col("term").bitwiseAND(F.lit(bins - 1)).alias("bin"),
            _drawn(F.col("term"), F.col("weight")).alias("sample"),
        )
        .groupBy(*keys, "bin")
        .agg(F.min("sample").alias("sample"))
    )
    by_bin = drawn.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "sample"))).alias("by_bin")
    )
    return by_bin.select(
        *keys,
        F.expr(
            f"transform(sequence(0L, {bins - 1}L),"
            f" b -> CAST((by_bin[b] & {2**32 - 1}L) - {2**31}L AS INT))"
        ).alias("samples"),
    )


def written(samples: str) -> Column:
    """A fingerprint as text, 8 hexadecimal digits a bin; '' without words."""
    digits = f"coalesce(lower(lpad(hex(s + {2**31}L), 8, '0')), '{EMPTY}')"
    return F.coalesce(
        F.expr(f"array_join(transform({samples}, s -> {digits}), '')"), F.lit("")
    )


def likeness(left: str, right: str) -> Column:
    """Share of equal samples among bins that are not both empty.

    1 for two texts without words, 0 for one.
    """
    both = f"zip_with({left}, {right}, (a, b) -> CASE WHEN a IS NULL AND b IS NULL THEN NULL "
    both += "ELSE coalesce(a = b, false) END)"
    equal = f"size(filter({both}, s -> s)) / size(filter({both}, s -> s IS NOT NULL))"
    return F.expr(
        f"CASE WHEN {left} IS NULL AND {right} IS NULL THEN 1D "
        f"WHEN {left} IS NULL OR {right} IS NULL THEN 0D ELSE {equal} END"
    )


KEYS = ["key1", "key2"]


def _in_order(docs: DataFrame) -> DataFrame:
    """Per distinct document its keys, id, n_chars, and the keys of the next in order of id.

    The order is made by a range partitioning of narrow rows, stored with each row's partition;
    the last row of a partition is followed by the first of the next one.
    """
    narrow = docs.select("id", *KEYS, F.length("text").cast("long").alias("n_chars")).distinct()
    rows = stored(
        narrow.repartitionByRange("id", *KEYS).withColumn("part", F.spark_partition_id())
    )
    first = rows.groupBy("part").agg(F.min(F.struct("id", *KEYS)).alias("first"))
    # As many rows as there are partitions.
    parts = Window.orderBy("part")
    after = first.select(
        "part",
        F.coalesce(
            F.lead("first").over(parts),
            F.first("first").over(parts.rowsBetween(Window.unboundedPreceding, 0)),
        ).alias("after"),
    )
    own = Window.partitionBy("part").orderBy("id", *KEYS)
    following = F.lead(F.struct("id", *KEYS)).over(own)
    return stored(
        rows.withColumn("following", following)
        .join(F.broadcast(after), "part")
        .select(
            "id",
            *KEYS,
            "n_chars",
            *(F.coalesce("following", "after")[k].alias(f"next_{k}") for k in KEYS),
        )
    )


def edited_pairs(docs: DataFrame, order: DataFrame) -> DataFrame:
    """Keys, n_chars, the next document's keys, text and edited of each distinct document.

    Of the text of n code points the last floor(n / 2) give way to the first as many, or all, of
    the next document in the order; the first document follows the last. docs has columns text,
    key1 and key2 from keyed(). Texts are shuffled once; what moves on is the first part of each.
    """
    # Repeated rows have equal keys, and meet in their own tasks first.
    texts = docs.groupBy(*KEYS).agg(F.first("text").alias("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int").alias("half")
    following = [F.col(f"next_{k}") for k in KEYS]
    wanted = order.select(
        *(f.alias(k) for f, k in zip(following, KEYS)),
        *(F.col(k).alias(f"of_{k}") for k in KEYS),
        half,
    )
    heads = texts.join(wanted, KEYS).select(
        *(F.col(f"of_{k}").alias(k) for k in KEYS), F.expr("substring(text, 1, half)").alias("head")
    )
    own = texts.join(order.select(*KEYS, "n_chars", *following, half), KEYS)
    return own.join(heads, KEYS).select(
        *KEYS,
        "n_chars",
        *following,
        "text",
        F.expr("concat(substring(text, 1, CAST(n_chars AS INT) - half), head)").alias("edited"),
    )


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id and text ('' for NULL) with two hashes that stand for both together."""
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    return rows.select(
        "id", "text", F.xxhash64("id", "text").alias("key1"), F.xxhash64("text", "id").alias("key2")
    )


def fingerprinted(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", bins: int = BINS
) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    A row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited (to the edited text) and near_next (to the next document). A NULL text counts as
    empty. Rows that repeat id and text are one document in the order; rows with one id and
    different texts follow one another; rows without an id come first. A single document is
    followed by itself. An empty table gives an empty result.
    """
    rows = keyed(docs, id_column, text_column)
    pairs = edited_pairs(rows, _in_order(rows))
    sides = pairs.select(
        *KEYS,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), "text"),
                F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")),
            )
        ).alias("of"),
    ).select(*KEYS, "of.side", "of.text")
    drawn = fingerprints(sides, [*KEYS, "side"], bins)
    by_side = drawn.groupBy(*KEYS).agg(
        F.first(F.expr("CASE WHEN side = 0 THEN samples END"), ignorenulls=True).alias("own"),
        F.first(F.expr("CASE WHEN side = 1 THEN samples END"), ignorenulls=True).alias("changed"),
    )
    following = [f"next_{k}" for k in KEYS]
    plain = pairs.select(*KEYS, "n_chars", *following, F.sha2("edited", 256).alias("edited_sha256"))
    made = stored(plain.join(by_side, KEYS, "left"))
    prints = made.select(
        *(F.col(k).alias(f) for k, f in zip(KEYS, following)), F.col("own").alias("next")
    )
    # Each join has shuffles of its own, so that a key of many repeated rows may be split.
    return (
        rows.select("id", *KEYS)
        .join(made, KEYS)
        .join(prints, following)
        .select(
            F.col("id").alias(id_column),
            "n_chars",
            "edited_sha256",
            written("own").alias("fingerprint"),
            written("changed").alias("edited_fingerprint"),
            likeness("own", "changed").alias("near_edited"),
            likeness("own", "next").alias("near_next"),
        )
    )
