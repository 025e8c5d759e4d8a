"""What the operators share: input tables, tables written between steps, words, hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a task turns to arrays at a time; a longer text is taken alone.
SLICE_BYTES = 2_000_000
#: Bytes of a batch between the JVM and Python; a longer row is a batch alone.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the session's spark.checkpoint.dir.

    Only a session without that setting, as in tests, gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="loanlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/loanlens-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to a size of which a task can hold several."""
    spark.conf.set(*BATCH)


def sent(df: DataFrame, value: object) -> Broadcast:
    """A value of bounded size for every task that works on df."""
    bounded_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(value)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again.

    Cuts the lineage: what follows survives the loss of any executor without a recomputation
    of what led here. The files stay until the folder is cleared.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    folder = shared_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def with_field(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The schema with one more column."""
    return T.StructType([*df.schema, T.StructField(name, kind)])


def remainder(key: Column | str, modulus: int) -> Column:
    """crc32 of a key's text, modulo; NULL for a NULL key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches cut to about SLICE_BYTES of text each, never inside a row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + SLICE_BYTES, "right")))
            yield batch.slice(start, end - start)
            start = end
        # What the slice needed goes back to the system, not to a pool that only grows.
        pa.default_memory_pool().release_unused()


def split_words(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Non-empty words of a list column, and where each row's words begin (one more at the end)."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(full), before[ends]


def spaced_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, A-Z in lower case."""
    return split_words(pc.ascii_split_whitespace(pc.ascii_lower(texts)))


def mixed(values: np.ndarray) -> np.ndarray:
    """Each 64-bit value stirred, one to one."""
    values = (values ^ (values >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> U64(27))) * U64(0x94D049BB133111EB)
    return values ^ (values >> U64(31))


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash per word, computed once for each distinct one."""
    if not len(words):
        return np.empty(0, U64)
    coded = words.dictionary_encode()
    return hashed_each(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]


def hashed_each(words: pa.Array) -> np.ndarray:
    """A 64-bit hash per word, for words that are known to be distinct."""
    plain = words.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, plain), U64, len(plain))


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(keys):
        return np.empty(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])


def byte_map(texts: pa.Array, places: np.ndarray) -> pa.Array:
    """Each text with its UTF-8 bytes replaced by places[byte]; only ASCII may change. NULL: empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
    return pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(places[raw])
    )


def _alphanumeric() -> np.ndarray:
    places = np.arange(256, dtype=np.uint8)
    places[:128] = 32
    for first, last, to in ((48, 57, 48), (97, 122, 97), (65, 90, 97)):
        places[first : last + 1] = np.arange(last - first + 1) + to
    return places


ALPHANUMERIC = _alphanumeric()


def plain_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of ASCII letters, digits and anything beyond ASCII, A-Z in lower case."""
    return split_words(pc.ascii_split_whitespace(byte_map(texts, ALPHANUMERIC)))
