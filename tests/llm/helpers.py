"""Documents for small tests, and plain versions to compare with."""

import random
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def held_out(doc_id, parts, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == remainder


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_texts():
    return [
        (900, None),
        (901, ""),
        (902, " \t\n "),
        (903, "One"),
        (904, "one two three"),
        (905, "ONE two Three"),
        (906, "é ü 中文 word \x00 nul"),
        (907, "long " * 30_000),
        (908, "x" * 50_000),
    ]


def corpus(seed=1, n=60):
    """Base texts, copies, near copies, odd texts."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, sentence(rng, rng.randrange(5, 200))))
    for i in range(n, 2 * n):
        words = rows[rng.randrange(n)][1].split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    return rows + odd_texts()


def documents(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", "src", len(t or "")) for i, t in rows], SCHEMA
    ).repartition(5)
