"""Documents with everything that is awkward, and plain versions of the operators to compare with."""

import hashlib
import re
import zlib

ODD = [
    (1, "Plain words and then some more plain words", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, "   \t\n ", "de"),
    (5, "Plain  words\tand then some more plain words", "en"),
    (6, "plain words and then some more plain words!", "en"),
    (7, "é à ü 😀 ñ", "fr"),
    (8, "Plain words and then some more plain words", "en"),
    (8, "Plain words and then some more plain words", "en"),
    (9, "word " * 30_000, "en"),
    (10, "x" * 60_000, None),
    (None, "a row without an id", "en"),
    (None, "a row without an id", "en"),
    (11, "one", "en"),
    (12, "one two", "en"),
    (13, "<|endoftext|> a<|endoftext|>b I'll 12½", "en"),
]


def odd(spark, extra=True):
    schema = "doc_id long, text string, lang string"
    rows = ODD
    if extra:  # further columns that are named like results
        schema += ", score double, size long, shard int, spans string, row long, key long, fp long, kept boolean, start int"
        rows = [(*r, 0.5, 1, 2, "s", 3, 4, 5, True, 6) for r in ODD]
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def remainder(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus
