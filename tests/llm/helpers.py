"""Small tables with every awkward row: nulls, blanks, long texts, ties, repeats, clashing names."""

import random
import zlib

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over lazy dogs while seven wizards box with liquid jugs of rare quartz and vex nobody".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ly", str(r.randint(0, 99))]) for _ in range(n))


def edge_docs(spark):
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 120), "en", "a", 1), (2, prose(2, 120), "en", "a", 1), (2, prose(2, 120), "en", "a", 1),
        (3, None, None, None, None), (None, prose(3, 80), None, "b", 2), (None, prose(3, 80), None, "b", 2),
        (4, "", "en", "", 0), (5, " \t\n\x0b\x0c\r ", "xx", "b", 7), (6, long, "de", "b", len(long)),
        (7, "one", "fr", "c", 3), (8, "one two", "fr", "c", 7), (9, "ÀÉ日本語 😀 \\ <|im_end|> <|endoftext|>", "ja", "c", 3),
        (-5, prose(4, 60) + "\n" + prose(4, 60), "en", "c", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


def with_clashes(docs):
    """The same rows with columns named like those that operators compute."""
    names = ("score", "fp", "kept", "hits", "row", "verdict", "n_words", "w", "n_tokens", "weights", "component_id", "id", "a", "h", "grams")
    return docs.select("*", *[F.lit(7).alias(n) for n in names])


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % n
