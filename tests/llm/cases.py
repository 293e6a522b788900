"""Rows that every operator on documents must bear: nulls, empty and very long texts, ties, repeats, clashing columns."""

from pyspark.sql import functions as F

LONG = "Lorem ipsum dolor sit amet, " * 40_000  # 1.1 MB

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog " * 8, "en", "src0", 1),
    (2, "the quick brown fox jumps over the lazy dog " * 8, "en", "src0", 1),
    (2, "the quick brown fox jumps over the lazy dog " * 8, "en", "src0", 1),
    (3, None, None, None, None),
    (4, "", "fr", "src1", 0),
    (5, " \n\t\x0b\x0c\r ", "de", "src2", 7),
    (6, LONG, "en", "src0", len(LONG)),
    (None, "a text without an id, All Rights Reserved", "es", "", 3),
    (8, "È 😀 ü word   𝒳", "xx", "other9", 5),
    (9, "x" * 200_000, "en", "src3", 200_000),
]
CLASHES = ["n_words", "ids", "class", "component_id", "a", "b", "score", "_counts", "_row", "_copies", "bit", "row", "_gone", "kept"]


def documents(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def empty(spark):
    return documents(spark).where("1 = 0")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
