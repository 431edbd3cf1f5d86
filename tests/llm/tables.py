"""Small tables with awkward rows, and plain-Python models shared by the tests."""

import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHES = ["doc", "key", "size", "shard", "row", "cluster", "n", "kind", "spans", "copies", "slot", "x", "score", "_h", "old_shard", "taken"]


def sentence(seed, n):
    """``n`` words that hardly repeat."""
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 100_003}" for i in range(n))


def awkward():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    a, b, long = sentence(1, 60), sentence(2, 80), sentence(3, 30_000)
    return [
        (1, a, "en", "s1", 1),
        (2, a, "en", "s1", 1),
        (3, a + " tail words", "en", "s2", None),
        (4, None, "en", "s1", 0),
        (5, "", None, None, 0),
        (6, " \t\n ", "fr", "s2", 3),
        (7, long, "fr", "s1", 9),
        (8, long + " " + b, "fr", "s1", 9),
        (9, b, None, None, 5),
        (9, b, None, None, 5),
        (None, b, "en", "s2", 5),
        (None, None, None, None, None),
        (10, "one", "en", "s2", 3),
        (11, "ONE", "en", "s2", 3),
        (12, "one two", "en", "s2", 7),
        (13, "Éé ñ 中文 text " * 9, "fr", "s2", 7),
        (-5, b.upper(), "en", "s3", 7),
        (14, ("same line here\n" * 40), "en", "s3", 7),
    ]


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
