"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

LONG = "one two three four five six seven eight nine ten " * 30_000
PLAIN = "the cat and the dog went to the park and then they came home again to eat in the house"

DOCS = [
    (1, PLAIN, "en", "a", 10), (1, PLAIN, "en", "a", 10), (2, PLAIN.upper(), "en", "a", 10),
    (3, None, None, None, None), (None, PLAIN, "en", "b", 5), (None, None, None, None, None),
    (4, "", "en", "b", 0), (5, " \n\t ", "en", "b", 4), (6, LONG, "en", "c", len(LONG)),
    (7, "word", "de", "c", 4), (8, "word", "de", "c", 4), (9, "über ŝ ſecret K", "de", "c", 4),
]
CLASH = ("score", "kept", "n_words", "spans", "items", "row", "own", "pattern", "n", "key", "word", "cluster", "text2")


def odd_docs(spark, extra=True):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH if extra else ():
        df = df.withColumn(c, F.lit(f"mine-{c}"))
    return df


def no_docs(spark):
    return odd_docs(spark).limit(0)
