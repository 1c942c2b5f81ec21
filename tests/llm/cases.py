"""Small tables with the awkward cases: nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    *(T.StructField(c, T.StringType()) for c in ("row", "rid", "cid", "kept", "score", "_doc", "_kept", "digest", "root", "block", "y", "n_lines", "secret_spans"))])


def words(rng, n, size=5000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def odd_rows():
    """(doc_id, text): the awkward ones."""
    rng = random.Random(5)
    long = "\n".join(words(rng, 40) for _ in range(1500))  # about 350,000 characters
    prose = words(rng, 60)
    return [
        (1, prose), (2, None), (3, ""), (4, " \t\n "), (5, long), (6, long + "\nand one more line at the end of it"),
        (7, prose), (7, prose), (8, prose.upper()), (None, prose), (None, None), (9, "one two"), (10, "one two"), (11, "x"),
        (12, "日本語 text 🙂 é́"), (13, "a\r\nb\r\nc"), (14, "line\n\n\nline\nline"), (15, "▁ mark"), (7, "another text of seven")]


def table(spark, rows):
    filled = [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else "src0", None if t is None else len(t), *(["clash"] * 13)) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(filled, DOCUMENTS)


def odd(spark):
    return table(spark, odd_rows())


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
