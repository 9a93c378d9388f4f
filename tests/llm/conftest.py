import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns of clashing names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9)))
    long = " ".join(word() for _ in range(60_000))
    same = " ".join(word() for _ in range(40))
    rows = [(None, None, None, None), (1, "", "en", "s"), (2, " \t\n ", None, "s"), (3, "One", "en", None),
            (4, long, "de", "s"), (5, same, "en", "s"), (6, same.upper().replace("É", "é"), "en", "t"),
            (7, same, "fr", "t"), (7, same, "fr", "t"), (8, "." * 3000, "en", "u"), (9, "é", "fr", "t"),
            (10, "a b c", "en", "u"), (11, "a b c d", "en", "u"), (None, same, None, None), (12, None, "en", "s")]
    frame = spark.createDataFrame(
        [(i, t, la, s, len(t) if t is not None else None) for i, t, la, s in rows], SCHEMA)
    from pyspark.sql import functions as F
    for name in ("key", "name", "size", "taken", "digest", "row", "score", "length", "documents", "value", "sig", "part"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
