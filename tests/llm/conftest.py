import pytest


@pytest.fixture(scope="session")
def docs_rows():
    """Awkward documents: nulls, empty and long texts, ties, repeated rows."""
    base = " ".join(f"word{i}" for i in range(60))
    near = base.replace("word7 ", "other ")
    return [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, near, "en", None, 1), (4, None, "en", "b", None),
            (5, "", None, "b", 0), (6, " \t\n", "en", "b", 3), (7, "One two", "en", "b", 7), (8, "one TWO", "en", None, 7),
            (None, base, "en", "a", 1), (9, "x " * 30_000, "en", "c", 60_000), (10, "mail me at joe.doe@mail.example.com now", "en", "c", 1),
            (11, "a" * 120_000, "en", "c", 1)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F
    names = ["size", "score", "spans", "found", "held_out", "predicted", "draws", "target", "source_size", "label", "sig", "n", "row", "block", "h"]
    return docs.select("*", *[F.lit(3).alias(c) for c in names])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 12)] + [(3, None, 1), (None, 1, 1), (5, 0, 1)],
                                 "doc_id long, quality int, toxic int")
