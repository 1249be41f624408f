import random

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns that clash."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "délta", "x", "epsilon,", "zeta.", "eta", "42", "naïve"]
    rows = [(1, None, "en", "a", 0), (2, "", None, "b", 0), (3, " \n\t", "en", None, 3), (None, "one two three", "en", "a", 13), (None, "one two three", "en", "a", 13), (4, "same words here now", "en", "a", 19), (4, "same words here now", "en", "a", 19), (4, "other text under one id", "de", "b", None)]
    rows += [(10 + k, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 9))), "en", rng.choice(["a", "b", "c", None]), 1) for k in range(60)]
    rows += [(100 + k, rows[10 + k % 7][1], "en", "c", 1) for k in range(20)]
    rows += [(200, " ".join(rng.choice(words) for _ in range(30_000)), "en", "a", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
