"""Extra columns, with names that the operators use inside, change nothing."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import decontaminate, media, quality, simhash, token_counts, token_records, toxicity, warc

NAMES = ["size", "key", "name", "fp", "root", "spans", "items", "n_words", "features", "score", "held_out", "toxic", "severity", "html", "digest", "stored", "pos", "parts", "row", "file", "start", "tie", "place", "frame", "simhash_row", "others", "proposing", "n_shingles", "w0", "text_", "hash"]
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def few(spark, docs):
    """A part of the documents, with labels and items of a benchmark."""
    rows = docs.filter("doc_id is null or doc_id < 30")
    labels = spark.createDataFrame([(10 + k, k % 2, int(k % 3 == 0)) for k in range(20)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, "alpha gamma"), (2, "one two three")], "item_id bigint, text string")
    return rows, labels, items


OPERATORS = {
    "token_counts": lambda d, labels, items: token_counts.token_counts(d, public_tokenizers.path("byte_bpe_50k.tiktoken")),
    "decontaminate.find": lambda d, labels, items: decontaminate.find(d, items),
    "quality": lambda d, labels, items: quality.ranked(d, labels),
    "toxicity": lambda d, labels, items: toxicity.severity(d, toxicity.learn(d, labels)),
    "media": lambda d, labels, items: media.texts_as_media(d).drop("media_sha256"),
    "simhash": lambda d, labels, items: simhash.near_duplicates(d),
    "token_records": lambda d, labels, items: token_records.token_records(d, BPE).drop("file"),
}
FILTERS = {
    "decontaminate": lambda d, labels, items: decontaminate.decontaminate(d, items),
    "toxic_removed": lambda d, labels, items: toxicity.toxic_removed(d, labels),
    "near_duplicates_removed": lambda d, labels, items: simhash.near_duplicates_removed(d, shingle=5, similarity=0.8),
}


def clashing(docs):
    return docs.withColumns({n: F.concat_ws("/", F.lit(n), F.col("doc_id")) for n in NAMES})


@pytest.mark.parametrize("name", OPERATORS)
def test_results_are_the_same(few, name):
    docs, *others = few
    want, got = OPERATORS[name](docs, *others), OPERATORS[name](clashing(docs), *others)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", FILTERS)
def test_columns_go_through(few, name):
    docs, *others = few
    there = clashing(docs)
    want, got = FILTERS[name](docs, *others), FILTERS[name](there, *others)
    assert got.columns == there.columns
    assert sorted(map(str, got.select(docs.columns).collect())) == sorted(map(str, want.collect()))
    assert {str(r) for r in got.collect()} <= {str(r) for r in there.collect()}


def test_pages_with_other_columns(spark):
    pages = spark.createDataFrame([(k, "u", "x" * 1500 if k < 3 else f"p{k}") for k in range(6)], "page_id bigint, url string, html string")
    clash = pages.withColumns({n: F.lit("z") for n in ("payload", "mark", "original", "record", "about", "digest", "block", "number", "n")})
    assert sorted(map(str, warc.archive(clash).collect())) == sorted(map(str, warc.archive(pages).collect()))
