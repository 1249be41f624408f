"""The corpus pipeline: documents through five operators, each step saved before the next.

Counted as part of ``pixelloom.llm``. Every stage takes (spark, docs, sf_dir) and returns
a DataFrame; all but the last return the columns of ``documents``.

Defined cases, for every stage: any column may be null and ids may repeat, rows are told
apart as rows. Null and empty texts aren't toxic and hold no benchmark window; all of them
are near-duplicates of each other, so one stays, and its record is the end id alone. Texts
are taken whole, whatever their length. Repeated rows are near-duplicates; those that the
mix makes again stay. Other columns than those of ``documents`` go in the first stage,
whatever their names. Empty tables give an empty result; without labels of both kinds no
document is toxic, and without benchmark items none is contaminated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm.common import saved, table
from pixelloom.llm.decontaminate import decontaminate
from pixelloom.llm.mixing import emitted
from pixelloom.llm.simhash import near_duplicates_removed
from pixelloom.llm.token_records import token_records
from pixelloom.llm.toxicity import toxic_removed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model finds toxic go."""
    return toxic_removed(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links stays, that with the smallest id.

    Links stand for a similarity of 0.8 or more of 5-word shingles.
    """
    return near_duplicates_removed(docs, shingle=5, similarity=0.8).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weights 3, 1, 2 to 150% of all words, documents repeated as their rates say."""
    return emitted(docs.select(*COLUMNS))


def write_token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as checked records in order of doc_id, with the index that is returned."""
    return token_records(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token records", write_token_records),
]

#: SQL can't express the learned model of the first stage; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
