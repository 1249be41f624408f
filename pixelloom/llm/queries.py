"""The registered queries: each applies its operator to a whole table and returns what its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .common import saved, table
from .credentials import count_of, find_secrets, listed
from .decontaminate import find
from .filter_audit import audit, failures, with_labels
from .line_dedup import line_dedup
from .manifest import folded, leaves_of, proven
from .media import texts_as_media
from .mixing import mix, word_count
from .quality import held_out, ranked
from .simhash import near_duplicates
from .token_counts import token_counts
from .token_records import token_records
from .toxicity import learn, severity
from .warc import archive


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents`` mixed by 3, 1, 2 to 150% of its words."""
    docs = table(spark, sf_dir, "documents")
    sizes = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return mix(sizes, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of lines that repeat anywhere in ``documents``, removed but for the first."""
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_kept", "n_removed", F.md5("text").alias("kept_md5"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the best unigram split of every document, over the ranks of a public vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, in segments and revisits, and read back."""
    found = archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image that an HTML document refers to, resolved and read back."""
    found = texts_as_media(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("size").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")


def op6_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from pairs of labelled ones that aren't held out."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word SimHash of every document, linked at 4 differing bits or fewer."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, windows of 10 words."""
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity, learned from the labelled ones that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))
    return severity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p_toxic", "p_severe", "severity", "toxic")


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as checked records in order of doc_id, and read back."""
    index = token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: those that tell alone, and parts that tell together."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.col("base")
    return found.select(
        "doc_id",
        *[count_of(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof under the root, and what the root would be had some texts lost their line ends."""
    found = proven(leaves_of(table(spark, sf_dir, "documents")))
    siblings = F.array_join(F.transform("proof", lambda step: F.concat(step["left"], step["right"])), "")
    rows = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over every document in all 120 orders, counted by source, order and step."""
    return audit(with_labels(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_line_dedup": op2_line_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_warc": op4_warc,
        "op5_media_columns": op5_media_columns,
        "op6_quality_ranking": op6_quality_ranking,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_decontaminate": op8_decontaminate,
        "op9_toxicity": op9_toxicity,
        "op10_token_records": op10_token_records,
        "op11_secret_scan": op11_secret_scan,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_filter_audit": op13_filter_audit,
    }
