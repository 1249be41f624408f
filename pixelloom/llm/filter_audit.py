"""How filters interact: every order of them, run over a trie of permutations.

Filters that each remove documents are applied in every order. A trie of all orders has an
edge for each filter applied after a prefix; what survives a prefix depends on its set of
filters alone, so the trie is walked depth first, each set's survivors are saved once, and
every other prefix of the same set shares them. At each edge the documents are counted that
the next filter really removes from those survivors. From the counts follow, for each order
and step, what is kept, removed and redundant, and each filter's Shapley sum.

The filters of ``failures``, over whole texts (words are runs of anything but ASCII white
space): A under 200 words; B fewer than half the words distinct; C more than 2 of 100 code
points are A-Z; D holds one of ``#$%&*|``; E identical to the text of a smaller doc_id.

Defined cases. Null text is an empty text, and all of those are identical. Null doc_id: not
a copy, and none is a copy of it; no label. Rows of equal id and text are no copies of each
other. Null source: the part ''. Of several labels of one id the largest counts; null ones
don't. Texts of any length are read whole. Other columns are left out, whatever their
names. An empty table gives an empty result.

Scale. Texts are read once, in Arrow batches, into a few bytes a row, and never shuffled.
Copies are found by their SHA-256, combined before the shuffle; digests and ids that hold
many rows are joined apart. With n filters there are 2^n sets: each step reads only what
survived the step before, and one shuffle of sums, combined before, ends all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import even_join, saved, utf8
from .token_counts import blocks

FILTERS = "ABCDE"
UPPER, SIGNS, CONTINUED = bytes(range(65, 91)), b"#$%&*|", bytes(range(128, 192))


def without(text: bytes, signs: bytes) -> int:
    """The number of bytes that aren't among ``signs``."""
    return len(text.translate(None, signs))


def own_failures(text: bytes) -> int:
    """Bits 0 to 3: what a text fails by itself, A to D."""
    words = text.split()
    few = len(words) < 200
    dull = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * (len(text) - without(text, UPPER)) > 2 * without(text, CONTINUED)
    signs = without(text, SIGNS) < len(text)
    return few | dull << 1 | loud << 2 | signs << 3


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, failed (bits in the order of FILTERS) of each row, saved."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(map(own_failures, texts), pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], ["key", "failed", "digest"])

    key = F.struct("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    rows = docs.select(key.alias("key"), utf8(F.col("text")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    read = saved(rows.mapInArrow(scan, f"key {kind}, failed int, digest binary").select("key.*", "failed", "digest"), "audit-texts")
    copies = read.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    found = even_join(read, saved(copies, "audit-copies"), "digest", "left")
    copied = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).cast("int")
    return saved(found.select("doc_id", "part", F.col("failed").bitwiseOR(F.shiftleft(copied, 4)).alias("failed")), "audit-failures")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Saved rows with good and toxic (0 or 1) of their ids."""
    marks = {"good": "quality", "toxic": "toxic"}
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(n) for n, c in marks.items()])
    return even_join(rows, known, "doc_id", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in marks})


def bit(c: Column, k: int | Column) -> Column:
    return F.getbit(c, F.lit(k) if isinstance(k, int) else k).cast("long")


def survivors(rows: DataFrame, n: int) -> DataFrame:
    """The rows that each set of filters (``prefix``, in bits) leaves, but for the set of all."""
    found: dict[int, DataFrame] = {}

    def visit(prefix: int, left: DataFrame) -> None:
        found[prefix] = left
        for k in range(n):
            after = prefix | 1 << k
            if after != prefix and after not in found and after != (1 << n) - 1:
                visit(after, saved(left.filter(bit(F.col("failed"), k) == 0), f"audit-{after}"))

    visit(0, saved(rows.select("part", "failed", "good", "toxic"), "audit-0"))
    every = None
    for prefix, left in found.items():
        one = left.withColumn("prefix", F.lit(prefix))
        every = one if every is None else every.unionByName(one)
    return every


def edges(rows: DataFrame, n: int) -> DataFrame:
    """part, prefix, filter (its number) and the counts of every edge, zeros too, of rows (part, failed, good, toxic)."""
    sums = [F.count("*").alias("n")]
    for k in range(n):
        failed = bit(F.col("failed"), k)
        sums += [F.sum(failed).alias(f"removed{k}"), F.sum(failed * F.col("good")).alias(f"good{k}"), F.sum(failed * F.col("toxic")).alias(f"toxic{k}"), F.sum((F.col("failed") == 1 << k).cast("long")).alias(f"only{k}")]
    counted = survivors(rows, n).groupBy("part", "prefix").agg(*sums)
    state = F.struct("n", *[F.array(*[f"{c}{k}" for k in range(n)]).alias(c) for c in ("removed", "good", "toxic", "only")])
    states = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("prefix", state))).alias("states"))
    prefixes = F.sequence(F.lit(0), F.lit((1 << n) - 2))
    rows = states.withColumn("prefix", F.explode(prefixes))
    rows = rows.withColumn("filter", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.getbit("prefix", k) == 0)))

    def at(prefix: Column, count: str) -> Column:
        return F.coalesce(F.get(F.element_at("states", prefix)[count], F.col("filter")), F.lit(0).cast("long"))

    # the number of orders in which a set of that size stands before the filter
    orders = F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)])
    without_it = F.filter(prefixes, lambda p: F.getbit(p, F.col("filter")) == 0)
    removed, root = at(F.col("prefix"), "removed"), F.lit(0)
    return rows.select(
        "part",
        "prefix",
        "filter",
        (F.coalesce(F.element_at("states", F.col("prefix"))["n"], F.lit(0).cast("long")) - removed).alias("kept"),
        removed.alias("removed"),
        (at(root, "removed") - removed).alias("redundant"),
        at(root, "only").alias("unique_fails"),
        at(F.col("prefix"), "good").alias("good_lost"),
        at(F.col("prefix"), "toxic").alias("toxic_lost"),
        F.aggregate(without_it, F.lit(0).cast("long"), lambda s, p: s + at(p, "removed") * F.get(orders, F.bit_count(p))).alias("shapley"),
    )


def audit(rows: DataFrame, names: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of every step of every order, of rows (part, failed, good, toxic)."""
    steps = [("".join(order), k + 1, sum(1 << names.index(f) for f in order[:k]), names.index(f)) for order in permutations(names) for k, f in enumerate(order)]
    orders = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, prefix int, filter int")
    found = edges(rows, len(names)).join(F.broadcast(orders), ["prefix", "filter"])
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
