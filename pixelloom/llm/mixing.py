"""Mixing sources to target weights.

A source's size is the number of words of its documents. Its target is a share by weight
of ``budget`` times all sizes, at most ``most`` times its own size, the excess going to the
other sources by weight. rate = target / size; a document is emitted floor(rate) times
and once more if a number drawn from the hash of its id, with a seed before it, lies below
the fraction.

Defined cases. Null text and text without words: size 0; such documents have the rate of
their source all the same. Null source: a source like any other, last in order. A null id
draws as an empty string does. Rows with the same id and source draw alike. An empty table
gives an empty result. Texts of any length are counted whole. Columns of the input that
are named like the operator's own (size, source_size, target, rate, copies, taken) are
replaced by ``mix``; all others go through, whatever their names. ``emitted`` returns the
input's columns as they were.

Scale. Words are counted once: the registered query saves (id, source, size), and what
``emitted`` returns depends on the sizes of sources alone. Sums per source are combined before the shuffle, so a source that holds
a third of all rows costs one row a task. Shares are settled by repeated one-row sums over
the table of sources, never by collecting it. That table is broadcast only if it has been
counted and is short; beyond that, the hot sources are salted.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, WORD, saved, unused

SALTS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = "") -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of seed and id."""
    head = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def with_rank(sources: DataFrame) -> DataFrame:
    """Number the sources from 0 by code point, null last.

    Ranges are numbered each by itself and then moved by what lies before them, so no
    task sees more than one range.
    """
    parts = 8
    cut = saved(sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-rank")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = cut.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return cut.withColumn("inside", F.row_number().over(inside) - 1).join(F.broadcast(moved), "part").select(F.col("source"), F.col("source_size"), (F.col("inside") + F.col("before")).alias("rank"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), budget: str = "3/2", most: int = 2) -> DataFrame:
    """From rows of (source, size): source, source_size, target, for each source.

    A source is held at ``most`` times its size if its share by weight would be above
    that. Which are held is decided in whole numbers, so the result doesn't depend on the
    order of sums.
    """
    share = Fraction(budget)
    if share > most:
        raise ValueError("the budget can't be met: it is more than every source at its most")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_rank(sources)
    at = F.pmod(F.col("rank"), F.lit(len(weights)))
    weight = F.coalesce(*[F.when(at == i, F.lit(int(w))) for i, w in enumerate(weights)]).cast("long")
    ranked = saved(ranked.withColumn("weight", weight), "mix-sources")
    top = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, all_weight = top[0] or 0, top[1] or 0
    # what the sources that aren't held share, times den, and their weights
    den = share.denominator
    left, weights_left = share.numerator * total, all_weight

    def held_at(left: int, weights_left: int) -> Column:
        return F.lit(left).cast("decimal(38,0)") * F.col("weight") > F.lit(most * den).cast("decimal(20,0)") * F.col("source_size") * F.lit(weights_left)

    while weights_left:
        now = ranked.filter(held_at(left, weights_left)).agg(F.sum("source_size"), F.sum("weight")).first()
        left_now, weights_now = share.numerator * total - most * den * (now[0] or 0), all_weight - (now[1] or 0)
        if (left_now, weights_now) == (left, weights_left):
            break
        left, weights_left = left_now, weights_now
    if weights_left:
        shared = (F.lit(left).cast("decimal(38,0)") * F.col("weight")).cast("double") / F.lit(float(den * weights_left))
        target = F.when(held_at(left, weights_left), (F.lit(most) * F.col("source_size")).cast("double")).otherwise(shared)
    else:
        target = (F.lit(most) * F.col("source_size")).cast("double")
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: Column | None = None, seed: str = "", **options) -> DataFrame:
    """Each row with size, source_size, target, rate, copies and taken = copies * size.

    ``size``: a column that has the number of words already, so that texts aren't read.
    ``seed``: another one draws other documents.
    """
    own = ("source_size", "target", "rate", "copies", "taken")
    docs = docs.withColumn("size", word_count(F.col("text")) if size is None else size).drop(*own)
    named = unused("mix_source", docs.columns)
    targets = saved(source_targets(docs.select("source", "size"), **options), "mix-targets").withColumnRenamed("source", named)
    few = targets.count() <= BROADCAST_ROWS
    rated = docs.join(F.broadcast(targets), docs["source"].eqNullSafe(targets[named]), "left") if few else salted(docs, targets, named)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    rated = rated.drop(named).withColumn("rate", rate)
    copies = (F.floor("rate") + F.when(draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")
    return rated.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def salted(docs: DataFrame, targets: DataFrame, named: str) -> DataFrame:
    """The same join for many sources: every source stands in SALTS places, so no task gets a hot one whole."""
    mine, theirs = unused("mix_salt", docs.columns), unused("mix_salt_of", docs.columns)
    left = docs.withColumn(mine, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    right = targets.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return left.join(right, left["source"].eqNullSafe(right[named]) & (left[mine] == right[theirs]), "left").drop(mine, theirs)


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    # a row in one column, so that no name of the input meets one of ours
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mix(rows, **options).withColumn("copy_no", F.explode(times)).select("row.*")
