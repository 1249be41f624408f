"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade >= k) is the logistic function of w.x - t[k] with one w for all k and thresholds
that rise; the expected severity is the sum of these chances. x is sparse: which of the
chosen strings occur in the text, whatever their number. Strings are whole words and the
4-, 5- and 6-character pieces of words (the space before and after a word is a character
of it), so unseen forms of a known stem count.

Grades are those of ``labels.toxic``, 0 and up. Where it has 0 and 1 alone, grades are
weak ones: 2 is a toxic text with more telling words, repeats counted, than the median of
toxic texts. The model doesn't see these numbers, only which strings occur, but both come
from the same words: the second threshold shows how much, not how bad.

The strings, weights and thresholds are learned from at most SAMPLE labelled rows, the
first by hash of doc_id: the one documented bound. A string is chosen if its odds are over
LEAST_ODDS and its likelihood ratio is over CHANCE times the logarithm of the number of
strings, so that chance makes few of them. How many are chosen has no limit. Scores cover
all documents and whole texts.

Defined cases. Null and empty texts have no features. Null labels are passed over; of
several labels of one id the largest counts, of several documents the smallest text.
Without labels of both kinds nothing is toxic and every severity is 0; an empty table gives
an empty result. Repeated rows stay. ``severity`` leaves other columns out,
``toxic_removed`` passes all through, whatever their names. Texts of any length are
scanned in one pass.

Scale. Documents are scored where they are read, by one automaton of all strings; nothing
is shuffled but counts of the sample's strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, saved, scratch, utf8
from .decontaminate import FOLD, mixed
from .token_counts import blocks

SAMPLE = 12_000
#: Cells that strings are hashed to when they are first counted; what is chosen is counted again by itself.
CELLS = 1 << 22
#: Documents that must have a string, and log-odds that make it a feature, and telling.
SUPPORT, LEAST_ODDS, TELLING = 4, 1.0, 2.5
#: Times the logarithm of the number of strings: the likelihood ratio that a feature needs.
CHANCE = 1.4
THRESHOLD = 0.5
GRAMS = (4, 5, 6)
#: Characters that are hashed at once.
PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15
#: Powers of BASE and of its inverse, modulo 2^64, for a piece.
POWERS = tuple(np.cumprod(np.array([1] + [b] * (PIECE + 1), np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64)))


def folded(text: bytes | None) -> str:
    """A-Z in lower case, spaces for all that is no word, and at both ends."""
    return f" {(text or b'').translate(FOLD).decode('utf-8', 'replace')} "


def pieces(text: str) -> Iterator[str]:
    """A folded text in parts of at most PIECE characters that begin and end with a space; a longer word is cut."""
    at = 0
    while at < len(text) - 1:
        end = min(len(text), at + PIECE)
        cut = end if end == len(text) else text.rfind(" ", at + 1, end) + 1 or end
        yield text[at:cut]
        at = cut - 1 if text[cut - 1] == " " else cut


def strings(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, begin and end of each string of a piece: pieces of words, and whole words that are longer."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * POWERS[0][: len(code)])))
    space = code == 32
    spaces = np.concatenate(([0], np.cumsum(space)))
    begins, ends = [], []
    for n in GRAMS:
        if len(code) >= n:
            i = np.arange(len(code) - n + 1)
            i = i[spaces[i + n - 1] == spaces[i + 1]]  # no space inside
            begins.append(i)
            ends.append(i + n)
    gap = np.flatnonzero(space)
    long = np.diff(gap) + 1 > GRAMS[-1]
    begin, end = np.concatenate([*begins, gap[:-1][long]]), np.concatenate([*ends, gap[1:][long] + 1])
    return mixed((sums[end] - sums[begin]) * POWERS[1][begin]) >> np.uint64(42), begin, end


class Severity:
    """The learned model: strings, their weights, thresholds, which strings are telling."""

    def __init__(self, features: list[str], telling: set[int]):
        self.features, self.telling, self.token = features, telling, uuid.uuid4().hex
        self.weights, self.thresholds = np.zeros(len(features)), np.full(2, np.inf)

    def automaton(self) -> ahocorasick.Automaton | None:
        def made() -> ahocorasick.Automaton | None:
            found = ahocorasick.Automaton()
            for k, s in enumerate(self.features):
                found.add_word(s, k)
            found.make_automaton()
            return found if self.features else None

        return kept(("severity", self.token), made)

    def sparse(self, text: bytes | None) -> tuple[list[int], int]:
        """The features that occur, and the number of telling words, repeats counted."""
        automaton, plain = self.automaton(), folded(text)
        if automaton is None:
            return [], 0
        found, words = set(), set()
        for end, k in automaton.iter(plain):
            found.add(k)
            if k in self.telling:
                words.add(plain.rfind(" ", 0, end))
        return sorted(found), len(words)

    def fit(self, rows: list[list[int]], grade: np.ndarray, rounds: int = 400, shrink: float = 5e-4) -> None:
        """Cumulative-link likelihood with shrinkage, by accelerated gradient steps. rows: the features of each text.

        Toxic and other rows weigh the same in sum, so 0.5 is a fair threshold for rare grades too.
        """
        n, d, most = len(rows), len(self.features), int(grade.max())
        row, column = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate([np.array(r, np.int64) for r in rows])
        weight = np.where(grade > 0, n / (2 * max(1, (grade > 0).sum())), n / (2 * max(1, (grade == 0).sum()))) / n
        w, t = np.zeros(d), np.arange(1.0, most + 1)
        m, v = np.zeros(d + most), np.zeros(d + most)
        for step in range(1, rounds + 1):
            gradient = self.gradient(w, t, row, column, grade, weight, shrink)
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, t = w + move[:d], np.maximum.accumulate(t + move[d:] - 1e-3 * np.arange(most)) + 1e-3 * np.arange(most)
        self.weights, self.thresholds = w, t

    @staticmethod
    def gradient(w: np.ndarray, t: np.ndarray, row: np.ndarray, column: np.ndarray, grade: np.ndarray, weight: np.ndarray, shrink: float) -> np.ndarray:
        """Of the weighted log likelihood, less shrink / 2 times the squares of w, by w and t."""
        n = len(grade)
        strength = np.bincount(row, w[column], n)
        # p[k]: P(grade >= k), from k = 0, where it is 1, to one over the most, where it is 0
        p = np.concatenate([np.ones((1, n)), 1 / (1 + np.exp(-np.clip(strength[None, :] - t[:, None], -30, 30))), np.zeros((1, n))])
        own, above = p[grade, np.arange(n)], p[grade + 1, np.arange(n)]
        by_strength = (1 - own - above) * weight
        gap, slope = np.maximum(own - above, 1e-9), p * (1 - p)
        by_t = [(np.where(grade == k - 1, slope[k], np.where(grade == k, -slope[k], 0)) / gap * weight).sum() for k in range(1, len(t) + 1)]
        return np.concatenate([np.bincount(column, by_strength[row], len(w)) - shrink * w, by_t])

    def chances(self, texts: list[bytes | None]) -> np.ndarray:
        """P(grade >= k) of each text, a column for each k from 1 on."""
        s = np.array([self.weights[self.sparse(t)[0]].sum() for t in texts])
        with np.errstate(over="ignore"):  # an endless threshold is chance 0
            return 1 / (1 + np.exp(self.thresholds[None, :] - s.reshape(-1, 1)))


def one_sided(toxic: np.ndarray, clean: np.ndarray, bad: int, good: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of strings by the documents that have them, and twice the log of the likelihood ratio."""
    odds = np.log((toxic + 0.5) / (bad + 1)) - np.log((clean + 0.5) / (good + 1))
    n, share = toxic + clean, bad / (bad + good)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (n * share)), 0) + np.where(clean > 0, clean * np.log(clean / (n * (1 - share))), 0))
    return odds, ratio


def chosen_strings(rows: DataFrame, bad: int, good: int) -> tuple[list[str], set[int]]:
    """The strings of rows (toxic, text) that are features, and the places of the telling ones."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, CELLS), np.int32)
        for flags, texts in blocks(batches):
            for toxic, text in zip(flags.to_pylist(), texts, strict=True):
                cells = [np.unique(strings(p)[0]) for p in pieces(folded(text))]
                counts[int(toxic > 0), np.unique(np.concatenate(cells)).astype(np.int64)] += 1
        some = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some].astype(np.int64)), pa.array(counts[1, some].astype(np.int64))], ["cell", "clean", "toxic"])

    sums = [F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")]
    counted = saved(rows.mapInArrow(count, "cell bigint, clean bigint, toxic bigint").groupBy("cell").agg(*sums).filter(F.col("toxic") + F.col("clean") >= SUPPORT), "toxicity-cells")
    least = CHANCE * np.log(max(counted.count(), 1))
    # a cell of few texts or none that are toxic can't hold a chosen string
    held = counted.filter(F.log((F.col("toxic") + 0.5) / F.lit(bad + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(good + 1.0)) > LEAST_ODDS - 1).filter("toxic > 1").toPandas()
    odds, ratio = one_sided(held["toxic"].to_numpy(float), held["clean"].to_numpy(float), bad, good)
    wanted = np.zeros(CELLS, bool)
    wanted[held["cell"].to_numpy()[(odds > LEAST_ODDS) & (ratio > least)]] = True
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for flags, texts in blocks(batches):
            for toxic, text in zip(flags.to_pylist(), texts, strict=True):
                mine = set()
                for p in pieces(folded(text)):
                    cell, begin, end = strings(p)
                    at = np.flatnonzero(shared.value[cell.astype(np.int64)])
                    mine.update(p[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True))
                for s in mine:
                    found.setdefault(s, [0, 0])[int(toxic > 0)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *[pa.array([c[k] for c in found.values()], pa.int64()) for k in (0, 1)]], ["string", "clean", "toxic"])

    spelt = rows.mapInArrow(spell, "string string, clean bigint, toxic bigint").groupBy("string").agg(*sums).filter(F.col("toxic") + F.col("clean") >= SUPPORT).toPandas().sort_values("string")
    odds, ratio = one_sided(spelt["toxic"].to_numpy(float), spelt["clean"].to_numpy(float), bad, good)
    best = (odds > LEAST_ODDS) & (ratio > least)
    return spelt["string"][best].tolist(), set(np.flatnonzero(odds[best] > TELLING).tolist())


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Severity:
    """The model of at most ``sample`` labelled rows."""
    with scratch():  # the model is all that is left
        return learned(docs, labels, sample)


def learned(docs: DataFrame, labels: DataFrame, sample: int) -> Severity:
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    rows = saved(found.select(F.greatest("toxic", F.lit(0)).cast("int").alias("toxic"), utf8(F.col("text")).alias("text")), "toxicity-sample")
    totals = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = sum(n for k, n in totals.items() if k > 0), totals.get(0, 0)
    if not bad or not good:
        return Severity([], set())
    model = Severity(*chosen_strings(rows, bad, good))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vector(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flags, texts in blocks(batches):
            found = [shared.value.sparse(t) for t in texts]
            yield pa.RecordBatch.from_arrays([flags, pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.int64())], ["toxic", "places", "telling"])

    # at most ``sample`` rows, in an order that no partitioning changes
    sparse = sorted((r.toxic, r.telling, r.places) for r in rows.mapInArrow(vector, "toxic int, places array<int>, telling bigint").collect())
    grade, telling = np.array([r[0] for r in sparse]), np.array([r[1] for r in sparse])
    if grade.max() == 1:
        grade = grade + ((grade == 1) & (telling > np.median(telling[grade == 1])))
    model.fit([r[2] for r in sparse], grade)
    return model


def severity(docs: DataFrame, model: Severity, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_toxic (of grade 1 or more), p_severe (of the highest grade), severity (expected grade), toxic of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            p = shared.value.chances(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(p[:, 0]), pa.array(p[:, -1]), pa.array(p.sum(1))], ["doc_id", "p_toxic", "p_severe", "severity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(scan, f"doc_id {kind}, p_toxic double, p_severe double, severity double")
    return found.withColumn("toxic", F.col("p_toxic") >= threshold)


def toxic_by(shared: Broadcast, threshold: float) -> Callable:
    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.chances(texts.tolist())[:, 0] >= threshold, dtype=bool)

    return toxic


def toxic_removed(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without the rows that the model finds toxic."""
    toxic = toxic_by(docs.sparkSession.sparkContext.broadcast(learn(docs, labels, **options)), threshold)
    return docs.filter(~toxic(utf8(F.col("text"))))
