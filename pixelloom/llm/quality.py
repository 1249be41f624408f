"""Quality by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text. From labelled documents, pairs of
a better (label 1) and a worse one (label 0) are drawn; the weights minimise the logistic
loss of the pairs on the differences of their features. The cut is a quantile of the
strengths of the labelled documents, at their share of label 0; a score is the logistic
function of the strength, shifted so that the cut scores CUT.

The labelled rows learned from are at most SAMPLE, the first by hash of doc_id, and the
pairs at most PAIRS; both are parameters. Everything scored is the whole text.

Defined cases. Null and empty texts have the features of a text without bytes, and a
score. Null labels are passed over; of several labels of one id the largest counts, of
several documents the smallest features.
Without labels of both kinds, every score is 0.5. Equal texts have equal scores, texts of
any length are read whole. Repeated rows stay, null ids too. Other columns are left out,
whatever their names. An empty table gives an empty result.

Scale. Texts are read once: features (float32) are saved, then joined with the sampled
ids, a bounded and broadcast table, to learn, and read again to score. No shuffle of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, utf8
from .token_counts import blocks

SAMPLE, PAIRS, CUT = 16_000, 60_000, 0.7
#: Groups of bytes: upper case, lower case, digits, white space, sentence marks, quotes and brackets, other signs, non-ASCII.
GROUPS = np.array([0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 if b in b" \t\n\r\x0b\x0c" else 4 if b in b".,;:-" else 5 if b in b"'\"()" else 6 if b < 128 else 7 for b in range(256)])
SIGNS = b"!?#$%&*|+=/<>[]{}@_~^\\"
DOTTED = re.compile(rb"\d{1,3}\.\d{1,3}\.\d{1,3}|@\w+\.|https?://|[0-9a-f]{16}|\d{9}")


def features(text: bytes) -> list[float]:
    """Shares of bytes and words, lengths, repetition."""
    n = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = np.bincount(GROUPS, weights=counts, minlength=8) / n
    words, lines = text.split(), text.split(b"\n")
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    distinct = len(set(words)) / m
    upper = sum(map(bytes.isupper, words)) / m
    repeated = 1 - len(set(lines)) / len(lines)
    bare = sum(map(bytes.isalnum, words)) / m
    spread = counts[counts > 0] / n
    return [
        *shares,
        *(counts[list(SIGNS)] / n),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        np.log1p(m / len(lines)),
        lengths.mean() if len(words) else 0,
        lengths.std() if len(words) else 0,
        np.log1p(lengths.max(initial=0)),
        float((lengths <= 3).mean()) if len(words) else 0,
        distinct,
        distinct * np.log1p(m),
        upper,
        float(upper > 0.3),
        repeated,
        float(repeated > 0.3),
        bare,
        float(len(words) < 20),
        np.log1p(len(DOTTED.findall(text))),
        float(-(spread * np.log(spread)).sum()),
        sum(w in (b"|", b"-", b"*") for w in words) / m,
        min(1.0, 100 * counts[list(b"#$%&*")].sum() / n),
    ]


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, features (array of float) of each row."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([features(t) for t in texts], pa.list_(pa.float32()))], ["doc_id", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(scan, f"doc_id {kind}, features array<float>")


class Ranking:
    """Weights, the cut, and the scale of strengths."""

    def __init__(self, x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, cut: float = CUT, seed: int = 7):
        self.cut, self.weights = cut, None
        good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        if not len(good) or not len(bad):
            return
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self.standard(x)
        rng = np.random.default_rng(seed)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        w = np.zeros(d.shape[1])
        for _ in range(25):  # Newton's method with a little shrinkage
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # how surprising each pair is
            gradient = d.T @ p / pairs - 1e-3 * w
            hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + 1e-3 * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        self.at = float(np.quantile(z @ w, len(bad) / (len(good) + len(bad))))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        s = self.standard(x.astype(np.float64)) @ self.weights - self.at
        return 1 / (1 + np.exp(-np.clip(s + np.log(self.cut / (1 - self.cut)), -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels aren't learned from: CRC-32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(table: DataFrame, labels: DataFrame, sample: int = SAMPLE, pairs: int = PAIRS, cut: float = CUT) -> Ranking:
    """The ranking from rows of (doc_id, features) and (doc_id, quality)."""
    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = table.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("features").alias("features"))
    rows = found.orderBy("doc_id").toPandas()
    if rows.empty:
        return Ranking(np.empty((0, 1)), np.empty(0), pairs, cut)
    return Ranking(np.stack(rows["features"].to_numpy()), rows["quality"].to_numpy(), pairs, cut)


def ranked(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pairs: int = PAIRS, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score is ``cut`` or more) of each row."""
    table = saved(featured(docs), "quality-features")
    ranking = learn(table, labels, sample, pairs, cut)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(ranking.score(np.stack(x.to_numpy()))) if len(x) else pd.Series([], dtype=float)

    scored = table.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("features").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
