"""Benchmark decontamination by winnowing.

Words are maximal runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII bytes.
A window is SPAN consecutive words of a benchmark item; an item of fewer words, but not
none, is one window. A document word inside any occurrence of a window is hit.

Fingerprints: of every SPAN - GRAM + 1 consecutive GRAM-word hashes the smallest is kept,
the last one among equals, in items and documents alike. Two texts that share SPAN words
share such a run of hashes and so keep the same one: no shared window is missed. Documents
keep fingerprints only where all words occur in the benchmark. Where a document has a
fingerprint of the benchmark, the hit is extended to the SPAN - GRAM + 1 windows around it:
each is looked up among the benchmark's distinct windows and compared word by word, so
equal hashes of different words do no harm, and a word, line or passage that is repeated
any number of times on both sides costs its length, not the product. Items of a window are
listed once. Shorter items are looked up by the hash of their whole sequence, one table a
length, and compared word by word too.

Defined cases. Null and empty texts have no words. An item without words has no window.
Repeated item ids count once; an item with a null id counts as one with an empty id. Equal
rows of documents give equal rows. Other columns of the documents go through in
``decontaminate``; its own columns replace those of the same name.

Very long texts are taken whole. Empty tables: no document gives no row, no item hits
nothing.

Scale. The index of the benchmark is broadcast, after the bytes of its distinct items were
added up: at most BLOCK_BYTES of items, and documents are read once, with no shuffle.

A larger benchmark stays a table. Its fingerprints (and the hashes of its shorter items)
are marked in bitmaps of a fixed size, which are broadcast; documents are read once, and
where a fingerprint is marked, the windows around it go on, word for word, with the
document's key. They are joined with the table of the benchmark's distinct windows; windows
that very many documents have are joined apart. So the number of passes is fixed, only
windows of documents that seem to be hit are shuffled, and full bitmaps mean more of them,
never another result. In ``decontaminate`` rows that are hit are marked the same way, and
texts of all others stay where they are.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import even_join, kept, saved, utf8
from .line_dedup import MARKS, ROW, bitmap_of, marking
from .token_counts import blocks

SPAN, GRAM = 10, 5
BLOCK_BYTES = 16 << 20
#: Words whose hashes a task keeps.
WORDS_KEPT = 1 << 20
#: Separators become spaces, A-Z become a-z, digits, a-z and bytes from 128 stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Odd multipliers for word numbers, by place in a gram.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n word numbers."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * FACTOR + ids[k : len(ids) - n + 1 + k].astype(np.uint64)
    return mixed(out)


def winnowed(hashes: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Where the smallest of each span - gram + 1 hashes stands, the last among equals."""
    wide = span - gram + 1
    if len(hashes) < wide:
        return np.empty(0, np.int64)
    n = len(hashes) - wide + 1
    low, at = hashes[:n].copy(), np.arange(n)
    for k in range(1, wide):
        other = hashes[k : n + k]
        less = other <= low
        low[less], at[less] = other[less], np.flatnonzero(less) + k
    return np.unique(at)


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of numbers from 0 on once, in order."""
    wide = int(b.max(initial=0)) + 1
    both = np.unique(a.astype(np.int64) * wide + b)
    return both // wide, both % wide


class Windows:
    """The distinct runs of n words of the benchmark, sorted by hash, each with the items it occurs in."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, at: np.ndarray, n: int):
        self.ids, self.n, self.salt = ids, n, np.uint64(0)
        at = np.sort(at)
        while True:  # until different runs have different hashes
            hashes = self._hash(ids)[at] if len(at) else np.empty(0, np.uint64)
            order = np.argsort(hashes, kind="stable")
            first = np.concatenate(([True], np.diff(hashes[order]) > 0))[: len(at)]
            number = np.cumsum(first) - 1
            places = at[order]
            self.at = places[first]
            if self._same(ids, places, self.at[number]).all():
                break
            self.salt += np.uint64(1)
        self.hashes = hashes[order][first]
        # the items of run k are owners[edges[k] : edges[k + 1]]
        runs, self.owners = distinct_pairs(number, owner[places])
        self.edges = np.searchsorted(runs, np.arange(len(self.at) + 1))

    def _hash(self, ids: np.ndarray) -> np.ndarray:
        return gram_hashes(ids, self.n) if not self.salt else gram_hashes(mixed(ids.astype(np.uint64) + self.salt), self.n)

    def _same(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = np.ones(len(a), bool)
        for k in range(self.n):
            same &= ids[a + k] == self.ids[b + k]
        return same

    def found(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places in ``ids`` those where one of these runs begins, and its number."""
        if not len(at) or not len(self.at):
            return (np.empty(0, np.int64),) * 2
        hashes = gram_hashes(ids[at[0] : at[-1] + self.n], self.n)[at - at[0]] if not self.salt else self._hash(ids)[at]
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.at) - 1)
        some = self.hashes[k] == hashes
        at, k = at[some], k[some]
        some = self._same(ids, at, self.at[k])
        return at[some], k[some]


class Index:
    """The benchmark as one array of word numbers, with its fingerprints and its distinct windows."""

    def __init__(self, items: list[tuple[str, bytes]], span: int = SPAN, gram: int = GRAM):
        self.span, self.gram, self.number, self.names = span, gram, {}, []
        ids, owner, long, short = array("i"), array("i"), [], {}
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            begin, k = len(ids) + 1, len(self.names)
            self.names.append(name)
            ids.append(0)
            ids.extend(self.number.setdefault(w, len(self.number) + 1) for w in words)
            owner.extend([k] * (len(words) + 1))
            if len(words) >= span:
                long.append((begin, len(ids)))
            else:
                short.setdefault(len(words), []).append(begin)
        ids.append(0)
        owner.append(-1)
        numbers, owners = np.frombuffer(ids, np.int32), np.frombuffer(owner, np.int32)
        none = [np.empty(0, np.int64)]
        marks = [gram_hashes(numbers[a:b], gram) for a, b in long]
        self.marks = np.unique(np.concatenate([h[winnowed(h, span, gram)] for h in marks] or [np.empty(0, np.uint64)]))
        self.windows = Windows(numbers, owners, np.concatenate([np.arange(a, b - span + 1) for a, b in long] or none), span)
        self.short = [Windows(numbers, owners, np.array(starts, np.int64), n) for n, starts in sorted(short.items())]

    def hits(self, ids: np.ndarray) -> list[tuple[Windows, np.ndarray, np.ndarray]]:
        """Windows, the places where they begin in an array of word numbers, their numbers; 0 is a word that no item has."""
        out = []
        known = ids > 0
        run = np.concatenate(([0], np.cumsum(~known)))  # equal at both ends of a run of known words
        if len(ids) >= self.span and len(self.marks) and (run[self.span :] == run[: -self.span]).any():
            # only stretches with a window of known words are looked at, and each apart
            edge = np.diff(np.concatenate(([0], known.astype(np.int8), [0])))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            long = b - a >= self.span
            for x, y in zip(a[long].tolist(), b[long].tolist(), strict=True):
                hashes = gram_hashes(ids[x:y], self.gram)
                at = winnowed(hashes, self.span, self.gram)
                at = at[np.isin(hashes[at], self.marks)]
                if len(at):
                    # a fingerprint is extended to the windows around it
                    begins = np.unique((at[:, None] - np.arange(self.span - self.gram + 1)).ravel())
                    begins = begins[(begins >= 0) & (begins <= y - x - self.span)]
                    out.append((self.windows, *self.windows.found(ids, begins + x)))
        for windows in self.short:
            if len(ids) >= windows.n:
                out.append((windows, *windows.found(ids, np.flatnonzero(run[windows.n :] == run[: -windows.n]))))
        return [x for x in out if len(x[1])]


def spans(index: Index, texts: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """Of each text: the number of words, the merged hit spans, the sorted names of the items hit."""
    split = [words_of(t) for t in texts]
    get = index.number.get
    # all texts in one array, with an unknown word between them
    ids = np.zeros(sum(map(len, split)) + len(split), np.int64)
    ends, at = [], 0
    for words in split:
        ids[at : at + len(words)] = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        at += len(words) + 1
        ends.append(at)
    edges = np.array([0, *ends])
    begins, lengths, owned = [], [], []
    for windows, places, number in index.hits(ids):
        begins.append(places)
        lengths.append(np.full(len(places), windows.n))
        # a text's windows, each once, and the items of each
        text, k = distinct_pairs(np.searchsorted(edges, places, "right") - 1, number)
        n = windows.edges[k + 1] - windows.edges[k]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owned.append(np.stack(distinct_pairs(np.repeat(text, n), windows.owners[np.repeat(windows.edges[k], n) + inside])))
    begin, length = (np.concatenate(x or [np.empty(0, np.int64)]) for x in (begins, lengths))
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], (begin + length)[order]
    text, owner = distinct_pairs(*np.concatenate(owned or [np.empty((2, 0), np.int64)], axis=1))
    cut, mine = np.searchsorted(begin, edges), np.searchsorted(text, np.arange(len(split) + 1))
    for k, words in enumerate(split):
        a, b, base = cut[k], cut[k + 1], edges[k]
        yield len(words), merged(zip((begin[a:b] - base).tolist(), (end[a:b] - base).tolist(), strict=True)), sorted({index.names[i] for i in owner[mine[k] : mine[k + 1]].tolist()})


def merged(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in pairs:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def built(shared: Broadcast) -> Index:
    """The index of the broadcast items; a worker builds it once."""
    *parts, token = shared.value
    return kept(("index", token), lambda: Index(*parts))


SPANS = "n_words bigint, spans array<struct<begin:bigint,end:bigint>>, items array<string>"


def items_of(benchmark: DataFrame) -> DataFrame:
    """item, text (bytes) of each distinct item."""
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), utf8(F.col("text")).alias("text")).distinct()


def one_block(items: DataFrame, most: int) -> list[tuple[str, bytes]] | None:
    """All items, if they have been added up to ``most`` bytes at most."""
    total = items.agg(F.coalesce(F.sum(F.length("text") + F.length("item") + 64), F.lit(0))).first()[0]
    return None if total > most else [(r.item, bytes(r.text)) for r in items.collect()]


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """A hash of each word, by itself."""
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def bench_windows(items: DataFrame, span: int, gram: int) -> DataFrame:
    """mark, n, window (its words), items: a row for each distinct window; mark: the fingerprint that it has, for shorter items the hash of all their words. Saved."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, texts in blocks(batches):
            known, out = {}, []
            for name, text in zip(names.to_pylist(), texts, strict=True):
                words = words_of(text)
                if not words:
                    continue
                hashes = word_hashes(words, known)
                n = min(span, len(words))
                if n < span:
                    out.append((int(gram_hashes(hashes, n).view(np.int64)[0]), n, b" ".join(words), name))
                    continue
                # any text that has the window keeps its smallest hash
                least = np.lib.stride_tricks.sliding_window_view(gram_hashes(hashes, gram), span - gram + 1).min(axis=1).view(np.int64)
                out += [(h, n, b" ".join(words[begin : begin + span]), name) for begin, h in enumerate(least.tolist())]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["mark", "n", "window", "item"])

    rows = items.select("item", "text").mapInArrow(cut, "mark bigint, n int, window binary, item string")
    return saved(rows.groupBy("n", "window").agg(F.first("mark").alias("mark"), F.collect_set("item").alias("items")), "decontaminate-windows")


def bitmap_bytes(hashes: DataFrame) -> bytes:
    """The bits that the hashes (column h) set, MARKS of them whatever their number."""
    bits = bytearray(MARKS >> 3)
    for r in bitmap_of(hashes).collect():  # MARKS / ROW rows at most
        part = bytes(r.mark_bits)
        at = r.mark_row * (ROW >> 3)
        bits[at : at + len(part)] = part
    return bytes(bits)


def by_join(keyed: DataFrame, items: DataFrame, span: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """n_words of each row of (key, text), and the hits (key, begin, n, items), by a join of windows."""
    windows = bench_windows(items, span, gram)
    marks = windows.select("n", F.col("mark").alias("h"))
    lengths = [r.n for r in marks.select("n").distinct().collect()]  # span at most
    shared = keyed.sparkSession.sparkContext.broadcast({n: bitmap_bytes(marks.filter(F.col("n") == n)) for n in lengths})
    schema = f"key {keyed.schema['key'].dataType.simpleString()}, n_words bigint, places array<struct<begin:bigint,n:int,window:binary>>"
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("n", pa.int32()), ("window", pa.binary())]))

    def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.mod(hashes.view(np.int64), MARKS)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {n: np.frombuffer(b, np.uint8) for n, b in shared.value.items()}
        known: dict[bytes, int] = {}
        for keys, texts in blocks(batches):
            sizes, places = [], []
            for text in texts:
                words = words_of(text)
                if len(known) > WORDS_KEPT:
                    known.clear()
                hashes, found = word_hashes(words, known), []
                for n, own in bits.items():
                    if len(words) < n:
                        continue
                    if n < span:
                        begins = np.flatnonzero(marked(own, gram_hashes(hashes, n)))
                    else:
                        grams = gram_hashes(hashes, gram)
                        at = winnowed(grams, span, gram)
                        at = at[marked(own, grams[at])]
                        begins = np.unique((at[:, None] - np.arange(span - gram + 1)).ravel())
                        begins = begins[(begins >= 0) & (begins <= len(words) - span)]
                    found += [{"begin": b, "n": n, "window": b" ".join(words[b : b + n])} for b in begins.tolist()]
                sizes.append(len(words))
                places.append(found)
            yield pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), pa.array(places, kind)], ["key", "n_words", "places"])

    read = saved(keyed.mapInArrow(scan, schema), "decontaminate-places")
    places = saved(read.select("key", F.explode("places").alias("p")).select("key", "p.*"), "decontaminate-marked")
    # a window in one row is a key in one column, so that one length's doesn't meet another's
    one = F.concat(F.col("n").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("window"))
    hits = even_join(places.withColumn("whole", one).drop("window"), windows.select(one.alias("whole"), "items"), "whole")
    return read.select("key", "n_words"), hits.select("key", "begin", "n", "items")


def with_keys(texts: DataFrame) -> DataFrame:
    """key (equal rows have one, since they have equal spans) and text of rows of (doc_id, text)."""
    return texts.select(F.struct("doc_id", F.xxhash64("text").alias("hash"), F.length("text").alias("size")).alias("key"), "text")


def find(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (word positions, end exclusive), items of each row of ``docs``."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", utf8(F.col("text")).alias("text"))
    items = items_of(benchmark)
    few = one_block(items, block_bytes)
    if few is not None:
        shared = spark.sparkContext.broadcast((few, span, gram, uuid.uuid4().hex))

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = built(shared)
            for keys, block in blocks(batches):
                found = list(spans(index, block))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        pa.array([x[0] for x in found], pa.int64()),
                        pa.array([[{"begin": a, "end": b} for a, b in x[1]] for x in found], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                        pa.array([x[2] for x in found], pa.list_(pa.string())),
                    ],
                    ["doc_id", "n_words", "spans", "items"],
                )

        return texts.mapInArrow(scan, f"doc_id {kind}, {SPANS}")
    counted, hits = by_join(with_keys(texts), items, span, gram)
    hits = saved(hits, "decontaminate-hits")
    each = hits.select("key", F.struct("begin", (F.col("begin") + F.col("n")).alias("end")).alias("s")).distinct()
    order = Window.partitionBy("key").orderBy("s.begin", "s.end")
    reach = F.max("s.end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.sum(F.when(reach.isNull() | (F.col("s.begin") > reach), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    joined = each.withColumn("run", starts).groupBy("key", "run").agg(F.min("s.begin").alias("begin"), F.max("s.end").alias("end"))
    merged_spans = joined.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    names = hits.select("key", F.explode("items").alias("item")).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    empty = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    return counted.join(merged_spans.join(names, "key"), "key", "left").select(F.col("key.doc_id").alias("doc_id"), "n_words", F.coalesce("spans", empty).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def hit_by(shared: Broadcast) -> Callable:
    """Whether a text (as bytes) has a window of the broadcast items."""

    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(x[1]) for x in spans(built(shared), texts.tolist())], dtype=bool)

    return hit


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows in which a window of the benchmark occurs.

    With a benchmark of one block each row is judged where it stands. Beyond, rows that are
    hit are found by a join and marked in a bitmap; only rows that are marked, or seem so,
    are shuffled.
    """
    items = items_of(benchmark)
    few = one_block(items, block_bytes)
    if few is not None:
        hit = hit_by(docs.sparkSession.sparkContext.broadcast((few, span, gram, uuid.uuid4().hex)))
        return docs.filter(~hit(utf8(F.col("text"))))
    # a row in one column, so that no name of the input meets one of ours
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct("doc_id", F.xxhash64(utf8(F.col("text"))).alias("hash"), F.length(utf8(F.col("text"))).alias("size")).alias("key"))
    _, hits = by_join(with_keys(docs.select("doc_id", utf8(F.col("text")).alias("text"))), items, span, gram)
    gone = saved(hits.select("key").distinct(), "decontaminate-gone")
    marked = marking(rows.withColumn("h", F.xxhash64("key")), gone.select(F.xxhash64("key").alias("h")), "h", "decontaminate-marks").drop("h")
    there = gone.select(F.col("key").alias("gone_key")).hint("merge")
    unsure = marked.filter("marked").join(there, F.col("key").eqNullSafe(F.col("gone_key")), "left_anti")
    return marked.filter("not marked").unionByName(unsure).select("row.*")
