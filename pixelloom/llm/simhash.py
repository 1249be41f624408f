"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprint: a text is cut into words (runs of anything but ASCII white space, A-Z
lower-cased) and all its runs of SHINGLE words, joined by one space, are hashed by XXH64;
fewer words make one shingle. A bit of the fingerprint is 1 if it is set in more than half
of the hashes. Fingerprints with at most BITS differing bits are linked; a document's
component is the smallest doc_id that can be reached over links. The 64 bits tell only
very near copies from others. For a similarity of shingles (0.8, say) fingerprints of
WORDS words, made of distinct shingles, only propose: what is linked within a loose budget
of bits is compared by the shingles' hashes, and a link is a pair whose Jaccard similarity
is that or more. The share of differing bits says little of few shingles, so texts of FEW
or less are compared wherever a shingle proposes them.

Self-join: distinct fingerprints stand in a binary trie. Pairs of its nodes are followed
down together, beginning with each node and itself; a pair's differing bits are added up
and the pair is given up when they exceed the budget. Both children of a node are paired
with both children of the other. The trie of wide fingerprints goes over all their bits,
and its budget grows with the level: what the similarity makes likely of the bits so far.

Defined cases. No words (null, empty or white space alone): fingerprint zero, linked like
any other. Very long texts are taken whole. Equal rows and copies share a fingerprint and so a
component. Null ids take no part in the smallest id; a component of null ids alone has the
id null. An empty table gives an empty result. ``near_duplicates`` leaves other columns
out; ``near_duplicates_removed`` passes all through, whatever their names, and keeps
exactly one row of each component, told apart by keys of the rows, not by ids: the row
with the component's id; of several such rows in it the one whose columns, compared in
order, are smallest. So an id that is null or names rows of several components stays once
for each of them.

Scale. The 64-bit fingerprints go without any loss: they are cut into BITS + s blocks, and
two that differ in at most BITS bits agree in s of these blocks; so each fingerprint is
sent once for every choice of s blocks, with these bits turned to the front, where the
budget is 0. s grows with the number of fingerprints (a few dozen in a bucket on average),
which changes the work, never the result.

Wide fingerprints are dealt to tries by the KEYS smallest shingles of their texts, so a
document costs KEYS copies of its fingerprint however large the corpus is. (Bands of bits
would be so many more with each doubling: at 0.8 a bit agrees with chance 0.85, and their
number grows with the fourth root of the corpus.) A pair of similarity 0.8 shares none of
its KEYS smallest with chance 2 (1/9)^KEYS, 0.00003; texts of FEW shingles or less send so
many that they can't share none. A shingle in the texts of more than CROWDED fingerprints
(a common passage) is the exception: its trie is cut by bands of bits, as many as that
one bucket asks for, and a pair is missed there with chance MISSED unless another shingle
proposes it too. ``exact=True`` has no such chances: there every text is proposed by as many
of its smallest shingles as any text that is alike must share one of (a fifth of them and
one, at 0.8), and what they propose is compared in tiles. Shingles are made again for texts that have others proposed, one of each
fingerprint, and compared group by group; a group of more than PART texts or PART_BYTES is
dealt out in tiles. In a tile one text after another is compared with all by lists of the
texts of each shingle, but for those of the largest component so far.

Copies are one row a fingerprint before any join. A bucket that is hot all the same
(clusters of near copies) is dealt out in tiles, each pair of parts in one task. Within a
task pairs are held in bounded runs, depth first, and pairs of nodes whose fingerprints
are in one component already are skipped, so a cluster costs about its size and a task's
output is a forest, not all pairs. Components are then joined by the large-star small-star
method over fingerprints, each round saved; rows that go are marked in a bitmap (more of
them than it holds are joined), so texts of the others stay where they are; a star's centre, a fingerprint with many
copies and the name of a large component are joined apart (``even_join``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, even_join, saved, scratch, unused, utf8
from .line_dedup import marking
from .token_counts import blocks

SHINGLE, BITS, SEED = 4, 4, 42
#: Words of a wide fingerprint, and the chance that all bands miss a pair of the similarity asked for.
WORDS, MISSED = 4, 0.004
#: Standard deviations of the differing bits by which a proposed pair may be off the average.
LOOSE = 4.4
#: Texts of so few distinct shingles are compared wherever a shingle proposes them.
FEW = 32
#: Shingles that propose a longer text.
KEYS = 5
#: Fingerprints in a shingle's bucket from which on it is cut by bands of bits.
CROWDED = 1024
#: Texts, and bytes of their shingles' hashes, of a group in a part of a tile.
PART, PART_BYTES = 2000, 16 << 20
#: Average fingerprints in a bucket that a finer cut isn't worth.
CROWD = 64
#: A bucket of more is dealt out in tiles of two parts.
TILE = 50_000
#: Pairs of nodes that are followed at once.
RUN = 1 << 16
#: The key of a row, made when the rows are saved: ids may be null or name several rows.
ROW = "simhash_row"


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    return word_of(hashes_of(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id (and the key, if there is one) and fp, the fingerprint as a signed long, of each row."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            found = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.view(np.int64))], ["name", "fp"])

    named = with_names(docs)
    return named.mapInArrow(scan, f"name {named.schema['name'].dataType.simpleString()}, fp bigint").select("name.*", "fp")


def with_names(docs: DataFrame) -> DataFrame:
    """name (doc_id and the key, if there is one) and text, as bytes, of each row."""
    return docs.select(F.struct("doc_id", *[c for c in docs.columns if c == ROW]).alias("name"), utf8(F.col("text")).alias("text"))


def with_rows(docs: DataFrame) -> DataFrame:
    """Saved rows of doc_id, text, a key of the row, and all other columns in one, so that no name clashes."""
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return saved(docs.select("doc_id", "text", F.struct(F.lit(0).alias(unused("_", docs.columns)), *others).alias("others"), F.monotonically_increasing_id().alias(ROW)), "simhash-rows")


def hashes_of(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words; of all words if there are fewer; none without words."""
    words = text.lower().split() if text else []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip((end - length)[:n].tolist(), end[shingle - 1 :].tolist(), strict=True)), np.uint64, n)


def word_of(hashes: np.ndarray) -> int:
    """64 bits: which are set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), RUN):
        ones += np.unpackbits(hashes[k : k + RUN].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def components_of(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Smallest member of each component after the links a-b, from the roots so far."""
    a, b = root[a], root[b]
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while True:
            shorter = root[root]
            if np.array_equal(shorter, root):
                break
            root = shorter
        a, b = root[a], root[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    return root


def trie_forest(values: np.ndarray, bucket: np.ndarray, free: int, budget: int | np.ndarray = BITS, rest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the self-join connects: places of linked values, as a forest.

    values: 64-bit, sorted within each bucket; all but the last ``free`` bits of a bucket's
    values agree. Buckets follow each other in ``bucket``. rest: further words of each
    value, one row a word, whose bits continue the trie. budget: how many bits may differ,
    in all or, as an array, while so many bits are still to come.
    """
    n = len(values)
    words = values[None, :] if rest is None else np.vstack([values[None, :], rest])
    place = np.arange(n) if rest is None else np.lexsort((*words[::-1], bucket))
    words, bucket = np.ascontiguousarray(words[:, place]), bucket[place]
    free += 64 * (len(words) - 1)
    allowed = np.full(free + 1, budget) if np.ndim(budget) == 0 else budget

    def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.zeros(len(a), np.int64)
        for word in words:
            found += np.bitwise_count(word[a] ^ word[b])
        return found

    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    lo, hi = edge[:-1], edge[1:]
    some = hi - lo > 1
    lo, hi = lo[some].astype(np.int64), hi[some].astype(np.int64)
    root = np.arange(n)
    # changes[i]: how often the root changes up to place i; a node with no change inside is one component
    changes = np.arange(n)
    stack = [(lo[k : k + RUN], hi[k : k + RUN], lo[k : k + RUN], hi[k : k + RUN], np.zeros(len(lo[k : k + RUN]), np.int64), free) for k in range(0, len(lo), RUN)]

    def halves(lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        """Where the ones of this bit begin in each node, by bisection of all nodes at once."""
        word, shift = words[len(words) - 1 - bit // 64], np.uint64(bit % 64)
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            one = (word[np.minimum(mid, n - 1)] >> shift) & np.uint64(1) > 0
            b = np.where(open_ & one, mid, b)
            a = np.where(open_ & ~one, mid + 1, a)
        return a

    while stack:
        alo, ahi, blo, bhi, bits, depth = stack.pop()
        same = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (root[alo] == root[blo])
        # at the end of the trie a node is a run of equal values
        single = ~same & (((ahi - alo == 1) & (bhi - blo == 1)) | (depth == 0))
        if single.any():
            a, b = alo[single], blo[single]
            near = differing(a, b) <= allowed[0]
            if depth == 0:
                for x, y in zip(alo[single].tolist() + blo[single].tolist(), ahi[single].tolist() + bhi[single].tolist(), strict=True):
                    root = components_of(n, np.full(y - x, x), np.arange(x, y), root)
            if near.any() or depth == 0:
                root = components_of(n, a[near], b[near], root)
                changes = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))
        live = ~same & ~single
        alo, ahi, blo, bhi, bits = alo[live], ahi[live], blo[live], bhi[live], bits[live]
        if not len(alo):
            continue
        bit = depth - 1
        amid, own = halves(alo, ahi, bit), (alo == blo)
        bmid = np.where(own, amid, halves(blo, bhi, bit))
        x = np.concatenate([alo, amid, alo, amid])
        x_end = np.concatenate([amid, ahi, amid, ahi])
        y = np.concatenate([blo, bmid, bmid, blo])
        y_end = np.concatenate([bmid, bhi, bhi, bmid])
        more = np.concatenate([bits, bits, bits + 1, bits + 1])
        # of a node with itself, one of the two crossed pairs is enough
        keep = (x < x_end) & (y < y_end) & (more <= allowed[bit]) & ~np.concatenate([np.zeros(3 * len(own), bool), own])
        keep &= ~((x == y) & (x_end - x == 1) & (y_end - y == 1))
        x, x_end, y, y_end, more = x[keep], x_end[keep], y[keep], y_end[keep], more[keep]
        # near pairs first: they make the components by which the others are skipped
        order = np.argsort(-more, kind="stable")
        for k in range(0, len(order), RUN):
            i = order[k : k + RUN]
            stack.append((x[i], x_end[i], y[i], y_end[i], more[i], bit))
    child = np.flatnonzero(root != np.arange(n))
    return place[child], place[root[child]]


def layout(spare: int, budget: int = BITS) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each choice of ``spare`` of budget + spare blocks: the number of bits at the front, and (shift, width) of all blocks in their new order."""
    n = budget + spare
    cuts = [64 * k // n for k in range(n + 1)]
    block = [(64 - cuts[k + 1], cuts[k + 1] - cuts[k]) for k in range(n)]
    return [(sum(block[k][1] for k in chosen), [block[k] for k in chosen] + [block[k] for k in range(n) if k not in chosen]) for chosen in combinations(range(n), spare)]


def turned(values: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for shift, width in order:
        out = (out << np.uint64(width)) | ((values >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def spare_blocks(count: int, budget: int = BITS, crowd: int = CROWD) -> int:
    """The smallest number of agreeing blocks that leaves ``crowd`` evenly spread fingerprints in a bucket."""
    for spare in range(1, 9):
        if count / 2 ** (64 * spare // (budget + spare)) <= crowd:
            return spare
    return 9


def gathered(dealt: DataFrame, rows: int, tile: int, full: Column | None = None) -> DataFrame:
    """Rows of (way, key, fp, ...) with their tile, each bucket's tile in one task and in order. full: how many parts a bucket fills, if not by ``tile`` rows each."""
    filled = F.count("*") / tile if full is None else full
    hot = saved(dealt.groupBy("way", "key").agg(F.ceil(filled).cast("int").alias("parts")).filter("parts > 1"), "simhash-hot")
    if hot.isEmpty():
        placed = dealt.withColumn("tile", F.lit(0).cast("bigint"))
    else:
        hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
        pair = dealt.join(hot, ["way", "key"], "left").withColumn("part", F.coalesce(part, F.lit(0))).withColumn("other", other)
        low, high = F.least("part", "other").cast("bigint"), F.greatest("part", "other").cast("bigint")
        placed = pair.select(*dealt.columns, (high * (high + 1) / 2 + low).cast("bigint").alias("tile"))
    tasks = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // 2_000_000))
    return placed.repartition(tasks, "way", "key", "tile").sortWithinPartitions("way", "key", "tile", "fp")


def links(distinct: DataFrame, count: int, budget: int = BITS, tile: int = TILE) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp), enough to connect all that are linked."""
    spare = spare_blocks(count, budget)
    ways = layout(spare, budget)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for way, (front, order) in enumerate(ways):
                key = turned(fp, order) >> np.uint64(64 - front)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), way, np.int32)), pa.array(key.astype(np.int64)), pa.array(fp.view(np.int64))], ["way", "key", "fp"])

    dealt = distinct.select("fp").mapInArrow(deal, "way int, key bigint, fp bigint")
    placed = gathered(dealt, count * len(ways), tile)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for way, group, (fp,) in runs(batches):
            front, order = ways[way]
            values = turned(fp, order)
            at = np.lexsort((values, group))
            child, parent = trie_forest(values[at], group[at], 64 - front, budget)
            fp = fp[at].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[parent])], ["a", "b"])

    return placed.mapInArrow(join, "a bigint, b bigint")


def runs(batches: Iterable[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whole buckets of one way, up to ``most`` rows or one bucket at a time: way, the buckets' numbers, the other columns."""
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for way in np.unique(rows[0]):
            part = rows[:, rows[0] == way]
            new = np.concatenate(([True], (part[1:3, 1:] != part[1:3, :-1]).any(axis=0)))
            yield int(way), np.cumsum(new), part[3:].view(np.uint64)

    for batch in batches:
        names = ["way", "key", "tile", *[n for n in batch.schema.names if n not in ("way", "key", "tile")]]
        held.append(np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]))
        if sum(x.shape[1] for x in held) >= most:
            rows = np.concatenate(held, axis=1)
            change = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0))
            if len(change):
                cut = change[-1] + 1
                yield from flush(np.ascontiguousarray(rows[:, :cut]))
                rows = rows[:, cut:]
            held = [rows]
    if held:
        yield from flush(np.ascontiguousarray(np.concatenate(held, axis=1)))


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for each end of the links a, b.

    Large-star: of a node's neighbours and itself the smallest is linked to all larger
    neighbours. Small-star: the same for its smaller neighbours. Both keep components, and
    they end in stars.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def print_of(e: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        return tuple(e.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())

    # a: the larger end
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seen = print_of(edges)
    while True:
        pairs = both(edges)
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = even_join(pairs.filter("v > u"), least, "u", rows=seen[0]).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = saved(large, "links")
        lower = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = even_join(large.withColumnRenamed("a", "u"), lower, "u")
        star = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        star = saved(star, "links")
        now = print_of(star)
        discard(edges)
        discard(large)
        edges = star
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(printed: DataFrame, budget: int = BITS, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id of rows of (doc_id, fp)."""
    distinct = distinct_prints(printed)
    return even_join(printed, named_components(distinct, links(distinct, distinct.count(), budget, tile)), "fp").select("doc_id", "fp", "component_id")


def distinct_prints(printed: DataFrame) -> DataFrame:
    """Of each fingerprint the smallest doc_id (least), the smallest key and the other columns."""
    other = [(F.min if c == ROW else F.first)(c).alias(c) for c in printed.columns if c not in ("doc_id", "fp")]
    return saved(printed.groupBy("fp").agg(F.min("doc_id").alias("least"), *other), "simhash-distinct")


def named_components(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """fp, root (the component's own fingerprint), component_id of each distinct fingerprint, by links found."""
    stars = connected(found)
    # a node that no link ends in is its own root
    rooted = distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = saved(rooted, "simhash-roots")
    by_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return saved(even_join(named, by_root, "root").select("fp", "root", "component_id"), "simhash-named")


def wide_fingerprint(text: bytes | None, shingle: int) -> list[int]:
    """WORDS words of the distinct shingles' hashes, mixed anew for each word."""
    return wide_words(np.unique(hashes_of(text, shingle)))


def wide_words(hashes: np.ndarray) -> list[int]:
    out = []
    for k in range(WORDS):
        out.append(word_of(hashes))
        hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        hashes ^= hashes >> np.uint64(29)
    return out


def proposing(n: int, similarity: float) -> int:
    """How many of a text's n distinct shingles, the smallest by hash, propose it: KEYS, or so many that the others are too few to be alike."""
    return prefix(n, similarity) if n <= few(similarity) else KEYS


def few(similarity: float) -> int:
    """No text of FEW shingles is alike to one of more than this."""
    return int(FEW / similarity)


def prefix(n: int, similarity: float) -> int:
    """How many of n shingles, the first in an order that all texts share, any text that is alike must share one of."""
    return sum(k / n >= similarity for k in range(1, n + 1))


def wide_fingerprints(docs: DataFrame, shingle: int, similarity: float = 0.8) -> DataFrame:
    """doc_id (and the key, if there is one), fp (a hash of all words), the words, the number of distinct shingles and the proposing ones of each row."""
    names = [f"w{k}" for k in range(WORDS)]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            sets = [np.unique(hashes_of(t, shingle)) for t in texts]
            found = np.array([wide_words(h) for h in sets], np.uint64).reshape(-1, WORDS)
            least = pa.array([h[: proposing(len(h), similarity)].view(np.int64) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in range(WORDS)], pa.array(list(map(len, sets)), pa.int64()), least], ["name", *names, "n_shingles", "proposing"])

    named = with_names(docs)
    words = named.mapInArrow(scan, f"name {named.schema['name'].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in names) + ", n_shingles bigint, proposing array<bigint>")
    return words.select("name.*", *names, "n_shingles", "proposing", F.xxhash64(*names).alias("fp"))


def differing_share(similarity: float) -> float:
    """The share of bits that differ, on average, between two texts with this Jaccard similarity of shingles."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_budget(similarity: float, deviations: float = 1.3, bits: int = 64 * WORDS) -> int:
    """Of so many bits those that may differ: so many standard deviations over the average; a tenth of the pairs of this similarity exceed 1.3."""
    share = differing_share(similarity)
    return int(bits * share + deviations * np.sqrt(bits * share * (1 - share)))


def level_budgets(similarity: float) -> np.ndarray:
    """The loose budget at each level of the trie, by the bits still to come."""
    return np.array([wide_budget(similarity, LOOSE, 64 * WORDS - k) for k in range(64 * WORDS + 1)])


def bands(count: int, similarity: float) -> tuple[int, int]:
    """Bits of a band, so that evenly spread fingerprints are few in a bucket, and the number of bands that miss a pair of this similarity and the average bits together with chance MISSED at most."""
    width = min(40, max(4, int(count // CROWD).bit_length()))
    return width, int(np.ceil(np.log(MISSED) / np.log1p(-((1 - differing_share(similarity)) ** width))))


def near_links(distinct: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """a, b: links between wide fingerprints (fp, words) that a shingle proposes and that differ in the loose budget of bits at most.

    A shingle's bucket is a trie. One that holds more than CROWDED is cut by bands of
    bits, drawn with a fixed seed, as many as its size asks for.
    """
    names = [f"w{k}" for k in range(WORDS)]
    budgets = level_budgets(similarity)
    keyed = distinct.select("fp", *names, F.explode(F.slice("proposing", 1, KEYS)).alias("key"))
    crowded = saved(keyed.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > CROWDED), "simhash-crowded")
    dealt = keyed.select(F.lit(0).alias("way"), "key", "fp", *names)
    if not crowded.isEmpty():

        def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, size, fp, *words = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                cut = np.array([bands(int(n), similarity) for n in size], np.int64).reshape(-1, 2)
                bits = np.unpackbits(np.ascontiguousarray(np.stack(words, axis=1)).view(np.uint8), axis=1)
                for width in np.unique(cut[:, 0]).tolist():
                    for band in range(int(cut[cut[:, 0] == width, 1].max(initial=0))):
                        i = np.flatnonzero((cut[:, 0] == width) & (cut[:, 1] > band))
                        at = np.random.default_rng((SEED, width, band)).permutation(64 * WORDS)[:width]
                        front = bits[np.ix_(i, at)].astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
                        # bucket and band in one number; where two meet by chance, the trie tells them apart
                        both = (key[i].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (front.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), band + 1, np.int32)), pa.array(both.view(np.int64)), pa.array(fp[i]), *[pa.array(w[i]) for w in words]], ["way", "key", "fp", *names])

        sized = even_join(keyed, crowded, "key", "left")
        cut = sized.filter("size is not null").select("key", "size", "fp", *names).mapInArrow(deal, "way int, key bigint, fp bigint, " + ", ".join(f"{n} bigint" for n in names))
        dealt = saved(sized.filter("size is null").select(F.lit(0).alias("way"), "key", "fp", *names).union(cut), "simhash-dealt")
    placed = gathered(dealt, dealt.count(), tile)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group, (fp, *words) in runs(batches):
            child, parent = trie_forest(words[0], group, 64, budgets, np.stack(words[1:]))
            fp = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[parent])], ["a", "b"])

    return placed.mapInArrow(join, "a bigint, b bigint")


def alike(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all pairs of this Jaccard similarity or more: places in ``sets``, as a forest. Each set is of distinct hashes."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    owner = np.repeat(np.arange(n), size)
    _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    listed = owner[np.argsort(shingle, kind="stable")]  # the owners of each shingle, one list after the other
    end = np.cumsum(count)
    begin, own = end - count, np.cumsum(size) - size
    root, done = np.arange(n), np.zeros(n, bool)
    while True:
        # a pair across components has an end outside the largest one
        rest = np.flatnonzero(~done & (root != np.bincount(root).argmax()))
        if not len(rest):
            break
        i = rest[0]
        done[i] = True
        of = shingle[own[i] : own[i] + size[i]]
        of = of[count[of] > 1]
        if not len(of):
            continue
        common = np.bincount(np.concatenate([listed[a:b] for a, b in zip(begin[of].tolist(), end[of].tolist(), strict=True)]), minlength=n)
        near = np.flatnonzero((common / np.maximum(size[i] + size - common, 1) >= similarity) & (root != root[i]))
        if len(near):
            root = components_of(n, np.full(len(near), i), near, root)
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def proposed(distinct: DataFrame, texts: DataFrame, near: DataFrame | None, shingle: int, similarity: float) -> DataFrame:
    """way, key, fp, shingles (hashes, as bytes): groups in which pairs of the similarity are, 0 by links, 1 by shingles of texts with few; without links, by shingles of all texts."""
    if near is None:
        most = 1 << 62
        asked = distinct.filter("n_shingles > 0").withColumn("root", F.lit(None).cast("bigint"))
    else:
        stars = connected(near)
        groups = stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
        most = few(similarity)
        short = F.col("n_shingles").between(1, most)
        asked = distinct.join(groups, distinct["fp"] == groups["node"], "left").filter(F.col("root").isNotNull() | short)
    rows = texts.select(ROW, "text").join(asked.select(ROW, "fp", "root").hint("merge"), ROW)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, found in blocks(batches):
            way, key, fp, held = [], [], [], []
            for name, text in zip(names.to_pylist(), found, strict=True):
                hashes = np.unique(hashes_of(text, shingle))
                keys = [] if name["root"] is None else [(0, name["root"])]
                if len(hashes) <= most:
                    keys += [(1, h) for h in hashes[: prefix(len(hashes), similarity)].view(np.int64).tolist()]
                for w, k in keys:
                    way.append(w)
                    key.append(k)
                    fp.append(name["fp"])
                    held.append(hashes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(way, pa.int32()), pa.array(key, pa.int64()), pa.array(fp, pa.int64()), pa.array(held, pa.binary())], ["way", "key", "fp", "shingles"])

    return rows.select(F.struct("fp", "root").alias("name"), utf8(F.col("text")).alias("text")).mapInArrow(deal, "way int, key bigint, fp bigint, shingles binary")


def similar_links(distinct: DataFrame, texts: DataFrame, shingle: int, similarity: float, tile: int = TILE, part: int = PART, exact: bool = False) -> DataFrame:
    """a, b: links between fingerprints whose texts have this similarity of shingles or more, enough to connect all that are proposed; exact: all there are."""
    near = None if exact else near_links(distinct.filter(F.col("n_shingles") > FEW), similarity, tile)
    dealt = saved(proposed(distinct, texts, near, shingle, similarity), "simhash-proposed")
    full = F.greatest(F.count("*") / part, F.sum(F.length("shingles")) / PART_BYTES)
    placed = gathered(dealt, dealt.count(), part, full)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, sets in groups_of(batches):
            child, parent = alike(sets, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[parent])], ["a", "b"])

    return placed.select("way", "key", "tile", "fp", "shingles").mapInArrow(compare, "a bigint, b bigint")


def groups_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """fp and sets of each run of rows of (way, key, tile, fp, shingles) with the same first three, but for runs of one row."""
    last, prints, sets = None, [], []
    for batch in batches:
        marks = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:3]])
        fp, shingles = batch.column(3).to_numpy(), batch.column(4)
        n = batch.num_rows
        edge = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), n] if n else []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            mark = tuple(marks[:, a].tolist())
            if mark != last:
                if len(sets) > 1:
                    yield np.concatenate(prints), sets
                last, prints, sets = mark, [], []
            prints.append(fp[a:b])
            sets += [np.frombuffer(x, np.uint64) for x in shingles.slice(a, b - a).to_pylist()]
    if len(sets) > 1:
        yield np.concatenate(prints), sets


def printed_links(rows: DataFrame, shingle: int, budget: int, tile: int, similarity: float | None, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows' fingerprints, and fp, root, component_id of each."""
    if similarity is None:
        printed = saved(fingerprints(rows, shingle), "simhash-prints")
        distinct = distinct_prints(printed)
        return printed, named_components(distinct, links(distinct, distinct.count(), budget, tile))
    printed = saved(wide_fingerprints(rows, shingle, similarity), "simhash-prints")
    distinct = distinct_prints(printed)
    return printed, named_components(distinct, similar_links(distinct, rows, shingle, similarity, tile, exact=exact))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BITS, tile: int = TILE, similarity: float | None = None, exact: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of ``docs``.

    With a similarity, fingerprints have WORDS words, and texts are linked that have at
    least this Jaccard similarity of distinct shingles. exact: pairs are proposed by a
    prefix filter instead of tries, at the cost of more to compare, and none is missed.
    """
    printed, named = printed_links(docs if similarity is None else with_rows(docs), shingle, budget, tile, similarity, exact)
    return even_join(printed, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates_removed(docs: DataFrame, shingle: int = SHINGLE, budget: int = BITS, tile: int = TILE, similarity: float | None = None, exact: bool = False) -> DataFrame:
    """``docs`` with one row of each component, one whose id names it."""
    rows = with_rows(docs)
    with scratch():
        kept = saved(kept_rows(rows, docs.columns, shingle, budget, tile, similarity, exact), "simhash-kept", lasting=True)
    back = without_rows(rows, kept)
    return back.select(*[column_of(c).alias(c) for c in docs.columns])


def without_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows whose keys are in ``kept``. Those that go are marked, so most rows are let through where they lie; only rows that are marked, or seem so, are shuffled with their texts."""
    gone = saved(rows.select(ROW).join(kept.hint("merge"), ROW, "left_anti"), "simhash-gone")
    mark = unused("h", rows.columns)
    marked = marking(rows.withColumn(mark, F.xxhash64(ROW)), gone.select(F.xxhash64(ROW).alias("h")), mark, "simhash-gone-hashes").drop(mark)
    unsure = marked.filter("marked").join(gone.hint("merge"), ROW, "left_anti")
    return marked.filter("not marked").unionByName(unsure).drop("marked")


def column_of(name: str) -> Column:
    """A column of the input among the saved rows."""
    return F.col(name) if name in ("doc_id", "text") else F.col("others").getField(name)


def kept_rows(rows: DataFrame, columns: list[str], shingle: int, budget: int, tile: int, similarity: float | None, exact: bool = False) -> DataFrame:
    """The keys of the rows that stay."""
    printed, named = printed_links(rows, shingle, budget, tile, similarity, exact)
    found = even_join(printed.select("doc_id", ROW, "fp"), named, "fp")
    stays = saved(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(ROW, "root"), "simhash-stays")
    one = saved(stays.groupBy("root").agg(F.min(ROW).alias(ROW), F.count("*").alias("n")), "simhash-counts")
    kept = one.filter("n = 1").select(ROW)
    if one.filter("n > 1").isEmpty():
        return kept
    # rows of a component that share its id: the smallest by all columns in order
    same = even_join(stays, one.filter("n > 1").select("root", F.lit(True).alias("several")), "root").select(ROW, "root")
    whole = F.struct(*[column_of(c).alias(f"c{k}") for k, c in enumerate(columns)], F.col(ROW).alias("key"))
    least = rows.join(same.hint("merge"), ROW).groupBy("root").agg(F.min(whole).alias("row"))
    return kept.union(least.select(F.col("row.key").alias(ROW)))
