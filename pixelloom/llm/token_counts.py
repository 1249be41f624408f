"""Token counts by a unigram model: dynamic programming shared along a trie of pre-tokens.

A pre-token is a run of anything but ASCII white space with one space before it. Its best
split into vocabulary pieces has the highest sum of piece scores and, among equals, the
fewest pieces; a document's count is the sum over its pre-tokens.

The distinct pre-tokens of a block go into a trie. The forward score of a node (best score
and number of pieces of any split of the prefix that the node stands for) depends on the
prefix alone, so it is computed once for all pre-tokens that share the prefix; nodes that
end a pre-token store its count. The trie is built level by level in arrays while a level
has many nodes (those of level d are the distinct d-byte prefixes); the few long words that
then are left are walked depth first, by an automaton of all pieces.

The vocabulary is read from a file, never trained here. A unigram model's file (a piece, a
tab and its score a line, U+2581 standing for a space) gives scores of its own, in
millionths. A rank file has none: there a piece's score is -round(1000 ln(rank + 1 + SHIFT)),
Zipf's law over ranks. Scores are whole numbers so that sums are exact. Single bytes that
the file lacks are added with a score below all others, so every byte string has a split.

Defined cases. Null text, empty text and text of white space alone: no pre-tokens, no
tokens. Pre-tokens of any length are handled, in about a microsecond a byte. Repeated rows give repeated results, equal ids are rows of their own, and null ids
stay. Other columns are left out of the result, whatever their names. An empty table gives
an empty result.

Scale. No shuffle. A task holds one block of texts (BLOCK_BYTES), its trie level and a
table of counts that is emptied at CACHE entries, so memory doesn't grow with the input.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, utf8

#: Pieces of more bytes than two machine words hold are looked up by their bytes.
LONGEST = 16
SHIFT = 9
#: A level of fewer words than this costs more in arrays than word by word.
FEW = 1000
CACHE = 400_000
BLOCK_BYTES = 8 << 20
#: A lost split: no real sum of scores comes near it.
NEVER = -(1 << 60)


def pieces_of(file: str) -> Iterator[tuple[bytes, int]]:
    """Pieces and scores of a rank file or of a unigram model's file."""
    lowest, singles = 0, set()
    with open(file, "rb") as lines:
        for line in lines:
            line = line.rstrip(b"\r\n")
            if b"\t" in line:
                piece, _, score = line.rpartition(b"\t")
                piece, score = piece.replace("\u2581".encode(), b" "), round(1_000_000 * float(score))
            elif line:
                piece, rank = line.split()
                piece, score = base64.b64decode(piece), -round(1000 * float(np.log(int(rank) + 1 + SHIFT)))
            else:
                continue
            if piece:
                lowest = min(lowest, score)
                if len(piece) == 1:
                    singles.add(piece)
                yield piece, score
    for byte in map(bytes, zip(range(256), strict=True)):
        if byte not in singles:
            yield byte, lowest - 10_000_000


class Unigram:
    """Pieces as two 64-bit words each, sorted by length class, with scores; the few longer ones by their last 16 bytes."""

    def __init__(self, file: str):
        by_length: dict[int, list[tuple[int, int, int]]] = {}
        #: last 16 bytes as two words -> pieces of more bytes that end so, with scores
        self.longer: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        self.longest = LONGEST
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces_of(file):
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), score))
            word = int.from_bytes(piece[-LONGEST:], "big")
            if len(piece) > LONGEST:
                self.longer.setdefault((word >> 64, word & (1 << 64) - 1), []).append((piece, score))
                self.longest = max(self.longest, len(piece))
            else:
                by_length.setdefault(len(piece), []).append((word >> 64, word & (1 << 64) - 1, score))
        self.automaton.make_automaton()
        self.ends = np.array(sorted({low for _, low in self.longer}), np.uint64)
        self.tables = {}
        for n, pieces in by_length.items():
            pieces.sort(key=lambda p: (p[1], p[0]))
            high, low, score = zip(*pieces, strict=True)
            self.tables[n] = np.array(high, np.uint64), np.array(low, np.uint64), np.array(score, np.int64)

    def scores(self, n: int, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The score of each n-byte string, NEVER for one that isn't a piece."""
        out = np.full(len(low), NEVER, np.int64)
        if n not in self.tables:
            return out
        highs, lows, scores = self.tables[n]
        at = np.searchsorted(lows, low)
        if n <= 8:
            at[at == len(lows)] = 0
            hit = lows[at] == low
            out[hit] = scores[at[hit]]
            return out
        end = np.searchsorted(lows, low, "right")
        while (open_ := at < end).any():  # pieces with the same low word follow each other
            i = np.flatnonzero(open_)
            hit = highs[at[i]] == high[i]
            out[i[hit]] = scores[at[i[hit]]]
            at[i] += 1
        return out


def walked(words: list[bytes], model: Unigram) -> list[int]:
    """The same for sorted words, the trie taken depth first: a word begins where it leaves the one before.

    At each place the automaton names the pieces that end there, so a byte costs its
    pieces, whatever the number of words.
    """
    out, before = [], b""
    best, pieces = [0], [0]
    for word in words:
        shared = common(before, word)
        del best[shared + 1 :], pieces[shared + 1 :]
        at, top, fewest = shared, NEVER, 0
        for end, (n, score) in model.automaton.iter(word.decode("latin-1"), max(0, shared + 1 - model.longest)):
            if end < shared or n > end + 1:
                continue
            if end > at:
                best.append(top)
                pieces.append(fewest)
                at, top = end, NEVER
            total, many = best[end + 1 - n] + score, pieces[end + 1 - n] + 1
            if total > top or total == top and many < fewest:
                top, fewest = total, many
        if len(word) > shared:
            best.append(top)
            pieces.append(fewest)
        out.append(pieces[len(word)])
        before = word
    return out


def common(a: bytes, b: bytes) -> int:
    """The number of bytes that two strings begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def trie_counts(words: list[bytes], model: Unigram) -> list[int]:
    """The number of pieces in the best split of each of ``words``."""
    if not words:
        return []
    order = sorted(range(len(words)), key=words.__getitem__)
    lengths = np.fromiter((len(words[i]) for i in order), np.int64, len(order))
    data = np.frombuffer(b"".join([words[i] for i in order]), np.uint8)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    counts = np.zeros(len(order), np.int64)
    # alive: the words longer than this level; node: which of the level's nodes each is in
    alive, node = np.arange(len(order)), np.zeros(len(order), np.int64)
    highs, lows = np.zeros(1, np.uint64), np.zeros(1, np.uint64)  # a node's last 16 bytes
    # of a node's ancestors, from 0 levels up to the longest piece's length less 1: score, pieces
    best, pieces = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    depth = 0
    keep = lengths > 0
    alive, node = alive[keep], node[keep]
    while len(alive):
        if len(alive) < FEW:
            counts[alive] = walked([words[order[i]] for i in alive.tolist()], model)
            break
        byte = data[first[alive] + depth].astype(np.int64)
        new = np.empty(len(alive), bool)  # the words are sorted, so a node's words are neighbours
        new[0] = True
        new[1:] = (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])
        parent, of = node[new], np.cumsum(new) - 1
        depth += 1
        b = byte[new].astype(np.uint64)
        highs = (highs[parent] << np.uint64(8)) | (lows[parent] >> np.uint64(56))
        lows = (lows[parent] << np.uint64(8)) | b
        best = [x[parent] for x in best[: model.longest]]
        pieces = [x[parent] for x in pieces[: model.longest]]
        top, fewest = np.full(len(parent), NEVER, np.int64), np.zeros(len(parent), np.int64)
        for n in range(1, min(depth, LONGEST) + 1):
            if n > 8:
                h, low = highs & np.uint64((1 << 8 * (n - 8)) - 1), lows
            else:
                h, low = highs, lows & np.uint64((1 << 8 * n) - 1)
            score = model.scores(n, h, low)
            i = np.flatnonzero(score > NEVER)
            total, many = best[n - 1][i] + score[i], pieces[n - 1][i] + 1
            better = (total > top[i]) | (total == top[i]) & (many < fewest[i])
            top[i[better]], fewest[i[better]] = total[better], many[better]
        if depth > LONGEST and len(model.ends):
            word = alive[new]  # a word of each node
            for i in np.flatnonzero(np.isin(lows, model.ends)).tolist():
                for piece, score in model.longer.get((int(highs[i]), int(lows[i])), ()):
                    n, end = len(piece), int(first[word[i]]) + depth
                    if n <= depth and data[end - n : end].tobytes() == piece:
                        total, many = best[n - 1][i] + score, pieces[n - 1][i] + 1
                        if total > top[i] or total == top[i] and many < fewest[i]:
                            top[i], fewest[i] = total, many
        best.insert(0, top)
        pieces.insert(0, fewest)
        ends = lengths[alive] == depth
        counts[alive[ends]] = fewest[of[ends]]
        alive, node = alive[~ends], of[~ends]
    out = np.empty(len(order), np.int64)
    out[order] = counts
    return out.tolist()


def blocks(batches: Iterable[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Runs of (other column, texts) of about ``most`` bytes; a longer text is a block of its own."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        begin = size = 0
        for i, n in enumerate(pc.binary_length(texts).to_pylist()):
            size += n or 0
            if size >= most or i == len(texts) - 1:
                yield keys.slice(begin, i + 1 - begin), texts.slice(begin, i + 1 - begin).to_pylist()
                begin, size = i + 1, 0


def token_counts(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of each row of (doc_id, text). Workers read the vocabulary ``file`` where they run."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = kept(("counts", file), lambda: (Unigram(file), {}))
        for ids, texts in blocks(batches):
            split = [t.split() if t else [] for t in texts]
            fresh: set[bytes] = set()
            for words in split:
                fresh.update(filterfalse(known.__contains__, words))
            if len(known) + len(fresh) > CACHE:
                known.clear()
                fresh = set().union(*split)
            new = list(fresh)
            known.update(zip(new, trie_counts([b" " + w for w in new], model), strict=True))
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in split], pa.int64()), pa.array([sum(map(known.__getitem__, w)) for w in split], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(count, f"doc_id {kind}, n_pretokens bigint, n_tokens bigint")
