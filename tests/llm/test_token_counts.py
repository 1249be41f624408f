import math
import random
import time
from functools import cache

import public_tokenizers

from pixelloom.llm import token_counts as C

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def slow_pieces(rank_file):
    import base64

    ranks = dict(line.split() for line in open(rank_file, "rb"))
    return {base64.b64decode(k): -round(1000 * math.log(int(v) + 10)) for k, v in ranks.items()}


def slow_count(word, pieces):
    best = [(0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        ways = [(best[a][0] + pieces[word[a:end]], best[a][1] - 1) for a in range(max(0, end - 128), end) if word[a:end] in pieces]
        best[end] = max(ways)
    return -best[-1][1]


def test_every_document_by_brute_force(spark, docs):
    pieces = slow_pieces(FILE)
    count = cache(lambda w: slow_count(w, pieces))
    want = sorted((str(r.doc_id), len(r.text.encode().split()) if r.text else 0, sum(count(b" " + w) for w in r.text.encode().split()) if r.text else 0) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_pretokens, r.n_tokens) for r in C.token_counts(docs, FILE).collect()) == want


def test_long_and_odd_words():
    pieces, model = slow_pieces(FILE), C.Unigram(FILE)
    words = [b" " + w for w in (b"x" * 3000, b"international", b"internationally", b"intern", bytes(range(128, 256)), b"\0\0\0\0\0\0\0\0a", b"\0a", "日本語日本語".encode(), b"a")]
    assert C.trie_counts(words, model) == [slow_count(w, pieces) for w in words]
    assert C.trie_counts([], model) == []


def test_scores_of_a_unigram_model(spark, tmp_path):
    """A file of pieces and scores: the best split is by them, and bytes without a piece are pieces of their own."""
    file = tmp_path / "pieces.tsv"
    file.write_text("\u2581ab\t-1.5\n\u2581a\t-0.5\nb\t-0.75\nc\t-2\nbc\t-4.0\nabc\t-9\n\u2581\t-1\n", encoding="utf-8")
    pieces = {b" ab": -1.5, b" a": -0.5, b"b": -0.75, b"c": -2.0, b"bc": -4.0, b"abc": -9.0, b" ": -1.0}
    pieces |= {bytes([k]): -19.0 for k in range(256) if bytes([k]) not in pieces}
    words = [b" ab", b" abc", b" a", b" cab", b" \xff", b" abcabc", "\u00e9".encode()]
    assert C.trie_counts(words, C.Unigram(str(file))) == [slow_count(w, pieces) for w in words] == [2, 3, 1, 4, 2, 4, 2]
    docs = spark.createDataFrame([(1, "ab abc"), (2, None)], "doc_id bigint, text string")
    assert sorted(map(tuple, C.token_counts(docs, str(file)).collect())) == [(1, 2, 5), (2, 0, 0)]


def test_empty_table(spark, no_docs):
    assert C.token_counts(no_docs, FILE).count() == 0


def test_pieces_of_more_than_two_words():
    """The vocabulary is the whole rank file: pieces of 17 to 128 bytes count as well."""
    import base64

    pieces = {base64.b64decode(k): -round(1000 * math.log(int(v) + 10)) for k, v in (line.split() for line in open(FILE, "rb"))}
    longest = max(map(len, pieces))

    def count(word):
        best = [(0, 0)]
        for end in range(1, len(word) + 1):
            best.append(max((best[a][0] + pieces[word[a:end]], best[a][1] - 1) for a in range(max(0, end - longest), end) if word[a:end] in pieces))
        return -best[-1][1]

    long = [p for p in pieces if len(p) > 16]
    assert len(long) == 72
    words = [w for p in long for w in (p, b" " + p, p + b"s", p + p, p[:-1], b" x" + p + b"-y")] + [b" " + b"-" * n for n in range(1, 300, 7)]
    model = C.Unigram(FILE)
    assert C.trie_counts(words, model) == [count(w) for w in words]
    assert C.trie_counts([b" responsibilities", b" telecommunications", b" cryptocurrencies"], model) == [1, 1, 1]


def test_both_walks_agree(monkeypatch):
    """Level by level and depth first give the same, whatever prefixes words share."""
    rng = random.Random(4)
    words = sorted({b" " + bytes(rng.choice(b"abcint-\xe6\x97") for _ in range(rng.randint(0, 40))) for _ in range(300)} | {b" internation" + bytes([k]) for k in range(97, 123)} | {b" telecommunications" * k for k in range(1, 5)})
    rng.shuffle(words)
    model = C.Unigram(FILE)
    found = []
    for few in (0, 50, 10**9):
        monkeypatch.setattr(C, "FEW", few)
        found.append(C.trie_counts(words, model))
    assert found[0] == found[1] == found[2]


def test_long_unspaced_text_takes_seconds():
    """A pre-token of a megabyte, and many long ones that begin alike."""
    rng = random.Random(5)
    model, letters = C.Unigram(FILE), "abcdefghijklmnopqrstuvwxyz日本語"
    long = ("".join(rng.choice(letters) for _ in range(700_000))).encode()
    begun = time.monotonic()
    assert C.trie_counts([b" " + long], model)[0] > 100_000
    assert time.monotonic() - begun < 5
    begun = time.monotonic()
    same = [b" " + long[:100_000] + b"%d" % k for k in range(200)]
    assert len(C.trie_counts(same, model)) == 200
    assert time.monotonic() - begun < 5
