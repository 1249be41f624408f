import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pixelloom.llm import manifest as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climbed(digests):
    """Levels from the leaves to the root."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        run = level[i - i % 3 : i - i % 3 + 3]
        yield run[: i % 3], run[i % 3 + 1 :]
        i //= 3


def slow(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        leaf = H(*map(told, (r.doc_id, r.source, r.lang, r.n_chars, r.text)))
        changed = None
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
            changed = H(*map(told, (r.doc_id, r.source, r.lang, r.n_chars, None if r.text is None else r.text.replace("\n", ""))))
        trees.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf, changed, r.doc_id))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: x[:3])
    below = [climbed([x[2] for x in trees[s]]) for s in names]
    top, out = climbed([b[-1][0] for b in below]), []
    for k, s in enumerate(names):
        for i, (_, _, leaf, changed, doc_id) in enumerate(trees[s]):
            way = [*siblings(below[k], i), *siblings(top, k)]
            now = changed or leaf
            for left, right in way:
                now = H(*left, now, *right)
            out.append((str(doc_id), leaf, below[k][-1][0], top[-1][0], H(*[d for a, b in way for d in a + b]), now, now == top[-1][0]))
    return sorted(out)


def got(docs, **options):
    found = M.proven(M.leaves_of(docs), **options)
    siblings_of = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    root = M.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    rows = found.select(F.col("doc_id").cast("string"), "leaf", "subroot", "root", F.sha2(siblings_of, 256), root, root == F.col("root"))
    return sorted((str(r[0]), *r[1:]) for r in rows.collect())


@pytest.mark.parametrize("options", [{}, {"rows_a_part": 5, "fan": 2}, {"rows_a_part": 11, "fan": 3}])
def test_against_plain_trees(spark, docs, options):
    assert got(docs, **options) == slow(docs.collect())


def test_tampering_shows(spark, docs):
    rows = slow(docs.collect())
    assert {r[-1] for r in rows} == {True, False}
    assert got(docs) == rows


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_trees_of_every_height(spark, n):
    rows = [(k, f"t\n{k}", "en", f"s{k % 4:02}" if n > 4 else "s", k) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert got(docs, rows_a_part=2, fan=2) == slow(docs.collect())


def test_many_sources_and_a_hot_one(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, f"text {k}\n", None, "hot" if k % 3 == 0 else rng.choice([None, "", "é", *(f"s{j}" for j in range(40))]), k) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = slow(docs.collect())
    assert got(docs, rows_a_part=20, fan=4) == want
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)  # runs and trees are joined by shuffle
    assert got(docs, rows_a_part=50, fan=4) == want


def test_repeated_rows_are_leaves_each(spark):
    docs = spark.createDataFrame([(1, "a\nb", "en", "s", 3)] * 40 + [(None, None, None, None, None)] * 5, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert got(docs, rows_a_part=7, fan=2) == slow(docs.collect())


def test_forests_merge_in_any_order():
    rng = random.Random(5)
    digests = {0: [H(f"a{k}") for k in range(50)], 1: [H(f"b{k}") for k in range(3)], 2: [H("c")]}
    sizes = {t: len(d) for t, d in digests.items()} | {M.TOP: 3}
    nodes = [((t, 0, k), d) for t, ds in digests.items() for k, d in enumerate(ds)]
    root = climbed([climbed(digests[t])[-1][0] for t in range(3)])[-1][0]
    for _ in range(5):
        rng.shuffle(nodes)
        parts = [nodes[k::7] for k in range(7)]
        while len(parts) > 1:  # any two forests give one; only open nodes go on
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
            forest = M.Forest(sizes)
            for node, digest in a + b:
                forest.add(node, digest)
            parts.append([(n, forest.digests[n]) for n in forest.open])
        ((node, digest),) = parts[0]
        assert digest == root and node == (M.TOP, 1, 0)


def test_few_nodes_wait(spark):
    """A run of m rows leaves a number of nodes that grows with log m."""
    forest = M.Forest({0: 10**6, M.TOP: 1})
    for k in range(5_000, 25_000):
        forest.add((0, 0, k), H(str(k)))
    assert len(forest.open) <= 4 * 10


def test_long_texts_clashing_columns_and_empty_table(spark, docs, no_docs):
    names = ["row", "name", "rank", "digest", "own_number", "at", "part", "tree", "level", "place", "size", "run_part", "steps"]
    clash = docs.withColumns({n: F.lit("z") for n in names})
    assert got(clash) == slow(docs.collect())
    rows = M.leaves_of(docs).withColumns({n: F.lit("z") for n in names})
    assert M.proven(rows).columns == [*rows.columns, "subroot", "root", "proof"]
    assert M.proven(rows).select("root").distinct().count() == 1
    assert got(no_docs) == []
