import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pixelloom.llm import simhash as S


def slow_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(prints):
    """Smallest doc_id of each one's component. prints: list of (doc_id, fp)."""
    root, least = slow_roots(prints), {}
    for (doc_id, _), r in zip(prints, root, strict=True):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return [least.get(r) for r in root]


def slow_roots(prints):
    n, root = len(prints), list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_whole_operator(spark, docs):
    rows = docs.collect()
    prints = [(r.doc_id, slow_print(r.text)) for r in rows]
    want = sorted((str(d), f"{fp:016x}", str(c)) for (d, fp), c in zip(prints, slow_components(prints), strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in S.near_duplicates(docs).collect())
    assert got == want


def clustered(rng, n):
    """Fingerprints in chains and tight groups, with far ones between."""
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 40])):
            out.append(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 5, 9])):
                x ^= 1 << b
    return list(dict.fromkeys(out))[:n]


def test_join_finds_all_links(spark):
    rng = random.Random(3)
    prints = [(i, fp) for i, fp in enumerate(clustered(rng, 500))]
    want = dict(zip(range(len(prints)), slow_components(prints), strict=True))
    df = spark.createDataFrame([(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in prints], "doc_id bigint, fp bigint")
    for tile in (S.TILE, 7):  # 7: every larger bucket is dealt out in tiles
        got = {r.doc_id: r.component_id for r in S.components(df, tile=tile).collect()}
        assert got == want


def test_finer_cuts_lose_nothing():
    rng = random.Random(5)
    values = np.array(clustered(rng, 300), np.uint64)
    whole = slow_components([(i, int(v)) for i, v in enumerate(values)])
    for spare in (1, 2, 3, 4):
        a, b = [], []
        for front, order in S.layout(spare):
            t = S.turned(values, order)
            at = np.argsort(t)
            child, parent = S.trie_forest(t[at], t[at] >> np.uint64(64 - front), 64 - front)
            a += at[child].tolist()
            b += at[parent].tolist()
        root = S.components_of(len(values), np.array(a, np.int64), np.array(b, np.int64), np.arange(len(values)))
        assert root.tolist() == whole


def test_one_of_each_group_stays(spark, docs):
    """Texts are compared, not ids: an id may be null or name several texts."""
    rows = docs.collect()
    prints = [(r.doc_id, slow_print(r.text)) for r in rows]
    of_row, want = {}, {}
    for r, root, least in zip(rows, slow_roots(prints), slow_components(prints), strict=True):
        of_row[tuple(r)] = root
        want[root] = least
    kept = S.near_duplicates_removed(docs)
    assert kept.columns == docs.columns
    got = [(of_row[tuple(r)], r.doc_id) for r in kept.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.items()))


def test_unlike_texts_without_an_id_or_with_one_stay(spark):
    rows = [(None, " ".join(f"t{k}w{i}" for i in range(40)), k) for k in range(10)] + [(7, "first text under this id", 10), (7, "another one, quite unlike it in all of its words", 11)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, root int").withColumns({"simhash_row": F.col("root"), "gone_id": F.col("root"), "component_id": F.col("root"), "others": F.col("root"), "fp": F.col("root"), "key": F.col("root"), "whole": F.col("root")})
    for given in ({}, {"shingle": 5, "similarity": 0.8}):
        kept = S.near_duplicates_removed(docs, **given)
        assert kept.columns == docs.columns
        assert sorted(kept.collect(), key=lambda r: r.root) == sorted(docs.collect(), key=lambda r: r.root)


def test_empty_table(spark, no_docs):
    assert S.near_duplicates(no_docs).count() == 0
    assert S.near_duplicates_removed(no_docs).count() == 0


def test_copies_of_a_similarity(spark):
    """Nearly all pairs of 0.8 and more are found, and none of 0.5 and less."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    rows, want = [], {}
    for g in range(120):
        text = [rng.choice(words) for _ in range(rng.choice([60, 200, 600]))]
        rows.append((10 * g, " ".join(text)))
        shingles = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        for k, share in enumerate((0.005, 0.02, 0.3), 1):
            other = [w if rng.random() > share else rng.choice(words) for w in text]
            more = {tuple(other[i : i + 5]) for i in range(len(other) - 4)}
            want[(10 * g, 10 * g + k)] = len(shingles & more) / len(shingles | more)
            rows.append((10 * g + k, " ".join(other)))
    found = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=5, similarity=0.8).collect()}
    near = [found[b] == found[a] for (a, b), j in want.items() if j >= 0.8]
    far = [found[b] == found[a] for (a, b), j in want.items() if j <= 0.5]
    assert len(near) > 100 and sum(near) / len(near) > 0.95
    assert len(far) > 100 and not any(far)
    assert all(c // 10 == d // 10 for d, c in found.items())


def test_wide_forest_by_brute_force():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (12, 4), dtype=np.uint64)
    rows = [b.copy() for b in base for _ in range(9)]
    for k, r in enumerate(rows):
        for bit in rng.integers(64 if k % 3 else 0, 256, rng.integers(0, 30)):  # many agree in the first word
            r[bit // 64] ^= np.uint64(1 << int(bit % 64))
    values = np.array(rows)
    values = values[np.argsort(values[:, 0], kind="stable")]
    child, parent = S.trie_forest(values[:, 0].copy(), np.zeros(len(values), int), 64, 40, values[:, 1:].T.copy())
    got = S.components_of(len(values), child, parent, np.arange(len(values)))
    want = np.arange(len(values))
    near = np.array([[int(np.bitwise_count(a ^ b).sum()) <= 40 for b in values] for a in values])
    for _ in range(len(values)):
        want = np.array([want[near[i]].min() for i in range(len(values))])
    assert got.tolist() == want.tolist()


def test_a_row_of_each_group_stays_whatever_its_ids(spark):
    """Null ids of unlike texts, one id in two groups, a null id beside a near copy with an id."""
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(30))
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (None, text(3)), (5, text(4)), (5, text(5)), (6, text(5)), (7, text(6)), (None, text(6)), (8, text(7))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = [(None, text(1)), (None, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (7, text(6)), (8, text(7))]
    for given in ({}, {"shingle": 5, "similarity": 0.8}):
        kept = S.near_duplicates_removed(docs, **given)
        assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))


def jaccard_components(texts, similarity=0.8):
    """Smallest place that links lead to; a link is a pair of this similarity of 5-word shingles."""
    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for _ in texts:
        before = root[:]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if len(a & b) / len(a | b) >= similarity:
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            return root


def test_links_are_pairs_of_the_similarity(spark):
    """Short copies of 0.8 and more are all linked, and pairs just below it aren't, long or short, in tiles or not."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(5000)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    texts = []
    for n in (5, 8, 9, 12, 20, 36, 37, 44, 45):
        for _ in range(6):
            base = draw(n)
            texts += [" ".join(base), " ".join(base + draw(1)), " ".join(base + draw(max(1, (n - 4) // 4))), " ".join(base + draw(max(1, (n - 4) // 4) + 1))]
    for _ in range(30):  # 0.74 to 0.79 of 104 shingles: within 46 bits mostly
        base = draw(104)
        texts += [" ".join(base), " ".join(base + draw(rng.randint(27, 35)))]
    want = jaccard_components(texts)
    found = S.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), shingle=5, similarity=0.8)
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(want))
    sets = [np.unique(S.hashes_of(t.encode(), 5)) for t in texts]
    child, parent = S.alike(sets, 0.8)
    assert S.components_of(len(sets), child, parent, np.arange(len(sets))).tolist() == want


def test_large_groups_are_compared_in_tiles(spark):
    rng = random.Random(10)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base + [f"x{rng.randrange(9)}" for _ in range(rng.randint(0, 30))]) for _ in range(80)]
    docs = S.with_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    distinct = S.distinct_prints(S.saved(S.wide_fingerprints(docs, 5), "prints"))
    links = S.similar_links(distinct, docs, 5, 0.8, part=7)
    root = {r.fp: r.component_id for r in S.named_components(distinct, links).collect()}
    assert set(root.values()) == set(jaccard_components(texts))


def test_exact_links_miss_none(spark, monkeypatch):
    """Texts of every length that share a common passage, near 0.8 on both sides: with a prefix filter all links are there."""
    monkeypatch.setattr(S, "CROWDED", 4)
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    passage, texts = draw(30), ["", " "]
    for _ in range(25):
        base = draw(rng.choice([3, 10, 40, 90, 150])) + passage
        n = len(base) - 4
        texts.append(" ".join(base))
        texts += [" ".join(base + draw(max(1, round(n * share)))) for share in (0.15, 0.24, 0.25, 0.26, 0.4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = jaccard_components(texts)
    for part in (S.PART, 9):
        monkeypatch.setattr(S, "PART", part)
        found = S.near_duplicates(docs, shingle=5, similarity=0.8, exact=True)
        assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(want))
    kept = S.near_duplicates_removed(docs, shingle=5, similarity=0.8, exact=True)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_texts_of_rows_that_stay_are_not_shuffled(spark, monkeypatch):
    """Only rows that are marked go on to the join; past what a bitmap holds, all are joined, with the same rows."""
    from pixelloom.llm import line_dedup

    docs = spark.createDataFrame([(k, f"text {k // 2 if k < 40 else k}") for k in range(400)], "doc_id bigint, text string")
    rows = S.with_rows(docs)
    kept = rows.filter("doc_id >= 40 or doc_id % 2 = 0").select(S.ROW)
    want = sorted(r.doc_id for r in rows.join(kept, S.ROW, "left_semi").collect())
    left = S.without_rows(rows, kept)
    assert sorted(r.doc_id for r in left.collect()) == want
    plan = left._jdf.queryExecution().executedPlan().toString()
    stays = plan.split("Union\n")[1].split("\n      +- ")[0]
    assert "BroadcastHashJoin" in stays and "hashpartitioning" not in stays and "hashpartitioning" in plan
    monkeypatch.setattr(line_dedup, "FILLED", line_dedup.MARKS)
    assert sorted(r.doc_id for r in S.without_rows(rows, kept).collect()) == want
