import hashlib
import re
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from pixelloom.llm import filter_audit as A

LABELS = "doc_id bigint, quality int, toxic int"


def slow_failures(rows):
    """(part, set of letters, doc_id) of each row, by the words of the contract."""
    out = []
    for r in rows:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if r.doc_id is not None and any(o.doc_id is not None and o.doc_id < r.doc_id and (o.text or "") == text for o in rows):
            fails.add("E")
        out.append((r.source or "", fails, r.doc_id))
    return out


def slow(rows, labels):
    """Every order by itself, documents removed one filter after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for part, fails, doc_id in slow_failures(rows):
        parts[part].append((fails, doc_id))
    out = []
    for part, docs in parts.items():
        shapley, lines = defaultdict(int), []
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                lost, left, before = [d for d in left if f in d[0]], [d for d in left if f not in d[0]], left
                failing = [d for d in docs if f in d[0]]
                shapley[f] += len(lost)
                lines.append(("".join(order), k + 1, f, len(left), len(lost), len(failing) - len([d for d in before if f in d[0]]), sum(d[0] == {f} for d in docs), sum(d[1] in good for d in lost), sum(d[1] in toxic for d in lost)))
        out += [(part, order, step, *counts, shapley[f]) for order, step, f, *counts in lines]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus(spark, docs):
    words = " ".join(f"word{k}" for k in range(250))
    more = [(400, words, "en", "b", 1), (401, words, "en", None, 1), (402, words + " #", "en", "", 1), (403, "same " * 300, "en", "b", 1), (404, words.upper(), "en", "c", 1), (None, words, "en", "c", 1), (405, None, "en", "c", 1), (399, words + " é", "en", "a", 1)]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in (*range(1, 60), *range(399, 406))] + [(10, 1, None), (11, 0, 1), (None, 1, 1), (12, None, None), (9999, 1, 1)]
    return docs.unionByName(spark.createDataFrame(more, docs.schema)), labels


def test_whole_audit(spark, corpus):
    docs, labels = corpus
    got = A.audit(A.with_labels(A.failures(docs), spark.createDataFrame(labels, LABELS)))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == slow(docs.collect(), labels)


def test_failures(spark, corpus):
    docs, _ = corpus
    got = sorted((r.part, "".join(f for k, f in enumerate("ABCDE") if r.failed >> k & 1), str(r.doc_id)) for r in A.failures(docs).collect())
    assert got == sorted((p, "".join(sorted(f)), str(i)) for p, f, i in slow_failures(docs.collect()))
    assert {f for _, f, _ in got} >= {"", "E", "D"}


def test_prefixes_are_shared(spark, monkeypatch):
    """Each set of filters is run once, not each order of it, and removes from what was left before."""
    made = []
    whole = A.saved
    monkeypatch.setattr(A, "saved", lambda df, name: made.append(name) or whole(df, name))
    rows = spark.createDataFrame([("p", k % 32, 1, 0) for k in range(64)], "part string, failed int, good int, toxic int")
    left = {r.prefix: r.n for r in A.survivors(rows, 5).groupBy("prefix").agg(F.count("*").alias("n")).collect()}
    assert sorted(made) == sorted(f"audit-{k}" for k in range(31))
    assert left == {k: 2 * 2 ** (5 - k.bit_count()) for k in range(31)}


def test_other_numbers_of_filters(spark):
    rows = spark.createDataFrame([("p", 0, 0, 0), ("p", 1, 1, 0), ("p", 3, 0, 1), ("q", 2, 0, 0)], "part string, failed int, good int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in A.audit(rows, "XY").collect()}
    assert got == {
        ("p", "XY", 1): (1, 2, 0, 1, 1, 1, 3),
        ("p", "XY", 2): (1, 0, 1, 0, 0, 0, 1),
        ("p", "YX", 1): (2, 1, 0, 0, 0, 1, 1),
        ("p", "YX", 2): (1, 1, 1, 1, 1, 0, 3),
        ("q", "XY", 1): (1, 0, 0, 0, 0, 0, 0),
        ("q", "XY", 2): (0, 1, 0, 1, 0, 0, 2),
        ("q", "YX", 1): (0, 1, 0, 1, 0, 0, 2),
        ("q", "YX", 2): (0, 0, 0, 0, 0, 0, 0),
    }


def test_long_text_and_copies_of_many(spark, monkeypatch):
    from pixelloom.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 5)
    rows = [(k, "the same text", "x", "a", 1) for k in range(200)] + [(500, "w " * 500_000, "x", "a", 1), (501, "#" + "v" * 3_000_000, "x", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    failed = {r.doc_id: r.failed for r in A.failures(docs).collect()}
    assert [failed[k] for k in (0, 1, 199, 500, 501)] == [1, 17, 17, 2, 9]
    labels = spark.createDataFrame([(k, 1, 1) for k in range(0, 600, 2)], LABELS)
    got = A.audit(A.with_labels(A.failures(docs), labels)).filter("filter_order = 'EABCD' and step = 1 and part = 'a'").first()
    assert (got.kept, got.removed, got.good_lost, got.toxic_lost) == (2, 199, 99, 99)


def test_clashing_columns_and_empty_tables(spark, docs, no_docs):
    labels = spark.createDataFrame([], LABELS)
    names = ["part", "failed", "digest", "key", "first", "n", "good", "toxic", "prefix", "filter", "states"]
    clash = docs.withColumns({n: F.lit("z") for n in names})
    got, want = (sorted(map(str, A.audit(A.with_labels(A.failures(d), labels)).collect())) for d in (clash, docs))
    assert got == want and len(got) == 600 * docs.select(F.coalesce("source", F.lit(""))).distinct().count()
    assert A.audit(A.with_labels(A.failures(no_docs), labels)).count() == 0


def test_digests_tell_texts_apart():
    assert hashlib.sha256(b"").digest() != hashlib.sha256(b" ").digest()
    assert A.own_failures(b"") == 1 and A.own_failures("É".encode() * 3) == 1 and A.own_failures(b"A" + b"b" * 48) == 5 and A.own_failures(b"A" + b"b" * 49) == 1
