import random
import re
import time

import numpy as np
import pytest

from pixelloom.llm import decontaminate as D


def slow_words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))


def slow(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = slow_words(text), set(), set()
        for item, body in items:
            q = slow_words(body)
            n = min(10, len(q))
            for a in range(len(q) - n + 1) if n else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == q[a : a + n]:
                        hit |= {*range(b, b + n)}
                        found.add(str(item) if item is not None else "")
        out.append((str(doc_id), len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(11)
    few = ["a", "b", "Ç", "d4"]
    items = [(k, " ".join(rng.choice(few) for _ in range(rng.choice([0, 1, 3, 6, 9, 10, 11, 14, 25])))) for k in range(25)]
    items += [(3, items[5][1]), (None, "a d4-b,Ç a"), (30, None), (31, ""), (32, "!!"), (33, " ".join(f"w{i}" for i in range(40)))]
    docs = [(k, ", ".join(rng.choice([*few, "zz"]) for _ in range(rng.randint(0, 60)))) for k in range(40)]
    docs += [(100 + k, f"before {items[k][1].upper()} after. {items[k][1]}") for k in range(25)]
    docs += [(200, None), (201, ""), (None, "clean text"), (202, " ".join(f"W{i}" for i in range(7, 17))), (203, " ".join(f"w{i}" for i in range(7, 16))), (100, "same id but clean"), (204, "x " * 50_000 + " ".join(f"w{i}" for i in range(40)))]
    return docs, items


def found(spark, case, **options):
    docs = spark.createDataFrame(case[0], "doc_id bigint, text string")
    items = spark.createDataFrame(case[1], "item_id bigint, text string")
    rows = D.find(docs, items, **options).collect()
    return sorted((str(r.doc_id), r.n_words, sum(s.end - s.begin for s in r.spans), sorted(r["items"])) for r in rows)


def test_windows_by_brute_force(spark, case):
    assert found(spark, case) == slow(*case)


def test_benchmark_in_blocks(spark, case):
    assert found(spark, case, block_bytes=2000) == slow(*case)


def test_large_benchmarks_are_joined(spark, case, monkeypatch):
    """However large: one pass over the documents, with full bitmaps, hot windows and hot rows the same result."""
    from pixelloom.llm import common, line_dedup

    want = slow(*case)
    scans = []
    whole = D.by_join
    monkeypatch.setattr(D, "by_join", lambda *a: scans.append(1) or whole(*a))
    for block in (0, 100, 10_000):
        scans.clear()
        assert found(spark, case, block_bytes=block) == want
        assert len(scans) == (block < 10_000)
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    monkeypatch.setattr(line_dedup, "MARKS", line_dedup.ROW)
    monkeypatch.setattr(D, "MARKS", line_dedup.ROW)
    assert found(spark, case, block_bytes=0) == want
    assert found(spark, (case[0] + case[0], case[1]), block_bytes=0) == sorted(want + want)


def test_clean_rows_stay(spark, case):
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in case[0]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    items = spark.createDataFrame(case[1], "item_id bigint, text string")
    want = sorted((str(d), str(t)) for (d, t) in case[0] if not slow([(d, t)], case[1])[0][2])
    for options in ({}, {"block_bytes": 2000}, {"block_bytes": 0}):
        kept = D.decontaminate(docs, items, **options)
        assert kept.columns == docs.columns
        assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == want


def test_repeated_words_by_brute_force():
    """Items and texts of few words, over and over, in periods and with edges."""
    rng = random.Random(12)
    few = ["a", "a", "a", "b"]
    items = [(0, "a " * 30), (1, "a b " * 15), (2, "a " * 12 + "b"), (3, "b " + "a " * 11), (4, "a " * 4), (5, "a b a"), (6, "a " * 30)] + [(k, " ".join(rng.choice(few) for _ in range(40))) for k in range(7, 12)]
    docs = [(0, "a " * 200), (1, "b a " * 60), (2, "c " + "a " * 12 + "b c"), (3, "a " * 9), (4, "b b b")] + [(k, " ".join(rng.choice([*few, "c"]) for _ in range(rng.randint(1, 80)))) for k in range(5, 30)]
    index = D.Index([(str(i), t.encode()) for i, t in items])
    got = [(str(d), n, sum(b - a for a, b in spans), names) for (d, _), (n, spans, names) in zip(docs, D.spans(index, [t.encode() for _, t in docs]), strict=True)]
    assert sorted(got) == slow(docs, items)


def test_repetition_costs_its_length():
    index = D.Index([("one", b"same " * 2000), ("two", b"same " * 2000)])
    began = time.perf_counter()
    assert list(D.spans(index, [b"same " * 50_000, None, b"same " * 9])) == [(50_000, [(0, 50_000)], ["one", "two"]), (0, [], []), (9, [], [])]
    assert time.perf_counter() - began < 2


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    """With a hash of one bit nearly all windows collide until the salt changes; nothing is lost or added."""
    plain = D.gram_hashes
    ids = np.array([0, 1, 2, 3, 0, 4, 5, 6, 0], np.int64)
    calls = []
    monkeypatch.setattr(D, "gram_hashes", lambda x, n: plain(x, n) & np.uint64(0) if not calls.append(1) and len(calls) < 2 else plain(x, n))
    w = D.Windows(ids, np.array([0, 0, 0, 0, 1, 1, 1, 1, -1]), np.array([1, 5]), 3)
    assert w.salt == 1 and [x.tolist() for x in w.found(ids, np.array([0, 1, 2, 5]))] in ([[1, 5], [0, 1]], [[1, 5], [1, 0]])


def test_empty_tables(spark, no_docs, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.find(no_docs, none).count() == 0
    assert D.decontaminate(docs, none).count() == docs.count()
