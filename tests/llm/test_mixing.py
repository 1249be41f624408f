import hashlib
import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pixelloom.llm import mixing as M


def slow_targets(sizes, weights=(3, 1, 2), budget=Fraction(3, 2), most=2):
    """Excess handed on, round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    held, total = {}, budget * sum(sizes.values())
    while len(held) < len(names):
        left, rest = total - sum(held.values()), [s for s in names if s not in held]
        over = [s for s in rest if left * w[s] / sum(w[r] for r in rest) > most * sizes[s]]
        if not over:
            return held | {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        held |= {s: Fraction(most * sizes[s]) for s in over}
    return held


def slow_mix(rows):
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    sizes = {}
    for r, n in zip(rows, words, strict=True):
        sizes[r.source] = sizes.get(r.source, 0) + n
    targets, out = slow_targets(sizes), []
    for r, n in zip(rows, words, strict=True):
        rate = float(targets[r.source]) / sizes[r.source] if sizes[r.source] else 1.0
        u = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16) / 2**32
        out.append((str(r.doc_id), n, sizes[r.source], float(targets[r.source]), n * (math.floor(rate) + (u < rate - math.floor(rate)))))
    return sorted(out)


def test_whole_mix(spark, docs):
    got = sorted((str(r.doc_id), r.size, r.source_size, r.target, r.taken) for r in M.mix(docs).collect())
    want = slow_mix(docs.collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_targets_of_many_sources(spark, monkeypatch):
    rng = random.Random(1)
    sizes = {f"s{k:03}": rng.choice([0, 1, 5, 100, 10_000]) for k in range(120)} | {None: 7, "é": 3}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    want = slow_targets(sizes)
    assert {r.source: r.target for r in M.source_targets(df).collect()} == pytest.approx({s: float(t) for s, t in want.items()})
    # many sources: the salted join gives the same rows
    docs = spark.createDataFrame([(k, "word " * (k % 7), f"s{k % 50}" if k % 50 else None) for k in range(400)], "doc_id bigint, text string, source string")
    few = sorted(map(str, M.mix(docs).collect()))
    monkeypatch.setattr(M, "BROADCAST_ROWS", 10)
    many = M.mix(docs)
    assert sorted(map(str, many.select(*M.mix(docs).columns).collect())) == few


def test_copies_and_columns(spark, docs):
    taken = {}
    for r in M.mix(docs).collect():
        taken[(r.doc_id, r.text)] = taken.get((r.doc_id, r.text), 0) + r.copies
    out = M.emitted(docs)
    assert out.columns == docs.columns
    seen = {}
    for r in out.collect():
        seen[(r.doc_id, r.text)] = seen.get((r.doc_id, r.text), 0) + 1
    assert seen == {k: n for k, n in taken.items() if n}
    clash = docs.withColumnsRenamed({"n_chars": "size", "lang": "rate"})
    assert M.mix(clash).select("size").agg({"size": "sum"}).first()[0] == sum(r.size for r in M.mix(docs).collect())


def test_columns_of_any_name_come_back(spark, docs):
    clash = docs.withColumns({n: F.concat_ws("/", F.lit(n), F.col("doc_id")) for n in ("copy_no", "mix_source", "mix_salt", "size", "rate", "target", "row", "copies")})
    out = M.emitted(clash)
    assert out.columns == clash.columns
    there = {str(tuple(r)) for r in clash.collect()}
    assert {str(tuple(r)) for r in out.collect()} <= there and out.count() == M.emitted(docs).count()
    assert M.mix(clash).select("mix_source", "copy_no", "row").distinct().count() == clash.select("mix_source", "copy_no", "row").distinct().count()


def test_another_seed_draws_others(spark):
    docs = spark.createDataFrame([(k, "w " * 5, "abc"[k % 3]) for k in range(400)], "doc_id bigint, text string, source string")
    taken = [{(r.doc_id, r.copies) for r in M.mix(docs, seed=s).collect()} for s in ("", "x", "x")]
    assert taken[0] != taken[1] and taken[1] == taken[2]


def test_empty_table(spark, no_docs):
    assert M.mix(no_docs).count() == 0
    assert M.emitted(no_docs).count() == 0
