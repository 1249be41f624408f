import hashlib
import math
import os
import random
import shutil
import zlib
from collections import namedtuple

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline as P
from pixelloom.llm.toxicity import learn
from tests.llm.test_decontaminate import slow_words
from tests.llm.test_mixing import slow_targets

DATA = "/root/testdata/sf0.001"
Row = namedtuple("Row", "doc_id text lang source n_chars")
TABLES = ("documents", "labels", "benchmark")


def slow_jaccard_roots(texts, similarity=0.8):
    """A number for each text's component; links by the similarity of 5-word shingles, all pairs that share one compared."""

    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}

    sets, root, owners = [shingles(t) for t in texts], list(range(len(texts))), {}
    for i, s in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in owners[x] if j < i}:
            if len(s & sets[j]) / len(s | sets[j]) >= similarity:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def slow_contaminated(text, windows):
    w = slow_words(text)
    return any(tuple(w[b : b + n]) in found for n, found in windows.items() for b in range(len(w) - n + 1))


def last(v):
    """Nulls first, whatever the type."""
    return (v is not None, v if v is not None else 0)


def slow_pipeline(model, docs, items):
    """Rows of the last stage, by loops."""
    docs = [r for r in docs if model.chances([(r.text or "").encode()])[0, 0] < 0.5]
    groups = {}
    for root, r in zip(slow_jaccard_roots([r.text for r in docs]), docs, strict=True):
        groups.setdefault(root, []).append(r)
    kept = []
    for rows in groups.values():
        least = min((r.doc_id for r in rows if r.doc_id is not None), default=None)
        kept.append(min((r for r in rows if r.doc_id == least), key=lambda r: tuple((v is not None, v if v is not None else "") for v in r)))
    windows = {}
    for text in items:
        q = slow_words(text)
        n = min(10, len(q))
        for a in range(len(q) - n + 1) if n else ():
            windows.setdefault(n, set()).add(tuple(q[a : a + n]))
    kept = [r for r in kept if not slow_contaminated(r.text, windows)]
    sizes = {}
    for r in kept:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    targets = slow_targets(sizes)
    library, start, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    tie = lambda r: np.uint64(xxhash.xxh64_intdigest((r.text or "").encode(), 42)).view(np.int64)
    for r in sorted(kept, key=lambda r: (last(r.doc_id), tie(r))):
        rate = float(targets[r.source]) / sizes[r.source] if sizes[r.source] else 1.0
        u = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16) / 2**32
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        for _ in range(math.floor(rate) + (u < rate - math.floor(rate))):
            out.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Copies of the tables, with nulls in every column, shared ids, repeated rows, empty and long texts and columns that clash."""
    there = str(tmp_path_factory.mktemp("pipeline"))
    for name in TABLES:
        shutil.copyfile(f"{DATA}/{name}.parquet", f"{there}/{name}.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rng = random.Random(4)
    words = [f"w{k}x" for k in range(3000)]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b, c, long = body(50), body(60), body(9), body(30_000)
    more = [(None, body(30), "en", "s1", 1), (None, body(30), None, None, None), (None, a, "en", "s1", 1), (9001, a, "en", "s1", 1), (9002, b, "en", "s1", 1), (9002, body(40), "de", None, 2), (9003, b + " more", "en", "s2", 1),
            (9004, c, "en", "s2", 3), (9005, c + " q", "en", "s2", 3), (9006, None, "en", "s1", 0), (9007, "", "en", "s1", 0), (9008, " \n", "en", "s1", 0), (9009, long, "en", "s3", 1), (9010, long[:-20], "en", "s3", 1), (9011, body(20), "en", "", 1), (9011, body(20), "en", "", 1)]
    more += more[3:5]
    both = docs.unionByName(spark.createDataFrame(more, docs.schema))
    clash = both.selectExpr("*", "doc_id as copy_no", "text as simhash_row", "source as mix_source", "n_chars as size", "lang as fp")
    clash.coalesce(3).write.mode("overwrite").parquet(f"file://{there}/clash")
    os.remove(f"{there}/documents.parquet")
    os.rename(f"{there}/clash", f"{there}/documents.parquet")
    return there


def test_run_by_brute_force(spark, tables):
    read = lambda name: spark.read.parquet(f"file://{tables}/{name}.parquet")
    docs = read("documents").select(*Row._fields)
    model = learn(docs, read("labels"))
    want = slow_pipeline(model, [Row(*r) for r in docs.collect()], [r.text for r in read("benchmark").collect()])
    assert sum(d is None for d, *_ in want) > 1 and len(want) > 100
    assert sorted(map(tuple, P.run(spark, f"file://{tables}").collect()), key=lambda r: r[1]) == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing", "token records"]


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, DATA).count() == 0


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark", "labels benchmark"])
def test_run_over_empty_tables(spark, tmp_path, empty):
    """No documents: no records. No labels: nothing is toxic. No benchmark: nothing is contaminated."""
    for name in TABLES:
        table = spark.read.parquet(f"{DATA}/{name}.parquet")
        table = table.limit(0) if name in empty else table.filter("doc_id < 60") if name == "documents" else table
        table.write.parquet(f"file://{tmp_path}/{name}.parquet")
    rows = P.run(spark, f"file://{tmp_path}").collect()
    assert len(rows) == 0 if empty == "documents" else len(rows) > 30
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    if "labels" in empty:
        assert P.drop_toxic(spark, docs, f"file://{tmp_path}").count() == docs.count()
    if "benchmark" in empty:
        assert P.drop_contaminated(spark, docs, f"file://{tmp_path}").count() == docs.count()
