import hashlib
import time

from pyspark.sql import functions as F

from pixelloom.llm import line_dedup as L


def slow(rows):
    """(doc_id, text) -> kept text, lines, kept lines, removed chunks."""
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % L.PRIME
    docs = {}
    for doc_id, text in rows:
        if text is None:
            continue
        lines, chunks, held = text.split("\n"), [], []
        for i, line in enumerate(lines):
            held.append(line)
            roll = sum(h(lines[i - k]) * pow(L.BASE, k, L.PRIME) for k in range(L.WINDOW) if i >= k) % L.PRIME
            if roll % L.SPACING == 0 or i == len(lines) - 1:
                chunks.append(held)
                held = []
        docs[(doc_id, text)] = chunks
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, hashlib.md5(d[1].encode()).hexdigest()))
    seen, out = set(), {}
    for d in order:
        kept, removed = [], 0
        for c in docs[d]:
            if len(c) > 1 and tuple(c) in seen:
                removed += 1
            else:
                kept += c
            seen.add(tuple(c))
        out[d] = ("\n".join(kept), sum(map(len, docs[d])), len(kept), removed)
    return sorted(str((d, t, *(out[(d, t)] if t is not None else (None, 0, 0, 0)))) for d, t in rows)


def got(spark, rows):
    docs = spark.createDataFrame([(d, t, t) for d, t in rows], "doc_id bigint, text string, was string")
    return sorted(str((r.doc_id, r.was, r.text, r.n_lines, r.n_kept, r.n_removed)) for r in L.line_dedup(docs).collect())


def test_against_brute_force(spark, docs):
    shared = "\n".join(f"line {k} of a long passage" for k in range(60))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(300 + k, f"own start {k}\n{shared}\nown end {k}") for k in range(9)] + [(320, shared + "\n" + shared), (321, "\n\n\n\n\n\n"), (322, "\n\n\n\n\n\n")]
    assert got(spark, rows) == slow(rows)
    freed = [r for r in got(spark, rows) if r.startswith("(308")]
    assert freed and "long passage" in freed[0]


def test_no_python_in_the_plan(spark, docs):
    plan = L.line_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_other_columns_go_through_whatever_their_names(spark, docs):
    names = ["chunk_lines", "chunk_hashes", "chunk_text", "gone_id", "gone_text", "chunk_gone", "gone", "row", "id", "key", "h", "kept", "marked", "mark_row", "first"]
    clash = docs.withColumns({n: F.concat_ws("/", F.lit(n), F.col("doc_id")) for n in names})
    out = L.line_dedup(clash)
    assert out.columns == clash.columns + ["n_lines", "n_kept", "n_removed"]
    want = sorted(str(tuple(r)) for r in clash.drop("text").collect())
    assert sorted(str(tuple(r)) for r in out.select([c for c in clash.columns if c != "text"]).collect()) == want


def test_frequent_chunks_meet_their_first_by_broadcast(spark, monkeypatch):
    """With a low bar for hot chunks and few bits in a bitmap the rows are the same."""
    shared = "\n".join(f"line {k} of a long passage" for k in range(30))
    rows = [(k, f"start {k}\n{shared}\nend {k}\nof {k}") for k in range(60)] + [(100 + k, f"a {k}\nb {k}") for k in range(20)]
    monkeypatch.setattr(L, "LEAST_HOT", 5)
    monkeypatch.setattr(L, "MARKS", L.ROW)
    assert got(spark, rows) == slow(rows)


def test_many_hashes_are_joined(spark, monkeypatch, docs):
    """Past what a bitmap holds the rows are the same."""
    monkeypatch.setattr(L, "FILLED", L.MARKS)
    shared = "\n".join(f"line {k} of a long passage" for k in range(40))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(300 + k, f"own start {k}\n{shared}\nown end {k}") for k in range(9)]
    assert got(spark, rows) == slow(rows)


def test_work_grows_with_repeated_lines(spark):
    """A million lines, all of whose chunks go: no step takes the square of them."""
    text = "\n".join(f"line {k}" for k in range(1_000_000))
    docs = spark.createDataFrame([(1, text), (2, text + "\nend")], "doc_id bigint, text string")
    begun = time.monotonic()
    rows = {r.doc_id: (r.n_lines, r.n_kept) for r in L.line_dedup(docs).select("doc_id", "n_lines", "n_kept").collect()}
    assert rows[1] == (1_000_000, 1_000_000) and rows[2][0] == 1_000_001 and rows[2][1] < 400_000
    assert time.monotonic() - begun < 90


def test_clashing_columns_and_empty_table(spark, docs, no_docs):
    clash = docs.withColumnsRenamed({"n_chars": "n_kept", "lang": "chunk"})
    out = L.line_dedup(clash)
    assert out.columns == ["doc_id", "text", "chunk", "source", "n_lines", "n_kept", "n_removed"]
    assert out.count() == docs.count()
    assert L.line_dedup(no_docs).count() == 0
