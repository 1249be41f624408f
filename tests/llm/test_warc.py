import gzip
import hashlib
import random
import uuid
from collections import Counter

import pytest

from pixelloom.llm import warc as W


def page_rows():
    rng = random.Random(2)
    long = "".join(rng.choice("abc é\r\n") for _ in range(5000))
    rows = [(k, f"http://x/{k}", f"<p>{k}</p>" + "z" * rng.randint(0, 3000)) for k in range(20)]
    rows += [(100 + k, "http://copy", long) for k in range(5)] + [(104, "http://copy", long)]
    rows += [(200 + k, None, "short copy") for k in range(3)]
    rows += [(300, "u\r\nWARC/1.1", "a\r\n\r\nWARC/1.1\r\n\r\n0\r\n\r\n" * 200), (301, "u", None), (302, "u", ""), (None, "u", "x" * 2000), (303, "u", "x" * 2000), (None, "u", "y" * 2000), (None, "u", "y" * 2000)]
    return rows


def slow(rows):
    top = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            top[b] = max(top.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        of = top.get(b)
        revisit = of is not None and p != of
        out.append(str((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", of if revisit else None)))
    return sorted(out)


@pytest.mark.parametrize("segment", [W.SEGMENT, 700])
def test_round_trip(spark, tmp_path, segment):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = W.archive(pages, f"file://{tmp_path}/w", segment=segment).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == slow(rows)
    # responses hold their pages' html, each as often as it is there, and revisits nothing
    responses = {x for x in slow(rows) if "'response'" in x}
    entry = lambda p, b: str((p, len(b), hashlib.sha1(b).hexdigest(), "response", None))
    want = Counter((p, (h or "").encode()) for p, _, h in rows if entry(p, (h or "").encode()) in responses)
    assert Counter((r.page_id, bytes(r.payload)) for r in got if r.record_type == "response") == want
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    for r in got:
        if r.payload is not None:
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest


def archive_records(folder):
    """Fields and blocks of all records, each from a gzip member of its own."""
    out = []
    for f in sorted(folder.glob("part-*")):
        data = f.read_bytes()
        whole = gzip.decompress(data) if data else b""
        assert not whole or whole.endswith(b"\r\n\r\n")
        records = list(W.parsed(memoryview(data)))
        assert records == list(W.parsed(memoryview(whole)))
        members = [k for k in range(len(data)) if data[k : k + 4] == b"\x1f\x8b\x08\x00" and next(iter(W.parsed(memoryview(data)[k:])), None) in records]
        assert len(members) == len(records)
        out += records
    return out


def test_archives_are_warc_files(spark, tmp_path):
    rows = page_rows()
    W.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string"), f"file://{tmp_path}/w", segment=700)
    found = archive_records(tmp_path / "w")
    assert {f["warc-type"] for f, _ in found} == {"response", "revisit", "continuation"}
    ids = [f["warc-record-id"] for f, _ in found]
    assert len(set(ids)) == len(ids)
    by_id = {f["warc-record-id"]: f for f, _ in found}
    revisits = [f for f, _ in found if f["warc-type"] == "revisit"]
    for f in revisits:
        assert f["warc-refers-to-target-uri"] in ("http://copy", "u") and f["warc-refers-to-date"] == W.DATE
        if "warc-refers-to" in f:  # the response stands once
            of = by_id[f["warc-refers-to"]]
            assert of["warc-type"] == "response" and of["warc-payload-digest"] == f["warc-payload-digest"] and of["warc-page-id"] == f["warc-refers-to-page-id"]
    assert {f["warc-refers-to-page-id"] for f in revisits if "warc-refers-to" not in f} == {"104"} and any("warc-refers-to" in f for f in revisits)


def test_archives_are_read_together_and_others_too(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id bigint, url string, html string")
    for name in ("a", "b"):
        W.write_warc(pages, f"file://{tmp_path}/all/{name}", segment=700)
    assert W.read_warc(spark, f"file://{tmp_path}/all/*").count() == 2 * pages.count()
    # as other writers do it: one member, other types, no digest, a digest in hex, no pages' ids
    body = b"HTTP/1.1 200 OK\r\nX-Note: transfer-encoding: chunked\r\n\r\nhello"
    more = [("warcinfo", b"software: x", {}), ("response", body, {}), ("request", b"GET /", {}), ("response", body, {"WARC-Payload-Digest": f"sha1:{hashlib.sha1(b'hello').hexdigest()}"}), ("revisit", b"HTTP/1.1 200 OK\r\n\r\n", {"WARC-Payload-Digest": "md5:zz"})]
    data = b"".join(W.header({"WARC-Type": t, "WARC-Record-ID": f"<urn:x:{k}>", **f, "Content-Length": len(b)}) + b + b"\r\n\r\n" for k, (t, b, f) in enumerate(more))
    for name, content in (("part-one.warc.gz", gzip.compress(data)), ("part-plain.warc", data), ("part-padded.warc.gz", gzip.compress(data[:300]) + gzip.compress(data[300:]) + b"\0" * 20)):
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_bytes(content)
        got = W.read_warc(spark, f"file://{tmp_path}/{name}").collect()
        assert sorted((r.record_type, bytes(r.payload or b"")) for r in got) == [("response", b"hello")] * 2 + [("revisit", b"")]
    with pytest.raises(ValueError):
        list(W.parsed(memoryview(gzip.compress(data)[:-9])))
    with pytest.raises(ValueError):
        list(W.parsed(memoryview(data[:-10])))


def test_segments_of_other_records_are_passed_over(spark, tmp_path):
    """A resource in segments, one of them in another file, beside a page in segments and a whole one."""
    body = b"HTTP/1.1 200 OK\r\n\r\n" + b"p" * 50

    def record(kind, name, block, **more):
        fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>"} | {k.replace("_", "-"): v for k, v in more.items()}
        return W.header(fields | {"Content-Length": len(block)}) + block + b"\r\n\r\n"

    first = [
        record("resource", "r1", b"a" * 10, WARC_Segment_Number=1),
        record("response", "p1", body[:30], WARC_Segment_Number=1),
        record("continuation", "r1c", b"b" * 10, WARC_Segment_Origin_ID="<r1>", WARC_Segment_Number=2),
        record("resource", "r2", b"c" * 10),
    ]
    second = [
        record("continuation", "r1d", b"d", WARC_Segment_Origin_ID="<r1>", WARC_Segment_Number=3, WARC_Segment_Total_Length=21),
        record("continuation", "p1c", body[30:], WARC_Segment_Origin_ID="<p1>", WARC_Segment_Number=2, WARC_Segment_Total_Length=len(body)),
        record("response", "p2", body),
    ]
    for name, records in (("part-0", first), ("part-1", second)):
        (tmp_path / name).write_bytes(b"".join(records))
    got = W.read_warc(spark, f"file://{tmp_path}").collect()
    assert [(r.record_type, bytes(r.payload)) for r in got] == [("response", b"p" * 50)] * 2
    # a page's segment that is missing is still an error
    (tmp_path / "part-1").write_bytes(b"".join(second[::2]))
    with pytest.raises(Exception, match="segments of <p1>"):
        W.read_warc(spark, f"file://{tmp_path}").collect()


def test_large_archives_are_inflated_as_they_are_read():
    record = W.header({"WARC-Type": "response", "Content-Length": 50_000}) + b"z" * 50_000 + b"\r\n\r\n"
    packed = gzip.compress(record * 400)
    assert sum(len(b) for _, b in W.parsed(memoryview(packed))) == 400 * 50_000


def test_lost_segments_raise(spark):
    rows = []
    for body in W.records("1", "u", b"x" * 5000, None, "n", uuid.uuid4(), 1000):
        (f, block), = W.parsed(memoryview(body + b"\r\n\r\n"))
        number, total = int(f["warc-segment-number"]), f.get("warc-segment-total-length")
        rows.append((f["warc-record-id"], f.get("warc-segment-origin-id"), number, int(total) if total else None, f["warc-type"], "1", "u", None, f.get("warc-payload-digest"), 5000, block))
    assert W.reassembled(spark.createDataFrame(rows, W.RECORD)).count() == 1
    for bad in (rows[:-1], rows[1:], rows + [rows[1]], rows[:2] + rows[3:]):
        with pytest.raises(Exception, match="segments of"):
            W.reassembled(spark.createDataFrame(bad, W.RECORD)).collect()


def test_chunked_framing():
    for n in (0, 1, W.CHUNK, W.CHUNK + 1, 3 * W.CHUNK):
        assert W.unchunked(W.chunked(b"q" * n)) == b"q" * n
    assert W.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"


def test_empty_table(spark):
    assert W.archive(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
