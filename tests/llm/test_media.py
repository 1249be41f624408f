import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pixelloom.llm import media as M


def slow_feature(payload, width=192):
    """Mean, and which of 8 x 8 cells are lighter than it, by loops over exact fractions."""
    h = len(payload) // width
    mean, bits = Fraction(sum(payload), len(payload)), 0
    for a in range(8):
        for b in range(8):
            y0 = min(a * h // 8, h - 1)
            ys = range(y0, max((a + 1) * h // 8, y0 + 1))
            cell = [payload[y * width + x] for y in ys for x in range(b * width // 8, (b + 1) * width // 8)]
            bits = bits << 1 | (Fraction(sum(cell), len(cell)) > mean)
    return f"mean={float(mean):.4f};ahash={bits:016x}"


def test_every_text_comes_back(spark, docs):
    got = M.texts_as_media(docs).collect()
    rows = docs.collect()
    want, payloads = [], {}
    for r in rows:
        b = (r.text or "").encode()
        p = b + b" " * (-len(b) % 192 or (0 if b else 192))
        payloads[hashlib.sha256(p).hexdigest()] = p
        want.append(str((r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))))
    assert sorted(str((r.doc_id, r["size"], r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in got) == sorted(want)
    same = {}
    for r in got:
        assert same.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
        # the stored form and the feature, made again from the payload alone
        png = M.png_of(payloads[r.payload_sha256])
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        assert r.feature == slow_feature(payloads[r.payload_sha256])
        assert r.pos == 1 and r.caption == f"{r['size']} bytes in {r.payload_bytes // 192} rows"


def test_png_round_trip_and_damage():
    for n in (1, 2, 7, 40):
        data = bytes(np.random.default_rng(n).integers(0, 256, 192 * n, dtype=np.uint8))
        png = M.png_of(data)
        assert M.pixels_of(png).tobytes() == data
        bad = bytearray(png)
        bad[45] ^= 1
        with pytest.raises(ValueError):
            M.pixels_of(bytes(bad))
    flat = M.average_hash(np.full((1, 192), 32, np.uint8))
    assert flat == "0" * 16


def test_parts_keep_order_and_captions():
    d = "a" * 64
    html = f'<h1>One &amp; two</h1><p>text <b>bold</b></p><figure><img src="sha256:{d}" alt="x" data-bytes="5"><figcaption>cap <i>tion</i></figcaption></figure>tail<script>no</script><img src="other" alt="alone"><p>end'
    parts = M.parts_of(html)
    assert [(p["pos"], p["kind"], p["text"], p["digest"], p["caption"], p["size"]) for p in parts] == [
        (0, "text", "One & two", None, None, None), (1, "text", "text bold", None, None, None), (2, "media", None, d, "cap tion", 5),
        (3, "text", "tail", None, None, None), (4, "media", None, None, "alone", None), (5, "text", "end", None, None, None)]
    assert M.parts_of(None) == M.parts_of("") == M.parts_of("<p></p>") == []
    M.parts_of("<figure><figcaption>never closed</figure></figcaption></script><p>x")


def test_sequences_resolve_by_digest(spark):
    d, e = "a" * 64, "b" * 64
    pages = spark.createDataFrame([(1, f'<p>x</p><img src="sha256:{d}"><p>y</p><img src="sha256:{e}">'), (2, None), (3, "<p>t</p>"), (3, "<p>t</p>"), (None, f'<img src="sha256:{d}">')], "doc_id bigint, html string")
    media = spark.createDataFrame([(d, b"payload")], "digest string, payload binary")
    got = sorted((str(r.doc_id), [(p.pos, p.text, bytes(p.payload) if p.payload else None) for p in r.sequence]) for r in M.sequences(pages, media).collect())
    assert got == sorted([("1", [(0, "x", None), (1, None, b"payload"), (2, "y", None), (3, None, None)]), ("2", []), ("3", [(0, "t", None)]), ("3", [(0, "t", None)]), ("None", [(0, None, b"payload")])])


def test_media_columns_of_any_name_and_hot_digests(spark, monkeypatch):
    """Columns named like a part's own, a digest that most refer to, references without one, many media in a document."""
    monkeypatch.setattr("pixelloom.llm.common.LEAST_HOT", 5)
    d, e = "a" * 64, "b" * 64
    many = "".join(f'<p>t{k}</p><img src="sha256:{d if k % 2 else e}" alt="c{k}">' for k in range(40)) + '<img src="none">'
    pages = spark.createDataFrame([(k, f'<img src="sha256:{d}">') for k in range(50)] + [(100, many), (101, many)], "doc_id bigint, html string")
    media = spark.createDataFrame([(d, 1, "one", "x"), (e, 2, "two", "y")], "digest string, pos int, text string, row string")
    got = {r.doc_id: [p.asDict() for p in r.sequence] for r in M.sequences(pages, media).collect()}
    assert len(got) == 52 and got[100] == got[101] and [p["pos"] for p in got[100]] == list(range(81))
    for k, (t, m) in enumerate(zip(got[100][:80:2], got[100][1:80:2], strict=True)):
        assert (t["text"], t["media_pos"], t["row"]) == (f"t{k}", None, None)
        assert (m["caption"], m["media_pos"], m["media_text"], m["row"]) == (f"c{k}", *((1, "one", "x") if k % 2 else (2, "two", "y")))
    assert got[100][80]["media_pos"] is None and all(got[k][0]["media_text"] == "one" for k in range(50))


def test_empty_table(spark, no_docs):
    assert M.texts_as_media(no_docs).count() == 0
