import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pixelloom.llm import token_records as R

FILE = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = [
    "", " ", "  ", "\n", "a", " a", "a ", "a\n", "\na", "a  b", "a   b", "a \n b", "a\n\nb", "a\tb", "a\xa0b", "a\xa0 b", "don't stop's 've", "x²y Ⅷ", "naïve. Élan, ñ!",
    "12 34.5 a1 1a", "<|endoftext|>", "a <|endoftext|> b", "日本語 text ok", "🙂 smile 🙂", "A.B c..d e,", "_under_ score", "ÿ ª º µ", "word\u200bword b", "Ünï\nCöde. Ok\nyes", "a." * 50,
]


def test_encoder_agrees_with_the_library(spark):
    library, own = Tokenizer.from_file(FILE), R.Encoder(FILE)
    texts = TRICKY + [" ".join(TRICKY), "\n".join(TRICKY)] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert own.by_piece


def test_drawn_texts_agree_with_the_library():
    """Words of letters, digits, marks and what no piece is known of, drawn at random, with few pieces remembered."""
    library, own, rng = Tokenizer.from_file(FILE), R.Encoder(FILE), np.random.default_rng(10)
    signs = ["a", "the", "S", "é", "ß", "ɏ", "ɐ", "µ", "×", "²", "٣", "日", "'s", "'", "'LL", "'ve", "’", "-", "_", "|", "12", "0", ".", ",", "?!", ":", "<", "\x7f", "\x00", "\u0301", "🙂", "\n", "\n'd"]
    for _ in range(400):
        words = ["".join(rng.choice(signs, rng.integers(1, 5))) for _ in range(rng.integers(1, 30))]
        text = " ".join(words)
        assert np.frombuffer(own.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_all_white_space_but_spaces_and_newlines_is_odd():
    assert {chr(k) for k in range(0x110000) if chr(k).isspace()} == set(R.ODD_SPACES) | {" ", "\n"}


def test_pieces_in_use_are_made_once(monkeypatch):
    """New words push out words that aren't used, and of a new word with a mark only the word takes room."""
    monkeypatch.setattr(R, "CACHE", 50)
    own, made = R.Encoder(FILE), []
    make = own.known.make
    own.known.make = lambda piece: made.append(piece) or make(piece)
    for k in range(100):
        new = "".join(chr(97 + int(d)) for d in str(k))
        for text in (f"x often, used é! q{new}w z{new}. v{new}é? q{new}w. often",):
            own.encode(text)
        assert len(own.known) <= 60 and len(own.known.older) <= 60
    assert len(made) == len(set(made)) == 3 + 3 * 100
    assert not any(piece[-1] in ".,!?" for piece in made)


def test_texts_that_are_encoded_together_share_their_pieces(monkeypatch):
    """A piece is looked up once however often the texts have it, and any turns between leave the ids right."""
    library, own, asked = Tokenizer.from_file(FILE), R.Encoder(FILE), []

    class Watched(R.Pieces):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    own.known = Watched(own.known.make, own.known.marks)
    texts = [*TRICKY, *["again, some words and more\nand again"] * 50, *[f"Zq{k}x v{'a' * k}é, {k}." for k in range(40)], *TRICKY]

    def agree():
        got = own.encode_all(texts)
        assert [np.frombuffer(ids, "<u2").tolist() for ids in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]

    agree()
    assert {piece: asked.count(piece) for piece in ("some", "words", "more", "again")} == dict.fromkeys(("some", "words", "more", "again"), 1)
    monkeypatch.setattr(R, "CACHE", 9)
    monkeypatch.setattr(R, "TURN_BY", 2)
    agree()
    assert len(own.known) < 20
    assert own.encode_all([]) == [] and own.encode_all(["", "word"]) == [b"", own.whole("word")]


def test_frames_round_trip_and_show_damage():
    payloads = [b"", b"\n", b"abc\n\n", bytes(range(256)) * 3]
    data = b"".join(R.framed(p) + b"\n" for p in payloads)
    assert [bytes(p) for _, p in R.unframed(memoryview(data))] == payloads
    for at in (0, 9, 30, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(R.unframed(memoryview(bytes(bad))))


def test_index_of_all_documents(spark, docs, tmp_path):
    library = Tokenizer.from_file(FILE)
    got = R.token_records(docs, FILE, f"file://{tmp_path}/out").collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [r.doc_id for r in rows]
    assert sorted(r.start for r in got) == np.concatenate(([0], np.cumsum([r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1])).tolist()
    want = {}
    for r in rows:
        want.setdefault(r.doc_id, []).append(library.encode(r.text or "", add_special_tokens=False).ids + [0])
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    per_document = sorted(str((d, len(ids), crc(ids))) for d, each in want.items() for ids in each)
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == per_document
    # starts are the same however few files a run has
    again = R.with_starts(spark.read.parquet(f"file://{tmp_path}/out/index"), run=1)
    assert sorted(str((r.file, r.offset, r.start)) for r in again.collect()) == sorted(str((r.file, r.offset, r.start)) for r in got)
    orders = [[(r.file, r.offset, r.doc_id, tuple(r.ids)) for r in R.read_shuffled(spark, f"file://{tmp_path}/out", seed).collect()] for seed in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2] and sorted(map(str, orders[0])) == sorted(map(str, orders[2]))
    assert sorted(str((d, ids)) for _, _, d, ids in orders[0]) == sorted(str((d, tuple(ids))) for d, each in want.items() for ids in each)
    assert {(f, o) for f, o, _, _ in orders[0]} == {(r.file, r.offset) for r in got}


def test_files_that_ask_for_more_go_to_the_library_whole(tmp_path):
    for change in ({"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"normalizer": {"type": "Lowercase"}}):
        told = json.load(open(FILE)) | change
        (tmp_path / "t.json").write_text(json.dumps(told))
        own = R.Encoder(str(tmp_path / "t.json"))
        assert not own.by_piece
        assert np.frombuffer(own.encode("Some words and more"), "<u2").tolist() == Tokenizer.from_file(str(tmp_path / "t.json")).encode("Some words and more", add_special_tokens=False).ids


def test_rows_that_agree_spread_over_files(spark):
    docs = spark.range(4000).selectExpr("7L as doc_id", "'the same text' as text")
    files = {r.file: r["count"] for r in R.token_records(docs, FILE).groupBy("file").count().collect()}
    assert len(files) > 1 and max(files.values()) < 2500


def test_empty_table(spark, no_docs):
    assert R.token_records(no_docs, FILE).count() == 0
