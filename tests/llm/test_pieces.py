import hashlib
import struct
import uuid
import zlib

import public_tokenizers
import pytest
import sentencepiece
from conftest_data import FOLDER
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


@given(text=st.lists(st.sampled_from(
    ["  ", "   ", "a", "th", "ing", "e", "é", "😀", "日本", "\n", "\t", "\x00", "the", " the", " ", "ﬁ", "!!", "....", "===",
     " " * 9, "0", "aaaa", "s", "ss", "<s>", "<0x41>"]
), max_size=14).map("".join))
@settings(max_examples=500, deadline=None)
def test_equals_the_library_and_reads_back(library, text):
    own = pieces.pieces(pieces.MODEL)
    ids = own.encode(text)
    assert ids.tolist() == library.encode(text)
    assert own.decode(ids) == text


# A model of the unigram kind, put together by hand: scores in quarters, so that sums are exact.
SCORES = {
    "▁": -2, "a": -3, "b": -3.25, "c": -3.5, "▁a": -2.5, "ab": -4.5, "bc": -4.25, "abc": -6, "ca": -6.25, "aa": -5,
    "▁▁": -2.25, "▁▁▁": -4, "éx": -5, "cab": -7.5, "x": -4, "▁bca": -8, "bb": -6.5, "ca😀": -9,
}


def message(*fields) -> bytes:
    """A serialised message of (number, value) fields: whole numbers, 32-bit floats, or bytes."""
    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def made_model(folder, kind=pieces.UNIGRAM, scores=SCORES, octets=256, extra=(), remove_spaces=0, charsmap=b""):
    """The path of a hand-made model file."""
    special = [("<unk>", 2), ("<s>", 3), ("</s>", 3)]
    parts = [(p, 0.0, t) for p, t in special] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(octets)]
    parts += [(p, float(s), 1) for p, s in scores.items()] + list(extra)
    fields = [(1, message((1, p.encode()), (2, s), (3, t))) for p, s, t in parts]
    trainer = message((3, kind), (35, 1 if octets else 0))
    normalizer = message((1, b"identity"), (2, charsmap), (3, 1), (4, remove_spaces), (5, 1))
    path = f"{folder}/{uuid.uuid4().hex}.model"
    with open(path, "wb") as out:
        out.write(message(*fields, (2, trainer), (3, normalizer)))
    return path


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    path = made_model(tmp_path_factory.mktemp("models"))
    return pieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)


@given(text=st.text(alphabet="aabbccx é😀▁日", max_size=24))
@settings(max_examples=1500, deadline=None)
def test_best_sum_of_scores_equals_the_library(unigram, text):
    own, library = unigram
    ids = own.encode(text)
    assert ids.tolist() == library.encode(text)
    assert own.decode(ids) == text.replace(pieces.MARK, " ")


def test_scores_decide_and_not_merges(unigram):
    own, _ = unigram
    assert [own.text[i] for i in own.encode("abc")] == ["▁a", "bc"]
    assert [own.text[i] for i in own.encode("éx")] == ["▁", "éx"]
    long = "abc" * 100_000
    assert own.decode(own.encode(long)) == long


@pytest.mark.parametrize("changes", [
    {"kind": 3}, {"kind": 4}, {"octets": 0}, {"remove_spaces": 1}, {"charsmap": b"\x01\x00\x00\x00"},
    {"extra": [("zz", 0.0, 4)]}, {"scores": {**SCORES, "a▁b": -5}},
])
def test_models_that_are_not_followed_are_refused(tmp_path, changes):
    with pytest.raises((pieces.Unsuitable, RuntimeError)):
        pieces.Pieces(made_model(tmp_path, **changes))


def test_summary_is_of_the_ids(spark, library, documents, edge_rows):
    docs = documents(edge_rows)
    got = sorted(map(tuple, pieces.summarize(docs).select("n_pieces", "ids_crc32", "round_trip", "decoded_sha256").collect()))
    want = []
    for row in edge_rows:
        ids = library.encode(row[1] or "")
        text = (row[1] or "").replace(pieces.MARK, " ")
        crc = zlib.crc32(struct.pack(f"<{len(ids)}i", *ids))
        want.append((len(ids), crc, True, hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert pieces.summarize(documents([])).count() == 0


def test_pairs_follow_as_merging_says(library):
    """Against the definition: the two pieces stay apart when their joined text is encoded."""
    own = pieces.pieces(pieces.MODEL)
    ids = [i for i, p in enumerate(own.text) if p in own.id and own.left[i] >= 0][::97]
    for a in ids[:60]:
        for b in ids[-60:]:
            if own.text[b].startswith(pieces.MARK):
                continue
            text = own.text[a] + own.text[b]
            if text.startswith(pieces.MARK):
                whole = library.encode(text[1:].replace(pieces.MARK, " "))
                assert own.may_follow(a, b) == (whole == [a, b])


def test_given_documents(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: r.piece_ids for r in pieces.encode(docs).collect()}
    rows = docs.collect()
    assert got == {r.doc_id: library.encode(r.text or "") for r in rows}
    assert all(r.round_trip for r in pieces.summarize(docs).collect())


def test_edges(documents, edge_rows, spark):
    docs = documents(edge_rows)
    encoded = pieces.encode(docs)
    assert encoded.columns == [*docs.columns, "piece_ids"]
    read = pieces.decode(encoded).collect()
    assert sorted(r.decoded_text for r in read) == sorted(r[1] or "" for r in edge_rows)
    assert all(r.kept == "x" for r in read)
    assert pieces.encode(documents([])).count() == 0
    again = pieces.encode(encoded.withColumnRenamed("source", "decoded_text"))
    assert again.columns.count("piece_ids") == 1 and pieces.decode(again).columns.count("decoded_text") == 1
