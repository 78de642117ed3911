import random
import zlib

import numpy as np
import pytest
from conftest_data import FOLDER
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import rans, token_files


@pytest.mark.parametrize("n, symbols", [(0, 5), (1, 1), (300, 1), (5000, 60_000), (300_000, 40)])
def test_round_trip_of_ids(n, symbols):
    ids = np.random.default_rng(n).zipf(1.3, n) % symbols
    segment = rans.Segment.parse(rans.encode([3, None], [n, 0], ids))
    assert segment.doc_ids == [3, None] and segment.lengths.tolist() == [n, 0]
    assert (segment.ids() == ids).all()


def test_blocks_decode_alone_and_from_checkpoints():
    ids = np.random.default_rng(1).integers(0, 900, 2 * rans.BLOCK + 77_777)
    segment = rans.Segment.parse(rans.encode([1], [len(ids)], ids))
    assert (segment.ids([1]) == ids[rans.BLOCK:2 * rans.BLOCK]).all()
    assert (segment.ids([2, 0])[:77_777] == ids[2 * rans.BLOCK:]).all()
    skip = rans.CHECKPOINT * rans.LANES
    assert (segment.ids([0], checkpoint=1) == ids[skip:rans.BLOCK]).all()


def test_compresses_close_to_the_entropy():
    ids = np.random.default_rng(2).zipf(1.5, 500_000) % 5000
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8
    assert len(rans.encode([1], [len(ids)], ids)) < 1.1 * entropy + 10_000


def test_damage_is_noticed():
    payload = bytearray(rans.encode([1], [50_000], np.arange(50_000) % 700))
    payload[-9] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.Segment.parse(bytes(payload)).ids()
    payload[30] ^= 1
    with pytest.raises(ValueError):
        rans.Segment.parse(bytes(payload))


@given(st.lists(st.sampled_from(
    ["'s", "'re", "'", "<|endoftext|>", "<|", "é", "E\u0301", "ß", " ", "\u00a0", "İ", "\x1c", "😀", "日本", "Σς", "ª", "²",
     "\x85", "\n", "A", "bc", "9", "--", "_", "\x00", "¿", "×", "word"]
), max_size=12))
@settings(max_examples=300, deadline=None)
def test_pieces_equal_the_whole_text(parts):
    encoder = token_files.encoder(token_files.TOKENIZER)
    text = "".join(parts)
    assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def check(spark, docs, monkeypatch=None):
    tokenizer = token_files.encoder(token_files.TOKENIZER).tokenizer
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted(token_files.round_trip(docs).collect(), key=lambda r: r.start)
    start = 0
    for (doc_id, text), r in zip(rows, got, strict=True):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_equals_the_library_on_the_given_documents(spark):
    check(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_edges_and_any_order(spark, documents, edge_rows):
    random.Random(5).shuffle(edge_rows)
    check(spark, documents(edge_rows).repartition(3))
    assert token_files.round_trip(documents([])).count() == 0


def test_written_files_read_back(spark, documents, folder):
    docs = documents([(i, f"text number {i}") for i in range(100)])
    token_files.write(docs, f"{folder}/ids")
    read = token_files.read_index(spark.read.parquet(f"{folder}/ids"))
    assert read.agg({"n_tokens": "sum"}).first()[0] == token_files.round_trip(docs).agg({"n_tokens": "sum"}).first()[0]
