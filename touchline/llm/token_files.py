"""Token ids of whole texts in binary segment files, and back.

Rows are dealt by ranges of doc_id and sorted inside each range; a task encodes its range
document after document, appends the end id, and closes a segment (see `rans`) whenever it
holds `SEGMENT` ids, so a task keeps one segment in memory. Segments are rows of a Parquet
folder, numbered by range and place, written through Spark's commit protocol: a lost or
repeated task leaves no half a file. Positions of documents in the whole corpus come from
the segments' lengths, summed per range first.

Texts are cut as the tokenizer cuts them, and each distinct piece is encoded by its model once
per worker while it is remembered; what is out of the ordinary goes to the tokenizer whole.
The result equals encoding the whole text, because the tokenizer never joins across pieces.

Defined results: null text counts as empty and becomes the end id alone; rows with equal
doc_id go by text; a null doc_id comes first; repeated rows are repeated documents; an
empty table gives no segments and an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm import rans
from touchline.llm.common import stored

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SEGMENT = 1 << 20
#: Pieces a worker remembers, in the newer of two generations, and the longest remembered.
MAX_PIECES, LONGEST = 350_000, 48

SEGMENTS = "part int, segment int, n_docs long, n_tokens long, payload binary"

#: Texts made of these characters alone are cut into pieces here; of other texts, only the
#: words made of them are, and the rest go to the tokenizer whole.
_PLAIN = re.compile("[ -~\t-\rÀ-ÿ]*")
#: Fixed: the tokenizer's own pattern, for lower-case text of those characters.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ \t-\r]+")


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow at 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Recent(dict):
    """What was worked out lately: when `most` entries are held, those not used since the last
    time are forgotten."""

    def __init__(self, work: Callable, most: int):
        self.work, self.most, self.older = work, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.work(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Ids of texts in UTF-8, piece by piece."""

    def __init__(self, name: str):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name) if "/" not in name else name)
        self.tokenize = self.tokenizer.model.tokenize
        self.alphabet = _byte_alphabet()
        self.pieces = Recent(self._piece, MAX_PIECES)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.tokenize(piece)]).tobytes()

    def _bytes(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))
        words = text.encode().split()
        if len(words) > 1:
            return b"".join([self._bytes(word.decode()) for word in words])
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self._bytes(text), dtype="<u4")


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def _encode_stream(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        end = np.array([END_ID], dtype="<u4")
        encode = encoder(name).encode
        doc_ids, lengths, pieces, held, segment = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            payload = rans.encode(doc_ids, lengths, np.concatenate(pieces))
            row = [[part], [segment], [len(doc_ids)], [held], [payload]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types)], ["part", "segment", "n_docs", "n_tokens", "payload"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py() or "")
                doc_ids.append(doc_id)
                lengths.append(len(ids) + 1)
                pieces += [ids, end]
                held += len(ids) + 1
                if held >= SEGMENT:
                    yield close()
                    doc_ids, lengths, pieces, held, segment = [], [], [], 0, segment + 1
        if doc_ids:
            yield close()

    return run


def segments(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The segments of `docs` in ascending doc_id: part, segment, n_docs, n_tokens, payload."""
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_encode_stream(tokenizer), SEGMENTS)
    )


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> None:
    """Segment files in folder `path`; they are dense already."""
    segments(docs, tokenizer).write.option("compression", "none").parquet(path)


def _decode_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, segment, payload in zip(
            batch.column("part").to_pylist(), batch.column("segment").to_pylist(), batch.column("payload")
        ):
            parsed = rans.Segment.parse(payload.as_buffer())
            ids = parsed.ids().astype("<u4")
            ends = np.cumsum(parsed.lengths)
            starts = ends - parsed.lengths
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * n, pa.int32()), pa.array([segment] * n, pa.int32()),
                    pa.array(parsed.doc_ids, pa.int64()), pa.array(starts, pa.int64()),
                    pa.array(parsed.lengths, pa.int64()), pa.array(crc, pa.int64()),
                ],
                ["part", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"],
            )


def read_index(files: DataFrame) -> DataFrame:
    """Per document, decoded from the segments: doc_id, start, n_tokens, ids_crc32."""
    lengths = files.select("part", "segment", "n_tokens")
    in_part = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range of doc_id: as many as there were tasks.
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = lengths.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select(
        "part", F.coalesce(F.sum("n_tokens").over(over_parts), F.lit(0)).alias("part_start")
    )
    starts = lengths.select(
        "part", "segment", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0)).alias("segment_start")
    ).join(parts, "part")
    decoded = files.select("part", "segment", "payload").mapInArrow(
        _decode_stream, "part int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long"
    )
    return decoded.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("part_start") + F.col("segment_start") + F.col("offset")).alias("start"),
        "n_tokens", "ids_crc32",
    )


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    return read_index(stored(segments(docs, tokenizer), "token-files", compression="none"))
