"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton over the model's pieces reads a word once; at each position its output links
name all pieces that end there, and each relaxes the best segmentation of the text up to
that position: Viterbi in one pass.

- Models of the unigram kind: the best sum of scores. Of equal sums the one with the longer
  last piece stays, as in the model's library (which adds 32-bit floats along the whole text,
  so that sums closer than seven digits may fall differently there). A character that no piece
  of its own covers may stand alone, for the lowest score less 10.
- Models of the byte-pair kind, as the given one: scores only order merges, and the
  segmentation with the best sum is not the one the model means. So a piece may follow another
  only if merging would leave the two apart (score 0, otherwise minus infinity); then exactly
  one segmentation of each prefix survives, and it is the model's own. Pieces that merging
  never makes are left out.

Models of other kinds, without pieces for all bytes, with user-defined pieces, that change or
shorten the text first, or with marks elsewhere than in front, are refused by `Unsuitable`.

A space becomes the mark U+2581, one is put in front, and pieces have marks only at their
start, so words with their leading marks are independent; recent ones are remembered.
Characters without a piece are encoded as bytes. A worker's memory is bounded by `MAX_WORDS` and
`MAX_PAIRS`. Decoding gives the text back, except that
a mark in the text itself returns as a space, as in the model's own library.

Defined results: null text counts as empty and has no pieces; rows are encoded one by one,
repeated or not; words of any length are encoded in linear time and only short ones are
remembered; other columns pass through `encode` and `decode` unchanged, but for a column
named like the result, which is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from touchline.llm.common import whole_text

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words and pairs of pieces a worker remembers, and the longest remembered word.
MAX_WORDS, MAX_PAIRS, LONGEST = 125_000, 250_000, 40
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_UNSPLIT = -1
# Fixed by the model format: kinds of models, numbers of its fields, what an unknown character costs.
UNIGRAM, BPE = 1, 2
TRAINER, NORMALIZER, PIECE = 2, 3, 1
MODEL_TYPE, SUFFIX_MARKS = 3, 24
CHARSMAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
PIECE_TYPE, USER_DEFINED = 3, 4
UNKNOWN_COST = 10.0
# End of fixed values.


class Unsuitable(ValueError):
    """A model that would not be followed exactly."""


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            octet = message[at]
            at += 1
            value |= (octet & 127) << shift
            shift += 7
            if octet < 128:
                return value

    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, message[at:at + size]
        at += size


def _kind(model: sentencepiece.SentencePieceProcessor) -> int:
    """UNIGRAM or BPE; `Unsuitable` for what is not followed here."""
    trainer, normalizer = {}, {}
    for number, value in _fields(model.serialized_model_proto()):
        if number == TRAINER:
            trainer = dict(_fields(value))
        elif number == NORMALIZER:
            normalizer = dict(_fields(value))
        elif number == PIECE and dict(_fields(value)).get(PIECE_TYPE) == USER_DEFINED:
            raise Unsuitable("user-defined pieces")
    kind = trainer.get(MODEL_TYPE, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise Unsuitable(f"model type {kind}")
    if normalizer.get(CHARSMAP) or normalizer.get(REMOVE_SPACES, 1):
        raise Unsuitable("the text is changed before it is cut")
    if trainer.get(SUFFIX_MARKS, 0) or not normalizer.get(DUMMY_PREFIX, 1) or not normalizer.get(ESCAPE_SPACES, 1):
        raise Unsuitable("spaces are not marked in front of words")
    return kind


class Pieces:
    """A model's pieces, their automaton, and which may follow each other."""

    def __init__(self, name: str):
        path = public_tokenizers.path(name) if "/" not in name else name
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = _kind(model)
        n = model.get_piece_size()
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        special = {i for i in range(n) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.id = {p: i for i, p in enumerate(self.text) if i not in special}
        if len(self.bytes) < 256:
            raise Unsuitable("bytes without a piece")
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise Unsuitable("a piece with a mark inside")
        # Single characters come before all merges; merges come in the order of their scores.
        merged = sorted((i for p, i in self.id.items() if len(p) > 1), key=lambda i: -model.get_score(i))
        self.rank = [0] * n
        for place, i in enumerate(merged):
            self.rank[i] = place + 1
        self.left, self.right = [_UNSPLIT] * n, [_UNSPLIT] * n
        self.join: dict[tuple[int, int], int] = {}
        for p, i in self.id.items():
            for cut in range(1, len(p)):
                a, b = self.id.get(p[:cut]), self.id.get(p[cut:])
                if a is not None and b is not None:
                    self.join[a, b] = i
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self.kind == UNIGRAM or len(p) == 1 or self._made_by_merging(p, i):
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.alphabet = {p for p in self.id if len(p) == 1}
        self.score = [model.get_score(i) for i in range(n)]
        self.unknown = min((self.score[i] for i in self.id.values()), default=0.0) - UNKNOWN_COST
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _made_by_merging(self, piece: str, i: int) -> bool:
        """Merge a piece's characters step by step; notes its last merge. False if it ends elsewhere."""
        if any(c not in self.id for c in piece):
            return False
        parts = [self.id[c] for c in piece]
        while len(parts) > 1:
            options = [
                (self.rank[j], at) for at, pair in enumerate(zip(parts, parts[1:])) if (j := self.join.get(pair)) is not None
            ]
            if not options:
                return False
            _, at = min(options)
            last = parts[at], parts[at + 1]
            parts[at:at + 2] = [self.join[last]]
        if parts == [i]:
            self.left[i], self.right[i] = last
            return True
        return False

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b leaves these two pieces.

        Their merges are undone from the latest to the earliest. Whenever the pieces that then
        meet at the border could merge earlier than what was undone last, merging would have
        crossed the border. Of equal merges the left one comes first.
        """
        x, y, bound, rank = a, b, float("inf"), self.rank
        answer = True
        while True:
            across = self.join.get((x, y))
            if across is not None and rank[across] < bound:
                answer = False
                break
            if rank[x] > rank[y]:
                bound, x = rank[x], self.right[x]
            elif rank[y]:
                bound, y = rank[y] + 0.5, self.left[y]
            else:
                break
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = answer
        return answer

    def _run(self, text: str) -> list[int]:
        """The ids of a text all of whose characters are pieces."""
        last, known = [_UNSPLIT] * len(text), self.pairs.get
        for end, (piece, size) in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            if size <= end:
                before = last[end - size]
                if before < 0:
                    continue
                follows = known((before, piece))
                if follows is None:
                    follows = self.may_follow(before, piece)
                if not follows:
                    continue
            last[end] = piece
        ids, at = [], len(text) - 1
        while at >= 0:
            ids.append(last[at])
            at -= len(self.text[last[at]])
        ids.reverse()
        return ids

    def _best(self, text: str) -> list[int]:
        """The ids with the best sum of scores; lone unknown characters as bytes."""
        best, last = array("d", [-np.inf]) * len(text), array("i", [_UNSPLIT]) * len(text)
        score, alphabet, settled = self.score, self.alphabet, 0

        def settle(upto: int) -> int:
            # An unknown character is the shortest piece and comes after all others that end there.
            for end in range(settled, upto):
                alone = (best[end - 1] if end else 0.0) + self.unknown
                if text[end] not in alphabet and alone > best[end]:
                    best[end], last[end] = alone, _UNSPLIT
            return upto

        # The pieces that end at a position come longest first, so ties stay with the longest.
        for end, (piece, size) in self.automaton.iter(text):
            if settled < end:
                settled = settle(end)
            total = (best[end - size] if size <= end else 0.0) + score[piece]
            if total > best[end]:
                best[end], last[end] = total, piece
        settle(len(text))
        ids, at = [], len(text) - 1
        while at >= 0:
            if last[at] == _UNSPLIT:
                ids += [self.bytes[b] for b in reversed(text[at].encode())]
                at -= 1
            else:
                ids.append(last[at])
                at -= len(self.text[last[at]])
        ids.reverse()
        return ids

    def _word(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            if self.kind == UNIGRAM:
                ids = self._best(word)
            elif self.alphabet.issuperset(word):
                ids = self._run(word)
            else:
                ids, known = [], ""
                for c in word:
                    if c in self.alphabet:
                        known += c
                        continue
                    ids += (self._run(known) if known else []) + [self.bytes[b] for b in c.encode()]
                    known = ""
                ids += self._run(known) if known else []
            found = array("i", ids).tobytes()
        if len(word) <= LONGEST:
            if len(self.words) >= MAX_WORDS:
                self.words, self.older = {}, self.words
            self.words[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        known = self.words.get
        words = _WORDS.findall(MARK + text.replace(" ", MARK))
        return np.frombuffer(b"".join([known(w) or self._word(w) for w in words]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the mark put in front is taken away again."""
        raw = b"".join(map(self._octets().__getitem__, ids.tolist()))
        text = raw.decode(errors="replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    @lru_cache(maxsize=1)
    def _octets(self) -> list[bytes]:
        octets = [p.encode() for p in self.text]
        for byte, i in self.bytes.items():
            octets[i] = bytes([byte])
        return octets


@lru_cache(maxsize=2)
def pieces(name: str) -> Pieces:
    return Pieces(name)


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(i) for i in kept), values], [*(batch.schema.names[i] for i in kept), name]
    )


def _schema(df: DataFrame, name: str, kind) -> StructType:
    return StructType([f for f in df.schema.fields if f.name != name] + [StructField(name, kind)])


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """`docs` with `piece_ids`, the ids of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = pieces(model).encode
        for batch in batches:
            ids = [work(text.as_py() or "") for text in batch.column(batch.schema.names.index("text"))]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *ids])
            yield _replaced(batch, "piece_ids", pa.ListArray.from_arrays(offsets, flat))

    return docs.mapInArrow(run, _schema(docs, "piece_ids", ArrayType(IntegerType())))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """`encoded` with `decoded_text`, read from `piece_ids` alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = pieces(model).decode
        for batch in batches:
            column = batch.column(batch.schema.names.index("piece_ids"))
            texts = [work(ids.values.to_numpy()) if ids.is_valid else "" for ids in column]
            yield _replaced(batch, "decoded_text", pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, _schema(encoded, "decoded_text", StringType()))


def summarize(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row: doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), and
    whether decoding gave the text back, with the SHA-256 of what it gave.

    A batch is encoded and its ids are decoded by the same worker, so one model is in memory
    per task; texts go out again only as their digest.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            sizes, sums, same, digests = [], [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                ids = own.encode(text).astype("<i4", copy=False)
                read = own.decode(ids)
                sizes.append(len(ids))
                sums.append(zlib.crc32(ids))
                same.append(read == text.replace(MARK, " "))
                digests.append(hashlib.sha256(read.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_()),
                 pa.array(digests, pa.string())],
                ["doc_id", "n_pieces", "ids_crc32", "round_trip", "decoded_sha256"],
            )

    rows = docs.select("doc_id", whole_text().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_pieces long, ids_crc32 long, round_trip boolean, decoded_sha256 string"
    )
