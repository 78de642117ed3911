"""Quality classifier: boosted trees over statistics of the whole text.

One pass turns every text into `FEATURES` (kept in a small stored table), the labelled ones
train the trees on the driver, and the flattened trees score all rows in vectorised numpy.
Training sees at most `MAX_TRAINING` labelled rows, those with the smallest hash of their
identifier: the only bounded sample here. Labels, language, source and identifier never
enter a score. Rows whose crc32(doc_id as text) mod 3 is 1 are held out of training.

Defined results: null text counts as empty; an empty text gets the score of its (zero)
statistics like any other; without usable labels every score is 0.5 (and so kept); rows
with equal text get equal scores, repeated rows stay repeated; a null identifier counts as
the empty text for the split; null labels are not used; other columns pass through
`keep_good` unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import boosting
from touchline.llm.common import in_parts, stored

MAX_TRAINING = 40_000
ACCEPT = 0.5

#: Byte classes whose share of the text is a feature.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "newline": b"\n",
    "stop": b".,;:'\"()-",
    "shout": b"!?",
    "bar": b"|",
    "symbol": b"#*$%&<>@^~=+_/\\[]{}`",
    "high": bytes(range(128, 256)),
}
FEATURES = [
    *CLASSES, "log_chars", "log_words", "word_length", "longest_word", "distinct_words", "distinct_triples",
    "same_as_previous", "most_of_line", "repeated_lines", "short_words", "words_per_line",
]
_OF_BYTE = np.zeros((256, len(CLASSES)))
for _i, _members in enumerate(CLASSES.values()):
    _OF_BYTE[list(_members), _i] = 1


def statistics(text: bytes) -> list[float]:
    """The features of one text in UTF-8; zero where they have no meaning."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _OF_BYTE
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    size, n = max(len(text), 1), max(len(words), 1)
    lengths = [*map(len, words)] or [0]
    triples = max(len(words) - 2, 1)
    return [
        *(counts / size), math.log1p(len(text)), math.log1p(len(words)), sum(lengths) / n, min(max(lengths), 1000),
        len(set(words)) / n, len(set(zip(words, words[1:], words[2:]))) / triples,
        sum(map(eq, words, words[1:])) / n, max(map(len, lines), default=0) / size,
        1 - len(set(lines)) / max(len(lines), 1), sum(x <= 3 for x in lengths) / n, n / max(len(lines), 1),
    ]


def _matrix(texts: pa.Array) -> np.ndarray:
    rows = [statistics(value or b"") for value in texts.cast(pa.binary()).to_pylist()]
    return np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and `features` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            flat = pa.array(_matrix(batch.column("text")).astype(np.float32).ravel())
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, features array<float>"
    )


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def train(measured: DataFrame, labels: DataFrame, trees: int = 100, depth: int = 4) -> boosting.Trees:
    """Learn `labels.quality` from the rows that are not held out."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    sample = (
        measured.join(known.where(~held_out(F.col("doc_id"))), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(MAX_TRAINING)
        .select("features", "quality")
        .toArrow()
    )
    rows = np.array(sample.column("features").to_pylist(), dtype=np.float32).reshape(-1, len(FEATURES))
    return boosting.train(rows, sample.column("quality").to_numpy().astype(np.float64), trees, depth)


def score(measured: DataFrame, model: boosting.Trees) -> DataFrame:
    """Per row of `measured`: doc_id, held_out, score, predicted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            rows = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.probability(rows))], ["doc_id", "score"]
            )

    scored = measured.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"),
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    measured = stored(measure(docs), "text-statistics")
    return score(measured, train(measured, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier accepts, all their columns as they were.

    Texts are read twice, to learn and to filter; they are never shuffled.
    """
    model = train(stored(measure(docs), "text-statistics"), labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            accepted = model.probability(_matrix(batch.column(at)).astype(np.float32)) >= ACCEPT
            yield batch.filter(pa.array(accepted))

    return docs.mapInArrow(run, docs.schema)
